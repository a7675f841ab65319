"""Block-level view of one HTML page: which text stands where in its element tree."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from xxhash import xxh64_intdigest

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option "
    "p pre search section select summary table tbody td template tfoot th thead title tr ul iframe object svg textarea button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: A start tag of the key ends an open element of the value, up to the element that holds them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "optgroup": ("select",)}
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - {"button", "object", "svg", "iframe", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

#: Elements, and names in class, id or role, that mark what is not the article.
NOISE_TAGS = frozenset("head title nav footer aside form script style noscript template iframe svg select button textarea object canvas dialog menu search option".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar aside widget ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login register share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus pagination pager toolbar copyright disclaimer legal skip search form contentinfo complementary".split()
)
#: Parts that a name may hold beside such words and be one of them: post-comments, sidebar-inner.
PLAIN_WORDS = frozenset(
    "post page site main article entry content blog global primary secondary top bottom left right wrapper wrap container inner outer "
    "box bar block section list item items link links button buttons icons area region".split()
)
#: What marks an outer article or main element as none, and what an inner article element does not end.
COMMENT_WORDS = frozenset("comment comments reply replies related recommended sponsored".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article main".split())
HEADER_WORDS = frozenset(("header",))

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
#: Open elements beyond which inline ones, and all, only pass their text on.
MOST_INLINE, MOST_DEPTH = 40, 1000


#: Why text is noise: not at all, by names that an inner article ends, by names it doesn't end, by an element's tag.
NONE, NAMED, HELD, TAGGED = range(4)


class Element(NamedTuple):
    tag: str
    name: str  # tag, class and id without digits
    path: int
    noise: int
    article: bool
    marked: int = 0  # path of the outermost element that only its names mark as noise


class Block(NamedTuple):
    path: int
    parent: int
    noise: int
    article: bool
    text: str
    marked: int = 0


def _hash(text: str, seed: int = 0) -> int:
    value = xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def _names_any(names: list[str], words: frozenset[str]) -> bool:
    """Whether one of the names is made of these words: one at least, and else plain ones only."""
    for name in names:
        parts = PARTS.findall(name)
        if not words.isdisjoint(parts) and all(p in words or p in PLAIN_WORDS or len(p) == 1 for p in parts):
            return True
    return False


def _element(tag: str, rest: str, above: Element | None) -> Element:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    names = [n for value in found.values() for n in value.lower().split()]
    name = DIGITS.sub("", ".".join([tag, *(found[k].lower() for k in ("class", "id") if k in found)]))
    path = _hash(name, above.path if above else 0)
    inside = above is not None and above.article
    over, marked = (above.noise, above.marked) if above else (NONE, 0)
    if tag in ARTICLE_TAGS and over == NAMED:
        over, marked = NONE, 0
    own = NONE
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        own = TAGGED
    elif tag not in ("html", "body"):
        if _names_any(names, COMMENT_WORDS):
            own = HELD
        elif (tag not in ARTICLE_TAGS or inside) and (_names_any(names, NOISE_WORDS) or (not inside and _names_any(names, HEADER_WORDS))):
            own = NAMED
    article = inside or tag in ARTICLE_TAGS or (tag in ("div", "section", "td") and not own and not ARTICLE_WORDS.isdisjoint(names))
    return Element(tag, name, path, max(own, over), article, marked or (path if own in (NAMED, HELD) else 0))


def blocks(html: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """(blocks of text in page order, (path, style) of each element).

    Character references are decoded and white space is folded. An element's
    style is the run of its children's names, neighbours of one name counted once.
    """
    root = Element("", "", 0, NONE, False)
    stack, children = [root], [[]]
    out: list[Block] = []
    styles: list[tuple[int, int]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                on = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
                above = stack[-2].path if len(stack) > 1 else 0
                out.append(Block(on.path, above, stack[-1].noise, stack[-1].article, text, stack[-1].marked))

    def pop() -> None:
        e, inner = stack.pop(), children.pop()
        if e.tag in BLOCKS:
            styles.append((e.path, _hash(" ".join(inner))))

    def close(tags: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        """End the nearest open element of these tags, and all inside it, unless one of ``until`` is nearer."""
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in tags:
                while len(stack) > at:
                    pop()
                return
            if stack[at].tag in until:
                return

    at, end = 0, len(html)
    while at < end:
        found = TOKEN.match(html, at)
        at = found.end()
        if found["text"] is not None:
            held.append(found["text"])
            continue
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        rest = found["rest"] if found["tag"] else found["rest2"]
        if found["end"] or found["end2"]:
            if tag in BLOCKS:
                flush()
            close((tag,), () if tag in BLOCKS else ("td", "th", "caption", "table"))
            continue
        if tag == "br" or tag == "hr":
            held.append(" ")
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                close(("p",), ("button", "td", "th", "table", "object"))
            while tag in CLOSES and any(e.tag in CLOSES[tag] for e in stack[_holder(stack, HOLDS[tag]):]):
                close(CLOSES[tag], HOLDS[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else end  # all of these are noise
            continue
        if rest.endswith("/") and tag not in BLOCKS:
            continue
        if len(stack) < (MOST_DEPTH if tag in BLOCKS else MOST_INLINE):
            new = _element(tag, rest, stack[-1]) if tag in BLOCKS else stack[-1]._replace(tag=tag)
            if tag in BLOCKS:
                around = next(c for e, c in zip(reversed(stack), reversed(children)) if e.tag in BLOCKS or e is root)
                if around[-1:] != [new.name]:
                    around.append(new.name)
            stack.append(new)
            children.append([])
    flush()
    while len(stack) > 1:
        pop()
    return out, styles


def _holder(stack: list[Element], tags: tuple[str, ...]) -> int:
    """Place of what stands right inside the nearest open element of ``tags``."""
    return next((at + 1 for at in range(len(stack) - 1, 0, -1) if stack[at].tag in tags), 1)
