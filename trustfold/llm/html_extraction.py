"""Main text of web pages, by a style tree of each site.

The element trees of all pages of a host are merged: a node is a path of
element names with class and id, and holds how often each presentation (the
names of its children) and each content (a block's text) occurs. Its
importance is taken from entropies to the base of the number of pages: a node
that is presented alike everywhere, and a text that stands on most pages, are
low; a text of one page is high. Texts whose importance at their node is low go
from each page. Pages whose unmarked texts are all alike count once, so copies of one
article under many addresses don't make its text look like a template's.

All pages run through the tree. Elements that name their purpose weigh in:
inside ``article`` or ``main`` a fifth of the importance is given, so that a
text there goes only if it stands on most pages; menus, footers, forms and the
like are left out, and so are elements with classes such as ``sidebar``, unless
they hold most of the text of the host's pages that have them, and these pages
little or no article: then the tree decides on what they hold. A host of fewer than three pages has no tree: there
an article that holds at least half of a page's text is taken alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable
from trustfold.llm.html_blocks import TAGGED, _hash, blocks

#: Weight of a block's content against the presentation of the element that holds it.
CONTENT_WEIGHT = 0.9
LEAST_IMPORTANCE = 0.3
#: Weight of an article element's mark against what the tree says.
ARTICLE_WEIGHT = 0.2
#: Times the text of a page's articles that a class-marked element holds at least, if the class may be wrong.
MOST_ARTICLE = 10
#: Bytes of a row that lists the blocks left out of a page.
OUT_BYTES = 300
#: Different pages a host needs before its tree says anything.
LEAST_PAGES = 3

_BLOCK = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("mark", pa.int8()), ("marked", pa.int64()), ("hash", pa.int64()), ("text", pa.string())])
_SHARE = pa.struct([("marked", pa.int64()), ("part", pa.int64()), ("whole", pa.int64())])
_STYLE = pa.struct([("path", pa.int64()), ("style", pa.int64())])
PARSED = (
    "page_id long, url string, host string, signature long, lead boolean, "
    "blocks array<struct<path: long, parent: long, mark: byte, marked: long, hash: long, text: string>>, styles array<struct<path: long, style: long>>, "
    "shares array<struct<marked: long, part: long, whole: long>>"
)
#: What an element's name says of a block: noise by class words, nothing, the article.
NAMED, OPEN, ARTICLE = -1, 0, 1


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removesuffix(".")
    except ValueError:
        return ""


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page: host, hash of its texts, whether its articles hold half of them, its blocks, the styles of its elements, and how much each class-marked element holds.

    Blocks in elements whose tag marks them as noise are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                urls = part.column(1).to_pylist()
                held, styles, shares, signatures, leads = [], [], [], [], []
                for html in part.column(2).to_pylist():
                    found, kinds = blocks(html or "")
                    found = [b for b in found if b.noise != TAGGED]
                    held.append([
                        {"path": b.path, "parent": b.parent, "mark": NAMED if b.noise else ARTICLE if b.article else OPEN, "marked": b.marked, "hash": _hash(b.text), "text": b.text}
                        for b in found
                    ])
                    styles.append([{"path": p, "style": s} for p, s in sorted(set(kinds))])
                    plain = [b for b in found if not b.noise]
                    inside, whole, named = sum(len(b.text) for b in plain if b.article), sum(len(b.text) for b in found), Counter()
                    for b in found:
                        if b.noise:
                            named[b.marked] += len(b.text)
                    shares.append([{"marked": m, "part": n if n > MOST_ARTICLE * inside else 0, "whole": whole} for m, n in named.items()])
                    own = found if 2 * named.total() > whole else plain
                    signatures.append(_hash("\n".join(sorted({b.text for b in own}))))
                    leads.append(inside > 0 and 2 * inside >= whole - named.total())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([host_of(u) for u in urls], pa.string()), pa.array(signatures, pa.int64()),
                     pa.array(leads, pa.bool_()), pa.array(held, pa.list_(_BLOCK)), pa.array(styles, pa.list_(_STYLE)), pa.array(shares, pa.list_(_SHARE))],
                    names=["page_id", "url", "host", "signature", "lead", "blocks", "styles", "shares"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, PARSED).withColumn("row", F.monotonically_increasing_id())


def _share(part: Column, of: Column) -> Column:
    """log of ``part`` to the base ``of``; the entropy of something spread evenly over ``part`` of ``of`` pages."""
    return F.log(part) / F.log(of)


def host_pages(parsed: DataFrame) -> DataFrame:
    """(host, pages): different pages of every host."""
    return durable(parsed.groupBy("host").agg(F.count_distinct("signature").alias("pages")), "hosts")


def site_tree(parsed: DataFrame, sizes: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, path, hash, importance) of the texts below ``least``, for hosts of enough different pages.

    Content: one less the entropy of the text over the pages of the host that
    have it at the node. Presentation: entropy of the holding element's
    styles. All counts are of different pages and are summed before they are
    shuffled.
    """
    texts = parsed.select("host", "signature", F.explode("blocks").alias("b")).select("host", "signature", "b.path", "b.parent", "b.hash")
    texts = texts.groupBy("host", "signature", "path", "hash").agg(F.min("parent").alias("parent"))
    spread = texts.groupBy("host", "path", "hash").agg(F.count(F.lit(1)).alias("on"), F.min("parent").alias("parent"))
    styles = parsed.select("host", "signature", F.explode("styles").alias("s")).select("host", "signature", "s.path", "s.style").distinct()
    kinds = styles.groupBy("host", "path", "style").agg(F.count(F.lit(1)).alias("on"))
    small = broadcast_if_small(sizes.filter(F.col("pages") >= LEAST_PAGES))
    content = spread.join(small, "host").select("host", "path", "parent", "hash", (1 - _share(F.col("on"), F.col("pages"))).alias("content"))
    shown = kinds.join(small, "host").groupBy("host", F.col("path").alias("parent"), "pages").agg(
        F.sum("on").alias("n"), F.sum(F.col("on") * F.log(F.col("on"))).alias("s")
    ).select("host", "parent", ((F.log("n") - F.col("s") / F.col("n")) / F.log("pages")).alias("presentation"))
    importance = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.coalesce("presentation", F.lit(1.0))
    # Texts that stay by their content alone need no presentation and are not shuffled for it.
    doubtful = content.filter(CONTENT_WEIGHT * F.col("content") < least)
    judged = doubtful.join(shown, ["host", "parent"], "left").select("host", "path", "hash", importance.alias("importance"))
    return judged.filter(F.col("importance") < least)


def overruled(parsed: DataFrame) -> DataFrame:
    """(host, marked) of class-marked elements that hold most of the text of their host's pages that have them."""
    held = parsed.select("host", F.explode("shares").alias("s")).groupBy("host", "s.marked")
    return held.agg(F.sum("s.part").alias("part"), F.sum("s.whole").alias("whole")).filter(2 * F.col("part") > F.col("whole")).select("host", "marked")


def main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text) of every row: the blocks of the article in page order, joined by line feeds.

    A null or empty page has an empty text. A page without a host belongs to
    the host ''. Repeated rows get a row each; extra columns are not carried.
    """
    parsed = durable(parse_pages(pages), "parsed")
    sizes = host_pages(parsed)
    low = broadcast_if_small(durable(site_tree(parsed, sizes, least), "low-texts"))
    each = parsed.select("row", "host", "lead", F.posexplode("blocks").alias("at", "b")).select("row", "host", "lead", "at", "b.mark", "b.marked", "b.path", "b.hash")
    inside = ARTICLE_WEIGHT + (1 - ARTICLE_WEIGHT) * F.col("importance") < least
    weak = each.join(low, ["host", "path", "hash"]).filter((F.col("mark") != ARTICLE) | inside).select("row", "at")
    few = broadcast_if_small(sizes.filter(F.col("pages") < LEAST_PAGES).select("host"))
    beside = each.filter(F.col("lead") & (F.col("mark") == OPEN)).join(few, "host").select("row", "at")
    most = broadcast_if_small(durable(overruled(parsed), "overruled"))
    back = each.filter(F.col("mark") == NAMED).join(most, ["host", "marked"]).select("row", "at")
    said = weak.union(beside).withColumn("left", F.lit(True)).union(back.withColumn("left", F.lit(False)))
    out = said.groupBy("row").agg(F.collect_set(F.when(F.col("left"), F.col("at"))).alias("out"), F.collect_set(F.when(~F.col("left"), F.col("at"))).alias("back"))
    out = durable(out, "left-out")
    judged = parsed.join(broadcast_if_small(out, row_bytes=OUT_BYTES), "row", "left")
    among = lambda places, at: F.coalesce(F.array_contains(places, at), F.lit(False))
    kept = F.filter("blocks", lambda b, at: ((b["mark"] != NAMED) | among("back", at)) & ~among("out", at))
    return judged.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
