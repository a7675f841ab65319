"""Main text: parsing, marked elements, the site tree."""

import pytest

from trustfold.llm import html_extraction
from trustfold.llm.html_blocks import blocks


def _article(html):
    return [b.text for b in blocks(html)[0] if b.article and not b.noise]


@pytest.mark.parametrize("html, want", [
    ("<article><h1>A &amp; b&eacute;</h1><p><b>One \n two<br><p>Three <i>fo</i>ur</article><footer>f", ["A & bé", "One two", "Three four"]),
    ("<nav><ul><li>x</ul></nav><article>t<script>var a='</p>';</script>u<style>p{}</style></article>", ["tu"]),
    ("<main><div class='post-comments'>c</div><p>1 &lt; 2 < 3<aside>s</aside><form><p>f</form>tail</main>", ["1 < 2 < 3", "tail"]),
    ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", ["a", "b", "c", "1", "2", "3"]),
    ("<article><p>a</p><article class=comment><p>reader</p></article><p>b</article>", ["a", "b"]),
    ("<article><header><h1>T</h1></header><p>b</p><!-- x <p>y --><p>c&nbsp;d &#x41;&#66;", ["T", "b", "c d AB"]),
    ("", []), ("<article>", []), ("<", []), ("</p></article>x", []),
])
def test_blocks(html, want):
    assert _article(html) == want


def test_deep_and_broken_pages():
    for html in ("<div>" * 3000 + "x", "<b>" * 3000 + "x", "</div>" * 3000 + "x", "<a href='" + "x" * 1000, "<!--" + "x" * 1000, "<p " * 500, "&" * 2000 + "x"):
        found, _ = blocks(html)
        assert sum(len(b.text) for b in found) <= len(html)


def test_the_tree_tells_template_from_story(spark):
    page = (
        "<html><body><div class='w'><div class='t'><span>My Site</span></div><div class='l'><ul><li>Home</li><li>About us</li></ul></div>"
        "<div class='c'><h1>Title {i}</h1><p>Story {i} of {j}.</p></div><div class='z'>All rights</div></div></body></html>"
    )
    rows = [(i, f"http://site.x/{i}", page.format(i=i, j=7 * i)) for i in range(30)]
    rows += [(100 + i, f"https://site.x/copy/{i}", page.format(i=3, j=21)) for i in range(60)]  # one story, many addresses
    rows += [(900, "http://one.y/", "<div>only page of its host</div>"), (901, None, None), (901, None, None), (None, "x", ""), (902, "http://[bad", "<article>ok</article>")]
    got = {}
    for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[i] == [f"Title {i}\nStory {i} of {7 * i}."] for i in range(30))
    assert all(got[100 + i] == ["Title 3\nStory 3 of 21."] for i in range(60))
    assert got[900] == ["only page of its host"] and got[901] == ["", ""] and got[None] == [""] and got[902] == ["ok"]
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, row int")
    assert html_extraction.main_text(empty).isEmpty()


def test_articles_of_the_given_pages(spark, sf_dir):
    """The pages' articles are all their text between the article tags, tag by tag."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    held = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    rows = html_extraction.main_text(pages).collect()
    assert len(rows) == len(held)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", held[r["page_id"]], re.S)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1|br)[^>]*>", inner[1])] if inner else []
        assert r["text"] == "\n".join(p for p in parts if p)


def _texts(spark, rows):
    found = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in found.collect()}


def test_a_notice_longer_than_the_story_leaves_the_pages_apart(spark):
    notice = "We keep cookies for reasons that this long notice lists. " * 9
    page = "<body><div class='m'>Menu of the site</div><div class='c'><p>Story {i}.</p></div><div class='z'>{n}</div><footer>{n} {n}</footer></body>"
    got = _texts(spark, [(i, f"http://long.x/{i}", page.format(i=i, n=notice)) for i in range(12)])
    assert got == {i: f"Story {i}." for i in range(12)}


def test_single_texts_of_one_path_are_told_apart(spark):
    same = "".join(f"<p>Notice {'abcdefghi'[k]} of the site.</p>" for k in range(9))
    page = "<body><div class='c'>{same}<p>Story {i}.</p></div></body>"
    got = _texts(spark, [(i, f"http://mixed.x/{i}", page.format(i=i, same=same)) for i in range(12)])
    assert got == {i: f"Story {i}." for i in range(12)}
    most = "<body><div class='c'><p>Read more here.</p>{own}</div></body>"
    own = lambda i: "".join(f"<p>Story {i}, part {k}.</p>" for k in range(9))
    got = _texts(spark, [(i, f"http://mixed.x/{i}", most.format(own=own(i))) for i in range(12)])
    assert got == {i: "\n".join(f"Story {i}, part {k}." for k in range(9)) for i in range(12)}


def test_pages_with_articles_run_through_the_tree(spark):
    page = (
        "<body><div class='m'>Menu of the site</div><article><p>Subscribe to our letter today.</p><p>Story {i}.</p></article>"
        "<div class='z'>All rights are ours</div></body>"
    )
    teaser = "<body><div class='m'>Menu of the site</div><article>Teaser {i}</article><div class='story'><p>The story {i} itself.</p></div></body>"
    rows = [(i, f"http://art.x/{i}", page.format(i=i)) for i in range(12)]
    rows += [(100 + i, f"http://stray.x/{i}", teaser.format(i=i)) for i in range(12)]
    rows += [(200, "http://few.x/", "<article>A story of some length.</article><div>Menu</div>"), (201, "http://few.y/", teaser.format(i=1))]
    got = _texts(spark, rows)
    assert all(got[i] == f"Story {i}." for i in range(12))
    assert all(got[100 + i] == f"Teaser {i}\nThe story {i} itself." for i in range(12))
    assert got[200] == "A story of some length." and got[201].endswith("Teaser 1\nThe story 1 itself.")


def test_names_mark_noise_as_a_whole():
    for wrap in ("class='layout no-sidebar'", "class='has-sidebar'", "id='page' class='category-legal'", "class='sidebar'"):
        assert _article(f"<div {wrap}><article><p>a</p></article></div>") == ["a"]
    assert _article("<div class='main-title'>a</div><div class='wide main'>b</div>") == ["b"]
    assert _article("<main>a<div class='ad'>x</div><div class='widget-area sidebar-inner'>y</div><ul class=comments><li><article>z</article></ul></main>") == ["a"]
    assert not _article("<aside><article>a</article></aside>")


def test_the_tree_decides_where_class_words_mark_whole_pages(spark):
    page = "<body><div>Skip to text</div><div class='legal'><p>Our motto.</p><p>Story {i} is longer.</p><div class='ad'>Buy {i}</div></div></body>"
    small = "<body><div class='t'>A story {i} with some words.</div><div class='legal'>Terms of {i}</div></body>"
    rows = [(i, f"http://legal.x/{i}", page.format(i=i)) for i in range(12)] + [(100 + i, f"http://small.x/{i}", small.format(i=i)) for i in range(12)]
    rows += [(200, "http://few.x/", "<div class='layout no-sidebar'><p>Words of a page.</p></div>")]
    got = _texts(spark, rows)
    assert all(got[i].startswith(f"Story {i} is longer.") for i in range(12))
    assert all(got[100 + i] == f"A story {i} with some words." for i in range(12)) and got[200] == "Words of a page."
