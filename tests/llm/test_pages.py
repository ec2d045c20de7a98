from __future__ import annotations

import time

import pytest

from tideline.llm import pages


@pytest.fixture(scope="module")
def tree(spark):
    return pages.train_tree(spark)


def texts(spark, tree, *found):
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(found)], "page_id long, html string")
    rows = pages.extract(frame, model=tree).select("page_id", "text").collect()
    return [r.text for r in sorted(rows)]


WHOLE = (
    '<!DOCTYPE html><html><head><meta charset="utf-8"><title>T &amp; t</title><style>p{x:1}</style>'
    '<script>var t="</p>";f(1<2)</script></head><body><header>Site name</header><nav><ul><li><a href="/a">A</a></li>'
    "<li><a>B</a></ul></nav><!-- a --><div class=\"cookie-banner\">We use cookies on this site for your comfort.</div>"
    '<div class="ad">Buy some shoes now, they are very good and cheap.</div><article><h1>T &amp; t</h1><p><b>Bold '
    "start.<br><p>One &lt;b&gt;\n\n  two&nbsp;three &eacute; &#233; &#x41;.</p><p>End.</p><blockquote>Quoted words.</blockquote>"
    '<form><label>Name</label><input></form><aside>Read on elsewhere</aside></article><div id="comments"><p>A long comment '
    "by a reader who liked the article very much indeed.</p></div><footer>&copy; me &middot; all rights</footer></body></html>"
)


def test_article_without_furniture(spark, tree):
    (found,) = texts(spark, tree, WHOLE)
    assert found == "T & t Bold start. One <b> two three é é A. End. Quoted words."


def test_pages_without_an_article(spark, tree):
    body = "Prices rose again on Tuesday as traders looked for new supplies of metal in the south."
    page = f'<div><a>x</a> | <a>y</a> | <a>z</a></div><div><p>{body}</p><p>It rose by ten per cent.</p></div><div><a>Imprint</a></div>'
    (found,) = texts(spark, tree, page)
    assert body in found and "Imprint" not in found and "x |" not in found


def test_broken_pages(spark, tree):
    found = texts(
        spark, tree, None, "", "<", "<p", "a < b", "<article><p>never closed <b>bold", "<article><p title='>x</p><p>y</p></article>",
        "<article><script>if (a<b) {", "<!-- <article><p>x</p>", "<head><title>x</title><body><article>text here</article>",
    )
    assert found[:2] == ["", ""] and found[5] == "never closed bold"
    assert found[7] == "" and found[8] == "" and found[9] == "text here"


def test_repeated_rows_extra_columns_and_empty(spark, tree):
    frame = spark.createDataFrame([(1, WHOLE, "a"), (1, WHOLE, "b")], "page_id long, html string, text string")
    found = pages.extract(frame, model=tree)
    assert found.count() == 2 and len({r.text for r in found.collect()}) == 1
    assert pages.extract(frame.limit(0), model=tree).count() == 0


@pytest.mark.parametrize("closing", ["</i>", "</u>", "<hr>", "</li>"])
def test_work_grows_with_the_page(closing):
    """Tags that close nothing do not search the whole stack."""
    page = '<i class="y"><div>' + f"<span class=x>{closing}" * 20_000 + "<p>the end of it</p>"
    started = time.perf_counter()
    assert pages.flat_blocks(page)[-1]["text"] == "the end of it"
    assert time.perf_counter() - started < 5


def test_closing_tags_close_what_is_open():
    nested = "<div class=menu><p>a</p></div>b<p>c<div>d</div><ul><li>e<li>f</ul><div>g</i></p>h<b class=menu>i</div>j"
    assert [(b["text"], b["furniture"]) for b in pages.flat_blocks(nested)] == [
        ("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 0.0), ("e", 0.0), ("f", 0.0), ("g", 0.0), ("h", 0.0), ("i", 1.0), ("j", 0.0),
    ]


def test_features_of_neighbours():
    blocks = pages.flat_blocks("<p>one two</p><p><a>three</a> four</p><p>five</p>")
    assert [b["words"] for b in blocks] == [2, 2, 1]
    assert [b["link_density"] for b in blocks] == [0, 0.5, 0]
    assert blocks[1]["words_before"] == 2 and blocks[1]["words_after"] == 1 and blocks[2]["link_before"] == 0.5


def test_tree_fits_its_table(spark, tree):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(pages.FEATURES), outputCol="features").transform(pages.labelled_blocks(spark))
    wrong = tree.transform(rows).filter("label <> prediction").count()
    assert wrong == 0
