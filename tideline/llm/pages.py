"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once from start to end and cut into flat blocks of text at block-level tags.
Each block has its number of words and its link density, those of the blocks before and after
it, and flags for what it stands in (an article; a menu, footer, form or notice, by tag, role
or class). A decision tree decides which blocks are main text. It is trained by Spark on the
blocks of a small table of labelled pages (``LABELLED``) and applied as a column expression, so
pages are neither shuffled nor exploded.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table

SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "html head body address article aside blockquote br center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead tr ul caption legend button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand around page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog button label fieldset head".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar "
    "toolbar".split()
)
#: Words in a class or id that say the same; a trailing s is taken off before the look-up.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adbox adslot banner promo promotion sponsor sponsored "
    "nav navbar navigation menu breadcrumb pagination pager sidebar aside footer masthead topbar "
    "toolbar cookie consent gdpr notice alert popup modal overlay newsletter subscribe subscription "
    "signup login register share sharing social related recommended recommendation teaser widget "
    "notification announcement response responses feedback "
    "comment commentlist disqu disqus reply replie discussion respond form search copyright legal disclaimer "
    "skip hidden".split()
)
#: Tags that an open paragraph does not outlive.
_CLOSES_P = BLOCK - {"br", "option", "label", "button", "legend", "caption", "html", "head", "body"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    # A quote that is never closed: the tag ends at the next >.
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
FEATURES = (
    "words link_density words_before link_before words_after link_after furniture article header heading".split()
)
_BLOCKS = (
    "array<struct<text:string," + ",".join(f"{f}:double" for f in FEATURES) + ",mark:string>>"
)


class _Context:
    __slots__ = ("tag", "furniture", "article", "header", "mark", "silent")

    def __init__(self, tag, furniture, article, header, mark, silent):
        self.tag, self.furniture, self.article = tag, furniture, article
        self.header, self.mark, self.silent = header, mark, silent


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m.group(2) or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(m.group(1).lower(), value)
    return found


def _says_furniture(attributes: dict[str, str]) -> bool:
    if attributes.get("role", "").lower() in FURNITURE_ROLES or "hidden" in attributes:
        return True
    if attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    names = _CAMEL.sub(" ", attributes.get("class", "") + " " + attributes.get("id", "")).lower()
    return any(w in FURNITURE_WORDS or w.rstrip("s") in FURNITURE_WORDS for w in _WORDS.findall(names))


def _inside(parent: _Context, tag: str, attributes: dict[str, str]) -> _Context:
    role = attributes.get("role", "").lower()
    article = parent.article or tag in ("article", "main") or role in ("main", "article")
    furniture = parent.furniture or (
        tag in FURNITURE
        or (tag not in ("html", "body", "article", "main") and role not in ("main", "article") and _says_furniture(attributes))
    )
    # A header outside an article is the site's; one inside it holds the title.
    says_header = tag == "header" or "header" in attributes.get("class", "") + attributes.get("id", "")
    header = parent.header or (says_header and not article)
    return _Context(
        tag, furniture, article, header, attributes.get("data-main", parent.mark), parent.silent or tag in SILENT
    )


def flat_blocks(page: str | None) -> list[dict]:
    """The text blocks of a page in page order, with their features. Null has none."""
    page = page or ""
    root = _Context("", False, False, False, "", False)
    stack = [root]
    blocks: list[dict] = []
    text: list[str] = []
    linked = 0
    links = 0
    # Where each tag and where blocks stand on the stack: a closing tag finds its place at once.
    opened: dict[str, list[int]] = {}
    walls: list[int] = []

    def push(context: _Context) -> None:
        opened.setdefault(context.tag, []).append(len(stack))
        if context.tag in BLOCK:
            walls.append(len(stack))
        stack.append(context)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop().tag
            opened[gone].pop()
            if gone in BLOCK:
                walls.pop()

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if whole:
            at = stack[-1]
            n = len(whole.split(" "))
            blocks.append(
                {
                    "text": whole,
                    "words": float(n),
                    "link_density": min(1.0, linked / n),
                    "furniture": float(at.furniture),
                    "article": float(at.article),
                    "header": float(at.header),
                    "heading": float(any(c.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for c in stack[-3:])),
                    "mark": at.mark,
                }
            )
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].silent:
            text.append(piece)
            if links:
                linked += len(piece.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        k = 2 if m.group(2) else 5
        tag = (m.group(k) or "").lower()
        if not tag:
            continue
        if m.group(k - 1):  # a closing tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
            places = opened.get(tag)
            # A closing inline tag does not close the blocks around it.
            if places and (tag in BLOCK or not walls or walls[-1] < places[-1]):
                depth = places[-1]
                if stack[depth].furniture and not stack[depth - 1].furniture:
                    flush()
                cut(depth)
            continue
        attributes = m.group(k + 1)
        if tag in BLOCK:
            flush()
            if len(stack) > 1 and stack[-1].tag == "head":
                cut(len(stack) - 1)  # a head that is never closed ends at the first block
            if tag in _CLOSES_P and walls and stack[walls[-1]].tag == "p":
                cut(walls[-1])
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                # The same kind of item closes the one before it.
                if stack[-1].tag == tag:
                    cut(len(stack) - 1)
            links = 0 if tag in _CLOSES_P else links
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "a":
            links += 1
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in BLOCK or tag in SILENT or "class" in attributes or "id" in attributes or "role" in attributes:
            if tag not in BLOCK and tag not in SILENT and _says_furniture(_attributes(attributes)):
                flush()
            push(_inside(stack[-1], tag, _attributes(attributes) if attributes else {}))
    flush()
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        b["words_before"] = before["words"] if before else 0.0
        b["link_before"] = before["link_density"] if before else 0.0
        b["words_after"] = after["words"] if after else 0.0
        b["link_after"] = after["link_density"] if after else 0.0
    return blocks


#: Labelled pages: blocks below data-main="1" are main text, those below data-main="0" are not.
LABELLED = (
    '<header data-main="0"><a href="/">Daily Example</a></header><nav data-main="0"><ul><li><a>Home</a><li><a>World</a>'
    '<li><a>Sport</a></ul></nav><div class="ad" data-main="0">Buy two chairs and get one for free this week.</div>'
    '<article data-main="1"><h1>Rain expected in the north</h1><p>Heavy rain is expected in the north until Friday, '
    'said the weather service in its report on Monday morning.</p><p>Short.</p><p>Read more about it '
    'in <a>our long report</a> on floods and rivers.</p></article><footer data-main="0">&copy; Daily Example 2020</footer>',
    '<div id="menu" data-main="0"><a>Start</a> | <a>Shop</a> | <a>Contact us</a></div><div data-main="1"><h2>How to '
    'bake bread</h2><p>Take a pound of flour, some water and a little salt, and knead the dough until it is smooth '
    'and no longer sticks to the table.</p><p>Let it rest for two hours in a warm place and bake it until the crust is '
    'brown.</p></div><div class="comments" data-main="0"><p>I tried this recipe yesterday and my whole family loved '
    'the bread, thank you so much for it!</p><p>Great.</p></div><div class="footer" data-main="0">All rights reserved</div>',
    '<div class="cookie-notice" data-main="0">This site uses cookies to improve your visit; by going on you accept '
    'them all.<button>Accept</button></div><main data-main="1"><h1>Council agrees</h1><p>The council agreed.</p><p>It '
    'took the members three hours to find a wording that all parties could sign.</p><ul><li>More buses in the '
    'evening</li><li>Lower fares</li></ul></main><aside data-main="0"><h3>Most read</h3><ul><li><a>Ten ways to save money '
    'at home</a><li><a>Why trains are late again this winter</a></ul></aside>',
    '<form data-main="0"><label>Name</label><input><label>Your message to the editors of this paper</label></form>'
    '<article data-main="1"><header><h1>A visit to the harbour</h1></header><p><b>By the sea.</b><br>Boats came in all '
    'morning, and the gulls followed every one of them to the quay.</p><blockquote>We have never seen so many '
    'fish.</blockquote><p>Yes.</p></article><section id="comments" data-main="0"><h2>3 comments</h2><p>My '
    'grandfather was a sailor there and told us many stories about this old harbour.</p></section>',
    '<ul data-main="0"><li><a>News</a><li><a>Markets</a><li><a>Opinion</a></ul><div data-main="1"><p>Prices of copper '
    'rose for the third day as mines in the south stayed closed and traders looked for other supplies.</p><p>Analysts '
    'see no end to it.</p><p>The price of tin, on the other hand, fell to its lowest since the spring of last year, '
    'and lead did not move at all.</p></div><div data-main="0"><a>Terms of use</a> <a>Privacy</a> <a>Imprint</a></div>'
    '<div data-main="0"><a>Back to top</a></div>',
    '<nav data-main="0"><a>A</a><a>B</a></nav><article data-main="1"><h1>Notes</h1><p>One.</p><p>Two words.</p><p>A '
    'little longer note of seven words.</p><div class="share" data-main="0">Share this note with your friends and '
    'colleagues</div><p>Last <a>note</a>.</p></article><div class="newsletter" data-main="0">Subscribe to our letter and '
    'never miss a story that matters to you again.</div><footer data-main="0"><p>The paper is published by Example '
    'Press, 1 Example Street, in print and online every day of the week except on Sundays.</p></footer>',
    '<header data-main="0"><h1>The Example Blog</h1><p>Notes on gardens, birds and the weather, written every week by '
    'a happy gardener.</p></header><div data-main="1"><p>The tulips are out, and so are the bees, though the '
    'nights are still cold.</p><p>I have moved the young plants outside <a>as I told you</a> last week.</p></div>'
    '<div class="sidebar" data-main="0"><p>About me: I live in a small town by a river and have kept a garden for '
    'more than thirty years.</p></div>',
)


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """The small table that the tree is trained on: features and ``label``."""
    rows = [
        tuple(b[f] for f in FEATURES) + (float(b["mark"]),)
        for page in LABELLED
        for b in flat_blocks(page)
        if b["mark"]
    ]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label double")


def train_tree(spark: SparkSession, depth: int = 6):
    """A decision tree over block features."""
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled_blocks(spark))
    learner = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=1)
    return learner.fit(ready.coalesce(1))


def _as_column(node, block: Column) -> Column:
    """The tree below ``node`` as a condition on a block."""
    if node.numDescendants() == 0:
        return F.lit(node.prediction() == 1.0)
    split = node.split()
    feature = block[FEATURES[split.featureIndex()]]
    return F.when(feature <= split.threshold(), _as_column(node.leftChild(), block)).otherwise(
        _as_column(node.rightChild(), block)
    )


def _cut(pages: pd.Series) -> pd.Series:
    return pd.Series([flat_blocks(p) for p in pages])


def extract(pages: DataFrame, html_col: str = "html", model=None) -> DataFrame:
    """``pages`` with ``blocks`` (all flat blocks and their features), ``main`` (texts of those
    that the tree takes, in page order) and ``text`` (these joined by one space, empty if none).

    Every row is a page of its own. Null html is empty. Columns of these names in ``pages`` are
    replaced. ``model`` is a fitted tree over ``FEATURES``.
    """
    model = model or train_tree(pages.sparkSession)
    root = model._call_java("rootNode")
    cut = F.pandas_udf(_cut, _BLOCKS)
    return (
        pages.withColumn("blocks", cut(named(html_col).cast("string")))
        .withColumn(
            "main",
            F.transform(F.filter("blocks", lambda b: _as_column(root, b)), lambda b: b["text"]),
        )
        .withColumn("text", F.array_join("main", " "))
    )


@query("op10_html_extraction")
def op10_html_extraction(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
