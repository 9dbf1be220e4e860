"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into blocks at its block-level tags. A block is described by its word count, its link
density (share of words in links), the same of the blocks before and after it, and by what encloses
it: an article or main element, or an element that is furniture by its tag or by a word of its class, id
or role. A decision tree, trained by Spark ML on the labelled blocks below, says which blocks are
content; kept blocks are joined in page order. Where a page names its article the tree follows the markup; on
other pages words and links of a block and its neighbours decide.

A main element undoes what its wrappers are called, and so does an article within a layout element
(``content-sidebar-wrap``, a form around the page) that is no comment, teaser or advert.

Pages are independent: one pass over the table, no shuffle, memory in proportion to one page. The tree
has a few dozen nodes and travels with the function.

Edge cases: a null or empty page has the empty text and no blocks; malformed markup is read on as browsers do
(unclosed elements end with their parent, an unclosed comment or script takes the rest); repeated rows give
equal rows; an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import numbered, renamed
from recordloom.session import stage_path

# How HTML elements take part.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu "
    "nav ol section table td th tr ul".split())
SILENT = frozenset("button canvas iframe noscript object option script select style svg template textarea title".split())
FURNITURE_TAGS = frozenset("aside dialog footer form header menu nav".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article articlebody content entry maincontent post story".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion related remark remarks reply "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar "
    "widget widgets".split())

# Class words that hold for an article element too, and for the articles inside.
TEASER_WORDS = frozenset(
    "ad ads advert advertisement adverts comment comments disqus popup promo promoted promotion related remark remarks "
    "reply replies respond sponsor sponsored".split())

#: How firmly an element is furniture: not, by its layout (an article inside is content all the same), for certain.
NOT, LAYOUT, FIRM = 0, 1, 2

#: Column names of the features.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "in_content", "in_furniture", "page_has_content")

# The labelled table. One line per page; a block is "where:words/linked words=label", where
# a is inside an article, f inside furniture, b both, o neither.
LABELLED = """
f:1/1=0 f:1/1=0 f:2/2=0 f:1/1=0 f:12/0=0 a:9/0=1 a:80/0=1 a:45/2=1 a:3/0=1 a:120/6=1 f:14/1=0
f:1/1=0 f:1/1=0 f:6/0=0 a:5/0=1 a:1/0=1 a:22/0=1 a:1/0=1 a:2/0=1 f:30/0=0 f:8/3=0
f:3/3=0 o:2/0=0 a:7/0=1 a:60/20=1 a:5/5=1 a:70/0=1 b:18/0=0 a:64/1=1 b:9/0=0 f:25/0=0 f:40/0=0
f:40/0=0 a:10/0=1 a:300/0=1 b:35/0=0 b:50/2=0 f:12/2=0 o:15/0=0
o:4/4=0 o:25/0=0 a:6/0=1 a:15/0=1 a:14/0=1 f:60/0=0 o:30/2=0
f:1/1=0 f:1/1=0 o:7/0=1 o:55/1=1 o:80/0=1 o:12/0=1 o:66/3=1 f:9/1=0 f:20/0=0
o:1/1=0 o:1/1=0 o:1/1=0 o:8/0=1 o:90/2=1 o:40/0=1 o:11/0=1 o:75/0=1 o:3/3=0 o:4/4=0 o:5/2=0
o:2/2=0 o:3/3=0 f:15/0=0 o:6/0=1 o:35/0=1 o:28/1=1 o:50/0=1 f:22/0=0 o:6/6=0 o:7/7=0
o:1/1=0 o:2/2=0 o:10/0=1 o:140/4=1 o:95/0=1 f:70/0=0 f:3/0=0 o:9/9=0
f:2/2=0 f:5/0=0 o:9/0=1 o:18/0=1 o:33/0=1 o:21/0=1 f:11/0=0 o:2/2=0 o:3/3=0
a:8/0=1 a:10/0=1 a:4/4=1 a:9/0=1 f:100/5=0 f:80/0=0 o:90/0=0
f:90/0=0 b:120/0=0 a:11/0=1 a:16/16=1 a:200/9=1 o:45/0=0 f:33/33=0
a:7/0=1 a:2/2=1 a:40/8=1 a:1/1=1 a:30/3=1
a:1/0=1
a:12/12=1 a:3/1=1 a:1/0=1 a:2/2=1 a:9/4=1 a:25/10=1
f:1/1=0 a:10/0=1 a:500/40=1 a:2/1=1 a:3/0=1
o:3/3=0 a:4/0=1 a:18/6=1 a:22/11=1 b:10/10=0 a:6/3=1
o:20/0=0 a:30/5=1 a:1/1=1 a:8/4=1 o:50/0=0
a:15/3=1 a:11/2=1 b:4/0=0 a:14/7=1 a:60/30=1 f:2/2=0
f:9/0=0 f:200/10=0 a:5/1=1 a:80/25=1 o:70/1=0
f:150/0=0 f:60/0=0 f:25/0=0
o:1/1=0 o:30/1=1 o:60/2=1 o:25/0=1 o:120/0=1
o:2/0=0 o:3/0=0 o:5/0=0 o:4/0=0 o:7/0=1 o:48/1=1 o:3/0=1 o:66/0=1 o:31/2=1 o:6/0=1 o:5/0=0 o:2/0=0 o:4/1=0
o:1/0=0 o:6/0=0 o:3/0=0 o:8/0=1 o:21/0=1 o:17/0=1 o:90/4=1 o:2/0=1 o:4/0=0 o:7/0=0 o:3/3=0
o:9/0=0 o:5/0=0 o:2/0=0 o:1/0=0 o:8/0=0 o:4/4=0 o:6/0=0 o:3/0=0
o:4/0=0 o:2/0=0 o:5/0=1 o:130/6=1 o:9/0=1 o:75/2=1 o:1/0=1 o:40/0=1 o:8/0=1 o:9/0=0 o:6/6=0 o:8/0=0
o:3/0=0 o:7/0=0 o:9/0=1 o:19/1=1 o:9/0=1 o:4/0=0 o:5/0=0 o:2/2=0 o:1/1=0
""".strip()

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _names(attributes: str) -> set[str]:
    """The words of an element's class, id and role."""
    return {w for m in _NAMES.finditer(attributes)
            for w in _WORDS.findall((m.group(1) or m.group(2) or m.group(3) or "").lower())}


def _furniture(tag: str, attributes: str, in_content: bool) -> int:
    """How firmly the element itself is furniture."""
    if tag in FURNITURE_TAGS:
        # an article's own header holds its heading; a form may be wrapped around a whole page
        return NOT if tag == "header" and in_content else LAYOUT if tag == "form" else FIRM
    if tag in ("html", "body", "main") or not attributes:
        return NOT
    names = _names(attributes)
    if names & TEASER_WORDS or _HIDDEN.search(attributes):
        return FIRM
    # the class of an article names its topic or its place
    return LAYOUT if tag != "article" and names & FURNITURE_WORDS - ({"header"} if in_content else set()) else NOT


def blocks_of(page: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """``text, words, linked words, in content, in furniture`` of each block with a word, in page order."""
    open_tags: list[tuple[str, bool, int]] = [("", False, NOT)]
    pieces: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0
    paragraph = False

    def block():
        text = " ".join(html_lib.unescape("".join(pieces)).split())
        n_linked = len(html_lib.unescape("".join(linked)).split())
        pieces.clear()
        linked.clear()
        words = text.count(" ") + 1 if text else 0
        return (text, words, min(n_linked, words), open_tags[-1][1], bool(open_tags[-1][2] or paragraph)) if text else None

    while True:
        m = _TAG.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            pieces.append(piece)
            if in_link:
                linked.append(piece)
        if m is None:
            break
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if tag in SILENT and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            if tag in BLOCK_TAGS and (b := block()):
                yield b
            continue
        if tag == "a":
            in_link = not closing
            if in_link:
                linked.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        if b := block():
            yield b
        if tag in CONTAINERS:
            in_link, paragraph = False, False
            if closing:
                for k in range(len(open_tags) - 1, 0, -1):
                    if open_tags[k][0] == tag:
                        del open_tags[k:]
                        break
            else:
                _, content, furniture = open_tags[-1]
                named = tag in ("div", "section", "td") and m.group(3) and _names(m.group(3)) & CONTENT_WORDS
                outermost = not any(t in CONTENT_TAGS for t, _, _ in open_tags)
                if tag == "main" or tag == "article" and furniture == LAYOUT and outermost:
                    furniture = NOT
                open_tags.append((tag, content or tag in CONTENT_TAGS or bool(named),
                                  max(furniture, _furniture(tag, m.group(3), content))))
        elif tag != "br":
            # a paragraph, item or heading of its own class
            paragraph = not closing and bool(_furniture(tag, m.group(3), open_tags[-1][1]))
    if b := block():
        yield b


def features_of(blocks: list[tuple[int, int, bool, bool]]) -> list[tuple[float, ...]]:
    """The features of a page's blocks, given ``words, linked words, in content, in furniture`` of each."""
    has_content = float(any(c and not f for _, _, c, f in blocks))
    own = [(float(w), n / w if w else 0.0) for w, n, _, _ in blocks]
    edge = [(0.0, 0.0)]
    return [(*x, *before, *after, float(c), float(f), has_content)
            for x, before, after, (_, _, c, f) in zip(own, edge + own[:-1], own[1:] + edge, blocks)]


def labelled_rows() -> list[tuple[float, ...]]:
    """Features and label of every labelled block."""
    rows = []
    for line in LABELLED.splitlines():
        cells = [re.fullmatch(r"(.):(\d+)/(\d+)=(\d)", x).groups() for x in line.split()]
        found = features_of([(int(w), int(n), c in "ab", c in "fb") for c, w, n, _ in cells])
        rows += [(*x, float(label)) for x, (_, _, _, label) in zip(found, cells)]
    return rows


def train(spark: SparkSession, depth: int = 6) -> dict[int, tuple]:
    """The tree learned from the labelled table: ``{node: (feature, threshold, left, right, label)}``."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame(labelled_rows(), [*FEATURES, "label"]).coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=1).fit(vectors)
    path = stage_path(spark, "tree")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", "split.featureIndex",
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).collect()
    return {r.id: (r.featureIndex, r.threshold, r.leftChild, r.rightChild, r.prediction) for r in nodes}


def is_content(tree: dict[int, tuple], x: tuple[float, ...]) -> bool:
    """Follow the tree."""
    node = tree[0]
    while node[2] >= 0:
        node = tree[node[2] if x[node[0]] <= node[1] else node[3]]
    return node[4] > 0.5


def main_text(page: str, tree: dict[int, tuple]) -> tuple[str, int, int]:
    """Text, number of blocks, number of kept blocks of one page."""
    blocks = list(blocks_of(page))
    kept = [b[0] for b, x in zip(blocks, features_of([b[1:] for b in blocks])) if is_content(tree, x)]
    return " ".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, html: str = "html", tree: dict[int, tuple] | None = None,
            columns: list[str] | None = None) -> DataFrame:
    """The pages with ``text``, ``n_chars``, ``n_blocks`` and ``n_kept``.

    ``columns``: the input columns to carry (all).
    """
    tree = tree or train(pages.sparkSession)

    @F.pandas_udf("text string, n_blocks long, n_kept long")
    def main_texts(page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(p or "", tree) for p in page], columns=["text", "n_blocks", "n_kept"])

    result = ("text", "n_chars", "n_blocks", "n_kept")
    carried = [c for c in (pages.columns if columns is None else columns) if c not in result]
    return pages.select(*numbered(carried), main_texts(F.coalesce(F.col(html), F.lit(""))).alias("_x")).select(
        *renamed(carried), F.col("_x.text").alias("text"), F.length("_x.text").cast("long").alias("n_chars"),
        F.col("_x.n_blocks").alias("n_blocks"), F.col("_x.n_kept").alias("n_kept"))
