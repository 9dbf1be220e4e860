import math
import re
from collections import Counter

import pytest

from recordloom.llm import ranked_search

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def brute(docs, items, k=20):
    """The definition, row by row."""
    def terms(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **kw):
    got = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **kw)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


WORDS = "Alpha beta GAMMA delta Épée straße 中文 x1 _ -- e-mail".split()


@pytest.fixture(scope="module")
def corpus():
    docs = [(i, " ".join(WORDS[(i * j + j * j) % len(WORDS)] for j in range(1 + i % 9))) for i in range(60)]
    return docs + [(None, "alpha beta"), (None, None), (60, ""), (61, "---"), (5, docs[5][1]), (62, "beta " * 5000 + "gamma")]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_agrees_with_the_definition(spark, corpus, k):
    items = [(1, "alpha BETA beta"), (2, "Épée straße, 中文"), (3, ""), (4, None), (5, "unknown"), (6, "x1 e-mail gamma"), (7, "alpha")]
    assert ranked(spark, corpus, items, k=k) == brute(corpus, items, k)


def test_blocks_of_items_give_the_same(spark, corpus):
    items = [(i, " ".join(WORDS[i % 7:i % 7 + 3])) for i in range(20)]
    assert ranked(spark, corpus, items, most_postings=7) == brute(corpus, items)


def test_ties_go_by_id_and_copies_stay(spark):
    docs = [(i, "same text here") for i in range(50, 0, -1)] + [(99, "other")]
    assert [r[2] for r in sorted(ranked(spark, docs, [(1, "same")]), key=lambda r: r[1])] == list(range(1, 21))


def test_empty_tables(spark, corpus):
    assert ranked(spark, [], [(1, "alpha")]) == []
    assert ranked(spark, corpus, []) == []
    assert ranked(spark, [(1, None)], [(1, "alpha")]) == []


def test_other_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3, "y")], "doc_id long, text string, item string, part int, heap string")
    items = spark.createDataFrame([("q", "b", 1)], "item_id string, text string, id int")
    assert [tuple(r)[:3] for r in ranked_search.search(docs, items).collect()] == [("q", 1, 1)]


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", "z z z")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert [r.doc_id for r in ranked_search.search(docs, items).orderBy("rank").collect()] == ["a", "b"]
