"""Input columns that have the names of private ones stay as they are."""

from pyspark.sql import functions as F

from recordloom.llm import (
    decontaminate, html_blocks, line_quality, mixing, sanitise, sharding, shingle_join, url_lists,
)
from recordloom.llm.common import private

PRIVATE = ("_k1", "_k2", "_K1", "_f1", "_t1", "_t", "_s", "_id", "id", "k1", "name", "again", "_carried", "_row", "_w", "_c", "_gone", "_all")


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = [c for c in PRIVATE if c != "_K1"]
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}), names


def test_names_differ_from_all_columns():
    assert private(["_k1", "__K1"], "_k1", "_k2", "_k2") == ["___k1", "_k2", "__k2"]


def test_nothing_is_overwritten(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs, names = clashing(spark, [(1, words), (2, words), (3, "call me at a@b.de now please"), (4, None), (5, "some other words")])
    items = spark.createDataFrame([(9, " ".join(f"w{i}" for i in range(5, 20)))], "item_id long, text string")
    for got, ids in ((decontaminate.clean(docs, items), {3, 4, 5}), (shingle_join.one_of_each(docs), {1, 3, 4, 5}),
                     (sanitise.find(docs), {1, 2, 3, 4, 5})):
        rows = got.collect()
        assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


MORE = ("_slot", "_at", "_x", "_url", "_u2", "_top", "_n", "_source", "_range", "_key", "_s", "_cut", "_k1", "_host", "_w", "_gh",
        "_removed_words", "c0", "c1", "line", "words")


def test_nothing_is_overwritten_by_the_others(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a", words), (2, "b", words + " x"), (None, "a", "few words"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.withColumns({c: F.concat_ws("", F.lit(c), F.col("doc_id").cast("string")) for c in MORE})
    pages = docs.withColumns({"html": F.concat(F.lit("<article><p>"), "text"), "url": F.lit("https://h.de/a"),
                              "fetched_on": F.to_date(F.lit("2024-01-02"))})
    entries = spark.createDataFrame([("host", "h.de", "2024-01-01", "add")], "kind string, value string, dated string, action string") \
        .withColumn("dated", F.to_date("dated"))
    same = lambda r: all(r[c] == f"{c}{'' if r.doc_id is None else r.doc_id}" for c in MORE)
    for got in (sharding.place(docs, 4), html_blocks.extract(pages), url_lists.judge(pages, entries), mixing.mix(docs),
                line_quality.judge(docs)):
        found = got.collect()
        assert len(found) == 4
        assert all(same(r) for r in found)


def test_columns_named_like_results_come_through(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a", words), (2, "b", words + " x")], "doc_id long, source string, text string")
    docs = docs.withColumns({c: F.lit("mine") for c in ("n_words", "kept", "_removed_lines", "size", "target", "taken")})
    for got in (line_quality.clean(docs), mixing.mixed(docs)):
        assert got.columns == docs.columns and got.count() >= 2
        assert all(r["n_words"] == r["kept"] == r["_removed_lines"] == r["size"] == r["taken"] == "mine" for r in got.collect())
