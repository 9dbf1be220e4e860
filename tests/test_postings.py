import glob
import random
import re

import pytest

from pyspark.sql import functions as F

from recordloom.functions.text import URL_PATTERN, find_all
from recordloom.operators import postings as P


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, note string")


def plain(tables, needle):
    want = " ".join(needle.lower().split())
    return {(name, str(r[0]) if r[0] is not None else None, c)
            for name, rows in tables.items() for r in rows for c, cell in zip(("name", "note"), r[1:])
            if want in re.sub(r"[\x20\x09-\x0D]+", " ", (cell or "").lower())}


def found(index, needle):
    return {tuple(r) for r in P.search(index, needle).collect()}


def test_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["ring", "Ringer", "ba", "ab", "string", "été", "x"]) for _ in range(n))
    tables = {t: [(k, text(rng.randrange(5)), text(rng.randrange(9))) for k in range(60)] for t in ("a", "b")}
    tables["a"] += [(None, "ring", None), (7, "", "  \t"), (8, "two\n\n ringer  ba", "x"), (8, "other", "ring ba"),
                    (8, "other", "ring ba"), (9, "x" * 200_000 + " ba", None)]
    index = P.TokenIndex(spark, str(tmp_path / "i"), buckets=5)
    for name, rows in tables.items():
        P.add(index, {name: (table(spark, rows), "id", ["name", "note"])}, batch=f"load-{name}")
    for needle in ("ring", "RINGER", "ng ba", "r ba a", "ÉTÉ", "ba  ab", "ing ba ab r", "none", "two ringer", "xxx ba"):
        assert found(index, needle) == plain(tables, needle), needle
    assert found(index, "ring") and not found(index, "none")
    with pytest.raises(ValueError):
        P.search(index, " \n")


def test_batches_are_added_and_replaced(spark, tmp_path):
    index = P.TokenIndex(spark, str(tmp_path / "i"), buckets=4)
    assert P.search(index, "a").count() == 0
    assert P.unknown(index, spark.createDataFrame([("a",), ("a",), (None,)], "token string").distinct()).count() == 1
    add = lambda batch, rows: P.add(index, {"t": (table(spark, rows), "id", ["name"])}, batch)
    add("2024", [(1, "alpha beta", None)])
    first = set(glob.glob(f"{tmp_path}/i/postings/batch=2024/**/*.parquet", recursive=True))
    add("2025", [(2, "alpha gamma delta epsilon", None)])
    assert first == set(glob.glob(f"{tmp_path}/i/postings/batch=2024/**/*.parquet", recursive=True))
    assert {r[1] for r in found(index, "alpha")} == {"1", "2"}
    add("2025", [(3, "gamma", None)])
    assert {r[1] for r in found(index, "alpha")} == {"1"} and {r[1] for r in found(index, "gamma")} == {"3"}
    add("2025", [])
    assert found(index, "gamma") == set()
    left = P.unknown(index, spark.createDataFrame([("beta",), ("gamma",)], "token string"))
    assert [r.token for r in left.collect()] == ["gamma"]
    with pytest.raises(ValueError):
        add("../other", [])


def test_a_token_reads_its_bucket_only(spark, tmp_path):
    index = P.TokenIndex(spark, str(tmp_path / "i"), buckets=16)
    rows = [(k, f"word{k % 90} common", None) for k in range(500)]
    P.add(index, {"t": (table(spark, rows), "id", ["name"])}, "one")
    hits = P.occurrences(index, "word3")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"PushedFilters: \[[^]]*EqualTo\(token,word3\)", plan)
    assert hits.count() == sum(r[1].startswith("word3 ") for r in rows) > 0
    assert hits.select("bucket").distinct().count() == 1
    # the postings of a frequent token are one row each, none is lost
    assert P.occurrences(index, "common").count() == 500
    assert [tuple(r) for r in P.frequent(index, 1).collect()] == [("common", 500)]


def test_other_tokens(spark, tmp_path):
    index = P.TokenIndex(spark, str(tmp_path / "i"))
    rows = [(1, "see https://a.example/x and https://b.example/y", None)]
    P.add(index, {"t": (table(spark, rows), "id", ["name"])}, "one", tokens=lambda c: find_all(c, URL_PATTERN))
    cited = spark.createDataFrame([("https://a.example/x",), ("https://c.example/",)], "token string")
    assert [r.token for r in P.unknown(index, cited).collect()] == ["https://c.example/"]
    assert P.lookup(index, cited).select(F.max("record_id")).first()[0] == "1"


def test_a_repeated_word_is_stored_once_per_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "DEAL_CHARS", 64)
    index = P.TokenIndex(spark, str(tmp_path / "i"), buckets=3)
    rows = [(k, "a b a a", None if k % 2 else "b " * 3) for k in range(300)] + [(None, None, "")]
    P.add(index, {"t": (table(spark, rows), "id", ["name", "note"])}, "one")
    stored = {(r.record_id, r.column_name, r.token): r.positions for r in index.postings().collect()}
    assert index.postings().count() == len(stored) == 300 * 2 + 150
    assert stored["7", "name", "a"] == [0, 2, 3] and stored["8", "note", "b"] == [0, 1, 2]
    assert [tuple(r) for r in P.frequent(index, 2).collect()] == [("a", 900), ("b", 750)]
    assert found(index, "a  A") == {("t", str(k), "name") for k in range(300)}
