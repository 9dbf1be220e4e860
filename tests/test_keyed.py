"""Tables by record key, pulls by day, and pairing of every engagement."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import relate
from recordloom.sources import keyed, vintages

def frame(spark, ids, value="v"):
    return spark.createDataFrame([(i, f"p{i}", value) for i in ids], "parent long, id string, value string")


def load(spark, path, ids, value="v"):
    return keyed.append(frame(spark, ids, value), path, "id", ["value"], bucket_by="parent", buckets=8)


def test_a_key_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.open_keyed(spark, path) is None
    assert load(spark, path, list(range(100)) + [5, 6])["new"] == 100
    assert load(spark, path, range(50, 150), "later")["new"] == 50
    rows = keyed.open_keyed(spark, path)
    assert rows.count() == 150 and rows.select("id").distinct().count() == 150
    assert rows.where("value = 'later'").count() == 50
    nulls = spark.createDataFrame([(None, None, "a"), (1, None, "b")], "parent long, id string, value string")
    for _ in range(2):
        keyed.append(nulls, path, "id", ["value"], bucket_by="parent")
    assert keyed.open_keyed(spark, path).count() == 154


def test_an_append_reads_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, range(400))
    per_bucket = {r.bucket: r.n for r in keyed.zones(spark, path).collect()}
    one = frame(spark, [7]).select(keyed.bucket_of("parent", 8).alias("b")).first().b
    again = load(spark, path, [7])
    assert again == {"new": 0, "touched": 1, "read": per_bucket[one]}
    # the filter rules new keys out, but for a few
    fresh = load(spark, path, range(1000, 1100))
    assert fresh["new"] == 100 and fresh["read"] < 400
    assert keyed.stored_keys(spark, path, "id", [one]).count() > 0


def test_another_layout_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, range(5))
    with pytest.raises(ValueError, match="laid out by"):
        keyed.append(frame(spark, [1]), path, "id", ["value"])


def test_parent_and_child_join_without_a_shuffle(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    keyed.append(frame(spark, range(60)).select("parent", "value"), a, "parent", ["value"], buckets=8)
    load(spark, b, range(60))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left, right = keyed.open_keyed(spark, a), keyed.open_keyed(spark, b)
        sums = left.join(right, "parent").groupBy("parent").agg(F.count("*").alias("n"))
        assert sums.count() == 60
        assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pulls_stay(spark, tmp_path):
    wh = str(tmp_path)
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    vintages.store(df((1, "a"), (2, "b")), "x", wh, url="u", as_of="2024-01-01")
    vintages.store(df((1, "a"), (2, "c")), "x", wh, url="u", as_of="2024-02-01")
    vintages.store(df((2, "b"), (3, None)), "x", wh, url="u", as_of="2024-03-01")
    vintages.store(df((2, "b"), (3, None)), "x", wh, url="u", as_of="2024-03-01")
    stored = vintages.pulls(spark, "x", wh)
    assert stored.count() == 6
    assert sorted(map(tuple, vintages.known_on(stored, "2024-02-15").collect())) == [(1, "a"), (2, "c")]
    assert vintages.known_on(stored, "2023-01-01").count() == 0
    history = vintages.intervals(stored, ["k"])
    got = sorted((r.k, r.v, str(r.valid_from), r.valid_to and str(r.valid_to)) for r in history.collect())
    assert got == [(1, "a", "2024-01-01", "2024-03-01"), (2, "b", "2024-01-01", "2024-02-01"), (2, "b", "2024-03-01", None),
                   (2, "c", "2024-02-01", "2024-03-01"), (3, None, "2024-03-01", None)]
    assert vintages.holding_on(history, "2024-02-29").count() == 2
    assert sorted(map(tuple, vintages.difference(stored, ["k"], "2024-02-01", "2024-03-01").collect())) == [
        (1, "removed", 1), (2, "changed", 1), (3, "added", 1)]


def test_every_engagement_has_its_award(spark):
    rng = random.Random(1)
    day = lambda: f"2024-01-{rng.randrange(1, 20):02} {rng.randrange(3):02}:00:00"
    e = [(i, rng.choice(["a", "b", "hot", "hot", None]), rng.choice([day(), day(), None])) for i in range(80)]
    a = [(i, rng.choice(["a", "hot", "c", None]), rng.choice([day(), day(), None]), i * 1.5) for i in range(40)]
    want = set()
    for i, k, s in e:
        fits = sorted((t, n, v) for n, key, t, v in a if k is not None and s is not None and key == k and t is not None and t >= s)
        want.add((i, k, s, *(fits[0] if fits else (None, None, None))))
    got = relate.next_awards(
        spark.createDataFrame(e, "eng int, k string, s string").withColumn("s", F.to_timestamp("s")),
        spark.createDataFrame(a, "award int, k string, at string, v double").withColumn("at", F.to_timestamp("at")),
        key="k", start="s", awarded="at", tie="award", keep=["v"])
    text = lambda t: t and str(t)
    assert {(r.eng, r.k, text(r.s), text(r["at"]), r.award, r.v) for r in got.collect()} == want
    assert got.count() == 80
