import pytest

from pyspark.sql import functions as F

from recordloom.operators import sketches as S


def store(spark, path, **more):
    return S.DistinctStore(spark, str(path / "s"), ["k"], "year", ["a", "b"], **more)


def rows(spark, data):
    return spark.createDataFrame(data, "k string, year int, a long, b string")


def test_loads_and_periods_merge(spark, tmp_path):
    s = store(spark, tmp_path)
    S.add(s, rows(spark, [("x", 1, 1, "p"), ("x", 1, 1, "q"), ("x", 2, 2, None), (None, 1, 5, "p"), ("n", 1, None, None),
                          ("x", None, 99, "z")]), "one")
    S.add(s, rows(spark, [("x", 2, 1, "p"), ("x", 4, 3, "r")]), "two")
    assert {tuple(r) for r in S.window(s).collect()} == {("x", 3, 3), (None, 1, 1), ("n", 0, 0)}
    assert {tuple(r) for r in S.window(s, 2, 3).collect()} == {("x", 2, 1)}
    assert tuple(S.window(s, by=[]).first()) == (4, 3)
    got = {tuple(r) for r in S.rolling(s, 2).collect()}
    assert got == {("x", 1, 1, 2), ("x", 2, 2, 2), ("x", 4, 1, 1), (None, 1, 1, 1), ("n", 1, 0, 0)}
    S.add(s, rows(spark, [("x", 4, 8, "r")]), "two")
    assert {tuple(r) for r in S.window(s, 2).collect()} == {("x", 2, 1)}
    S.add(s, rows(spark, []), "two")
    assert {r.year for r in S.rolling(s, 1).where("k = 'x'").collect()} == {1, 2}
    with pytest.raises(ValueError):
        S.add(s, rows(spark, []), "../x")
    with pytest.raises(ValueError):
        S.rolling(s, 0)


def test_estimates_are_within_their_error(spark, tmp_path):
    s = store(spark, tmp_path, lg_k=10)
    data = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        (F.col("id") % 4).cast("int").alias("year"), (F.col("id") % 30_011).alias("a"),
        (F.col("id") % 911).cast("string").alias("b"))
    for part in (0, 1):
        S.add(s, data.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), f"load{part}")
    exact = S.exact_rolling(data, ["k"], "year", ["a", "b"], 3)
    both = S.compared(exact, S.rolling(s, 3), ["k", "year"], ["a", "b"], lg_k=10).collect()
    assert len(both) == 8 * 4 and all(r.a_within and r.b_within for r in both)
    assert any(r.a != r.a_estimate for r in both)
    want = {(r.k, r.year): r.n for r in data.select("k", "a", F.explode(F.sequence("year", F.col("year") + 2)).alias("year"))
            .where("year < 4").groupBy("k", "year").agg(F.count_distinct("a").alias("n")).collect()}
    assert {(r.k, r.year): r.a for r in both} == want
    # a wrong estimate is told
    off = S.rolling(s, 3).withColumn("a", F.col("a") * 2)
    assert not any(r.a_within for r in S.compared(exact, off, ["k", "year"], ["a", "b"], lg_k=10).collect())
