"""Canonical entities against a plain union-find."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import entities


def plain(edges):
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    return {x: find(x) for x in head}


@pytest.mark.parametrize("n, m", [(60, 20), (60, 55), (40, 200)])
def test_closure_of_random_ties(spark, n, m):
    rng = random.Random(m)
    ties = {tuple(sorted(rng.sample(range(n), 2), reverse=True)) for _ in range(m)}
    ties = [(f"r{a:03}", f"r{b:03}") for a, b in ties]
    got = {r.record: r.entity for r in entities.closure(spark.createDataFrame(ties, "a string, b string")).collect()}
    assert got == plain(ties)


def test_long_chain_takes_few_rounds(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    chain = [(f"r{max(p):03}", f"r{min(p):03}") for p in zip(order, order[1:])]
    got = entities.closure(spark.createDataFrame(chain, "a string, b string"), most_rounds=12).collect()
    assert len(got) == 200 and {r.entity for r in got} == {"r000"}


def test_kinds_keys_and_unknown_parts(spark):
    clients = spark.createDataFrame(
        [("c:1", "ACME", "100", None), ("c:2", "ACME", "200", "x9"), ("c:3", "ACME", None, None), (None, "ACME", "100", None),
         ("c:4", "", "100", None), ("c:1", "ACME", "100", None)], "record string, name string, zip string, alt string")
    firms = spark.createDataFrame([("f:1", "x9", "acme holding"), ("f:2", "x8", "acme holding")],
                                  "record string, alt string, name string")
    got = entities.canonical_entities([
        (clients, {"name_zip": [F.col("name"), F.col("zip")], "alt": [F.col("alt")]}),
        (firms, {"alt": [F.col("alt")], "firm": [F.col("name")]})])
    # f:2 and c:2 meet over two passes: firm name, then alternate id
    assert {tuple(r) for r in got.collect()} == {
        ("c:1", "c:1", 1), ("c:3", "c:3", 1), ("c:4", "c:4", 1), ("c:2", "c:2", 3), ("f:1", "c:2", 3), ("f:2", "c:2", 3)}
    seen = entities.with_entity(spark.createDataFrame([(1, "f:2"), (2, "?")], "id int, r string"), got, F.col("r"))
    assert {(r.id, r.entity) for r in seen.collect()} == {(1, "c:2"), (2, None)}


def test_key_parts_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "x", "yz"), ("b", "xy", "z")], "record string, p string, q string")
    got = entities.canonical_entities([(df, {"k": [F.col("p"), F.col("q")]})])
    assert got.select("entity").distinct().count() == 2
    assert entities.canonical_entities([(df.limit(0), {"k": [F.col("p")]})]).count() == 0
