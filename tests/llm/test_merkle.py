import hashlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def reduce(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def beside(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        at //= fanout
    return out


def brute(rows, fanout):
    """(key, group, text) -> sorted (key, leaf, subroot, root, steps)."""
    groups = {}
    for key, group, text in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf(key, group, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [reduce([x[2] for x in sorted(groups[g])], fanout) for g in names]
    top = reduce([t[-1][0] for t in trees], fanout)
    return sorted(((k if some else None, own, t[-1][0], top[-1][0], beside(t, i, fanout) + beside(top, g, fanout))
                   for g, (name, t) in enumerate(zip(names, trees)) for i, (some, k, own) in enumerate(sorted(groups[name]))), key=str)


def proofs(spark, rows, fanout, every):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    manifest = merkle.build(docs, ["doc_id", "lang", "text"], fanout=fanout, every=every)
    got = merkle.proofs(manifest).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert all(r.folded == manifest.root for r in got)
    return manifest, sorted(((r.key, r.leaf, r.subroot, manifest.root, [tuple(s) for s in r.steps]) for r in got), key=str)


ROWS = [(i * 7 % 101, "hot" if i % 4 else f"l{i % 9}", f"text {i}" * (i % 5)) for i in range(90)] + [
    (None, None, None), (None, "hot", "a"), (None, "hot", "b"), (5, "hot", "again"), (5, "hot", "again"), (7, "", ""), (8, "é", None), (9, "lone", "x")]


@pytest.mark.parametrize("fanout,every", [(2, 1), (2, 3), (3, 2), (8, 1), (8, 3)])
def test_agrees_with_the_definition(spark, fanout, every):
    assert proofs(spark, ROWS, fanout, every)[1] == brute(ROWS, fanout)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_group_of_a_size(spark, n):
    rows = [(i, "a", str(i)) for i in range(n)]
    manifest, got = proofs(spark, rows, 8, 1)
    assert got == brute(rows, 8)
    assert (manifest.root == got[0][1]) == (n == 1)


def test_only_every_level_is_stored(spark):
    manifest, _ = proofs(spark, [(i, "a", str(i)) for i in range(70)], 2, 3)
    sizes = [level.agg(F.sum(F.size("nodes"))).first()[0] for level in manifest.levels]
    assert sizes == [70, 9, 2, 1]
    assert all(level.agg(F.max(F.size("nodes"))).first()[0] <= 8 for level in manifest.levels)


def test_a_changed_row_does_not_verify(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, text string")
    shown = merkle.leaf_of(F.col("doc_id"), F.col("lang"), F.upper("text"))
    manifest = merkle.build(docs, ["doc_id", "lang", "text"], carried=shown)
    for r in merkle.proofs(manifest).withColumn("folded", merkle.fold(F.col("carried"), F.col("steps"))).collect():
        assert (r.folded == manifest.root) == (r.carried == r.leaf)


def test_an_empty_table(spark):
    manifest, got = proofs(spark, [], 8, 3)
    assert manifest.root is None and got == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5, "y", "z")], "doc_id long, lang string, text string, at int, hash string, nodes string")
    manifest = merkle.build(docs, ["doc_id", "at", "hash", "nodes"])
    assert manifest.root == leaf(1, 5, "y", "z")


def test_rows_of_one_key_are_spread(spark):
    """Ranges cut within a key, and between equal rows."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("lang"), F.lit("t").alias("text"))
    manifest = merkle.build(rows, ["doc_id", "lang", "text"])
    same = leaf(1, "a", "t")
    assert manifest.root == reduce([same] * 4000, 8)[-1][0]
