"""Merkle manifest of a table: one root for all rows, a short proof for each.

A row's leaf is the SHA-256 of its named columns. Within a group, leaves ascend by key; every ``fanout`` consecutive nodes
become their digest, level by level, until one is left, the group's subroot. Subroots, ordered by group, make the
root in the same way.

Checkpoint and recompute: only every ``every``-th level is stored, packed by aligned subtree (with 8 and 3, the 512 nodes
under one node of the next stored level are one row). Nothing in between is kept. ``proofs`` goes down the
stored levels: for each packed row it regenerates the two missing levels from the stored descendants, emits the siblings
of all its nodes, and appends what the row's own node has above it. The interior nodes live as long as the row.

Positions are found without gathering a group: leaves are range-sorted over group, key and leaf, numbered within their
partition, and moved up by prefix sums of the counts per partition and group. So a group that holds most rows is
spread over all tasks, and so is a key that repeats. A packed row has ``fanout ** every`` nodes at most, whatever the size of the
group. The number of rounds is the logarithm of the largest group.

All of it is DataFrame code. Digests are hex text and concatenated as such.

Edge cases: a null key sorts first within its group, a null group is a group of its own and comes first; rows of one key go by
their leaf, equal rows by nothing that shows; a null in a column differs from the empty text; a last run of one node
is digested alone; a lone leaf is its own subroot; an empty table has no row and a null root. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm.common import let
from recordloom.session import cut_lineage

#: Row numbers within a partition are the lower bits of Spark's increasing ids.
_ROW_BITS = 33
_STEPS = "array<struct<before:string,after:string>>"


def leaf_of(*columns: Column) -> Column:
    """The digest of the values: ``-`` for a null, else the length in bytes, a colon and the value as text."""
    def written(value):
        s = value.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[written(c) for c in columns]), 256)


def digest(nodes: Column) -> Column:
    """The digest of nodes in a row."""
    return F.sha2(F.array_join(nodes, ""), 256)


@dataclass
class Manifest:
    """``root`` of a table and what is stored to prove rows.

    ``levels[s]`` holds level ``s * every``, packed: ``group, total`` (nodes of the group on this level), ``block``
    (position among the packed rows of the group) and ``nodes``, an array of ``hash`` and, on level 0, ``key`` and ``carried``.
    """

    root: str | None
    fanout: int
    every: int
    levels: list[DataFrame]
    top: "Manifest | None"

    @property
    def subroots(self) -> DataFrame:
        """``group, subroot``."""
        return self.levels[-1].select("group", F.col("nodes")[0]["hash"].alias("subroot"))


def _numbered(leaves: DataFrame) -> DataFrame:
    """``group, key, hash, carried`` -> with the position ``at`` in the group and the group's ``total``."""
    # equal rows can be told apart by a stored number, so that ranges can cut between them
    rows = cut_lineage(leaves.withColumn("_row", F.monotonically_increasing_id()))
    order = ["group", "key", "hash", "_row"]
    sorted_ = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
        .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    runs = sorted_.groupBy("group", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("group", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                       F.sum("_n").over(Window.partitionBy("group")).alias("total"))
    runs = runs.withColumnsRenamed({"group": "_group"})
    return sorted_.join(runs, F.col("group").eqNullSafe(F.col("_group")) & (part == F.col("_part"))).select(
        "group", "key", "hash", "carried", "total", (F.col("_before") + F.col("_id") - F.col("_first")).alias("at"))


def _packed(nodes: DataFrame, width: int) -> DataFrame:
    """``group, total, at`` and the columns of a node -> one row per aligned subtree of ``width`` nodes."""
    inside = [c for c in nodes.columns if c not in ("group", "total", "at")]
    packed = nodes.groupBy("group", "total", F.expr(f"at div {width}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", *inside))).alias("_nodes"))
    return packed.select("group", "total", "block", F.transform(
        "_nodes", lambda x: F.struct(*[x[c].alias(c) for c in inside])).alias("nodes"))


def _level_size(total: Column, fanout: int, level: int) -> Column:
    """Nodes of the group ``level`` levels above."""
    return F.ceil(total / F.lit(fanout ** level)).cast("long")


def _level_up(nodes: Column, fanout: int, several: Column) -> Column:
    """The digests of the runs of nodes, or the nodes where the group has no further level."""
    runs = F.sequence(F.lit(0), F.expr("-1") + F.ceil(F.size(nodes) / F.lit(fanout)).cast("int"))
    return F.when(several, F.transform(
        runs, lambda i: digest(F.slice(nodes, i * fanout + 1, F.lit(fanout))))).otherwise(nodes)


def _hashes(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: x["hash"])


def _interior(total: Column, nodes: Column, fanout: int, every: int) -> list[Column]:
    """The digests on the levels of a packed row, from the stored one to the next stored one."""
    levels = [nodes]
    for k in range(every):
        levels.append(_level_up(levels[-1], fanout, _level_size(total, fanout, k) > 1))
    return levels


def _tree(leaves: DataFrame, fanout: int, every: int) -> list[DataFrame]:
    width = fanout ** every
    levels = [cut_lineage(_packed(_numbered(leaves), width))]
    while not levels[-1].where("total > 1").isEmpty():
        below = levels[-1]
        h = _hashes(F.col("nodes"))
        for k in range(every):
            several = _level_size(F.col("total"), fanout, k) > 1
            h = let(h, lambda x: _level_up(x, fanout, several))  # noqa: B023
        # inside a lambda, "total" would be the new column of that name if it were made in the same step
        up = below.withColumn("_hash", F.get(h, F.lit(0))).select(
            "group", _level_size(F.col("total"), fanout, every).alias("total"), F.col("block").alias("at"),
            F.col("_hash").alias("hash"))
        levels.append(cut_lineage(_packed(up, width)))
    return levels


def build(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", fanout: int = 8, every: int = 3,
          carried: Column | None = None) -> Manifest:
    """The manifest of the table. ``carried`` is any value that proofs should come with."""
    extra = F.lit(None).cast("string") if carried is None else carried
    levels = _tree(docs.select(F.col(group).alias("group"), F.col(key).alias("key"),
                               leaf_of(*[F.col(c) for c in columns]).alias("hash"), extra.alias("carried")), fanout, every)
    none = F.lit(None).cast("string")
    subroots = levels[-1].select(F.lit(0).alias("group"), F.col("group").alias("key"),
                                 F.col("nodes")[0]["hash"].alias("hash"), none.alias("carried"))
    above = _tree(subroots, fanout, every)
    root = above[-1].select(F.col("nodes")[0]["hash"]).first()
    top = Manifest(root and root[0], fanout, every, above, None)
    return Manifest(top.root, fanout, every, levels, top)


def _steps(total: Column, levels: list[Column], at: Column, fanout: int) -> Column:
    """What stands beside the node on each level of its packed row, up to the next stored level."""
    steps = []
    for k, nodes in enumerate(levels[:-1]):
        own = F.floor(at / F.lit(fanout ** k)).cast("int")
        first = (own - own % fanout).cast("int")
        beside = F.struct(
            F.array_join(F.slice(nodes, first + 1, own - first), "").alias("before"),
            F.array_join(F.slice(nodes, own + 2, F.lit(fanout - 1) - (own - first)), "").alias("after"))
        steps.append(F.when(_level_size(total, fanout, k) > 1, beside))
    return F.filter(F.array(*steps), lambda x: x.isNotNull()).cast(_STEPS)


def _above(manifest: Manifest, lower: DataFrame) -> DataFrame:
    """Going down the stored levels: ``group, at`` of a stored node and the steps from it to the top.

    ``lower`` has ``group`` and the steps that follow after the group's last node.
    """
    beyond = lower.withColumns({"at": F.lit(0).cast("long")})
    for level in reversed(manifest.levels):
        beyond = _expanded(level, beyond, manifest).select(
            "group", (F.col("block") * manifest.fanout ** manifest.every + F.col("at")).alias("at"), "node", "steps")
        if level is not manifest.levels[0]:
            beyond = beyond.drop("node")
    return beyond


def _expanded(level: DataFrame, beyond: DataFrame, manifest: Manifest) -> DataFrame:
    """Each node of a stored level with its steps: those within its packed row, then those of the row's own node."""
    own = beyond.select(F.col("group").alias("_g"), F.col("at").alias("_at"), F.col("steps").alias("_beyond"))
    rows = level.join(own, F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_at")))
    total = F.col("total")
    h = _interior(total, _hashes(F.col("nodes")), manifest.fanout, manifest.every)
    # all interior levels of the row, computed once before its nodes are dealt out
    rows = rows.select("group", "total", "block", "_beyond", "nodes", F.array(*h).alias("_h"))
    one = rows.select("group", "total", "block", "_beyond", "_h", F.posexplode("nodes").alias("at", "node"))
    levels = [F.col("_h")[k] for k in range(manifest.every + 1)]
    return one.select("group", "block", "at", "node", F.concat(
        _steps(total, levels, F.col("at"), manifest.fanout), "_beyond").alias("steps"))


def proofs(manifest: Manifest) -> DataFrame:
    """Per row of the table: ``group, key, leaf, carried, subroot`` and ``steps``, what to put before and after a
    node on each level up to the root."""
    start = manifest.top.levels[-1].select("group", F.array().cast(_STEPS).alias("steps"))
    groups = _above(manifest.top, start).select(F.col("node.key").alias("group"), "steps", F.col("node.hash").alias("subroot"))
    # few and small: one row per group
    groups = cut_lineage(groups)
    rows = _above(manifest, groups.select("group", "steps"))
    subroots = groups.select(F.col("group").alias("_g"), "subroot")
    return rows.join(subroots, F.col("group").eqNullSafe(F.col("_g"))).select(
        "group", F.col("node.key").alias("key"), F.col("node.hash").alias("leaf"),
        F.col("node.carried").alias("carried"), "subroot", "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
