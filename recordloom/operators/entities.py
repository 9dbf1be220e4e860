"""One entity over several match keys and record kinds.

Clients, registrants and lobbyists match on more than one key: a bridge id, a normalised name,
a name with its ZIP code, an alternate id. Two records are one entity if a chain of such matches
ties them, so the canonical id is the closure over all keys, not the result of one pass.

``match_edges`` ties every record to the least record of each of its key values: as many rows as
there are (record, key) pairs, never all pairs of a key. ``closure`` then moves ties towards the
least record in two alternating steps (to larger neighbours, then to smaller ones), which
takes a number of rounds that grows with the logarithm of the longest chain. Minima are
combined before they are shuffled, and the joins are on the record, which the planner can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, discard


def record_id(kind: str, ident) -> Column:
    """The record's name among all kinds, ``kind:id``."""
    return F.concat(F.lit(f"{kind}:"), F.col(ident).cast("string") if isinstance(ident, str) else ident)


def key_rows(records: DataFrame, keys: dict[str, list[Column]], *, record: str = "record") -> DataFrame:
    """``record, key`` for each key of each record; a key with a null or empty part ties nothing.

    Key columns of one name tie records of all kinds that have it.
    """
    def value(name, parts):
        # parts as text of known length: ('a', 'bc') and ('ab', 'c') differ
        texts = [p.cast("string") for p in parts]
        whole = F.concat(F.lit(name), *[F.concat(F.lit("|"), F.length(p).cast("string"), F.lit(":"), p) for p in texts])
        known = reduce(lambda a, b: a & b, [p.isNotNull() & (p != "") for p in texts])
        return F.when(known, whole)

    all_keys = F.array_compact(F.array(*[value(name, parts) for name, parts in keys.items()]))
    return records.where(F.col(record).isNotNull()).select(
        F.col(record).alias("record"), F.explode(all_keys).alias("key")).distinct()


def match_edges(keyed: DataFrame) -> DataFrame:
    """``a, b`` (b the smaller): each record with the least record that shares a key value."""
    least = keyed.groupBy("key").agg(F.min("record").alias("b"))
    return keyed.join(least, "key").where(F.col("record") != F.col("b")).select(
        F.col("record").alias("a"), "b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of ties and sum of their hashes: equal as soon as a round moves nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``record, entity``: every record in ``edges`` with the least record that a chain of them reaches."""
    edges = cut_lineage(edges)
    state = _state(edges)
    for _ in range(most_rounds):
        # larger neighbours go to the least of all neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = cut_lineage(
            both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # a record and its smaller neighbours go to the least of these
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = cut_lineage(
            large.join(least, large["a"] == least["u"]).where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        discard(large)
        discard(edges)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"ties still move after {most_rounds} rounds")
    return edges.select(F.col("a").alias("record"), F.col("b").alias("entity")).unionByName(
        edges.select(F.col("b").alias("record"), F.col("b").alias("entity")).distinct())


def canonical_entities(records: list[tuple[DataFrame, dict[str, list[Column]]]], *, record: str = "record"
                       ) -> DataFrame:
    """``record, entity, n_records`` for all records of all kinds; one that matches nothing is its own entity.

    ``records`` lists a frame per kind with a column ``record`` (see ``record_id``) and the kind's keys.
    """
    keyed = cut_lineage(reduce(DataFrame.unionByName, [key_rows(df, keys, record=record) for df, keys in records]))
    ids = reduce(DataFrame.unionByName, [
        df.where(F.col(record).isNotNull()).select(F.col(record).alias("record")) for df, _ in records]).distinct()
    found = closure(match_edges(keyed))
    out = ids.join(found, "record", "left").select(
        "record", F.coalesce("entity", "record").alias("entity"))
    sizes = out.groupBy("entity").agg(F.count("*").alias("n_records"))
    return out.join(sizes, "entity").select("record", "entity", "n_records")


def with_entity(df: DataFrame, entities: DataFrame, record: Column, alias: str = "entity") -> DataFrame:
    """``df`` with the canonical id of its record; null where the record is unknown."""
    known = entities.select(F.col("record").alias("_entity_record"), F.col("entity").alias(alias))
    return df.join(known, record == F.col("_entity_record"), "left").drop("_entity_record")
