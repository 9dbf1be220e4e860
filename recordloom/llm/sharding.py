"""Shards from a lookup table that the shards fill by taking turns.

The table has a prime number of slots. Each shard prefers the slots in its own
permutation, ``offset + j * skip`` modulo the table size with both numbers from hashes of its
name. In turn, every shard claims the first slot of its permutation that is still free.
All shards end up with the same number of slots (give or take one), and when a shard goes or comes,
few other slots change hands.

The table has ``slots`` rows of two integers, a size that does not depend on the data, so it is
broadcast; a document's slot is a hash of its key, and its shard one lookup.

Edge cases: a null key goes to the slot of its hash like any other; repeated rows go to one
shard; empty tables give an empty result; a column named ``slot`` or ``shard`` is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import private

#: Prime, and over a hundred slots per shard up to 655 shards: loads differ by under 1 %.
SLOTS = 65537
#: A table of this many slots is 24 MB in memory; more would be a mistake.
MOST_SLOTS = 1_000_003


def _number(name: str, salt: str) -> int:
    return int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not _is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the number of slots must be a prime up to {MOST_SLOTS}")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shard names must be distinct, one at least and no more than slots")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def shard_names(n: int) -> list[str]:
    """``shard-00000`` and so on."""
    return [f"shard-{k:05d}" for k in range(n)]


def _table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    rows = list(enumerate(lookup_table(shards, slots)))
    return spark.createDataFrame(rows, "_slot int, shard int")


def place(docs: DataFrame, shards: Sequence[str] | int = 64, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """All rows with their ``slot`` and ``shard`` (its number in ``shards``)."""
    names = shard_names(shards) if isinstance(shards, int) else list(shards)
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")
    at, owner = private(docs.columns, "_at", "_slot")
    table = F.broadcast(_table(docs.sparkSession, names, slots).withColumnRenamed("_slot", owner))
    # the key is read before columns are replaced, since it may be one of them
    placed = docs.withColumn(at, slot).drop("slot", "shard")
    return placed.join(table, F.col(at) == F.col(owner)).drop(owner).withColumnRenamed(at, "slot")


def write_shards(placed: DataFrame, path: str, pieces: int = 1) -> None:
    """One folder per shard. ``pieces`` tasks write each shard, so a large shard is not one task's work."""
    piece = F.pmod(F.xxhash64(*placed.columns), F.lit(pieces))
    placed.repartition("shard", piece).write.partitionBy("shard").parquet(path)
