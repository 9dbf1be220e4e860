from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordloom.llm import sharding


def brute_table(names, slots):
    """Each turn the next shard takes its first free preference; preferences written out in full."""
    import hashlib
    number = lambda n, s: int(hashlib.sha256(f"{s}:{n}".encode()).hexdigest()[:15], 16)
    wishes = []
    for n in names:
        offset, skip = number(n, "offset") % slots, number(n, "skip") % (slots - 1) + 1
        wish = [(offset + j * skip) % slots for j in range(slots)]
        assert len(set(wish)) == slots
        wishes.append(wish)
    table, turn = {}, 0
    while len(table) < slots:
        k = turn % len(names)
        table[next(s for s in wishes[k] if s not in table)] = k
        turn += 1
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 13), (7, 101), (10, 499)])
def test_table(n, slots):
    names = sharding.shard_names(n)
    table = sharding.lookup_table(names, slots)
    assert table == brute_table(names, slots)
    loads = Counter(table)
    assert max(loads.values()) - min(loads.values()) <= 1 and len(loads) == n


def test_few_slots_move_when_a_shard_goes():
    names = sharding.shard_names(20)
    before, after = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    stayed = [(b, a) for b, a in zip(before, after) if b != 19]
    assert sum(a != b for b, a in stayed) < 0.1 * len(stayed)


def test_bad_parameters():
    for names, slots in ((["a"], 12), ([], 13), (["a", "a"], 13), (["a", "b", "c"], 2), (["a"], 15_485_863)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_placement(spark, tmp_path):
    rows = [(k, "t", 3) for k in range(3000)] + [(None, "x", 1), (None, "x", 1), (7, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    placed = sharding.place(docs, shards=5, slots=1009)
    found = placed.collect()
    assert placed.columns == ["doc_id", "text", "slot", "shard"] and len(found) == len(rows)
    table = brute_table(sharding.shard_names(5), 1009)
    assert all(table[r.slot] == r.shard for r in found)
    slots = {r.doc_id: r.slot for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1009)).alias("slot")).collect()}
    assert all(slots[r.doc_id] == r.slot for r in found)
    assert sharding.place(docs.where("false")).count() == 0
    by_name = sharding.place(docs, ["p", "q"], key="slot", slots=13)
    assert by_name.count() == len(rows)
    path = str(tmp_path / "out")
    sharding.write_shards(placed, path, pieces=2)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 5
