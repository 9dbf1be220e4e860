"""JSON lists read by byte ranges, against a plain parser; XML files of several roots in one pass."""

import io
import json
import random

import pytest

from recordloom import schema
from recordloom.sources import json_ranges, readers

TRICKY = ['a', '"', '\\', '\\"', 'x],[{"y', 'é中😀', '', '\\\\', '{', 'a,b', ' \t', '\\u0022']


def random_list(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice(TRICKY) * rng.randrange(1, 4)
    if kind == 1:
        return rng.randrange(-5, 5)
    if kind == 2:
        return rng.choice([None, True, 1.5])
    if kind == 3:
        return [random_list(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TRICKY) + str(i): random_list(rng, depth + 1) for i in range(rng.randrange(4))}


def by_ranges(data: bytes, size: int):
    """What the two steps find, without Spark."""
    starts = list(range(0, len(data), size))
    odd, depth, out = False, 0, []
    for start in starts:
        end = min(start + size, len(data))
        out += list(json_ranges.elements(io.BytesIO(data), "f", start, end, odd, depth))
        turned, outside, inside = json_ranges.summary(io.BytesIO(data), start, end)
        depth += inside if odd else outside
        odd ^= turned
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_any_cut_gives_the_elements(monkeypatch, seed, chunk):
    monkeypatch.setattr(json_ranges, "CHUNK", chunk)
    rng = random.Random(seed)
    values = [random_list(rng) for _ in range(rng.randrange(8))]
    data = json.dumps(values, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < .5).encode()
    data = rng.choice([b"", b" \n", json_ranges.BOM]) + data + rng.choice([b"", b"\n "])
    for size in (1, 2, 3, 7, 50, 10_000):
        found = by_ranges(data, size)
        assert [json.loads(text) for _, text in found] == values, size
        assert all(data[at:].lstrip().startswith(text) for at, text in found)


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2", "[1] 2", "[1,,2]", "[1,]", '["a]', "[1]]", "[[1]", "1", "[1}", '[{"a": 1}] [2]'])
def test_what_is_no_list_is_an_error(text):
    for size in (1, 4, 100):
        with pytest.raises(ValueError):
            by_ranges(text.encode(), size)


def test_blank_files_have_no_rows():
    assert by_ranges(b" \n ", 1) == [] and by_ranges(b"[ ]", 1) == [] and by_ranges(b"", 1) == []


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_same_rows_as_whole_files(spark, tmp_path, size):
    for k in range(3):
        (tmp_path / f"f {k}.json").write_text(json.dumps([{"value": f"{i} \"x\\", "name": None if i % 3 else "né[,]"} for i in range(40 * k)]))
    (tmp_path / "empty.json").write_text("")
    path = str(tmp_path / "*.json")
    got = readers.read_json_array(spark, path, schema.LOOKUP, size=size)
    want = spark.read.schema(schema.LOOKUP).option("multiLine", True).json(path)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    first = got.groupBy("source_path").count().orderBy("source_path").collect()
    assert [r["count"] for r in first] == [40, 80] and "f%20" in first[0].source_path


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"value": str(i)} for i in range(5000)]))
    got = readers.read_json_array(spark, str(tmp_path / "one.json"), schema.LOOKUP, size=8192)
    from pyspark.sql import functions as F
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert got.count() == 5000


def test_elements_that_do_not_fit_fail(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"value": "a"}, 5]')
    with pytest.raises(Exception):
        readers.read_json_array(spark, str(tmp_path / "bad.json"), schema.LOOKUP).collect()


def test_xml_roots_in_one_pass(spark, tmp_path):
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- LOBBYINGDISCLOSURE1 -->\n'
    (tmp_path / "a.xml").write_text(head + "<LOBBYINGDISCLOSURE2><senateID>1-2</senateID></LOBBYINGDISCLOSURE2>")
    (tmp_path / "b.xml").write_text("<LOBBYINGDISCLOSURE1><senateID>3</senateID></LOBBYINGDISCLOSURE1>")
    (tmp_path / "cut.xml").write_text("<LOBBYINGDISCLOSURE1><senateID>3</sena")
    (tmp_path / "none.xml").write_text("not xml")
    (tmp_path / "other.xml").write_text("<OTHER><senateID>4</senateID></OTHER>")
    good, broken = readers.read_xml_dir(spark, [str(tmp_path)], schema.HOUSE_FILING)
    assert sorted((r.source_file, r.doc_type, r.senateID) for r in good.collect()) == [("a.xml", "LD2", "1-2"), ("b.xml", "LD1", "3")]
    assert sorted(r.source_file for r in broken.collect()) == ["cut.xml", "none.xml"]


def test_a_small_range_reads_little_beyond_its_end(spark, tmp_path):
    text = b"[" + b",".join(b'{"a": %d}' % k for k in range(200_000)) + b"]"

    class Counted(io.BytesIO):
        bytes_read = 0

        def read(self, n=-1):
            block = super().read(n)
            Counted.bytes_read += len(block)
            return block

    cut = text.index(b",", 1 << 19)
    stream = Counted(text)
    found = list(json_ranges.elements(stream, "x", cut, cut + 1000, False, 1))
    assert [at for at, _ in found] == [k + 1 for k in range(cut, cut + 1000) if text[k:k + 1] == b","]
    assert Counted.bytes_read < 2 * json_ranges.BEYOND  # 2.2 MB before
    # many small ranges share a task
    (tmp_path / "x.json").write_bytes(text)
    ranges = json_ranges.file_ranges(spark, [str(tmp_path / "x.json")], 1 << 10)
    cores = spark.sparkContext.defaultParallelism
    assert ranges.count() > 4 * cores and json_ranges._spread(ranges).rdd.getNumPartitions() == 4 * cores
