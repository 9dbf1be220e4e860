"""JSON lists of any size and layout, read by byte ranges.

A file that holds one JSON list has no place where a reader could safely start, as it cannot know whether it is inside a
string or how deep. So the file is read twice, both times in ranges that are tasks of their own:

1. Each range but the last of a file tells how many quotes it has (an odd number turns inside and outside of strings over) and how much
   deeper it ends than it starts, for both cases. Sums over the ranges before give the state in which each range begins.
2. From that state a range finds the brackets and commas on the level of the list, and hands out the elements that begin
   in it, reading on beyond its end for the last one. Elements are parsed by Spark's own JSON functions.

A file of one range needs only the second step. Memory is a chunk and the longest element; the sums are one small row for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .files import open_path

#: Bytes of a range, and of a piece that is looked at at once.
RANGE, CHUNK = 64 << 20, 4 << 20
#: Bytes read at once beyond the end of a range, for the rest of its last element; twice as many each time.
BEYOND = 64 << 10
#: Bytes of elements in one batch.
BATCH = 8 << 20

# The bytes that matter outside of strings, what they do to the depth, and white space.
QUOTE, BACKSLASH, COMMA = 34, 92, 44
_DELTA = np.zeros(256, np.int64)
_DELTA[[91, 123]] = 1
_DELTA[[93, 125]] = -1
_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[[QUOTE, COMMA, 91, 93, 123, 125]] = True
SPACE = b" \t\r\n"
BOM = b"\xef\xbb\xbf"


def structure(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of structural bytes that no backslash hides, whether an odd number of quotes comes before each, and whether
    the byte after the piece is escaped."""
    at = np.flatnonzero(_STRUCTURAL[data])
    slashes = np.flatnonzero(data == BACKSLASH)
    after = False
    if len(slashes) or escaped:
        # an odd run of backslashes escapes the byte after it; an escaped first byte that is one starts no run
        if escaped and len(slashes) and slashes[0] == 0:
            slashes = slashes[1:]
        heads = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        lengths = np.diff(np.append(heads, len(slashes)))
        hidden = (slashes[heads] + lengths)[lengths % 2 == 1]
        if escaped:
            hidden = np.append(hidden, 0)
        after = bool(len(hidden) and (hidden == len(data)).any())
        at = np.setdiff1d(at, hidden, assume_unique=True) if len(hidden) else at
    quotes = data[at] == QUOTE
    return at, (np.cumsum(quotes) - quotes) % 2 == 1, after


def _escaped_at(stream, start: int) -> bool:
    """Whether an odd run of backslashes ends just before a position."""
    run, end = 0, start
    while end > 0:
        begin = max(0, end - 4096)
        stream.seek(begin)
        block = stream.read(end - begin)
        tail = len(block) - len(block.rstrip(b"\\"))
        run += tail
        if tail < len(block):
            break
        end = begin
    return run % 2 == 1


def _pieces(stream, start: int, end: int, beyond: bool = False) -> Iterator[tuple[int, bytes]]:
    """The bytes up to the end of a range and, if asked for, those after it."""
    stream.seek(start)
    at, more = start, BEYOND
    while at < end or beyond:
        block = stream.read(min(CHUNK, end - at if at < end else more))
        if not block:
            return
        yield at, block
        more = more if at < end else 2 * more
        at += len(block)


def summary(stream, start: int, end: int) -> tuple[bool, int, int]:
    """Whether the quotes of a range are odd, and how much deeper it ends if it starts outside or inside of a string."""
    escaped, odd, outside, inside = _escaped_at(stream, start), False, 0, 0
    for _, block in _pieces(stream, start, end):
        data = np.frombuffer(block, np.uint8)
        at, after_odd, escaped = structure(data, escaped)
        delta = _DELTA[data[at]]
        turned = after_odd != odd
        outside += int(delta[~turned].sum())
        inside += int(delta[turned].sum())
        odd ^= bool(np.count_nonzero(data[at] == QUOTE) % 2)
    return odd, outside, inside


def _opening(stream, path: str) -> int | None:
    """Where the list of a file opens; a blank file has none, all else is an error."""
    for offset, block in _pieces(stream, 0, 0, beyond=True):
        text = (block.removeprefix(BOM) if offset == 0 else block).lstrip(SPACE)
        if text:
            if text[0] != 91:
                raise ValueError(f"expected a list at top level: {path}")
            return offset + len(block) - len(text)
    return None


def elements(stream, path: str, start: int, end: int, in_string: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the list's elements that begin in a range."""
    closed = False
    if depth == 0:  # before the list, or after it
        opening = _opening(stream, path)
        if opening is None or opening >= end:
            return
        closed = opening < start
    escaped = _escaped_at(stream, start)
    parts: list[bytes] | None = None
    begin, opened = 0, False
    for offset, block in _pieces(stream, start, end, beyond=True):
        if offset >= end and parts is None:
            break
        data = np.frombuffer(block, np.uint8)
        at, odd, escaped = structure(data, escaped)
        free = at[odd == in_string]
        steps = _DELTA[data[free]]
        levels = depth + np.cumsum(steps)
        marks = np.flatnonzero(np.where(steps < 0, levels <= 0, (levels == 1) & ((steps > 0) | (data[free] == COMMA))))
        last = 0
        for p, level in zip(free[marks].tolist(), levels[marks].tolist()):
            if closed or block[p:p + 1] not in b"[,]":
                raise ValueError(f"more than one list, or no list: {path}, byte {offset + p}")
            if parts is not None:
                parts.append(block[last:p])
                text = b"".join(parts).strip(SPACE)
                if text:
                    yield begin, text
                elif not (opened and level == 0):
                    raise ValueError(f"empty element: {path}, byte {begin}")
                parts = None
            last, closed = p + 1, level == 0
            if offset + p >= end:
                return
            if level == 1:
                parts, begin, opened = [], offset + p + 1, block[p] != COMMA
        if parts is not None:
            parts.append(block[last:])
        elif closed and block[last:].strip(SPACE):
            raise ValueError(f"text after the list: {path}")
        depth = int(levels[-1]) if len(levels) else depth
        in_string ^= bool(np.count_nonzero(data[at] == QUOTE) % 2)
    else:
        if not closed:
            raise ValueError(f"list without an end: {path}")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            system, place = open_path(path)
            with system.open_input_file(place) as stream:
                rows.append(summary(stream, start, end))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("start"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.bool_(), pa.int64(), pa.int64())))], ["path", "start", "odd", "outside", "inside"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source_path", "source_file", "source_start", "element"]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], names)

    for batch in batches:
        for r in batch.to_pylist():
            rows, size = [], 0
            system, place = open_path(r["path"])
            with system.open_input_file(place) as stream:
                for at, text in elements(stream, r["path"], r["start"], r["end"], r["in_string"], r["depth"]):
                    rows.append((r["source_path"], r["source_file"], at, text.decode()))
                    size += len(text)
                    if size > BATCH:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)


def file_ranges(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """``path, source_path, source_file, start, end, length``: the files in ranges; only names and sizes are listed."""
    files = spark.read.format("binaryFile").load(paths).select(
        "path", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"), "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    return files.where("length > 0").select("*", F.explode(starts).alias("start")).withColumn(
        "end", F.least(F.col("start") + size, F.col("length")))


def with_states(ranges: DataFrame) -> DataFrame:
    """The ranges with ``in_string`` and ``depth`` at their start."""
    tails = ranges.where("end < length")
    told = _spread(tails.select("path", "start", "end")).mapInArrow(
        _summaries, "path string, start long, odd boolean, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.join(cut_lineage(told), ["path", "start"], "left")
    rows = rows.withColumn("in_string", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    return rows.withColumn("depth", F.coalesce(F.sum(deeper).over(before), F.lit(0))).drop("odd", "outside", "inside")


def _spread(ranges: DataFrame) -> DataFrame:
    """The ranges over tasks of ``RANGE`` bytes, or of less to give each core work, 10,000 tasks at most; the planner would put
    the small rows into one."""
    n, size = ranges.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(4 * cores, -(-(size or 0) // RANGE)), 10_000)))


def read(spark: SparkSession, paths: list[str], schema: str, size: int = RANGE) -> DataFrame:
    """The elements of the lists as rows, with the file and the offset they come from. A file that holds something else, or an
    element that does not fit the schema, is an error."""
    ranges = cut_lineage(with_states(cut_lineage(file_ranges(spark, paths, size))))
    found = _spread(ranges).mapInArrow(
        _elements, "source_path string, source_file string, source_start long, element string")
    row = F.from_json("element", schema, {"mode": "FAILFAST"}).alias("r")
    return found.select(row, "source_path", "source_file", "source_start").select("r.*", "source_path", "source_file", "source_start")
