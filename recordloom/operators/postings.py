"""A stored token index over the text columns of many tables.

``add`` cuts the named columns of some tables into tokens and stores one posting per token and cell,
``(token, table_name, record_id, column_name, row, positions)``, plus the distinct tokens with their counts.
Postings lie in buckets by the hash of their token and are sorted by token, so that looking up a token reads one
bucket and, by its statistics, a few row groups of it; the texts are never read again. A load is a *batch*
of its own: adding the next file touches no other batch, adding one again replaces it.

``search`` answers substring queries from the index: what a name contains is looked for in the
vocabulary first, which is small next to the texts, and the words of a phrase are then tied by their
positions. ``unknown`` says which tokens occur nowhere, as a look-up by key.

The positions of a token in a cell are gathered while the cell is cut, so that a word is shuffled and stored once
per cell however often it is repeated. Buckets of much text are dealt by row into several files, each sorted by token;
so a token that most records hold is spread over them, and nothing is gathered per token.

Tokens are lower-cased runs without white space unless ``tokens`` says otherwise. Null and empty cells have
none; equal rows count as one; an empty table adds nothing. A search for nothing but white space is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: white space is the blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
POSTINGS = ("token string, table_name string, record_id string, column_name string, row long, positions array<int>, "
            "batch string, bucket int")
VOCABULARY = "token string, n_occurrences long, batch string, bucket int"
PLACE = ["table_name", "record_id", "column_name", "row"]
#: Characters of text whose postings share the files of one deal.
DEAL_CHARS = 256 << 20


def words(text: Column) -> Column:
    """Runs without white space, lower-cased."""
    return F.array_remove(F.split(F.lower(text), SPACE), "")


@dataclass(frozen=True)
class TokenIndex:
    """A stored index: its folder and the number of buckets it was made with."""
    spark: SparkSession
    path: str
    buckets: int = 64

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _stored(self, part: str, schema: str) -> DataFrame:
        place = f"{self.path}/{part}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place)

    def postings(self) -> DataFrame:
        return self._stored("postings", POSTINGS)

    def vocabulary(self) -> DataFrame:
        return self._stored("vocabulary", VOCABULARY)


def add(index: TokenIndex, tables: dict[str, tuple[DataFrame, str, list[str]]], batch: str,
        tokens: Callable[[Column], Column] = words) -> None:
    """Store the postings of one batch; a batch of that name is replaced.

    ``tables`` maps a table name to (frame, id column, text columns).
    """
    if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"a batch is named by letters, digits, dots, dashes and underscores: {batch!r}")
    cut, n_chars = [], 0
    for name, (df, ident, columns) in tables.items():
        cells = [F.col(f"`{c}`").cast("string") for c in columns]
        ident = F.col(f"`{ident}`").cast("string")
        n_chars += df.agg(F.sum(reduce(Column.__add__, [F.coalesce(F.length(c), F.lit(0)).cast("long") for c in cells]))
                          ).first()[0] or 0
        cut.append(df.select(
            F.lit(name).alias("table_name"), ident.alias("record_id"),
            # what a row holds names it, so that a task run twice gives the same postings
            F.xxhash64(ident, *cells).alias("row"),
            F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), tokens(cell).alias("tokens"))
                                for c, cell in zip(columns, cells)])).alias("cell"))
            .select("table_name", "record_id", "cell.column_name", "row", "cell.tokens"))
    rows = reduce(DataFrame.unionByName, cut).mapInArrow(_positions, (
        "token string, table_name string, record_id string, column_name string, row long, positions array<int>"))
    deals = F.lit(max(1, -(-n_chars // DEAL_CHARS)))
    place = f"{index.path}/postings/batch={batch}"
    (rows.withColumn("bucket", index.bucket(F.col("token"))).withColumn("_deal", F.pmod("row", deals))
     .repartition("bucket", "_deal").drop("_deal").sortWithinPartitions("bucket", "token", "row")
     .write.mode("overwrite").partitionBy("bucket").parquet(place))
    stored = index.spark.read.schema(POSTINGS.replace("batch string, ", "")).parquet(place)
    (stored.groupBy("bucket", "token").agg(F.sum(F.size("positions")).alias("n_occurrences"))
     .select("token", "n_occurrences", "bucket")
     .repartition("bucket").sortWithinPartitions("bucket", "token")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/vocabulary/batch={batch}"))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per cell and distinct token, with its positions in ascending order."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            batch = whole.slice(begin, 256)
            tokens = batch.column("tokens").fill_null([])
            words = tokens.flatten().dictionary_encode()
            sizes = tokens.value_lengths().to_numpy()
            code = words.indices.to_numpy(zero_copy_only=False).astype("int64")
            cell = np.repeat(np.arange(len(sizes)), sizes)
            key = cell * (len(words.dictionary) + 1) + code
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            position = np.arange(len(cell)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype("int32")),
                                             pa.array(position[order].astype("int32")))
            first = order[heads]
            places = batch.select(PLACE).take(pa.array(cell[first]))
            token = words.dictionary.take(pa.array(code[first]))
            yield pa.RecordBatch.from_arrays([token, *places.columns, lists], ["token", *PLACE, "positions"])


def lookup(index: TokenIndex, tokens: DataFrame) -> DataFrame:
    """The postings of the tokens in the column ``token``; only their buckets are read."""
    wanted = tokens.select("token").distinct().withColumn("bucket", index.bucket(F.col("token")))
    return index.postings().join(wanted, ["bucket", "token"], "left_semi")


def occurrences(index: TokenIndex, token: str) -> DataFrame:
    """The postings of one token, with bucket and token as filters of the scan."""
    value = F.lit(token)
    number = index.spark.range(1).select(index.bucket(value).alias("b")).first()["b"]
    return index.postings().where((F.col("bucket") == number) & (F.col("token") == value))


def search(index: TokenIndex, needle: str) -> DataFrame:
    """Where a name occurs: one row per table, record and column that holds it, case aside.

    The name may begin and end inside a word; any run of white space counts as one blank.
    """
    parts = [p for p in re.split(SPACE, needle.lower()) if p]
    if not parts:
        raise ValueError("nothing to search for")
    last = len(parts) - 1
    found = None
    for k, part in enumerate(parts):
        if 0 < k < last:
            hits = occurrences(index, part)
        else:
            token = F.col("token")
            fits = (F.contains(token, F.lit(part)) if last == 0 else
                    F.endswith(token, F.lit(part)) if k == 0 else F.startswith(token, F.lit(part)))
            hits = lookup(index, index.vocabulary().where(fits))
        if last == 0:
            found = hits
            break
        hits = hits.select(*PLACE, F.explode("positions").alias("at")).select(
            *PLACE, (F.col("at") - k).alias("start")).distinct()
        found = hits if found is None else found.join(hits, [*PLACE, "start"], "left_semi")
    return found.select("table_name", "record_id", "column_name").distinct()


def unknown(index: TokenIndex, tokens: DataFrame) -> DataFrame:
    """The distinct tokens of the column ``token`` that occur in no indexed cell."""
    wanted = tokens.select("token").where("token IS NOT NULL").distinct().withColumn(
        "bucket", index.bucket(F.col("token")))
    return wanted.join(index.vocabulary().select("bucket", "token"), ["bucket", "token"], "left_anti").select("token")


def frequent(index: TokenIndex, n: int) -> DataFrame:
    """The ``n`` most frequent tokens of all batches, equal counts by token."""
    return index.vocabulary().groupBy("token").agg(F.sum("n_occurrences").alias("n_occurrences")).orderBy(
        F.desc("n_occurrences"), "token").limit(n)
