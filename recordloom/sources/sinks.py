"""Writers: keyed append, full refresh, file ledger, manifest, exports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.shape import keep_first
from .files import sha256_of

LEDGER = ("source_id string, file_path string, file_sha256 string, row_count bigint, "
          "ingested_at timestamp, load_batch string")
STREAM = "stream-"
MANIFEST = "source string, url string, as_of string, row_count bigint"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_if_there(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A Parquet table, or ``None`` if there is nothing at the path yet, or a folder that only writes without rows
    have left; a table that cannot be read is an error."""
    if not exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def only_new(batch: DataFrame, stored: DataFrame | None, key: str | None, order: list[Column],
             ) -> DataFrame:
    """The rows of a batch to append: the first row per key, and no key stored already.

    Rows whose key is null are not comparable and all kept. Without a key every
    row is new.
    """
    if key is None:
        return batch
    keyed = keep_first(batch.where(F.col(key).isNotNull()), key, order)
    if stored is not None:
        keyed = keyed.join(stored.select(key), key, "left_anti").select(*batch.columns)
    return keyed.unionByName(batch.where(F.col(key).isNull()))


def append_dedup(batch: DataFrame, path: str, key: str | None, order: list[Column], *,
                 partition_by=(), drop=()) -> None:
    """Append the new rows of a batch to a Parquet table."""
    stored = read_if_there(batch.sparkSession, path)
    rows = only_new(batch, stored, key, order).drop(*drop)
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_load(df: DataFrame, path: str, source: str, batch: str) -> None:
    """Append the rows of one load to a table without a key.

    Rows name their file (``load_file``) and load. Which load counts for a file is in the ledger, so rows of
    a load that failed, or of an earlier state of a file, stay unseen.
    """
    df.withColumns({"load_source": F.lit(source), "load_batch": F.lit(batch)}).write.mode("append").partitionBy(
        "load_source", "load_batch").parquet(path)


def replace_batch(df: DataFrame, path: str, source: str, batch: str) -> None:
    """Write one batch of a stream to a table without a key, in place of an earlier try of the batch."""
    full_refresh(df, f"{path}/load_source={source}/load_batch={STREAM}{batch}")


def current_loads(spark: SparkSession, ledger_path: str, limited_path: str) -> DataFrame | None:
    """The load that counts for each file: the last complete one, or else the last limited one."""
    parts = [(read_if_there(spark, p), complete) for p, complete in ((ledger_path, 1), (limited_path, 0))]
    rows = None
    for df, complete in parts:
        if df is not None:
            part = df.withColumn("_c", F.lit(complete))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    return rows.groupBy("source_id", "file_path").agg(
        F.max_by("load_batch", F.struct("_c", "ingested_at")).alias("load_batch"))


def visible(stored: DataFrame, loads: DataFrame | None) -> DataFrame:
    """The rows of a table without a key that belong to a stream or to the load that counts for their file."""
    streamed = stored.where(F.col("load_batch").startswith(STREAM))
    if loads is None:
        return streamed
    own = (stored["load_source"] == loads["source_id"]) & (stored["load_batch"] == loads["load_batch"]) & (
        stored["load_file"] == loads["file_path"])
    return streamed.unionByName(stored.join(loads, own, "left_semi"))


def full_refresh(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace a table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def laid_out(df: DataFrame, table: str, *, bucket_by: str, buckets: int, sort_by=None,
             partition_by=(), bloom=()) -> None:
    """Save a table for later joins and point filters.

    Bucketing by the join key lets parent and child tables join without a
    shuffle; sorted files make min/max statistics selective, and bloom filters
    serve equality on columns that are not sorted.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, bucket_by).sortBy(sort_by or bucket_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.saveAsTable(table)


# --- file ledger --------------------------------------------------------------

def fingerprints(spark: SparkSession, paths) -> DataFrame:
    """The SHA-256 of every file's content, whatever its size; empty files are passed over.

    Tasks read the files in chunks; contents neither fill a row nor reach the driver.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file_path"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file_path": batch["file_path"], "file_sha256": batch["file_path"].map(sha256_of)})

    return files.mapInPandas(hashed, "file_path string, file_sha256 string")


def files_to_do(found: DataFrame, ledger: DataFrame | None, source_id: str,
                force: bool = False) -> DataFrame:
    """Files that are new or changed since the ledger saw them last."""
    if ledger is None or force:
        return found
    seen = (
        ledger.where(F.col("source_id") == source_id)
        .groupBy("file_path").agg(F.max_by("file_sha256", "ingested_at").alias("file_sha256")))
    return found.join(seen, ["file_path", "file_sha256"], "left_anti")


def ledger_rows(done: DataFrame, counts: DataFrame, source_id: str, batch: str = "") -> DataFrame:
    """Ledger entries for loaded files with the number of rows each gave."""
    return done.join(counts, "file_path", "left").select(
        F.lit(source_id).alias("source_id"), "file_path", "file_sha256",
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        F.current_timestamp().alias("ingested_at"), F.lit(batch).alias("load_batch"))


def manifest(tables: Mapping[str, DataFrame], ledger: DataFrame) -> DataFrame:
    """Rows per table, and files, rows and a combined file digest per source."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n_rows")).select(
            F.lit("table").alias("kind"), F.lit(name).alias("name"),
            F.lit(None).cast("bigint").alias("n_files"), "n_rows",
            F.lit(None).cast("string").alias("digest"))
        out = part if out is None else out.unionByName(part)
    latest = ledger.groupBy("source_id", "file_path").agg(
        F.max_by(F.struct("file_sha256", "row_count"), "ingested_at").alias("l"))
    # the digest adds up per-file hashes, so it does not depend on file order
    piece = F.xxhash64("file_path", "l.file_sha256").cast("decimal(38,0)")
    per_source = latest.groupBy("source_id").agg(
        F.count("*").alias("n_files"), F.sum("l.row_count").alias("n_rows"),
        F.sum(piece).cast("string").alias("digest"))
    return out.unionByName(per_source.select(
        F.lit("source").alias("kind"), F.col("source_id").alias("name"), "n_files", "n_rows",
        "digest"))


def write_manifest(tables: Mapping[str, DataFrame], ledger: DataFrame, path: str) -> None:
    """The manifest and the digest of every file as JSON lines."""
    manifest(tables, ledger).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    ledger.groupBy("source_id", "file_path").agg(
        F.max_by("file_sha256", "ingested_at").alias("file_sha256"),
        F.max_by("row_count", "ingested_at").alias("row_count")).write.mode("overwrite").json(f"{path}/files")


def vintage(df: DataFrame, as_of: str) -> DataFrame:
    """Rows of an external pull with the date they hold for."""
    return df.withColumn("_as_of", F.lit(as_of).cast("date"))


def log_vintage(df: DataFrame, source: str, url: str, as_of: str, path: str) -> None:
    """Add a pull to the manifest of external sources."""
    df.agg(F.count("*").alias("row_count")).select(
        F.lit(source).alias("source"), F.lit(url).alias("url"), F.lit(as_of).alias("as_of"),
        "row_count").write.mode("append").parquet(path)


def load_external(df: DataFrame, name: str, warehouse: str, *, url: str, as_of: str) -> DataFrame:
    """Replace an external table and log the pull; returns the stored table."""
    path = f"{warehouse}/{name}"
    full_refresh(df, path)
    stored = df.sparkSession.read.parquet(path)
    log_vintage(stored, name, url, as_of, f"{warehouse}/_vintages")
    return stored


# --- exports ------------------------------------------------------------------

def write_ranked_csv(df: DataFrame, path: str, order, limit: int) -> None:
    """A short ranking as one CSV file with a header, rows in order."""
    df.orderBy(*order).limit(limit).coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)


def write_queue(df: DataFrame, path: str) -> None:
    """A review queue as CSV; as many files as it has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def card_file_name(source, ident) -> Column:
    """File name of a record card: kind and id, with slashes made safe."""
    return F.concat(source, F.lit("_"), F.regexp_replace(ident, "/", "_"), F.lit(".md"))


def write_cards(cards: DataFrame, path: str) -> None:
    """Cards of any number as a table by kind, with text and file name of each."""
    cards.withColumn("file_name", card_file_name(F.col("source"), F.col("id"))).write.mode(
        "overwrite").partitionBy("source").parquet(path)
