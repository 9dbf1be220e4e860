"""Resumable ingest: each run takes the files that arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import flatten
from ..schema import Table
from ..session import cut_lineage
from ..sources import sinks


def stream_jsonl(spark: SparkSession, path: str, schema: str,
                 max_files: int = 10_000) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
        .select("*", F.col("_metadata.file_path").alias("source_path"),
                F.col("_metadata.file_name").alias("source_file"),
                F.col("_metadata.file_block_start").alias("source_start"))
    )


def ingest_available(stream: DataFrame, plan, tables: dict[str, Table], warehouse: str,
                     source_id: str, checkpoint: str | None = None) -> None:
    """Take in everything that is there, then stop.

    The query's own checkpoint remembers the files. It lives in the warehouse, since batch numbers must go
    on where the tables left off; keys are checked against the
    stored table, so a batch that is repeated after a failure adds nothing twice
    to keyed tables and no unbounded state is held. Tables without a key are
    replaced batch by batch: each batch is one sub-folder, overwritten on a repeat.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        raw = batch.withColumn("source_row", F.monotonically_increasing_id())
        order = [F.col(c).asc_nulls_last() for c in flatten.ORIGIN]
        for name, df in plan(cut_lineage(raw)).items():
            table = tables[name]
            if table.key is None:
                rows = df.withColumn("load_file", F.col("source_path")).drop(*flatten.ORIGIN)
                sinks.replace_batch(rows, f"{warehouse}/{name}", source_id, str(batch_id))
            else:
                sinks.append_dedup(df, f"{warehouse}/{name}", table.key, order,
                                   partition_by=table.partition_by, drop=flatten.ORIGIN)

    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint or f"{warehouse}/_streams/{source_id}")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
