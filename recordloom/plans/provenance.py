"""Running a query so that its result can be cited: text, hash, schema, row count, time."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.audit import row_hash
from ..sources.sinks import read_if_there
from .catalogue import detector, run_detector

RECORD = ("name string, sql string, sql_hash string, params string, "
          "schema array<struct<column:string,type:string>>, row_count bigint, digest string, "
          "elapsed_seconds double, executed_at string")


def sql_hash(text: str) -> str:
    """First 16 hex digits of the SHA-256 of the query text."""
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def canonical_text(ident: str, params: Mapping, version: str = "1") -> str:
    """Text that stands for a detector run, the same for equal parameters in any order."""
    return json.dumps({"id": ident, "version": version, "params": dict(params)}, sort_keys=True,
                      default=str)


def run_with_provenance(df: DataFrame, name: str, out: str, *, text: str,
                        params: Mapping | None = None) -> DataFrame:
    """Write a result under ``out/name`` and add its record to ``out/_provenance``.

    Row count and digest are observed while the result is written, so it is
    computed once.
    """
    spark = df.sparkSession
    seen = Observation(name)
    start = time.time()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(row_hash(df)).cast("string").alias("d")).write.mode(
        "overwrite").parquet(f"{out}/{name}")
    elapsed = round(time.time() - start, 3)
    record = [(name, text, sql_hash(text), json.dumps(dict(params or {}), default=str),
               [(c, t) for c, t in df.dtypes], seen.get["n"], seen.get["d"] or "0", elapsed,
               time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))]
    spark.createDataFrame(record, RECORD).coalesce(1).write.mode("append").parquet(
        f"{out}/_provenance")
    return spark.read.parquet(f"{out}/{name}")


def provenance_table(spark: SparkSession, out: str) -> DataFrame:
    found = read_if_there(spark, f"{out}/_provenance")
    return spark.createDataFrame([], RECORD) if found is None else found


def run_detector_with_provenance(ident: str, tables: Mapping[str, DataFrame], out: str,
                                 name: str | None = None, **params) -> DataFrame:
    d = detector(ident)
    merged = {**d.params, **params}
    return run_with_provenance(
        run_detector(ident, tables, **params), name or f"{ident}_{d.name}", out,
        text=canonical_text(ident, merged), params=merged)


def ad_hoc_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], out: str,
               name: str = "ad_hoc", args: Mapping | None = None) -> DataFrame:
    """Run any SQL over the tables as views; ``:name`` parameters come from ``args``."""
    for view, df in tables.items():
        df.createOrReplaceTempView(view)
    return run_with_provenance(spark.sql(sql, args=dict(args or {})), name, out, text=sql,
                               params=args)
