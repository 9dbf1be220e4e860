"""Profiles: which files hold which records, and the load that turns them into tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..operators import flatten
from ..session import cut_lineage
from ..sources import keyed as by_key, readers, sinks

READERS = ("json_array", "jsonl", "xml_dir")


@dataclass(frozen=True)
class Source:
    """One kind of input file. ``plan`` maps raw records to table frames."""

    ident: str
    format: str
    glob: str
    schema: str
    plan: Callable[[DataFrame], dict[str, DataFrame]]
    layout: str = "ranges"


@dataclass(frozen=True)
class Profile:
    name: str
    sources: tuple[Source, ...]
    tables: dict[str, schema.Table]


LOBBYING = Profile(
    "Lobbying disclosures and press releases",
    (
        Source("senate_constants", "json_array",
               "senate/constants/lobbying_activity_issues.json", schema.LOOKUP,
               flatten.issue_code),
        Source("senate_govt_entities_lookup", "json_array",
               "senate/constants/government_entities.json", schema.LOOKUP,
               flatten.government_entity),
        Source("senate_filings", "json_array", "senate/{year}/filings/filings_{year}.json",
               schema.SENATE_FILING, flatten.senate_filing),
        Source("senate_contributions", "json_array",
               "senate/{year}/contributions/contributions_{year}.json",
               schema.SENATE_CONTRIBUTION, flatten.senate_contribution),
        Source("house_filings", "xml_dir", "house/{year}_*_XML", schema.HOUSE_FILING,
               flatten.house_filing),
        Source("press_releases_yeared", "jsonl", "congress_press/{year}/*.jsonl",
               schema.PRESS_RELEASE, flatten.press_release),
        Source("press_releases_2026", "jsonl", "congress_press/2026-*.jsonl",
               schema.PRESS_RELEASE, flatten.press_release),
    ),
    schema.TABLES,
)


def fan_out(raw: DataFrame, plan, staged: bool = True) -> dict[str, DataFrame]:
    """All table frames of a source. The parsed records are written once to the shared
    folder, so that files are not parsed again for every table."""
    return plan(cut_lineage(raw) if staged else raw)


def _read(spark, source: Source, paths):
    if source.format == "json_array":
        return readers.read_json_array(spark, paths, source.schema, source.layout), None
    if source.format == "jsonl":
        return readers.read_jsonl(spark, paths, source.schema, strict=True), None
    if source.format == "xml_dir":
        return readers.read_xml_files(spark, paths, source.schema)
    raise ValueError(f"unknown format: {source.format}")


def load_source(spark: SparkSession, profile: Profile, source: Source, root: str, warehouse: str,
                *, years=None, limit: int | None = None, force: bool = False, keyed: bool = False) -> None:
    """Load the new and changed files of one source.

    The ledger is written after the tables and says which load counts for a file. A load that fails, is
    forced, or finds a changed file replaces the file's rows in tables without a key, whatever other
    files come with it; keyed tables take a key once. A limited run leaves no ledger entry, so
    the next load reads its files again and replaces its rows. With ``keyed`` the tables that have a key are
    bucketed by the record they belong to, so that later joins need no shuffle, and appends
    look only at the buckets they touch.
    """
    pattern = source.glob + ("/*.xml" if source.format == "xml_dir" else "")
    found = readers.expand_globs(spark, root, pattern, years)
    if not found:
        return
    ledger_path = f"{warehouse}/_ledger"
    todo = cut_lineage(sinks.files_to_do(
        sinks.fingerprints(spark, found), sinks.read_if_there(spark, ledger_path),
        source.ident, force))
    # names only: the list of new files, not their rows
    paths = sorted(r["file_path"] for r in todo.select("file_path").toLocalIterator())
    if not paths:
        return
    raw, broken = _read(spark, source, paths)
    if source.format == "xml_dir":
        sinks.full_refresh(broken, f"{warehouse}/_quarantine/{source.ident}")
    if limit is not None:
        raw = cut_lineage(raw.orderBy("source_path", "source_start").limit(limit))  # the same rows for every table
    # rows of one split keep their order in this number
    raw = raw.withColumn("source_row", F.monotonically_increasing_id())
    tables = fan_out(raw, source.plan, staged=source.format != "xml_dir")
    order = [F.col(c).asc_nulls_last() for c in flatten.ORIGIN]
    batch = uuid.uuid4().hex[:16]
    for name, df in tables.items():
        table = profile.tables[name]
        if table.key is None:
            rows = df.withColumn("load_file", F.col("source_path")).drop(*flatten.ORIGIN)
            sinks.append_load(rows, f"{warehouse}/{name}", source.ident, batch)
            continue
        if keyed:
            by_key.append(df, f"{warehouse}/{name}", table.key, order, bucket_by=table.bucket_by,
                          zone=next(iter(table.partition_by), None), drop=flatten.ORIGIN)
            continue
        sinks.append_dedup(df, f"{warehouse}/{name}", table.key, order,
                           partition_by=table.partition_by, drop=flatten.ORIGIN)
    sinks.ledger_rows(todo, emitted_rows(tables), source.ident, batch).write.mode("append").parquet(
        ledger_path if limit is None else f"{warehouse}/_limited")


def emitted_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per input file over all tables, before keys are made unique."""
    out = None
    for df in tables.values():
        part = df.groupBy(F.col("source_path").alias("file_path")).agg(
            F.count("*").alias("row_count"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("file_path").agg(F.sum("row_count").alias("row_count"))


def load(spark: SparkSession, profile: Profile, root: str, warehouse: str, *, only: str | None = None,
         **options) -> None:
    """Load all sources of a profile, or one of them."""
    for source in profile.sources:
        if only in (None, source.ident):
            load_source(spark, profile, source, root, warehouse, **options)


def open_tables(spark: SparkSession, profile: Profile, warehouse: str) -> dict[str, DataFrame]:
    """The loaded tables; a table without files is empty."""
    out = {}
    loads = sinks.current_loads(spark, f"{warehouse}/_ledger", f"{warehouse}/_limited")
    for name, table in profile.tables.items():
        df = by_key.open_keyed(spark, f"{warehouse}/{name}")
        if df is None:
            df = sinks.read_if_there(spark, f"{warehouse}/{name}")
        if df is not None and table.key is None:
            df = sinks.visible(df, loads)
        out[name] = (df.select(*[name for name, _ in table.fields()]) if df is not None
                     else spark.createDataFrame([], table.schema))
    return out
