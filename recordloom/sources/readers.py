"""Readers for raw record files and for the working files of an investigation.

Record readers keep where a row came from: ``source_path`` (full), ``source_file``
(name) and ``source_start`` (offset of the split it was read from).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.coerce import strip_null
from ..schema import CLAIM, HOUSE_ROOTS, PROVENANCE
from ..session import cut_lineage
from . import json_ranges

CORRUPT = "_corrupt_record"
SOURCE = ("source_path", "source_file", "source_start")


def expand_globs(spark: SparkSession, root: str, pattern: str, years=None) -> list[str]:
    """Paths that match a pattern under a root, sorted; no match gives an empty list.

    ``{year}`` stands for each of the years, or for any year where none are named. Only
    names are listed, by the file system the root lives on.
    """
    if "{year}" in pattern:
        patterns = [pattern.format(year=y) for y in (years or ["[0-9][0-9][0-9][0-9]"])]
    else:
        patterns = [pattern]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}")
        statuses = path.getFileSystem(conf).globStatus(path)
        found += sorted(str(s.getPath().toString()) for s in statuses or [])
    return found


def with_source(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("source_path"),
                     F.col("_metadata.file_name").alias("source_file"),
                     F.col("_metadata.file_block_start").alias("source_start"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No files, no rows, same columns."""
    return spark.createDataFrame(
        [], f"{schema}, source_path string, source_file string, source_start bigint")


def _corruptible(schema: str) -> str:
    return f"{schema}, {CORRUPT} string"


def read_jsonl(spark: SparkSession, paths, schema: str, strict: bool = False) -> DataFrame:
    """One JSON record per line; blank lines are skipped. ``strict`` fails on a bad line,
    otherwise it is kept in ``_corrupt_record``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return empty(spark, schema)
    if strict:
        return with_source(spark.read.schema(schema).option("mode", "FAILFAST").json(paths))
    return with_source(
        spark.read.schema(_corruptible(schema)).option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and unreadable lines of a reader that keeps the latter."""
    parsed = cut_lineage(df)
    return (parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT),
            parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT, *SOURCE))


def read_json_array(spark: SparkSession, paths, schema: str, layout: str = "ranges", size: int = json_ranges.RANGE
                    ) -> DataFrame:
    """Files that each hold one JSON list of records, in any layout and of any size.

    A file is read in ranges of ``size`` bytes that are tasks of their own; ``source_start`` is the offset of the record. A file that
    does not hold a list is an error. ``layout="lines"`` is for files with one element per line, which
    need no search for the elements.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return empty(spark, schema)
    if layout == "ranges":
        return json_ranges.read(spark, paths, schema, size)
    if layout != "lines":
        raise ValueError(f"unknown layout: {layout}")
    line = F.regexp_replace(F.trim("value"), r"^\[|,$|\]$", "")
    rows = with_source(spark.read.text(paths)).select(
        F.trim(line).alias("_line"), *SOURCE).where(F.col("_line") != "")
    return rows.select(F.from_json("_line", schema, {"mode": "FAILFAST"}).alias("r"),
                       *SOURCE).select("r.*", *SOURCE)


def read_xml(spark: SparkSession, paths, row_tag: str, schema: str) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return empty(spark, _corruptible(schema))
    return with_source(
        spark.read.format("xml").schema(_corruptible(schema)).option("rowTag", row_tag)
        .option("columnNameOfCorruptRecord", CORRUPT).load(paths))


def read_xml_dir(spark: SparkSession, dirs, schema: str, roots=None
                 ) -> tuple[DataFrame, DataFrame]:
    """All ``*.xml`` files of some folders: (good records, quarantined files).

    The files hold one of several root elements; each record gets the ``doc_type``
    of its root. A malformed file is set aside as a whole and reported once.
    """
    return read_xml_files(spark, [f"{d.rstrip('/')}/*.xml" for d in dirs], schema, roots)


def read_xml_files(spark: SparkSession, paths, schema: str, roots=None) -> tuple[DataFrame, DataFrame]:
    """``read_xml_dir`` for named files or patterns.

    Each file is read and parsed once, whatever its root; good and malformed ones are told apart in the same pass. A
    file is one record, so it is one row while it is read. Files of other roots give nothing.
    """
    roots = roots or HOUSE_ROOTS
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        none = empty(spark, _corruptible(schema)).withColumn("doc_type", F.lit(None).cast("string"))
        return (none.drop(CORRUPT).withColumn("house_xml_filename", F.col("source_file")),
                none.select("source_path", "source_file", CORRUPT))
    files = with_source(spark.read.text(paths, wholetext=True))
    # the first tag after the prolog, comments and a document type
    tag = F.regexp_extract("value", r"(?s)^\x{FEFF}?\s*+(?:<\?.*?\?>\s*+|<!--.*?-->\s*+|<![A-Z][^>]*>\s*+)*+<([^\s/>!?]++)", 1)
    types = F.create_map(*[F.lit(x) for doc_type, root in roots.items() for x in (root, doc_type)])
    record = F.from_xml("value", _corruptible(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = cut_lineage(  # parsed once for both results
        files.withColumn("_root", tag).where(F.col("_root").isin(*roots.values()) | (F.col("_root") == ""))
        .select(record.alias("r"), *SOURCE, types[F.col("_root")].alias("doc_type"), (F.col("_root") == "").alias("_rootless"), "value")
        .select("r.*", *SOURCE, "doc_type", F.when(
            F.col("_rootless") | F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull(), F.col("value")).alias("_broken")))
    broken = parsed.where(F.col("_broken").isNotNull()).select("source_path", "source_file", F.col("_broken").alias(CORRUPT))
    good = parsed.where(F.col("_broken").isNull()).drop(CORRUPT, "_broken").withColumn("house_xml_filename", F.col("source_file"))
    return good, broken


def read_id_list(spark: SparkSession, path: str, column: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Ids from a CSV file with a header: the named or the first column, blanks skipped.

    ``limit`` looks at the first rows of the file, blank or not.
    """
    df = spark.read.option("header", True).csv(path)
    if limit is not None:
        df = df.limit(limit)
    name = column or df.columns[0]
    return df.select(F.col(f"`{name}`").alias("id")).where(F.coalesce("id", F.lit("")) != "")


def claims_from_json(text) -> Column:
    """The ``claims`` map of an evidence document as an array of entries."""
    return F.map_entries(F.from_json(text, f"struct<claims:map<string,{CLAIM}>>")["claims"])


def explode_claims(df: DataFrame, text: str) -> DataFrame:
    """One row per claim of every evidence document in a text column."""
    return df.select(F.explode(claims_from_json(text)).alias("c")).select(
        F.col("c.key").alias("claim_id"), "c.value.*")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return explode_claims(spark.read.text(path, wholetext=True), "value")


def read_provenance(spark: SparkSession, pattern: str) -> DataFrame:
    """Provenance records, one JSON document per file."""
    return with_source(spark.read.schema(PROVENANCE).option("multiLine", True).json(pattern))


def read_text_corpus(spark: SparkSession, paths) -> DataFrame:
    """Text files for token scans, line by line so that big files are split."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def trimmed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed (new name to old), trimmed, empty as null."""
    return df.select(*[strip_null(old).alias(new) for new, old in mapping.items()])
