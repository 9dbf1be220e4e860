"""Tables stored by record key.

Rows are bucketed by the column that parents and children share, so that tables with the same number of buckets join without a
shuffle. Appending takes each key once, and looks at stored keys only where it must:

- a Bloom filter per bucket tells which keys of a batch may be stored at all; all others are new;
- a zone map (least and greatest key, and value of one more column, per bucket and append) leaves out buckets
  whose keys are all below or above;
- of the buckets that remain only the key column is read, and files of other buckets are not opened.

Layout, filter and zones are small tables of their own, written before the data: what a failed append leaves behind makes a later one look once more,
it never hides a key.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.shape import keep_first
from ..session import cut_lineage

#: Bits of a bucket's filter, and how many a key sets.
BLOOM_BITS, BLOOM_HASHES = 1 << 17, 5
BUCKETS = 32


def _table(path: str) -> str:
    """The name under which a session knows the table."""
    import hashlib
    return "keyed_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _sub(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    from .sinks import read_if_there

    found = read_if_there(spark, f"{path}/{name}", schema)
    return spark.createDataFrame([], schema) if found is None else found


def layout_of(spark: SparkSession, path: str) -> dict | None:
    """How a stored table is laid out, or ``None`` if there is none."""
    from .sinks import exists

    if not exists(spark, f"{path}/_layout"):
        return None
    return json.loads(spark.read.text(f"{path}/_layout").first()[0])


def bucket_of(column: str | Column, buckets: int) -> Column:
    """The bucket that Spark puts a value into."""
    return F.pmod(F.hash(column), F.lit(buckets))


def _bits_of(key: str) -> Column:
    """The positions that a key sets in its bucket's filter."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(BLOOM_BITS)) for k in range(BLOOM_HASHES)])


def open_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table with its buckets known to the planner, or ``None`` if there is none."""
    layout = layout_of(spark, path)
    if layout is None:
        return None
    name = _table(path)
    # another session may have appended
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({layout['schema']}) USING parquet CLUSTERED BY (`{layout['bucket_by']}`) "
              f"SORTED BY (`{layout['bucket_by']}`) "
              f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/data'")
    return spark.table(name)


def stored_keys(spark: SparkSession, path: str, key: str, buckets: list[int]) -> DataFrame:
    """The key column of some buckets. The number of a bucket is in the names of its files, so no others are opened."""
    from .sinks import read_if_there

    stored = read_if_there(spark, f"{path}/data")
    if stored is None:  # an append failed before its data
        return spark.createDataFrame([], layout_of(spark, path)["schema"]).select(key)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)(?:\..*)?$", 1).cast("int")
    return stored.where(number.isin(buckets)).select(key)


def may_be_stored(batch: DataFrame, path: str, key: str, bucket: str) -> DataFrame:
    """The keys of a batch (``key, bucket``) that the bucket's filter and zones do not rule out."""
    spark = batch.sparkSession
    words = _sub(spark, path, "_bloom", "bucket int, word int, bits bigint").groupBy(
        F.col("bucket").alias("_b"), F.col("word").alias("_w")).agg(F.bit_or("bits").alias("_bits"))
    at = batch.select(key, bucket, F.explode(_bits_of(key)).alias("_at")).withColumn("_word", F.floor(F.col("_at") / 64).cast("int"))
    hit = F.getbit(F.coalesce("_bits", F.lit(0).cast("bigint")), (F.col("_at") % 64).cast("int"))
    maybe = (
        at.join(words, (F.col(bucket) == F.col("_b")) & (F.col("_word") == F.col("_w")), "left")
        .groupBy(key, bucket).agg(F.min(hit).alias("_hit")).where("_hit = 1").drop("_hit"))
    zones = _sub(spark, path, "_zones", _zone_schema(dict(batch.dtypes)[key])).groupBy(F.col("bucket").alias("_b")).agg(
        F.min("least").alias("_least"), F.max("greatest").alias("_greatest"))
    return maybe.join(zones, (F.col(bucket) == F.col("_b")) & F.col(key).between(F.col("_least"), F.col("_greatest"))).select(key, bucket)


def _zone_schema(kind: str) -> str:
    return f"bucket int, least {kind}, greatest {kind}, zone_least string, zone_greatest string, n bigint"


def append(batch: DataFrame, path: str, key: str, order: list[Column], *, bucket_by: str | None = None, buckets: int = BUCKETS,
           zone: str | None = None, drop: tuple[str, ...] = ()) -> dict[str, int]:
    """Append the first row of each new key, and all rows with a null key.

    ``bucket_by`` must follow from the key (a child's id begins with its parent's). Returns how many rows were ``new`` and how many stored
    keys were ``read`` from how many ``touched`` buckets.
    """
    spark = batch.sparkSession
    layout = layout_of(spark, path)
    bucket_by = bucket_by or key
    buckets = layout["buckets"] if layout else buckets
    if layout and (layout["bucket_by"], layout["key"]) != (bucket_by, key):
        raise ValueError(f"{path} is laid out by {layout['bucket_by']} with the key {layout['key']}")
    first = cut_lineage(keep_first(batch.where(F.col(key).isNotNull()), key, order).drop(*drop)
                        .withColumn("_bucket", bucket_of(bucket_by, buckets)))
    done = {"touched": 0, "read": 0}
    rows = first
    if layout:
        maybe = cut_lineage(may_be_stored(first.select(key, "_bucket"), path, key, "_bucket"))
        # numbers of buckets, at most as many as the table has
        touched = sorted(r[0] for r in maybe.select("_bucket").distinct().collect())
        if touched:
            stored = stored_keys(spark, path, key, touched)
            done = {"touched": len(touched), "read": stored.count()}
            rows = first.join(maybe.join(stored, key, "left_semi").select(key), key, "left_anti")
    rows = cut_lineage(rows.select(first.columns).unionByName(
        batch.where(F.col(key).isNull()).drop(*drop).withColumn("_bucket", bucket_of(bucket_by, buckets))))
    data = rows.drop("_bucket")
    if not layout:
        text = json.dumps({"key": key, "bucket_by": bucket_by, "buckets": buckets,
                           "schema": ", ".join(f"`{c}` {t}" for c, t in data.dtypes)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    keyed = rows.where(F.col(key).isNotNull())
    bit = F.explode(_bits_of(key))
    keyed.select("_bucket", bit.alias("_at")).groupBy(
        F.col("_bucket").alias("bucket"), F.floor(F.col("_at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("bits")).write.mode("append").parquet(f"{path}/_bloom")
    of = F.col(zone).cast("string") if zone else F.lit(None).cast("string")
    keyed.groupBy(F.col("_bucket").alias("bucket")).agg(
        F.min(key).alias("least"), F.max(key).alias("greatest"), F.min(of).alias("zone_least"), F.max(of).alias("zone_greatest"),
        F.count("*").alias("n")).write.mode("append").parquet(f"{path}/_zones")
    name = _table(path)
    open_keyed(spark, path)
    data.repartition(buckets, bucket_by).write.mode("append").format("parquet").bucketBy(buckets, bucket_by).sortBy(bucket_by).option(
        "path", f"{path}/data").option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(name)
    return {"new": rows.count(), **done}


def zones(spark: SparkSession, path: str) -> DataFrame | None:
    """Per bucket: least and greatest key and zone value, and the number of keys."""
    layout = layout_of(spark, path)
    if layout is None:
        return None
    stored = spark.read.parquet(f"{path}/_zones")
    return stored.groupBy("bucket").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.min("zone_least").alias("zone_least"),
        F.max("zone_greatest").alias("zone_greatest"), F.sum("n").alias("n"))
