"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Skewed joins are split by the
# adaptive planner, and broadcasts are only chosen from measured sizes: the
# library itself never forces one.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Folders written by ``cut_lineage`` and not yet dropped.
_STAGED: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "recordloom", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only made up for a local master, where driver and
    executors are the same process; on a cluster a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="recordloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, what: str = "cut") -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that several branches need to the shared folder as Parquet and read it from there.

    The copy survives the loss of executors, the branches do not recompute it, and
    they read only their own columns, with filters and sizes known to the planner.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    _STAGED.append(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for this frame, once nothing reads it any more."""
    path = staged._staged_path
    if path in _STAGED:
        _STAGED.remove(path)
        place = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(spark: SparkSession) -> int:
    """Delete what ``cut_lineage`` has written so far; call it when the results are stored."""
    n = len(_STAGED)
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
