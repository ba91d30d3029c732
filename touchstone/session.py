"""Spark session settings and the shared folder that written tables go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str] = {}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, also where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Without call sites recorded for error messages, building a plan takes half the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def settings_for(input_bytes: int) -> dict[str, str]:
    """Settings for a job that reads this much.

    Adaptive execution joins small shuffle partitions but never splits those of an aggregate, so
    their number is set for the whole input: about half a gigabyte each, which fits a task's
    memory or spills once. Merging then aims at that size rather than at one task per core.
    """
    partitions = max(200, input_bytes // (512 * 1024**2))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def build_session(
    app: str = "touchstone", master: str | None = None, input_bytes: int | None = None, **settings: str
) -> SparkSession:
    """A session with this package's settings; with `input_bytes`, sized for a job that reads so much."""
    sized = settings_for(input_bytes) if input_bytes is not None else {}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **sized, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: What one task reads at most, of files or of a shuffle. A task counts or combines its rows in memory, and these tables
#: hold some 80 rows a KB: with Spark's 128 and 64 MB, the rows of a few tasks fill an executor and are sorted and spilled.
TASK_BYTES = 16 * 1024**2
TASK_SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def small_tasks(spark: SparkSession) -> None:
    """Bound what a task of this session reads, unless the session has a lower bound."""
    for key in TASK_SETTINGS:
        number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)[a-z]*\s*", spark.conf.get(key).lower()).groups()
        if int(number) * 1024 ** "bkmgtp".find(unit or "b") > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))


def isolated(spark: SparkSession) -> SparkSession:
    """A child session with the parent's SQL settings but none of its temporary views.

    Paths cannot be queried as tables in it, so a name resolves to a view put there or to nothing.
    """
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and child.conf.isModifiable(key):
            child.conf.set(key, value)
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    return child


def has_shared_dir(spark: SparkSession) -> bool:
    """Whether there is a folder that all executors can reach."""
    return bool(spark.conf.get(SHARED_DIR, None)) or spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder; executors on other machines
    could not read it.
    """
    folder = spark.conf.get(SHARED_DIR, None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR} to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="touchstone-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    The result has no lineage to recompute: lost executors are replaced by reading files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    drop_at_exit(spark, path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a written copy when the application ends; nothing reads it after that."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
