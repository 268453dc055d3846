"""Session-wide helpers: the shared folder, tables that cut lineage, table loading."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_RUNS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests on a local master) a temporary folder is made, and removed at the end
    of the process. On a cluster without the setting this raises, as a machine-local folder would be
    unreadable for other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_DIRS:
        made = tempfile.mkdtemp(prefix="inkloom-")
        weakref.finalize(sc, shutil.rmtree, made, True)
        _OWN_DIRS[sc.applicationId] = f"file://{made}"
    return _OWN_DIRS[sc.applicationId]


def _path(spark: SparkSession, path: str):
    """A path and its file system, by the session's Hadoop settings."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, to: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the run's part of the shared folder and return a scan of it.

    With ``to``, a table that this made, the rows are added to that table.

    This cuts the lineage with replicated storage: a lost executor costs a re-read, not a recomputation. The
    run's folder is removed when the application ends; ``drop`` removes a table that is no longer read.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/inkloom-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        at, files = _path(spark, run)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _RUNS.add(run)
    path = to._inkloom_path if to is not None else f"{run}/{name}-{uuid.uuid4().hex}"
    df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` made, once nothing reads them any more."""
    for df in tables:
        at, files = _path(df.sparkSession, df._inkloom_path)
        files.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of data frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least one partition a core, for work that is heavy on CPU.

    Only input of few splits moves; a large input has enough of them and is returned as it is. Call it on
    scans and projections of them only: counting the partitions of anything else would run its shuffles.
    """
    least = cores(df.sparkSession)
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df
