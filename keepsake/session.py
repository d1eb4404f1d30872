"""Session helpers: lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast table is held by every executor, so it is only used for sides
# that were counted first and found to be at most this many narrow rows.
BROADCAST_ROWS = 200_000


def local_session(name: str = "keepsake", cores: str = "*") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set a temporary folder serves, on one machine only: executors
    of a cluster would not find it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keepsake-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder


_RUNS: list[str] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Tables that ``cut`` writes inside go to one folder, which is deleted at the end.

    Results must be written before the block ends, as they read these tables.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and continue from the files.

    Loops use this each round, and tables that several branches read are written
    once: a lost executor then costs a re-read and not a recomputation, and the
    planner sees true sizes.
    """
    folder = _RUNS[-1] if _RUNS else ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A table of so few splits is small enough to be dealt out again.
FEW_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table stored in a handful of splits to all cores; larger tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(min(cores, 8 * splits)) if splits < min(cores, FEW_SPLITS) else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting it; past the bound leave it to a shuffle join.

    The count stops at ``max_rows + 1``. Only for narrow tables that are cheap
    to count (query terms, hits, dimensions); AQE splits skewed partitions of
    the shuffle join used otherwise.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension table of fixed values, small by construction."""
    return spark.createDataFrame(rows, schema)
