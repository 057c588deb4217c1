"""Session helpers: table access, checkpoints in the shared folder, task counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only where the setting is absent (local tests) a folder of this machine
    is used; such a session runs in one process, so it is shared as well.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"quire-checkpoints-{os.getpid()}")
        sc.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint, which survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of input that a task of a CPU-bound stage takes, the size at which Spark splits a scan.
SPLIT_BYTES = 128 << 20


def task_count(spark: SparkSession, size: int = 0) -> int:
    """Tasks for a CPU-bound stage over `size` bytes: one for each split of it, two for each core and the configured shuffle width at least."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SPLIT_BYTES))


def spread(df: DataFrame, *keys: str, splits_per_core: int = 1) -> DataFrame:
    """Rows in tasks enough for a CPU-bound Python stage; they are moved only where there are fewer tasks than cores.

    A scan that has `splits_per_core` splits for each core stays as it is, and so does input of a
    split's size for each core, which scans and shuffles part by bytes anyway. What is left is
    small (or a file of one row group); an explicit count keeps adaptive
    execution from packing its costly rows into one task. Without keys rows go
    round-robin, so no key can make a partition hot.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    size = int(str(run.optimizedPlan().stats().sizeInBytes()))
    if not keys:
        if size >= cores * SPLIT_BYTES:
            return df
        plan = run.executedPlan().toString()
        if "Exchange" not in plan and "AdaptiveSparkPlan" not in plan and run.toRdd().getNumPartitions() >= cores * splits_per_core:
            return df
    n = task_count(spark, min(size, cores * SPLIT_BYTES) if not keys else size)
    return df.repartition(n, *keys) if keys else df.repartition(n)


def fetch(df: DataFrame) -> pd.DataFrame:
    """A table of bounded size on the driver, handed over by column and not as Python rows."""
    return df.toArrow().to_pandas()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once for each context.

    Spark's file server delivers the archive, so executors need no path of this
    machine, nor the package on their own.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "quire.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(x for x in root.rglob("*") if x.suffix in (".py", ".tsv")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._quire_shipped = True
