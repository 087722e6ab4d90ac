"""Session helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.sources.tables import read_table

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed (tests, local runs)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A session without one gets a folder of its own only where it runs on one machine (tests, local runs): on a cluster no
    folder of the driver is seen by the executors, so that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{spark.conf.get('spark.local.dir', None) or '/tmp'}/veilwork-{sc.applicationId}"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back(spark: SparkSession) -> None:
    """Have the shuffle files and checkpoints removed that nothing refers to any more.

    Spark removes them when the driver's memory is collected, which large inputs do not bring about more often than small ones.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Plans executed inside send at most ``rows`` rows to Python in a batch; for rows that hold whole texts several times."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def plain_plans(spark: SparkSession) -> AbstractContextManager[None]:
    """Plans executed inside infer no constraints. A checkpoint hands them on, so in many rounds planning would take longer each time."""
    return _setting(spark, "spark.sql.constraintPropagation.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], stem: str) -> str:
    """A column name that clashes with none of ``taken`` (compared without case)."""
    low = {c.lower() for c in taken}
    name, n = stem, 0
    while name.lower() in low:
        n += 1
        name = f"{stem}{n}"
    return name


def held_out(col: str = "doc_id"):
    """The evaluation fold: crc32 of the id's decimal text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
