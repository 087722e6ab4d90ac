"""Tables of Parquet files, spread over the cores where a file alone would keep them idle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Partitions for each core that a spread table has.
PER_CORE = 3


def read_table(spark: SparkSession, path: str, spread: bool = True) -> DataFrame:
    """A Parquet table; with ``spread``, one that has fewer splits than the cluster has cores is dealt to all of them.

    Large tables have many splits and are never dealt anew, so no text of theirs is shuffled. A small file of one row group is
    one task's work otherwise, and the work on a text costs far more than to send it.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:  # a plain scan: nothing runs
        df = df.repartition(PER_CORE * cores)
    return df
