"""Tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, as its files' splits have it.

    Only a table with fewer splits than there are cores is dealt to all of them
    first, as one core would have all its text: that is less than a split
    (``spark.sql.files.maxPartitionBytes``) for each core to move.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
