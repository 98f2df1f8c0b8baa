"""Database tables over JDBC. Address and credentials come from the caller only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, table: str, options: Mapping[str, str], partition_column: str | None = None,
              lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """A table or ``(query) alias``; with a numeric column the read is split into ranges."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                                numPartitions=str(partitions))
    return reader.load()


def write_jdbc(df: DataFrame, table: str, options: Mapping[str, str], mode: str = "append", batch: int = 10_000) -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch).mode(mode).save()
