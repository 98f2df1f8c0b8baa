"""Tables kept as whole versions below one folder.

A version is a folder ``v=<number>``; it counts once the writer has put its success mark there, so a reader sees either the old or
the new version, and a load that fails half way changes nothing. Old versions are removed by ``prune``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first; only names are listed, no file is read."""
    p, fs = _files(spark, f"{path}/v=*/_SUCCESS")
    found = fs.globStatus(p) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version, None before the first."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def commit(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as the next version and read it back; ``df`` may read the version before."""
    spark = df.sparkSession
    found = _versions(spark, path)
    target = f"{path}/v={found[-1] + 1 if found else 0}"
    writer = df.write.mode("overwrite")  # an unfinished folder of this number is replaced
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    return spark.read.parquet(target)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give the single file that matches ``source`` the name ``target``."""
    p, fs = _files(spark, source)
    to, _ = _files(spark, target)
    fs.mkdirs(to.getParent())
    fs.rename(fs.globStatus(p)[0].getPath(), to)


def prune(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the newest ``keep`` versions."""
    for v in _versions(spark, path)[:-keep]:
        remove(spark, f"{path}/v={v}")
