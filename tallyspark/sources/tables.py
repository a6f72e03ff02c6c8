"""Scans with tolerant projection, partitioned sinks and report output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyspark.functions.columns import upper_names


def scan(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read a table with upper-case names; wanted columns match in any case, absent ones are skipped.

    The projection reaches the file scan, so unread columns cost nothing.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return prune(upper_names(reader.load(path)), columns)


def prune(df: DataFrame, columns: list[str] | None) -> DataFrame:
    if columns is None:
        return df
    present = {c.upper(): c for c in df.columns}
    return df.select(*[present[c.upper()] for c in columns if c.upper() in present])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder per report; array columns must be joined to text before."""
    paths = {}
    for name, report in reports.items():
        paths[name] = f"{folder}/{name}"
        report.write.mode("overwrite").option("header", True).csv(paths[name])
    return paths


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def load_or_build(
    spark: SparkSession, raw_path: str, stored: dict[str, str], build: Callable[[str], dict[str, DataFrame]]
) -> dict[str, DataFrame]:
    """Build tables from the raw file; without it use the stored ones; with neither, fail."""
    if exists(spark, raw_path):
        return build(raw_path)
    if all(exists(spark, p) for p in stored.values()):
        return {name: spark.read.parquet(p) for name, p in stored.items()}
    raise FileNotFoundError(f"neither {raw_path} nor all stored tables {sorted(stored)} exist")
