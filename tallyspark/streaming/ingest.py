"""Incremental ingest: the batch expressions on a stream, and mergeable counts, sums and distinct sketches.

The state of each summary has one row per group, whose number does not grow with the rows: survey years, or years and
regions. Summaries of several streams or batches merge without reading the rows again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.columns import number, ratio
from tallyspark.operators.cleaning import clean_and_harmonize
from tallyspark.operators.quality import logical_checks
from tallyspark.session import PIECEWISE, ROW_GROUP, configured
from tallyspark.sources.rules import RuleSet


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def ingest(stream: DataFrame, rules: RuleSet, out: str, checkpoint: str) -> None:
    """Clean and harmonise what has arrived and append it by year; every step is row-local."""
    # A file is open for each year, so that no task has to sort its rows by year first.
    with configured(stream.sparkSession, {**PIECEWISE, "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_YEARS)}):
        query = (
            clean_and_harmonize(stream, rules)
            .writeStream.outputMode("append")
            .partitionBy("YEAR")
            .option("checkpointLocation", checkpoint)
            .option("parquet.block.size", ROW_GROUP)
            .trigger(availableNow=True)
            .format("parquet")
            .start(out)
        )
        query.awaitTermination()


OPEN_YEARS = 32  # beyond them a task sorts the rest of its rows
SKETCH_BITS = 14  # registers of a distinct sketch, as a power of two: errors of about 0.7 %


def _summary(aggregated: DataFrame, checkpoint: str) -> DataFrame:
    """The state of an aggregated stream after all that has arrived, as a table."""
    name = f"summary_{uuid.uuid4().hex}"
    query = (
        aggregated.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("memory")
        .queryName(name)
        .start()
    )
    query.awaitTermination()
    return aggregated.sparkSession.table(name)


def stream_missingness(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Missing counts per year and variable, merged over micro-batches in the state store.

    The state and the result hold one row per survey year.
    """
    counts = (
        stream.filter(F.col("YEAR").isNotNull())
        .groupBy(F.col("YEAR").cast("int").alias("_year"))
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in stream.columns])
    )
    long = _summary(counts, checkpoint).unpivot(["_year", "_rows"], stream.columns, "VARIABLE", "_present")
    return long.select(
        F.col("_year").alias("YEAR"), "VARIABLE", F.col("_rows").alias("N_ROWS"),
        (F.col("_rows") - F.col("_present")).alias("N_MISSING"),
    ).withColumn("MISSING_RATE", ratio("N_MISSING", "N_ROWS"))


def stream_sketches(stream: DataFrame, variables: list[str], checkpoint: str) -> DataFrame:
    """A distinct sketch (YEAR, VARIABLE, SKETCH) of the present values of each variable and year, kept as state."""
    sketches = (
        stream.filter(F.col("YEAR").isNotNull())
        .groupBy(F.col("YEAR").cast("int").alias("_year"))
        .agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in variables])
    )
    return _summary(sketches, checkpoint).unpivot("_year", variables, "VARIABLE", "SKETCH").withColumnRenamed("_year", "YEAR")


def distinct_counts(parts: list[DataFrame]) -> DataFrame:
    """Estimated distinct values per year and variable over the sketches of several batches or streams."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("YEAR", "VARIABLE").agg(F.hll_union_agg("SKETCH").alias("_all"))
    return merged.select("YEAR", "VARIABLE", F.hll_sketch_estimate("_all").alias("N_UNIQUE"))


def stream_checks(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Failing rows per logical check; tables of several streams add up in ``combine_checks``."""
    return _summary(logical_checks(stream), checkpoint)


def stream_sums(stream: DataFrame, keys: list[str], value: str, weight: str, checkpoint: str) -> DataFrame:
    """Rows, weight and weighted sum for each group of ``keys``, of the rows that have keys, value and weight."""
    kept = stream.select(*keys, number(value).alias("_x"), number(weight).alias("_w")).dropna()
    sums = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("_w").alias("weight"), F.sum(F.col("_w") * F.col("_x")).alias("weighted_sum")
    )
    return _summary(sums, checkpoint)


def group_means(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Weighted mean and rows of each group, over the sums of several batches or streams."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_obs", "weight", "weighted_sum")])
    return merged.select(*keys, ratio("weighted_sum", "weight").alias("weighted_mean"), "n_obs")
