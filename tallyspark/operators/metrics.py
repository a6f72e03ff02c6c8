"""Classification scores from confusion counts, the only thing they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import ratio


def confusion_counts(
    df: DataFrame, label: str, prediction: str, keys: list[str] = [], count: Column | None = None
) -> DataFrame:
    """(keys, label, prediction, n); shuffles one row per task and class pair."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.sum(F.lit(1).cast("bigint") if count is None else count).alias("n")
    )


def class_report(confusion: DataFrame, keys: list[str] = []) -> DataFrame:
    """Precision, recall, F1 and support per class seen as label or prediction; 0/0 is 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pre"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pre"), F.lit(0).cast("bigint").alias("tp")),
    )
    tallied = (
        confusion.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.cls").alias("cls"))
        .agg(F.sum("s.sup").alias("support"), F.sum("s.pre").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    zero = F.lit(0.0)
    return tallied.select(
        *keys, "cls",
        F.coalesce(ratio("tp", "predicted"), zero).alias("precision"),
        F.coalesce(ratio("tp", "support"), zero).alias("recall"),
        F.coalesce(ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")), zero).alias("f1"),
        "support", "tp",
    )


def scores(confusion: DataFrame, keys: list[str] = []) -> DataFrame:
    """Accuracy and unweighted mean of per-class F1."""
    return class_report(confusion, keys).groupBy(*keys).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("n_obs"),
    )


def subgroup_scores(
    df: DataFrame, label: str, prediction: str, dimensions: list[str], least: int = 30, count: Column | None = None
) -> DataFrame:
    """Scores per value of each dimension, all dimensions in one pass; small groups drop out."""
    sides = F.explode(
        F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dimensions])
    )
    weight = F.lit(1).cast("bigint") if count is None else count
    long = df.select(
        sides.alias("g"), F.col(label).alias("_label"), F.col(prediction).alias("_pred"), weight.alias("_n")
    ).select(F.col("g.d").alias("subgroup_dimension"), F.col("g.v").alias("subgroup_value"), "_label", "_pred", "_n")
    keys = ["subgroup_dimension", "subgroup_value"]
    confusion = confusion_counts(
        long.filter(F.col("subgroup_value").isNotNull()), "_label", "_pred", keys, F.col("_n")
    )
    return scores(confusion, keys).filter(F.col("n_obs") >= least)
