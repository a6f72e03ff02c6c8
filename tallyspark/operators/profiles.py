"""Descriptive profiles: summaries, yearly means, gaps, cohorts, regions, convergence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import decoded, flag, number, period, ratio, weighted_mean
from tallyspark.functions.ordered import quantiles_of_cells
from tallyspark.operators.quality import MAX_YEARS
from tallyspark.session import bounded_rows, stage

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def summary_stats(df: DataFrame, columns: list[str] = settings.SUMMARY_VARS) -> DataFrame:
    """Count, mean, spread, range and exact quartiles per variable, from value counts."""
    present = [c for c in columns if c in df.columns]
    long = df.select(*[number(c).alias(c) for c in present]).unpivot([], present, "variable", "value")
    cells = stage(
        long.filter(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")), "values"
    )
    moments = cells.groupBy("variable").agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    spread = (
        cells.join(moments.select("variable", "mean"), "variable")
        .groupBy("variable")
        .agg(
            F.sqrt(
                F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2) / F.nullif(F.sum("n") - 1, F.lit(0))
            ).alias("std")
        )
    )
    return moments.join(spread, "variable").join(
        quantiles_of_cells(cells, ["variable"], "value", QUARTILES, "n", at_most=cells.count()), "variable"
    )


def yearly_mean(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Mean per year; weighted pairs with a missing side drop out."""
    weight = weight if weight in df.columns else None
    kept = df.filter(F.col("YEAR").isNotNull() & F.col(value).isNotNull())
    return kept.groupBy("YEAR").agg(weighted_mean(value, weight).alias(value))


def urban_rural_wealth(households: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    urban = "URBAN_H" if "URBAN_H" in households.columns else "URBAN"
    out = (
        households.filter(F.col("YEAR").isNotNull() & F.col(urban).isNotNull())
        .groupBy("YEAR", F.col(urban).alias("URBAN_CODE"))
        .agg(F.avg(wealth).alias("mean_wealth_index"), F.count(F.lit(1)).alias("n_households"))
    )
    return out.withColumn("URBAN_LABEL", decoded("URBAN_CODE", settings.URBAN_LABELS))


def gender_gap(joined: DataFrame, keys: list[str], wealth: str = "wealth_index", observed_rate: bool = True) -> DataFrame:
    """Weighted means of schooling, age and household wealth per group of persons."""
    kept = joined
    for key in keys:
        kept = kept.filter(F.col(key).isNotNull())
    weight = number("PERWT")
    measures = [
        F.count(F.lit(1)).alias("N_PERSONS"),
        weighted_mean(number("EDATTAIN_H"), weight).alias("MEAN_EDUCATION_ATTAINMENT"),
        weighted_mean(number("AGE"), weight).alias("MEAN_AGE"),
        weighted_mean(number(wealth), weight).alias("MEAN_HOUSEHOLD_WEALTH"),
    ]
    if observed_rate:
        measures.append(F.avg(flag(F.col("CLASSWK_H").isNotNull())).alias("CLASSWK_OBSERVED_RATE"))
    return kept.groupBy(*keys).agg(*measures)


def cohort_profiles(frame: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    return frame.groupBy("COHORT_DECADE", "YEAR").agg(
        F.avg("EDATTAIN_H").alias("mean_education_attainment"),
        F.avg(wealth).alias("mean_household_wealth"),
        F.count(F.lit(1)).alias("n_persons"),
    )


def education_rich_probability(frame: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    return frame.groupBy("YEAR", "EDATTAIN_H").agg(
        F.avg(flag(F.col("wealth_class") == "rich")).alias("rich_probability"),
        F.avg(wealth).alias("mean_WEALTH_INDEX"),
        F.count(F.lit(1)).alias("n_persons"),
    )


def region_year_wealth(households: DataFrame, wealth: str = "wealth_index", region: str = "GEO1_VN") -> DataFrame:
    """Weighted mean wealth per region and year; a missing weight counts as 1."""
    kept = households.dropna(subset=["YEAR", region, wealth])
    weight = F.coalesce(number("HHWT"), F.lit(1.0))
    sums = kept.groupBy("YEAR", region).agg(
        F.sum(F.col(wealth) * weight).alias("wealth_x_weight"),
        F.count(F.lit(1)).alias("household_count"),
        F.sum(weight).alias("weight_sum"),
    )
    return sums.withColumn("weighted_mean_wealth", ratio("wealth_x_weight", "weight_sum"))


def sigma_convergence(region_year: DataFrame, region: str = "GEO1_VN") -> DataFrame:
    """Spread of regional means per year, plain and relative to their mean."""
    spread = F.stddev_samp("weighted_mean_wealth")
    return region_year.groupBy("YEAR").agg(
        spread.alias("sigma_std"),
        (spread / F.nullif(F.avg("weighted_mean_wealth"), F.lit(0.0))).alias("sigma_cv"),
        F.count_distinct(region).alias("region_count"),
    )


def subgroup_sensitivity(households: DataFrame, wealth: str = "wealth_index", least: int = 100) -> DataFrame:
    return (
        households.filter(F.col("URBAN_H").isNotNull() & F.col("YEAR").isNotNull())
        .groupBy("URBAN_H", period("YEAR").alias("PERIOD_GROUP"))
        .agg(
            F.avg(wealth).alias("mean_wealth_index"),
            F.stddev_samp(wealth).alias("gini_proxy_std"),
            F.count(F.lit(1)).alias("n_households"),
        )
        .filter(F.col("n_households") >= least)
    )


def beta_convergence(region_year: DataFrame, region: str = "GEO1_VN") -> DataFrame:
    """Growth of regional wealth on its initial log level, with HC1 errors.

    Two regression terms in closed form from the one-row-per-region table.
    """
    staged = stage(region_year.select("YEAR", region, "weighted_mean_wealth"), "regions")
    ends = staged.agg(F.min("YEAR"), F.max("YEAR")).first()
    first, last = ends[0], ends[1]
    waves = list(dict.fromkeys([first, last]))
    wide = staged.groupBy(region).pivot("YEAR", waves).agg(F.max("weighted_mean_wealth"))
    wide = wide.select(F.col(str(first)).alias("a"), F.col(str(last)).alias("b")).dropna()
    low = wide.agg(F.min(F.least("a", "b"))).first()[0]
    shift = abs(low) + 1.0 if low is not None and low <= 0 else 0.0
    points = wide.select(
        F.log(F.col("a") + shift).alias("x"), (F.log(F.col("b") + shift) - F.log(F.col("a") + shift)).alias("y")
    )
    line = points.agg(
        F.regr_slope("y", "x").alias("b1"),
        F.regr_intercept("y", "x").alias("b0"),
        F.avg("x").alias("mx"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    b0, b1, mean_x, sxx = (F.lit(line[k]).cast("double") for k in ["b0", "b1", "mx", "sxx"])
    error = (F.col("y") - b0 - b1 * F.col("x")) ** 2
    centred = (F.col("x") - mean_x) / F.nullif(sxx, F.lit(0.0))
    lever = 1 / F.lit(float(line["n"] or 1)) - mean_x * centred
    sums = points.agg(
        F.max(b0).alias("b0"), F.max(b1).alias("b1"), F.count(F.lit(1)).alias("n"),
        F.sum(error * centred**2).alias("v1"),
        F.sum(error * lever**2).alias("v0"),
    )
    factor = F.col("n") / F.nullif(F.col("n") - 2, F.lit(0))
    slope = sums.select((F.col("b1") / F.nullif(F.sqrt(F.col("v1") * factor), F.lit(0.0))).alias("z")).first()["z"]
    return sums.select(
        F.lit(int(first)).alias("period_start"),
        F.lit(int(last)).alias("period_end"),
        F.col("b0").alias("intercept"),
        F.col("b1").alias("beta_coefficient"),
        F.sqrt(F.col("v0") * factor).alias("intercept_se"),
        F.sqrt(F.col("v1") * factor).alias("beta_se"),
        F.lit(None if slope is None else normal_p_value(slope)).cast("double").alias("beta_p_value"),
        F.col("n").alias("n_regions"),
        F.when(F.col("b1") < 0, "Slope below zero: regions that started lower gained more.")
        .otherwise("Slope not below zero: regions that started higher gained more.")
        .alias("interpretation"),
    )


def normal_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def survey_years(df: DataFrame) -> list[int]:
    found = df.select(F.col("YEAR").cast("int").alias("YEAR")).distinct().filter(F.col("YEAR").isNotNull())
    return sorted(r[0] for r in bounded_rows(found, MAX_YEARS, "survey years"))


def rank_models(comparison: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Best and worst model in one aggregate; equal scores resolve by name."""
    key = F.struct(F.col(score), F.col("model"))
    ends = comparison.agg(F.max(key).alias("best"), F.min(key).alias("worst"))
    return ends.select(
        F.col("best.model").alias("best_model"), F.col(f"best.{score}").alias("best_score"),
        F.col("worst.model").alias("baseline_model"), F.col(f"worst.{score}").alias("baseline_score"),
    )


def top_rows(df: DataFrame, order: list, k: int, buckets: int = 64) -> DataFrame:
    """First k rows. Tasks keep k each, a layer of buckets merges those, one task merges the buckets."""
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    bucketed = df.withColumn("_bucket", F.spark_partition_id() % buckets).withColumn("_place", place)
    return bucketed.filter(F.col("_place") <= k).drop("_bucket", "_place").orderBy(*order).limit(k)


def within_group_slope(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Slope of y on x with one intercept per group, from group sums only.

    Equals the regression with a dummy per group, but needs no dummy columns, so the
    number of groups is free. The within sums combine on the map side.
    """
    kept = df.select(group, number(y).alias("_y"), number(x).alias("_x")).dropna()
    per_group = kept.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_sxx("_y", "_x").alias("sxx")
    )
    return per_group.agg(
        (F.sum("sxy") / F.nullif(F.sum("sxx"), F.lit(0.0))).alias("slope"),
        F.sum("n").alias("n_obs"),
        F.count(F.lit(1)).alias("n_groups"),
    )
