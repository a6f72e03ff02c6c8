"""Household and person tables, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import cohort_decade, flag, number, ratio
from tallyspark.functions.joins import HOT_ROWS, skew_join

KEYS = settings.HOUSEHOLD_KEYS


def first_present(name: str, order: Column) -> Column:
    """Aggregate: first non-null value by ``order``; the value itself breaks ties."""
    return F.min(F.when(F.col(name).isNotNull(), F.struct(order.alias("o"), F.col(name).alias("v"))))["v"]


def household_rollup(
    df: DataFrame, carried: list[str] = settings.HOUSEHOLD_COLUMNS, order: str = "PERNUM"
) -> DataFrame:
    """One row per household: size, first non-null member values and derived ratios.

    One shuffle on (YEAR, SERIAL); every aggregate combines on the map side.
    """
    missing = [c for c in KEYS if c not in df.columns]
    if missing:
        raise ValueError(f"missing household id columns: {missing}")
    place = F.col(order) if order in df.columns else F.lit(0)
    present = [c for c in carried if c in df.columns]
    out = (
        df.filter(F.col("YEAR").isNotNull() & F.col("SERIAL").isNotNull())
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("HOUSEHOLD_SIZE"), *[first_present(c, place).alias(c) for c in present])
    )
    derived = {}
    if "LIVEAREA" in present:
        derived["AREA_PER_PERSON"] = ratio("LIVEAREA", "HOUSEHOLD_SIZE")
    if "ROOMS" in present:
        derived["ROOMS_PER_PERSON"] = ratio("ROOMS", "HOUSEHOLD_SIZE")
    if {"AUTOS", "MOTORCYCLE"} <= set(present):
        derived["VEHICLE_COUNT"] = F.coalesce(number("AUTOS"), F.lit(0.0)) + F.coalesce(
            number("MOTORCYCLE"), F.lit(0.0)
        )
    return out.withColumns(derived) if derived else out


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order; combines on the map side, so hot keys stay cheap.

    Columns outside the keys are compared in full to break ties, so they must be orderable.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    ranked = F.struct(*[F.col(c) for c in lead + [c for c in rest if c not in lead]])
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("_first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def person_table(df: DataFrame, keep: list[str] = settings.PERSON_COLUMNS) -> DataFrame:
    """Person columns that are present, plus a working-age flag (15 to 64)."""
    missing = [c for c in settings.PERSON_KEYS if c not in df.columns]
    if missing:
        raise ValueError(f"missing person id columns: {missing}")
    out = df.select(*[c for c in keep if c in df.columns])
    if "AGE" in out.columns:
        out = out.withColumn("IS_WORKING_AGE", flag(F.col("AGE").between(15, 64)))
    return out


def join_households(
    persons: DataFrame, households: DataFrame, columns: list[str], suffix: str = "_HH", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of household columns to persons; clashing names take the suffix.

    The planner broadcasts households only when their size is small, and otherwise
    hash-partitions both sides on the household key. HOUSEHOLD_SIZE tells which keys are
    hot; those few are joined apart.
    """
    size = "HOUSEHOLD_SIZE" if "HOUSEHOLD_SIZE" in households.columns else None
    right = households.select(
        *KEYS,
        *[F.col(c).alias(c + suffix if c in persons.columns else c) for c in columns],
        *([F.col(size).alias("_size")] if size else []),
    )
    return skew_join(persons, right, KEYS, "_size" if size else None, hot_rows=hot_rows).drop("_size")


def education_frame(joined: DataFrame, wealth: str = "wealth_index") -> DataFrame:
    """Persons joined to household wealth, with numeric schooling and birth-cohort decade."""
    numeric = joined.withColumns(
        {c: number(c) for c in ["AGE", "EDATTAIN_H", wealth, "PERWT"] if c in joined.columns}
    )
    kept = numeric.dropna(subset=["YEAR", "AGE", "EDATTAIN_H"])
    return kept.withColumns(
        {"BIRTH_YEAR_PROXY": F.col("YEAR") - F.col("AGE"), "COHORT_DECADE": cohort_decade("YEAR", "AGE")}
    )


def join_yearly_series(
    values: DataFrame, series: DataFrame, year: str = "YEAR", scale: float = 1e9
) -> DataFrame:
    """Attach a yearly outside series; a year it does not list gives 0, an empty cell stays null."""
    right = series.select(F.col("year").alias(year), (F.col("value") / scale).alias("_v"), F.lit(True).alias("_hit"))
    joined = values.join(right, year, "left")
    return joined.withColumn("Macro_Metric", F.when(F.col("_hit"), F.col("_v")).otherwise(0.0)).drop("_v", "_hit")
