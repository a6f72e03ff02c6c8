"""Order statistics from value counts: running totals, quantiles, ranks, Gini.

Rows are first reduced to (group, distinct value) counts, which combine on the map
side, so a group holding a third of all rows costs no more than its distinct values.
Running totals over those cells use one window while the cells are few. Beyond
``WINDOW_CELLS`` they are range-partitioned by value: totals per slice give each
slice its offset, and every slice is summed on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import number
from tallyspark.functions.joins import HOT_ROWS, skew_join
from tallyspark.session import stage

WINDOW_CELLS = 2_000_000


def value_cells(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, value) with the given sums; null keys and values drop out."""
    kept = df.filter(F.col(value).isNotNull())
    for key in keys:
        kept = kept.filter(F.col(key).isNotNull())
    return kept.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def running_totals(
    cells: DataFrame,
    keys: list[str],
    value: str,
    sums: list[str],
    window_cells: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive, in value order) and ``tot_<s>`` per group.

    ``at_most`` is a known bound on the number of cells; under the window limit it saves
    storing and counting them.
    """
    limit = WINDOW_CELLS if window_cells is None else window_cells
    if at_most is not None and at_most <= limit:
        return _window_totals(cells, keys, value, sums)
    staged = stage(cells, "cells")
    if staged.count() <= limit:
        return _window_totals(staged, keys, value, sums)
    return _sliced_totals(staged, keys, value, sums)


def _window_totals(cells: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    group = keys or [F.lit(1)]
    ordered = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    return cells.select(
        "*",
        *[F.sum(s).over(ordered).alias(f"cum_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"tot_{s}") for s in sums],
    )


def _sliced_totals(cells: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    # The slice number is stored with the rows, so a recomputed task sees the same slices.
    sliced = stage(
        cells.repartitionByRange(*keys, value).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    group = keys or [F.lit(1)]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_slice.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = sliced.join(offsets, [*keys, "_slice"])
    return joined.select(
        *cells.columns,
        *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"tot_{s}" for s in sums],
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    count: Column | None = None,
    window_cells: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group; ``count`` weights repeated rows."""
    cells = value_cells(df, keys, value, {"_n": F.lit(1) if count is None else count})
    return quantiles_of_cells(cells, keys, value, probs, "_n", window_cells)


def quantiles_of_cells(
    cells: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    n: str,
    window_cells: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    ranked = running_totals(cells.select(*keys, value, n), keys, value, [n], window_cells, at_most)
    found, out = [], []
    for name, p in probs.items():
        place = F.lit(p) * (F.col(f"tot_{n}") - 1)
        found.append(F.min(F.when(F.col(f"cum_{n}") > F.floor(place), F.col(value))).alias(f"_lo_{name}"))
        found.append(F.min(F.when(F.col(f"cum_{n}") > F.ceil(place), F.col(value))).alias(f"_hi_{name}"))
        share = F.lit(p) * (F.col("_tot") - 1)
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((low + (high - low) * (share - F.floor(share))).alias(name))
    return ranked.groupBy(*keys).agg(F.max(f"tot_{n}").alias("_tot"), *found).select(*keys, *out)


def average_ranks(
    cells: DataFrame, keys: list[str], value: str, n: str, out: str, at_most: int | None = None
) -> DataFrame:
    """Rank of each distinct value, ties sharing their average rank."""
    ranked = running_totals(cells, keys, value, [n], at_most=at_most)
    extra = [c for c in cells.columns if c not in (*keys, value, n)]
    rank = F.col(f"cum_{n}") - F.col(n) + (F.col(n) + 1) / 2
    return ranked.select(*keys, value, rank.alias(out), F.col(f"tot_{n}").alias("_total"), *extra)


def spearman(df: DataFrame, keys: list[str], a: str, b: str, count: Column | None = None) -> DataFrame:
    """Rank correlation of two columns on complete pairs, per group."""
    pairs = df.select(*keys, number(a).alias("_a"), number(b).alias("_b"), (F.lit(1) if count is None else count).alias("_w"))
    pairs = stage(
        pairs.filter(F.col("_a").isNotNull()).groupBy(*keys, "_a", "_b").agg(F.sum("_w").alias("_n")).filter("_b is not null"),
        "pairs",
    )
    for key in keys:
        pairs = pairs.filter(F.col(key).isNotNull())
    size = pairs.count()

    def ranks(side: str, out: str) -> DataFrame:
        cells = value_cells(pairs, keys, side, {"_n": F.col("_n"), "_cells": F.lit(1)})
        return average_ranks(cells, keys, side, "_n", out, at_most=size)

    # One value may pair with very many others; the number of pair cells per value is known.
    known = {"_ka": "_ka", "_kb": "_kb"} if size > HOT_ROWS else {}
    a = ranks("_a", "_ra").withColumnRenamed("_cells", "_ka")
    b = ranks("_b", "_rb").withColumnRenamed("_cells", "_kb").drop("_total")
    ranked = skew_join(pairs, a, [*keys, "_a"], known.get("_ka"), "inner").drop("_ka")
    ranked = skew_join(ranked, b, [*keys, "_b"], known.get("_kb"), "inner")
    da = F.col("_ra") - (F.col("_total") + 1) / 2
    db = F.col("_rb") - (F.col("_total") + 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_n") * da * db).alias("_ab"),
        F.sum(F.col("_n") * da * da).alias("_aa"),
        F.sum(F.col("_n") * db * db).alias("_bb"),
    )
    return sums.select(*keys, (F.col("_ab") / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0))).alias("rho"))


def gini(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Weighted Gini coefficient per group.

    Negative values shift the whole group up by its minimum. The shift s enters the
    closed form as ``1 - (A + s W^2) / (W (X + s W))`` with A = sum w (2 cum(xw) - xw),
    so no second pass over the data is needed.
    """
    x, w = number(value), F.lit(1.0) if weight is None else number(weight)
    rows = df.select(*keys, F.when(w.isNotNull(), x).alias("_x"), F.when(x.isNotNull(), w).alias("_w"))
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    # Incomplete pairs stay as one empty cell per group, so a group without values still reports.
    cells = rows.groupBy(*keys, "_x").agg(
        F.coalesce(F.sum("_w"), F.lit(0.0)).alias("w"),
        F.coalesce(F.sum(F.col("_x") * F.col("_w")), F.lit(0.0)).alias("xw"),
    )
    ranked = running_totals(cells, keys, "_x", ["xw"])
    parts = ranked.groupBy(*keys).agg(
        F.sum("w").alias("_W"),
        F.sum("xw").alias("_X"),
        F.sum(F.col("w") * (2 * F.col("cum_xw") - F.col("xw"))).alias("_A"),
        F.min("_x").alias("_min"),
    )
    shift = F.greatest(-F.col("_min"), F.lit(0.0))
    base = F.col("_X") + shift * F.col("_W")
    area = F.col("_A") + shift * F.col("_W") * F.col("_W")
    coefficient = 1 - area / F.nullif(F.col("_W") * base, F.lit(0.0))
    return parts.select(
        *keys,
        F.when(F.col("_min").isNull(), F.lit(None).cast("double"))
        .when((F.col("_W") == 0) | (base == 0), 0.0)
        .otherwise(coefficient)
        .alias("GINI"),
    )
