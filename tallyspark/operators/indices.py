"""Composite indices: first principal component, classes, additive scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import digits, number, total
from tallyspark.functions.ordered import exact_quantiles, quantiles_of_cells, spearman
from tallyspark.operators.quality import GROUP, value_counts
from tallyspark.session import bounded_rows, stage

MIN_VARIABLES = 3
MAX_GROUPS = 10_000


@dataclass
class Component:
    """First principal component of one year's standardised variables."""

    variables: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    loadings: list[float]
    eigenvalue: float

    def score(self) -> Column:
        terms = [
            (F.coalesce(number(v), F.lit(m)) - F.lit(mu)) / F.lit(s) * F.lit(w)
            for v, m, mu, s, w in zip(self.variables, self.medians, self.means, self.scales, self.loadings)
            if s > 0
        ]
        return reduce(lambda a, b: a + b, terms)


def first_component(covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """Leading eigenvector of the correlation matrix; its largest entry is positive."""
    scale = np.sqrt(np.diag(covariance))
    safe = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(safe, safe))
    lead = vectors[:, -1]
    peak = np.argmax(np.abs(lead).round(12))
    return (lead if lead[peak] > 0 else -lead), float(values[-1])


def fit_components(
    df: DataFrame, specs: dict[int, list[str]], least: int = MIN_VARIABLES
) -> dict[int, Component]:
    """Fit one component per year over that year's listed variables."""
    return fit_component_sets(df, {"one": specs}, least)["one"]


def fit_component_sets(
    df: DataFrame, sets: dict[str, dict[int, list[str]]], least: int = MIN_VARIABLES
) -> dict[str, dict[int, Component]]:
    """Fit several variable sets for all years in the same two passes.

    A year takes part with its listed variables that have more than one value, if enough
    are left. Pass one reads the medians off value counts; pass two sums cross products
    per year on the executors. Only a d x d matrix per listed year reaches the driver.
    """
    listed = {y: list(dict.fromkeys(v for s in sets.values() for v in s.get(y, []))) for s in sets.values() for y in s}
    variables = list(dict.fromkeys(v for vs in listed.values() for v in vs if v in df.columns))
    scoped = df.filter(F.col("YEAR").isin(*listed))
    cells = stage(value_counts(scoped, variables, "double").filter(F.col("VALUE").isNotNull()), "values")
    medians = quantiles_of_cells(cells, GROUP, "VALUE", {"median": 0.5}, "N", at_most=cells.count())
    distinct = cells.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_values"))
    found = {
        (r["YEAR"], r["VARIABLE"]): r for r in bounded_rows(medians.join(distinct, GROUP), MAX_GROUPS, "year variables")
    }
    usable = {
        name: {
            y: kept
            for y, vs in specs.items()
            if len(kept := [v for v in vs if (y, v) in found and found[y, v]["n_values"] > 1]) >= least
        }
        for name, specs in sets.items()
    }
    years = sorted({y for specs in usable.values() for y in specs})
    if not years:
        return {name: {} for name in sets}
    # Measured from the year's own median: a missing value is a zero, and no sum cancels badly.
    centred = scoped.filter(F.col("YEAR").isin(*years)).select(
        "YEAR",
        *[
            F.coalesce(number(v) - _by_year({y: found[y, v]["median"] for y in years if (y, v) in found}), F.lit(0.0)).alias(v)
            for v in variables
        ],
    )
    sums = centred.mapInPandas(_yearly_products(variables), "year int, i int, j int, v double")
    totals = sums.groupBy("year", "i", "j").agg(F.sum("v").alias("v"))
    size = len(variables) + 1
    products = {y: np.zeros((size, size)) for y in years}
    for r in bounded_rows(totals, len(years) * size * size, "cross products"):
        products[r["year"]][r["i"], r["j"]] = products[r["year"]][r["j"], r["i"]] = r["v"]
    return {
        name: {y: _component(y, kept, variables, products[y], found) for y, kept in specs.items()}
        for name, specs in usable.items()
    }


def _yearly_products(variables: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            data = np.column_stack([np.ones(len(pdf)), pdf[variables].to_numpy(dtype=float)])
            years = pdf["YEAR"].to_numpy()
            for year in np.unique(years):
                part = data[years == year]
                acc[int(year)] = acc.get(int(year), 0) + part.T @ part
        for year, matrix in acc.items():
            i, j = np.triu_indices(matrix.shape[0])
            yield pd.DataFrame({"year": np.int32(year), "i": i.astype("int32"), "j": j.astype("int32"), "v": matrix[i, j]})

    return run


def _component(year: int, kept: list[str], variables: list[str], products: np.ndarray, found: dict) -> Component:
    places = [variables.index(v) + 1 for v in kept]
    n = products[0, 0]
    shift = products[0, places] / n
    cov = products[np.ix_(places, places)] / n - np.outer(shift, shift)
    lead, value = first_component(cov)
    medians = [found[year, v]["median"] for v in kept]
    return Component(
        kept, medians, [m + float(s) for m, s in zip(medians, shift)], np.sqrt(np.diag(cov)).tolist(), lead.tolist(), value
    )


def _by_year(values: dict[int, object]) -> Column:
    out = F.lit(None).cast("double")
    for year, value in values.items():
        out = F.when(F.col("YEAR") == year, value if isinstance(value, Column) else F.lit(float(value))).otherwise(out)
    return out


def with_component(df: DataFrame, components: dict[int, Component], out: str) -> DataFrame:
    """Add the score; years without a component get null. Replaces a column of that name."""
    kept = df.select(*[c for c in df.columns if c.lower() != out.lower()])
    return kept.withColumn(out, _by_year({y: c.score() for y, c in components.items()}))


def loadings_table(df: DataFrame, components: dict[int, Component]) -> DataFrame:
    rows = [(int(y), v, float(w)) for y, c in components.items() for v, w in zip(c.variables, c.loadings)]
    return df.sparkSession.createDataFrame(rows, "YEAR int, variable string, loading double")


def pca_index(df: DataFrame, variables: list[str], out: str) -> DataFrame:
    """Pooled index over all rows, whatever their year."""
    available = [v for v in variables if v in df.columns]
    if len(available) < MIN_VARIABLES:
        raise ValueError(f"need at least {MIN_VARIABLES} variables, found {available}")
    pooled = df.select(F.lit(0).alias("YEAR"), *[number(v).alias(v) for v in available])
    component = fit_components(pooled, {0: available}).get(0)
    if component is None:
        raise ValueError("fewer than three variables vary")
    return df.withColumn(out, component.score())


def household_indices(
    households: DataFrame,
    assets: dict[int, list[str]] = settings.ASSET_VARS_BY_YEAR,
    housing: dict[int, list[str]] = settings.HOUSING_VARS_BY_YEAR,
) -> DataFrame:
    """Wealth index, its class within the year, and the housing-quality index."""
    fitted = fit_component_sets(households, {"assets": assets, "housing": housing})
    scored = with_component(households, fitted["assets"], "wealth_index")
    scored = with_component(scored, fitted["housing"], "housing_quality_index")
    return wealth_class(scored, "wealth_index")


def wealth_class(df: DataFrame, score: str, by: list[str] = ["YEAR"], low: float = 0.3, high: float = 0.7) -> DataFrame:
    """poor / middle / rich at the 30 % and 70 % points of each group; null score, null class.

    The two cut points per group are broadcast up to ``MAX_GROUPS``, whatever the session's limit is: a shuffle by so
    few keys would put a whole year into one task.
    """
    cuts = stage(exact_quantiles(df, by, score, {"_low": low, "_high": high}), "cuts")
    classed = df.join(F.broadcast(cuts) if cuts.count() <= MAX_GROUPS else cuts, by, "left")
    label = (
        F.when(F.col(score).isNull(), F.lit(None))
        .when(F.col(score) <= F.col("_low"), "poor")
        .when(F.col(score) <= F.col("_high"), "middle")
        .otherwise("rich")
    )
    return classed.withColumn("wealth_class", label).drop("_low", "_high")


def asset_score(df: DataFrame, variables: list[str], out: str = "asset_score_simple") -> DataFrame:
    available = [v for v in variables if v in df.columns]
    if not available:
        raise ValueError("no asset variables found")
    return df.withColumn(out, total(available))


def asset_score_by_year(df: DataFrame, specs: dict[int, list[str]], out: str = "simple_asset_score") -> DataFrame:
    """Additive score over each year's own variable list; other years get null."""
    return df.withColumn(
        out, _by_year({y: total([v for v in vs if v in df.columns]) for y, vs in specs.items() if set(vs) & set(df.columns)})
    )


def minmax(df: DataFrame, value: str, out: str, high: float = 100.0) -> DataFrame:
    """Scale to 0..high over all rows; a constant column gives 0."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = edges["lo"], edges["hi"]
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    width = float(hi - lo) or 1.0
    return df.withColumn(out, (F.col(value) - F.lit(float(lo))) / F.lit(width) * F.lit(high))


def progress_index(
    df: DataFrame, variables: list[str] = settings.PROGRESS_VARS, first: int = 1989, last: int = 2019
) -> DataFrame:
    """Pooled 0-100 index from the digits of mixed codes, oriented so that it rises over time."""
    names = [v for v in variables if v in df.columns]
    coded = df.withColumns({f"_d_{v}": digits(v) for v in names})
    pooled = coded.select(F.lit(0).alias("YEAR"), *[f"_d_{v}" for v in names])
    component = fit_components(pooled, {0: [f"_d_{v}" for v in names]}, least=1)[0]
    scored = coded.withColumn("_score", component.score()).drop(*[f"_d_{v}" for v in names])
    ends = scored.agg(
        F.avg(F.when(F.col("YEAR") == first, F.col("_score"))).alias("a"),
        F.avg(F.when(F.col("YEAR") == last, F.col("_score"))).alias("b"),
        F.min("_score").alias("lo"),
        F.max("_score").alias("hi"),
    ).first()
    sign = -1.0 if ends["a"] is not None and ends["b"] is not None and ends["a"] > ends["b"] else 1.0
    lo = min(sign * ends["lo"], sign * ends["hi"])
    width = abs(ends["hi"] - ends["lo"]) or 1.0
    return scored.withColumn(
        "wealth_progress_index", (F.col("_score") * F.lit(sign) - F.lit(lo)) / F.lit(width) * 100.0
    ).drop("_score")


def progress_means(df: DataFrame, groups: list[list[str]], value: str = "wealth_progress_index") -> DataFrame:
    """Mean by year and by year with each further key, in one grouping-sets pass."""
    keys = list(dict.fromkeys(k for g in groups for k in g))
    out = df.groupingSets([[F.col(k) for k in g] for g in groups], *[F.col(k) for k in keys]).agg(
        F.grouping_id(*keys).cast("int").alias("grouping"), F.avg(value).alias("mean_index"), F.count(value).alias("n_obs")
    )
    return out


def progress_by_schooling(persons: DataFrame, schooling: str = "EDATTAIN_H", outside: tuple[str, ...] = ("0", "9")) -> DataFrame:
    """Mean progress index by year and schooling, the index fitted on persons alone.

    Persons too young for school or of unknown schooling (codes ``outside``) take no part. Those without a code help to
    fit the index but have no group.
    """
    code = F.col(schooling).cast("string")
    scored = progress_index(persons.filter(code.isNull() | ~code.isin(*outside)))
    return progress_means(scored.filter(F.col(schooling).isNotNull()), [["YEAR", schooling]]).drop("grouping")


def index_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return spearman(df, ["YEAR"], a, b)


def robustness_main(
    households: DataFrame, assets: dict[int, list[str]] = settings.ASSET_VARS_BY_YEAR
) -> DataFrame:
    """Per-year rank agreement of the main index with an additive score."""
    simple = spearman(asset_score_by_year(households, assets), ["YEAR"], "wealth_index", "simple_asset_score")
    return simple.select("YEAR", F.lit("pca_vs_simple_asset_score").alias("comparison"), F.col("rho").alias("spearman_rho"))


def robustness_alternatives(
    households: DataFrame,
    assets: dict[int, list[str]] = settings.ASSET_VARS_BY_YEAR,
    housing: dict[int, list[str]] = settings.HOUSING_VARS_BY_YEAR,
) -> DataFrame:
    """Per-year rank agreement of the main index with indices over other variable sets."""
    columns = set(households.columns)
    variants = {
        "asset_only": assets,
        "asset_plus_rooms": {y: sorted(set(v) | ({"ROOMS", "LIVEAREA"} & columns)) for y, v in assets.items()},
        "housing_quality_alt": housing,
    }
    fitted = {name: c for name, c in fit_component_sets(households, variants).items() if c}
    # All variants in one long table: (year, variant) is the group of a single rank correlation.
    sides = [
        F.struct(
            F.lit(name).alias("specification"),
            _by_year({y: F.lit(float(len(c.variables))) for y, c in components.items()}).cast("int").alias("n_variables"),
            _by_year({y: c.score() for y, c in components.items()}).alias("alt"),
        )
        for name, components in fitted.items()
    ]
    long = households.select("YEAR", "wealth_index", F.explode(F.array(*sides)).alias("s")).select("YEAR", "wealth_index", "s.*")
    agreement = spearman(
        long.filter(F.col("n_variables").isNotNull()), ["YEAR", "specification", "n_variables"], "wealth_index", "alt"
    )
    return agreement.withColumnRenamed("rho", "correlation_with_main_wealth_index")
