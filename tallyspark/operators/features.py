"""Model frames: cells of equal feature values, imputation, encoding.

Training and scoring work on *cells*: one row per distinct combination of features,
label and split, with its row count as weight. Learners that take weights give the same
fit on cells as on rows, and one map-side-combined aggregate is all that touches the
full data. Features that hardly repeat leave the cells as large as the rows and still
distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyspark import settings
from tallyspark.functions.ordered import quantiles_of_cells
from tallyspark.operators.sampling import in_train
from tallyspark.session import stage

COUNT = "n"


def model_frame(df: DataFrame, target: str = "wealth_class", features: list[str] = settings.MODEL_FEATURES) -> DataFrame:
    """Available features and a present target."""
    return df.select(*[c for c in features if c in df.columns], target).dropna(subset=[target])


def numeric_features(df: DataFrame, features: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in features and isinstance(f.dataType, NumericType)]


def model_cells(
    df: DataFrame,
    target: str = "wealth_class",
    features: list[str] = settings.MODEL_FEATURES,
    keys: list[str] = settings.HOUSEHOLD_KEYS,
    extra: list[str] = [],
) -> DataFrame:
    """Staged (features, target, train, n) cells; the split is taken per row before counting."""
    present = [c for c in features if c in df.columns]
    rows = df.dropna(subset=[target]).select(
        *present, *extra, target, F.coalesce(in_train([target, *keys]), F.lit(False)).alias("train")
    )
    return stage(rows.groupBy(*present, *extra, target, "train").agg(F.count(F.lit(1)).alias(COUNT)), "cells")


@dataclass
class Fill:
    """Values that replace nulls, and the scale of numeric features."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    means: dict[str, float]
    spreads: dict[str, float]

    def filled(self, df: DataFrame, scale: bool = False) -> DataFrame:
        return df.withColumns(self.columns(scale))

    def columns(self, scale: bool) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in self.numeric:
            value = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
            out[c] = (value - self.means[c]) / (self.spreads[c] or 1.0) if scale else value
        for c in self.categorical:
            out[c] = F.coalesce(F.col(c), F.lit(self.modes[c]))
        return out


def fit_fill(cells: DataFrame, features: list[str], count: str = COUNT) -> Fill:
    """Exact medians, commonest categories (lowest on a tie), population mean and spread."""
    numeric = numeric_features(cells, features)
    categorical = [c for c in features if c not in numeric]
    medians, modes, means, spreads = {}, {}, {}, {}
    if numeric:
        long = cells.select(count, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            [count], numeric, "variable", "value"
        )
        values = long.filter(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.sum(count).alias(count))
        bound = cells.count() * len(numeric)
        found = quantiles_of_cells(values, ["variable"], "value", {"median": 0.5}, count, at_most=bound).collect()
        medians = {c: 0.0 for c in numeric} | {r["variable"]: r["median"] for r in found}
        sums = cells.agg(
            F.sum(count).alias("_n"),
            *[F.sum(F.col(count) * F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))).alias(f"s_{c}") for c in numeric],
        ).first()
        means = {c: sums[f"s_{c}"] / sums["_n"] for c in numeric}
        squares = cells.agg(
            *[
                F.sum(F.col(count) * (F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) - means[c]) ** 2).alias(c)
                for c in numeric
            ]
        ).first()
        spreads = {c: (squares[c] / sums["_n"]) ** 0.5 for c in numeric}
    if categorical:
        long = cells.select(count, *categorical).unpivot([count], categorical, "variable", "value")
        tallied = long.filter(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.sum(count).alias("k"))
        best = tallied.groupBy("variable").agg(F.min(F.struct((-F.col("k")).alias("k"), "value"))["value"].alias("mode"))
        modes = {c: "" for c in categorical} | {r["variable"]: r["mode"] for r in best.collect()}
    return Fill(numeric, categorical, medians, modes, means, spreads)


@dataclass
class Encoder:
    fill: Fill
    model: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``; imputation happens beside the raw columns, which stay as they are."""
        prepared = df.select("*", *[c.alias(f"_x_{n}") for n, c in self.fill.columns(scale=True).items()])
        encoded = self.model.transform(prepared)
        return encoded.drop(*[c for c in encoded.columns if c.startswith("_x_")])


def fit_encoder(cells: DataFrame, features: list[str], count: str = COUNT) -> Encoder:
    """Standardised numerics and one-hot categories; an unseen category encodes as all zeros."""
    fill = fit_fill(cells, features, count)
    prepared = cells.select(*[c.alias(f"_x_{n}") for n, c in fill.columns(scale=True).items()])
    stages, inputs = [], [f"_x_{c}" for c in fill.numeric]
    if fill.categorical:
        names = [f"_x_{c}" for c in fill.categorical]
        codes, hot = [f"{n}_i" for n in names], [f"{n}_h" for n in names]
        # 'keep' puts unseen values in a last slot, which dropLast then removes.
        stages.append(StringIndexer(inputCols=names, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Encoder(fill, Pipeline(stages=stages).fit(prepared))
