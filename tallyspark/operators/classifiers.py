"""Classifier benchmark on weighted cells: fit, compare, validate over time, explain."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import hash_word
from tallyspark.operators.features import COUNT, Encoder, fit_encoder
from tallyspark.operators.metrics import confusion_counts, scores, subgroup_scores
from tallyspark.operators.nets import fit_net
from tallyspark.operators import trees
from tallyspark.operators.profiles import survey_years
from tallyspark.session import stage

ROWS_PER_TASK = 20_000
SIDE_BY_SIDE = 4
NET = "mlp_classifier"
DEPTH = 30  # the deepest forest that Spark's own learner grows


class Classifier:
    """Encoder, target index and fitted learner; ``predict`` adds a ``prediction`` label."""

    def __init__(self, encoder: Encoder, labels: list[str], learner, expand: Callable[[DataFrame], DataFrame]):
        self.encoder, self.labels, self.learner, self.expand = encoder, labels, learner, expand

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.learner.transform(self.expand(self.encoder.transform(df)))
        names = F.array(*[F.lit(v) for v in self.labels])
        label = F.element_at(names, F.col("prediction").cast("int") + 1)
        return scored.select(*df.columns, label.alias("prediction"))


def _logistic(n_rows: int, width: int, classes: int, **_):
    # An L2 penalty of 1 against the summed loss is 1/n against the mean loss.
    return LogisticRegression(
        family="multinomial", maxIter=1000, regParam=1.0 / max(n_rows, 1), standardization=False, weightCol=COUNT, labelCol="_y"
    )


def _forest(n_rows: int, width: int, classes: int, trees: int = 300, depth: int = DEPTH, **_):
    # Reached when features hardly repeat: cells are rows then, and resampling cells is resampling rows.
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, bootstrap=True, featureSubsetStrategy="sqrt", seed=settings.SEED,
        weightCol=COUNT, labelCol="_y", maxMemoryInMB=1024,
    )


def _boosted(n_rows: int, width: int, classes: int, rounds: int = 300, depth: int = 6, **_):
    # As for the forest; one tree ensemble per class.
    one = GBTClassifier(
        maxIter=rounds, stepSize=0.05, maxDepth=depth, subsamplingRate=0.9, seed=settings.SEED, weightCol=COUNT, labelCol="_y"
    )
    return OneVsRest(classifier=one, labelCol="_y", weightCol=COUNT, parallelism=classes)


def _margin(n_rows: int, width: int, classes: int, **_):
    one = LinearSVC(maxIter=100, regParam=1.0 / max(n_rows, 1), labelCol="_y", weightCol=COUNT)
    return OneVsRest(classifier=one, labelCol="_y", weightCol=COUNT, parallelism=classes)


def _on_cells(name: str, encoded: DataFrame, classes: int, rounds: int = 300, depth: int | None = None, **options) -> trees.TreeLearner:
    """Forest with row resampling, or boosting of all classes at once, on cells that are few enough."""
    spark, table = encoded.sparkSession, trees.table_of(encoded, classes, COUNT)
    if name == "random_forest":
        return trees.TreeLearner(trees.fit_forest(spark, table, options.get("trees", 300), depth or DEPTH, settings.SEED))
    return trees.TreeLearner(trees.fit_boosted(spark, [table], rounds, depth or 6, seed=settings.SEED)[0])


LEARNERS = {"logistic_regression": _logistic, "random_forest": _forest, "svm_rbf": _margin, "boosted_trees": _boosted}


def fourier_features(width: int, gamma: float, size: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Random Fourier features of an RBF kernel: one matrix product per Arrow batch."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=math.sqrt(2 * gamma), size=(width, size))
    offsets = rng.uniform(0, 2 * math.pi, size)

    @F.pandas_udf("array<double>")
    def project(entries: pd.Series) -> pd.Series:
        x = np.vstack(entries.to_numpy())
        return pd.Series(list(np.cos(x @ weights + offsets) * math.sqrt(2.0 / size)))

    def expand(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))

    return expand


def kernel_scale(encoded: DataFrame, width: int) -> float:
    """1 / (width x variance of all matrix entries), the usual scale of an RBF kernel."""
    entries = F.col("_e")
    sums = encoded.select(COUNT, vector_to_array("features").alias("_e")).agg(
        F.sum(COUNT).alias("n"),
        F.sum(F.col(COUNT) * F.aggregate(entries, F.lit(0.0), lambda a, x: a + x)).alias("s"),
        F.sum(F.col(COUNT) * F.aggregate(entries, F.lit(0.0), lambda a, x: a + x * x)).alias("q"),
    ).first()
    cells = sums["n"] * width
    variance = sums["q"] / cells - (sums["s"] / cells) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def fit_classifier(name: str, cells: DataFrame, target: str, features: list[str], **options) -> Classifier:
    """Fit one learner on weighted cells."""
    train = cells.select(*features, target, COUNT)
    encoder = fit_encoder(train, features)
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    labels = list(indexer.labels)
    encoded = indexer.transform(encoder.transform(train)).withColumn(COUNT, F.col(COUNT).cast("double"))
    head = encoded.agg(F.sum(COUNT), F.first("features")).first()
    n_rows, width = int(head[0]), len(head[1])
    expand: Callable[[DataFrame], DataFrame] = lambda df: df
    if name == "svm_rbf":
        expand = fourier_features(width, kernel_scale(encoded, width), options.get("fourier_size", 64), settings.SEED)
    if name in ("random_forest", "boosted_trees") and trees.fits(train):
        return Classifier(encoder, labels, _on_cells(name, encoded, len(labels), **options), expand)
    prepared = keep_vectors(expand(encoded).select("_y", "features", COUNT), train.count())
    learner = LEARNERS[name](n_rows=n_rows, width=width, classes=len(labels), **options).fit(prepared)
    prepared.unpersist()
    return Classifier(encoder, labels, learner, expand)


def first_splits(cells: DataFrame, target: str, features: list[str], rate: float = 0.05) -> DataFrame:
    """The root of each class's first boosted tree on all rows: its gain and its two leaves."""
    train = cells.select(*features, target, COUNT)
    encoder = fit_encoder(train, features)
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    encoded = indexer.transform(encoder.transform(train)).withColumn(COUNT, F.col(COUNT).cast("double"))
    table = trees.table_of(encoded, len(indexer.labels), COUNT)
    n = table.counts.sum(axis=1)
    share, every = 1.0 / len(indexer.labels), np.arange(len(table.columns))
    rows = []
    for k, (_, _, nodes) in enumerate(trees.boost(table, 1, 1, rate, 1.0, 1.0, settings.SEED)):
        g, h = n * share - table.counts[:, k], 2.0 * n * share * (1.0 - share)
        _, gain = trees.best_splits(table, every, np.zeros(len(n), dtype=int), 1, g, h)
        leaves = sorted(float(node[-1]) for node in nodes if node[1] < 0)
        rows.append((indexer.labels[k], float(gain[0]), leaves[0], leaves[-1]))
    return cells.sparkSession.createDataFrame(rows, "wealth_class string, gain double, low_leaf double, high_leaf double")


def keep_vectors(df: DataFrame, size: int) -> DataFrame:
    """Hold what a learner iterates over in executor storage, in tasks of a useful size.

    A lost executor only means recomputing its partitions from the staged cells.
    """
    return df.coalesce(max(1, size // ROWS_PER_TASK)).persist()


def fit_network(
    rows: DataFrame, target: str, features: list[str], hidden: tuple[int, ...] = (128, 64), max_iter: int = 120
) -> tuple[Classifier, list[float]]:
    """Feed-forward net on rows; returns it with its loss history."""
    cells = rows.groupBy(*features, target).agg(F.count(F.lit(1)).alias(COUNT))
    return fit_network_cells(stage(cells, "cells"), target, features, hidden, max_iter)


def fit_network_cells(
    cells: DataFrame, target: str, features: list[str], hidden: tuple[int, ...] = (128, 64), max_iter: int = 120
) -> tuple[Classifier, list[float]]:
    """The same net on weighted cells: an iteration costs as much as there are cells, not rows."""
    train = cells.select(*features, target, COUNT)
    encoder = fit_encoder(train, features)
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    labels = list(indexer.labels)
    encoded = indexer.transform(encoder.transform(train)).select("_y", "features", COUNT)
    learner, history = fit_net(encoded, COUNT, hidden, len(labels), max_iter, settings.SEED, max(1, train.count() // ROWS_PER_TASK))
    return Classifier(encoder, labels, learner, lambda df: df), history


def evaluate(predictions: DataFrame, target: str, keys: list[str] = []) -> DataFrame:
    return scores(confusion_counts(predictions, target, "prediction", keys, F.col(COUNT)), keys)


def compare_fitted(models: dict[str, Classifier], test_cells: DataFrame, target: str) -> DataFrame:
    """Accuracy and macro F1 of fitted models on the held-out cells."""
    tables = [
        evaluate(model.predict(test_cells), target).select(F.lit(name).alias("model"), "accuracy", "macro_f1")
        for name, model in models.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tables)


def compare_models(
    cells: DataFrame, names: list[str], target: str = "wealth_class", features: list[str] = settings.MODEL_FEATURES, **options
) -> DataFrame:
    """Fit on the training cells, then compare."""
    models = {name: fit_classifier(name, cells.filter("train"), target, features, **options) for name in names}
    return compare_fitted(models, cells.filter("NOT train"), target)


def temporal_validation(
    cells: DataFrame, names: list[str], target: str = "wealth_class", features: list[str] = settings.MODEL_FEATURES,
    net: bool = False, **options,
) -> DataFrame:
    """Train on all earlier years, test on each later one; ``net`` adds the feed-forward net."""
    years = survey_years(cells)

    def fold(test_year: int, name: str) -> DataFrame | None:
        earlier, later = cells.filter(F.col("YEAR") < test_year), cells.filter(F.col("YEAR") == test_year)
        sizes = earlier.agg(F.sum(COUNT), F.count_distinct(target)).first()
        if not sizes[0] or sizes[1] < 2:
            return None
        if name == NET:
            model = fit_network_cells(earlier, target, features)[0]
        else:
            model = fit_classifier(name, earlier, target, features, **options)
        return evaluate(model.predict(later), target).select(
            F.lit(" | ".join(str(y) for y in years if y < test_year)).alias("train_years"), F.lit(test_year).alias("test_year"),
            F.lit(name).alias("model"), "accuracy", "macro_f1", F.lit(int(sizes[0])).cast("bigint").alias("n_train"),
            F.col("n_obs").alias("n_test"),
        )

    # Folds and learners do not depend on each other; small fits leave cores free for one another.
    jobs = [(year, name) for year in years[1:] for name in [*names, *([NET] if net else [])]]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        tables = [t for t in pool.map(lambda job: fold(*job), jobs) if t is not None]
    return reduce(lambda a, b: a.unionByName(b), tables)


def permuted_cells(
    rows: DataFrame, keys: list[str], target: str, features: list[str], repeats: int = 5, seed: int = settings.SEED
) -> DataFrame:
    """Cells of the test rows with one feature permuted, per feature and repeat.

    For each repeat the rows fall into random buckets of about a thousand; within a
    bucket, in random order, every row takes the value of the next row and the last that
    of the first. That is a permutation of the column, needs no global row number, and
    no bucket grows with the data. One shuffle per repeat serves all features. The keys
    must identify a row: exact copies would share a bucket.
    """
    buckets = max(1, rows.count() // 1000)
    repeated = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    # All columns enter the hash, so rows that share a key still spread out.
    mix = [F.col("repeat"), *keys, *[c for c in rows.columns if c not in keys]]
    repeated = repeated.withColumns(
        {"_b": hash_word(f"{seed}-bucket", *mix) % buckets, "_o": hash_word(f"{seed}-order", *mix)}
    )
    order = Window.partitionBy("repeat", "_b").orderBy("_o", *keys)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.coalesce(F.lead(F.struct(*features)).over(order), F.first(F.struct(*features)).over(whole))
    paired = repeated.select(*features, target, "repeat", donor.alias("_d"))
    swaps = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), *[(F.col(f"_d.{c}") if c == f else F.col(c)).alias(c) for c in features])
                for f in features
            ]
        )
    )
    long = paired.select(target, "repeat", swaps.alias("s")).select(target, "repeat", "s.*")
    return long.groupBy("feature", "repeat", *features, target).agg(F.count(F.lit(1)).alias(COUNT))


def permutation_importance(
    model: Classifier, rows: DataFrame, keys: list[str], target: str, features: list[str], repeats: int = 5
) -> DataFrame:
    """Drop in macro F1 when a feature is permuted: mean and population spread over repeats."""
    base_cells = rows.groupBy(*features, target).agg(F.count(F.lit(1)).alias(COUNT))
    base = evaluate(model.predict(base_cells), target).first()["macro_f1"]
    permuted = stage(permuted_cells(rows, keys, target, features, repeats), "permuted")
    table = evaluate(model.predict(permuted), target, ["feature", "repeat"])
    drop = F.lit(float(base)) - F.col("macro_f1")
    return table.groupBy("feature").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))


def ablation(
    rows: DataFrame, train: Column, target: str, features: list[str], sets: dict[str, list[str]], max_iter: int = 120
) -> DataFrame:
    """Held-out scores of the net on subsets of the features; subsets under two columns are skipped."""
    # Counted once: the cells of a subset are sums of these.
    counted = stage(rows.groupBy(*features, target, train.alias("train")).agg(F.count(F.lit(1)).alias(COUNT)), "cells")
    tables = []
    for name, wanted in {**sets, "all_features": features}.items():
        used = [c for c in features if c in wanted]
        if len(used) < 2:
            continue
        cells = counted.groupBy(*used, target, "train").agg(F.sum(COUNT).alias(COUNT))
        model, _ = fit_network_cells(cells.filter("train"), target, used, max_iter=max_iter)
        tables.append(
            evaluate(model.predict(cells.filter("NOT train")), target).select(
                F.lit(name).alias("specification"), F.lit(len(used)).alias("n_features"), "accuracy", "macro_f1"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), tables)


def subgroups(predictions: DataFrame, target: str, dimensions: list[str]) -> DataFrame:
    return subgroup_scores(predictions, target, "prediction", dimensions, count=F.col(COUNT))
