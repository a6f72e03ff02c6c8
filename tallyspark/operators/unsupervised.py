"""Clusters, anomalies and low-dimensional representations on weighted cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import hash_unit, hash_word, number
from tallyspark.functions.ordered import exact_quantiles, spearman
from tallyspark.operators.features import COUNT, fit_encoder, fit_fill
from tallyspark.operators.metrics import confusion_counts, scores
from tallyspark.operators.profiles import top_rows
from tallyspark.operators.regression import SUM_SCHEMA, _gather, _upper
from tallyspark.operators.sampling import priority_sample
from tallyspark.session import bounded_rows, stage

TREE_ROWS = 256
NODE_SCHEMA = "tree int, node int, feature int, cut double, below int, above int, depth double"


def kmeans_clusters(
    cells: DataFrame, features: list[str], k: int = 3, starts: int = 10, seed: int = settings.SEED
) -> tuple[DataFrame, DataFrame]:
    """Cluster cells (best of several starts by cost); returns labelled cells and a metrics row."""
    encoder = fit_encoder(cells, features)
    prepared = encoder.transform(cells).withColumn(COUNT, F.col(COUNT).cast("double")).persist()
    best = None
    for start in range(starts):
        model = KMeans(k=k, seed=seed + start, weightCol=COUNT, predictionCol="cluster").fit(prepared)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    labelled = best[1].transform(prepared)
    width = ClusteringEvaluator(predictionCol="cluster", weightCol=COUNT).evaluate(labelled)
    size = int(cells.agg(F.sum(COUNT)).first()[0])
    prepared.unpersist()
    metrics = cells.sparkSession.createDataFrame(
        [("kmeans", k, float(width), size)], "model string, n_clusters int, silhouette_score double, sample_size bigint"
    )
    out = best[1].transform(encoder.transform(cells)).select(*cells.columns, "cluster")
    return out, metrics


def cluster_summary(labelled: DataFrame, target: str = "wealth_class") -> DataFrame:
    return labelled.groupBy("cluster", target).agg(F.sum(COUNT).alias("n_households"))


def _average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(columns: list[str], seed: int):
    """One isolation tree per group of at most a few hundred sampled rows, as node rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_o").head(TREE_ROWS)
        data = pdf[columns].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(data), 2)))
        nodes, todo = [], [(0, np.arange(len(data)), 0)]
        count = 1
        while todo:
            node, rows, depth = todo.pop()
            spread = np.ptp(data[rows], axis=0) if len(rows) else np.zeros(len(columns))
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + _average_path(len(rows))))
                continue
            feature = int(rng.choice(usable))
            values = data[rows, feature]
            cut = float(rng.uniform(values.min(), values.max()))
            left, right = rows[values <= cut], rows[values > cut]
            nodes.append((tree, node, feature, cut, count, count + 1, 0.0))
            todo += [(count, left, depth + 1), (count + 1, right, depth + 1)]
            count += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return run


def forest_score(forest: list[dict[str, np.ndarray]], typical: float):
    """A column function: the anomaly score of a row from its filled features; equal rows of a batch are scored once."""

    def score(*features: pd.Series) -> pd.Series:
        data, place = np.unique(np.column_stack([f.to_numpy(dtype=float) for f in features]), axis=0, return_inverse=True)
        length = np.zeros(len(data))
        for tree in forest:
            at = np.zeros(len(data), dtype=int)
            while True:
                feature = tree["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                here = at[inner]
                goes_down = data[np.flatnonzero(inner), feature[inner]] <= tree["cut"][here]
                at[inner] = np.where(goes_down, tree["below"][here], tree["above"][here])
            length += tree["depth"][at]
        return pd.Series((2.0 ** (-length / len(forest) / typical))[place.ravel()])

    return F.pandas_udf(score, "double")


def pack_forest(nodes: list) -> list[dict[str, np.ndarray]]:
    """Node rows as arrays, one set for each tree; a node's number is its place."""
    trees: dict[int, list] = {}
    for row in nodes:
        trees.setdefault(row["tree"], []).append(row)
    ordered = [sorted(rows, key=lambda r: r["node"]) for rows in trees.values()]
    return [{c: np.array([r[c] for r in rows]) for c in ["feature", "cut", "below", "above", "depth"]} for rows in ordered]


def flag_anomalies(df: DataFrame, columns: list[str], fill, forest, typical: float, contamination: float = 0.03) -> DataFrame:
    """``df`` with the score of every row by a given forest, and a flag beyond the exact quantile of the scores.

    Rows are scored where they lie and written once; the quantile reads the scores alone, and nothing is joined.
    """
    raw = [f"_v_{c}" for c in columns]
    filled = fill.filled(df.withColumns({r: number(c) + F.lit(0.0) for r, c in zip(raw, columns)}))
    scored = stage(filled.select(*df.columns, forest_score(forest, typical)(*raw).alias("anomaly_score")), "scores")
    keyed = scored.select(F.lit(1).alias("_g"), "anomaly_score")
    cut = exact_quantiles(keyed, ["_g"], "anomaly_score", {"cut": 1 - contamination}).first()
    limit = F.lit(float(cut["cut"]) if cut else 0.0)
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > limit).cast("int"))


def isolation_forest(
    df: DataFrame,
    columns: list[str],
    keys: list[str],
    trees: int = 100,
    contamination: float = 0.03,
    seed: int = settings.SEED,
) -> DataFrame:
    """Anomaly score and flag for every row.

    Trees only ever see 256 rows each, so they grow from one bounded hash sample, split
    over Spark by tree. The forest (about 500 nodes per tree) is all that returns.
    All rows are scored in one narrow pass; the cut is the exact quantile of their scores.
    """
    spark = df.sparkSession
    raw = [f"_v_{c}" for c in columns]
    # Grouping takes -0.0 for 0.0; adding 0.0 makes them the same text as well.
    rows = df.withColumns({r: number(c) + F.lit(0.0) for r, c in zip(raw, columns)})
    cells = stage(rows.groupBy(*raw).agg(F.count(F.lit(1)).alias(COUNT)), "cells")
    fill = fit_fill(cells, raw)
    # Sampled per row, not per combination, so common values stay common.
    pool = stage(priority_sample(rows.select(*keys, *raw), keys, trees * TREE_ROWS, seed), "pool")
    size = pool.count()
    copies = max(1, min(trees, math.ceil(trees * TREE_ROWS * 1.2 / max(size, 1))))
    copied = fill.filled(pool).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    # A row enters `copies` different trees: a hashed start, then equal steps around the ring.
    step = max(1, trees // copies)
    assigned = copied.select(
        *raw,
        ((hash_word(seed, *keys) + F.col("_j") * step) % trees).cast("int").alias("tree"),
        hash_unit(seed + 1, "_j", *keys).alias("_o"),
    )
    grown = assigned.groupBy("tree").applyInPandas(_grow(raw, seed), NODE_SCHEMA)
    forest = pack_forest(bounded_rows(grown, trees * TREE_ROWS * 2, "tree nodes"))
    typical = _average_path(min(TREE_ROWS, max(size * copies / trees, 2)))
    return flag_anomalies(df, columns, fill, forest, typical, contamination)


def anomaly_rates(flagged: DataFrame, dimensions: list[str]) -> DataFrame:
    """Share flagged per value of each dimension, from one grouping-sets pass."""
    out = flagged.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        F.grouping_id(*dimensions).alias("_id"), F.count(F.lit(1)).alias("n_obs"), F.avg("is_anomaly").alias("anomaly_rate")
    )
    width = len(dimensions)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for place, d in enumerate(dimensions):
        here = F.col("_id") == (2**width - 1) - 2 ** (width - 1 - place)
        name = F.when(here, d).otherwise(name)
        value = F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(
        name.alias("group_dimension"), value.alias("group_value"), "n_obs", "anomaly_rate"
    ).filter(F.col("group_value").isNotNull())


def top_anomalies(flagged: DataFrame, keys: list[str], k: int = 500) -> DataFrame:
    return top_rows(flagged, [F.desc("is_anomaly"), F.desc("anomaly_score"), *[F.col(c) for c in keys]], k)


def _weighted_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    acc = None
    for pdf in batches:
        x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
        block = (x * pdf[COUNT].to_numpy(dtype=float)[:, None]).T @ x
        acc = block if acc is None else acc + block
    if acc is not None:
        yield _upper(acc)


def principal_components(encoded: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues (descending) and eigenvectors of weighted feature vectors, from d x d sums."""
    arrays = encoded.select(vector_to_array("features").alias("x"), COUNT)
    gram = _gather(arrays.mapInPandas(_weighted_gram, SUM_SCHEMA), width + 1)
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    values, vectors = np.linalg.eigh(gram[1:, 1:] / n - np.outer(mean, mean))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    peaks = np.argmax(np.abs(vectors).round(12), axis=0)
    return mean, values, vectors * np.sign(vectors[peaks, np.arange(width)])


def representation_benchmark(
    cells: DataFrame,
    scored_cells: DataFrame,
    target: str,
    features: list[str],
    wealth: str = "wealth_index",
    sizes: tuple[int, ...] = (2, 3, 5),
    starts: int = 10,
) -> DataFrame:
    """Linear latent features of several sizes: loss, agreement with wealth, downstream use.

    ``cells`` carry target and split; ``scored_cells`` carry (features, wealth, n).
    """
    encoder = fit_encoder(cells, features)
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(cells)
    encoded = indexer.transform(encoder.transform(cells)).withColumn(COUNT, F.col(COUNT).cast("double")).persist()
    width = len(encoded.first()["features"])
    mean, values, vectors = principal_components(encoded, width)

    def project(df: DataFrame, k: int) -> DataFrame:
        x = vector_to_array("features")
        parts = [
            F.aggregate(
                F.zip_with(x, F.array(*[F.lit(float(w)) for w in vectors[:, j]]), lambda a, b: a * b),
                F.lit(float(-mean @ vectors[:, j])),
                lambda acc, v: acc + v,
            )
            for j in range(k)
        ]
        return df.withColumn("_z", F.array(*parts))

    first = project(encoder.transform(scored_cells), 1).select(
        F.lit(1).alias("_g"), F.col("_z")[0].alias("_z1"), F.col(wealth).alias("_w"), F.col(COUNT).alias("_k")
    )
    rho = spearman(first, ["_g"], "_z1", "_w", F.col("_k")).first()
    rows = []
    for k in sizes:
        if k > width:
            continue
        latent = project(encoded, k).withColumn("latent", array_to_vector("_z")).persist()
        train, test = latent.filter("train"), latent.filter("NOT train")
        n = train.agg(F.sum(COUNT)).first()[0]
        model = LogisticRegression(
            family="multinomial", featuresCol="latent", labelCol="_y", weightCol=COUNT, maxIter=1000,
            regParam=1.0 / n, standardization=False,
        ).fit(train)
        result = scores(confusion_counts(model.transform(test), "_y", "prediction", [], F.col(COUNT).cast("bigint"))).first()
        best = None
        for start in range(starts):
            fitted = KMeans(k=3, seed=settings.SEED + start, featuresCol="latent", weightCol=COUNT, predictionCol="cluster").fit(latent)
            if best is None or fitted.summary.trainingCost < best[0]:
                best = (fitted.summary.trainingCost, fitted)
        silhouette = ClusteringEvaluator(featuresCol="latent", predictionCol="cluster", weightCol=COUNT).evaluate(
            best[1].transform(latent)
        )
        latent.unpersist()
        rows.append(
            (
                "pca", k, float(values[k:].sum() / width), float(values[:k].sum() / values.sum()),
                rho["rho"] if rho else None, float(result["accuracy"]), float(result["macro_f1"]), float(silhouette),
            )
        )
    encoded.unpersist()
    return cells.sparkSession.createDataFrame(
        rows,
        "representation string, latent_dim int, reconstruction_mse double, explained_variance_ratio double, "
        "corr_with_wealth_index double, downstream_accuracy double, downstream_macro_f1 double, cluster_silhouette double",
    )
