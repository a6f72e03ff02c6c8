"""Tree ensembles on weighted cells: a forest with row resampling, and boosted trees for several classes at once.

Rows reach these learners as cells, one for each distinct combination of encoded features, with a count per class. The
cells of categorical and binned features do not grow with the rows, so a learner holds them as arrays: the trees of a
forest are dealt over tasks, and each boosted fit is one task of its own. ``fits`` says whether the cells are few enough;
where features hardly repeat, cells are as many as rows and the callers take Spark's own distributed learners instead.

Drawing rows with replacement from a cell of n equal rows is a Poisson draw with mean n, and keeping each row with
probability s a binomial draw, so resampling cells equals resampling rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import bounded_rows

MAX_CELLS = 200_000
MAX_TREES = 100_000
CUTS = 64
PENALTY = 1.0  # added to the second-order sums of a leaf
LEAST_WEIGHT = 1.0
# One row for each tree; nodes in order, the values of a node one after the other.
TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, below array<int>, above array<int>, value array<double>"


@dataclass(frozen=True)
class Table:
    """Distinct feature rows with their class counts, in one fixed order, and where they may be split."""

    x: np.ndarray  # cells x columns
    counts: np.ndarray  # cells x classes
    columns: np.ndarray  # column of each possible split
    cuts: np.ndarray  # rows above the cut go up
    above: list[np.ndarray]  # cells above each split


@dataclass(frozen=True)
class Ensemble:
    """Trees end to end; ``roots`` are the first nodes."""

    feature: np.ndarray  # -1 for a leaf
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray  # nodes x classes
    roots: np.ndarray

    def totals(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves' values for each row."""
        out = np.zeros((len(x), self.value.shape[1]))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.feature[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                up = x[inner, self.feature[here]] > self.cut[here]
                at[inner] = np.where(up, self.above[here], self.below[here])
            out += self.value[at]
        return out


class TreeLearner:
    """Scores ``features`` with an ensemble; ``prediction`` is the class with the largest total."""

    def __init__(self, ensemble: Ensemble):
        self.ensemble = ensemble

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.ensemble)

        @F.pandas_udf("double")
        def choose(entries: pd.Series) -> pd.Series:
            if not len(entries):
                return pd.Series([], dtype=float)
            rows, place = np.unique(np.vstack(entries.to_numpy()), axis=0, return_inverse=True)
            return pd.Series(shared.value.totals(rows).argmax(axis=1)[place.ravel()].astype(float))

        return df.withColumn("prediction", choose(vector_to_array("features")))


def fits(cells: DataFrame) -> bool:
    """Whether there are at most ``MAX_CELLS`` cells, so that they may be sent to every task."""
    return cells.limit(MAX_CELLS + 1).count() <= MAX_CELLS


def table_of(cells: DataFrame, classes: int, count: str) -> Table:
    """Cells (features, _y, count) as arrays; the caller has checked ``fits``."""
    x = vector_to_array("features")
    wide = cells.groupBy(x.alias("x")).agg(
        *[F.sum(F.when(F.col("_y") == k, F.col(count)).otherwise(0.0)).cast("double").alias(f"c{k}") for k in range(classes)]
    )
    rows = bounded_rows(wide, MAX_CELLS, "cells")
    found = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), -1)
    counts = np.array([[r[f"c{k}"] for k in range(classes)] for r in rows], dtype=float).reshape(len(rows), classes)
    order = np.lexsort(found.T[::-1]) if found.size else np.arange(len(rows))
    return make_table(found[order], counts[order])


def make_table(x: np.ndarray, counts: np.ndarray) -> Table:
    """Splits lie half-way between neighbouring values, at weighted quantiles if a column has very many."""
    columns, cuts = [], []
    for column in range(x.shape[1]):
        values, place = np.unique(x[:, column], return_inverse=True)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > CUTS:
            share = np.cumsum(np.bincount(place.ravel(), counts.sum(axis=1)))[:-1] / counts.sum()
            middle = middle[np.unique(np.searchsorted(share, np.arange(1, CUTS + 1) / (CUTS + 1)).clip(0, len(middle) - 1))]
        columns += [column] * len(middle)
        cuts += middle.tolist()
    above = [np.flatnonzero(x[:, c] > cut) for c, cut in zip(columns, cuts)]
    return Table(x, counts, np.array(columns, dtype=int), np.array(cuts, dtype=float), above)


# --- forest -------------------------------------------------------------------------------


def grow_gini(table: Table, weights: np.ndarray, rng: np.random.Generator, depth: int, tried: int) -> list[tuple]:
    """One tree: at each node the best Gini split among ``tried`` columns drawn anew; leaves hold class shares."""
    nodes: list[tuple] = []
    width = table.x.shape[1]
    todo = [(0, np.flatnonzero(weights.sum(axis=1) > 0), 0)]
    made = 1
    while todo:
        node, rows, level = todo.pop()
        sums = weights[rows].sum(axis=0)
        share = sums / sums.sum() if sums.sum() else np.full(len(sums), 1.0 / len(sums))
        best = None
        if level < depth and np.count_nonzero(sums) > 1 and len(rows) > 1:
            # Columns come in random order; those after the first ``tried`` are looked at only if none of these splits the node.
            order = rng.permutation(width)
            for columns in (order[:tried], order[tried:]):
                splits = np.flatnonzero(np.isin(table.columns, columns))
                up = table.x[np.ix_(rows, table.columns[splits])] > table.cuts[splits]
                upper = up.T @ weights[rows]
                lower = sums - upper
                sizes = upper.sum(axis=1), lower.sum(axis=1)
                whole = np.flatnonzero((sizes[0] > 0) & (sizes[1] > 0))
                if len(whole):
                    purity = sum((side[whole] ** 2).sum(axis=1) / size[whole] for side, size in zip((upper, lower), sizes))
                    best = whole[purity.argmax()]
                    column, cut, up = int(table.columns[splits[best]]), float(table.cuts[splits[best]]), up[:, best]
                    break
        if best is None:
            nodes.append((node, -1, 0.0, -1, -1, share.tolist()))
            continue
        nodes.append((node, column, cut, made, made + 1, share.tolist()))
        todo += [(made, rows[~up], level + 1), (made + 1, rows[up], level + 1)]
        made += 2
    return nodes


def fit_forest(spark: SparkSession, table: Table, trees: int, depth: int, seed: int) -> Ensemble:
    """A forest of resampled trees, dealt over tasks; a tree depends on its number and the seed alone."""
    shared = spark.sparkContext.broadcast(table)
    tried = max(1, int(np.sqrt(table.x.shape[1])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                drawn = rng.poisson(shared.value.counts).astype(float)
                yield _frame(int(tree), grow_gini(shared.value, drawn, rng, depth, tried))

    parts = min(trees, max(1, 2 * spark.sparkContext.defaultParallelism))
    return pack(collected(spark.range(0, trees, 1, parts).mapInPandas(run, TREE_SCHEMA)), table.counts.shape[1])


# --- boosting -----------------------------------------------------------------------------


def best_splits(
    table: Table, usable: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each node the split with the largest gain (-1 if none gains) and that gain, from one histogram of all nodes."""
    total_g, total_h = np.bincount(node, g, n_nodes), np.bincount(node, h, n_nodes)
    base = total_g**2 / (total_h + PENALTY)
    best, gain = np.full(n_nodes, -1), np.full(n_nodes, 1e-9)
    for split in usable:
        rows = table.above[split]
        up_g, up_h = np.bincount(node[rows], g[rows], n_nodes), np.bincount(node[rows], h[rows], n_nodes)
        low_g, low_h = total_g - up_g, total_h - up_h
        found = up_g**2 / (up_h + PENALTY) + low_g**2 / (low_h + PENALTY) - base
        better = (found > gain) & (up_h >= LEAST_WEIGHT) & (low_h >= LEAST_WEIGHT)
        best[better], gain[better] = split, found[better]
    return best, np.where(best >= 0, gain, 0.0)


def grow_second_order(
    table: Table, g: np.ndarray, h: np.ndarray, usable: np.ndarray, depth: int, rate: float
) -> tuple[list[tuple], np.ndarray]:
    """One tree level by level on first and second derivatives; its nodes, and its value for every cell."""
    node = np.zeros(len(g), dtype=int)
    open_nodes, made = [0], 1
    nodes: dict[int, tuple] = {}
    value = np.zeros(len(g))
    for level in range(depth + 1):
        place = np.full(made, -1)
        place[open_nodes] = np.arange(len(open_nodes))
        rows = np.flatnonzero(place[node] >= 0)
        local = place[node[rows]]
        sums_g, sums_h = np.bincount(local, g[rows], len(open_nodes)), np.bincount(local, h[rows], len(open_nodes))
        best = np.full(len(open_nodes), -1)
        if level < depth:
            # Closed leaves weigh nothing; they share the place of the first open node.
            live = place[node] >= 0
            best, _ = best_splits(table, usable, np.maximum(place[node], 0), len(open_nodes), g * live, h * live)
        following = []
        for k, at in enumerate(open_nodes):
            if best[k] < 0:
                weight = -rate * sums_g[k] / (sums_h[k] + PENALTY)
                nodes[at] = (-1, 0.0, -1, -1, weight)
                value[node == at] = weight
                continue
            column, cut = int(table.columns[best[k]]), float(table.cuts[best[k]])
            nodes[at] = (column, cut, made, made + 1, 0.0)
            own = node == at
            up = table.x[:, column] > cut
            node[own & up], node[own & ~up] = made + 1, made
            following += [made, made + 1]
            made += 2
        open_nodes = following
        if not open_nodes:
            break
    return [(at, *nodes[at]) for at in sorted(nodes)], value


def boost(
    table: Table, rounds: int, depth: int, rate: float, rows_share: float, columns_share: float, seed: int
) -> Iterator[tuple[int, int, list[tuple]]]:
    """Trees (round, class, nodes) of softmax boosting; all classes of a round share the round's draw of rows."""
    cells, classes = table.counts.shape
    margin = np.zeros((cells, classes))
    width = table.x.shape[1]
    for turn in range(rounds):
        rng = np.random.default_rng([seed, turn])
        drawn = rng.binomial(table.counts.astype(np.int64), rows_share).astype(float) if rows_share < 1 else table.counts
        n = drawn.sum(axis=1)
        share = np.exp(margin - margin.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        steps = []
        for k in range(classes):
            kept = rng.permutation(width)[: max(1, int(columns_share * width))]
            usable = np.flatnonzero(np.isin(table.columns, kept))
            g, h = n * share[:, k] - drawn[:, k], 2.0 * n * share[:, k] * (1.0 - share[:, k])
            nodes, step = grow_second_order(table, g, h, usable, depth, rate)
            steps.append(step)
            yield turn, k, nodes
        margin += np.column_stack(steps)


def fit_boosted(
    spark: SparkSession, tables: list[Table], rounds: int, depth: int, rate: float = 0.05, rows_share: float = 0.9,
    columns_share: float = 0.9, seed: int = 0,
) -> list[Ensemble]:
    """One boosted ensemble for each table; every fit is a task, so several folds run side by side."""
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold in batch["id"]:
                table = shared.value[int(fold)]
                classes = table.counts.shape[1]
                for turn, k, nodes in boost(table, rounds, depth, rate, rows_share, columns_share, seed):
                    tree = (int(fold) * rounds + turn) * classes + k
                    wide = [(at, f, cut, low, up, [w if j == k else 0.0 for j in range(classes)]) for at, f, cut, low, up, w in nodes]
                    yield _frame(tree, wide)

    rows = collected(spark.range(0, len(tables), 1, max(1, len(tables))).mapInPandas(run, TREE_SCHEMA))
    out = []
    for fold, table in enumerate(tables):
        per = rounds * table.counts.shape[1]
        out.append(pack([r for r in rows if r[0] // per == fold], table.counts.shape[1]))
    return out


def _frame(tree: int, nodes: list[tuple]) -> pd.DataFrame:
    feature, cut, below, above, value = zip(*(n[1:] for n in sorted(nodes)))
    return pd.DataFrame(
        {"tree": [tree], "feature": [feature], "cut": [cut], "below": [below], "above": [above], "value": [np.concatenate(value)]}
    )


def collected(trees: DataFrame) -> list:
    """Rows of a bounded number of trees, by tree."""
    found = trees.limit(MAX_TREES + 1).toArrow().sort_by("tree")
    if len(found) > MAX_TREES:
        raise ValueError(f"more than {MAX_TREES} trees")
    columns = [found.column(c) for c in ("tree", "feature", "cut", "below", "above", "value")]
    return [tuple(np.asarray(c[i].values) if k else c[i].as_py() for k, c in enumerate(columns)) for i in range(len(found))]


def pack(rows: list, classes: int) -> Ensemble:
    if not rows:
        return Ensemble(*(np.empty(0, t) for t in (int, float, int, int)), np.empty((0, classes)), np.empty(0, int))
    sizes = np.array([len(r[1]) for r in rows])
    roots = np.cumsum(sizes) - sizes
    feature, cut, below, above, value = (np.concatenate(x) for x in list(zip(*rows))[1:])
    first = np.repeat(roots, sizes)
    return Ensemble(feature, cut, below + first, above + first, value.reshape(-1, classes), roots)
