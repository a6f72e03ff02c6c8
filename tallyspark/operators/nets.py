"""Feed-forward net on weighted cells: sigmoid layers, softmax output, mean log loss over all rows, L-BFGS.

Spark's learner takes no weights, so it has to pass over every row in each iteration. The loss of a cell counts once for each
of its rows here, which gives the same objective from the same start. Tasks hold blocks of cells and add up loss and
gradient; only sums as long as the weights reach the driver. Fitted weights go into Spark's own model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 10  # steps that the curvature is read from
TOLERANCE = 1e-6
PAST = 20  # loss values that a converged one is held against
TRIALS = 10  # of a line search, and of its zoom

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def loss_and_gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Summed log loss of weighted rows, then its gradient."""
    parts, at = [], 0
    for width, out in zip(layers, layers[1:]):
        parts.append((weights[at : at + width * out].reshape(width, out), weights[at + width * out : at + (width + 1) * out]))
        at += (width + 1) * out
    values = [x]
    for matrix, offset in parts[:-1]:
        values.append(1.0 / (1.0 + np.exp(-np.clip(values[-1] @ matrix + offset, -700, 700))))
    scores = values[-1] @ parts[-1][0] + parts[-1][1]
    scores -= scores.max(axis=1, keepdims=True)
    total = np.log(np.exp(scores).sum(axis=1))
    rows = np.arange(len(y))
    loss = float((n * (total - scores[rows, y])).sum())
    delta = np.exp(scores - total[:, None])
    delta[rows, y] -= 1.0
    delta *= n[:, None]
    found = []
    for (matrix, _), value in zip(parts[::-1], values[::-1]):
        found += [delta.sum(axis=0), (value.T @ delta).ravel()]
        if value is not x:
            delta = delta @ matrix.T * value * (1.0 - value)
    return np.concatenate([[loss], *found[::-1]])


def _line_search(along: Callable[[float], tuple[float, float]], step: float) -> float | None:
    """A step that meets the strong Wolfe conditions, or None; ``along`` gives value and slope."""
    start = low = (0.0, *along(0.0))
    if start[2] > 0:
        return None

    def too_high(c):
        return c[1] > start[1] + 1e-4 * c[0] * start[2]

    def zoom(low, high):
        for _ in range(TRIALS):
            left, right = (high, low) if low[0] > high[0] else (low, high)
            wide = right[0] - left[0]
            one = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0]) if wide else 0.0
            two = math.sqrt(max(one * one - left[2] * right[2], 0.0))
            bottom = right[2] - left[2] + 2 * two
            t = right[0] - wide * (right[2] + two - one) / bottom if bottom else left[0] + wide / 2
            t = min(max(t, left[0] + 0.1 * wide), left[0] + 0.9 * wide)
            c = (t, *along(t))
            if too_high(c) or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(start[2]):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    for trial in range(TRIALS):
        c = (step, *along(step))
        if not math.isfinite(c[1]):
            step /= 2
            continue
        if too_high(c) or (c[1] >= low[1] and trial > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(start[2]):
            return step
        if c[2] >= 0:
            return zoom(c, low)
        low, step = c, step * 1.5
    return None


def least(objective: Objective, x: np.ndarray, max_iter: int) -> tuple[np.ndarray, list[float]]:
    """Weights of the least value found by L-BFGS, and the value at the start and after each step."""
    value, slope = objective(x)
    history, moves = [value], []
    while len(history) <= max_iter:
        if np.linalg.norm(slope) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way, shares = -slope, []
        for s, g in reversed(moves):
            shares.append((s @ way) / (s @ g))
            way = way - shares[-1] * g
        if moves:
            way = way * (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1])
        for (s, g), share in zip(moves, reversed(shares)):
            way = way + s * (share - (g @ way) / (s @ g))
        seen = {0.0: (value, slope)}

        def along(t: float) -> tuple[float, float]:
            if t not in seen:
                seen[t] = objective(x + t * way)
            return seen[t][0], float(seen[t][1] @ way)

        step = _line_search(along, 1.0 if moves else 1.0 / np.linalg.norm(way))
        if step is None:
            if not moves:
                break
            moves = []  # once more, straight down
            continue
        (value, new), before = seen[step], slope
        x, slope = x + step * way, new
        if (step * way) @ (new - before) > 0:
            moves = [*moves, (step * way, new - before)][-MEMORY:]
        history.append(value)
        past = history[-PAST:]
        if len(history) > PAST and abs(value - max(past)) <= TOLERANCE * abs(history[0]):
            break
    return x, history


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays = [
            batch.column("x").flatten().to_numpy(), batch.column("y").to_numpy().astype(np.int64), batch.column("n").to_numpy()
        ]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["x", "y", "n"])


def fit_net(
    encoded: DataFrame, count: str, hidden: tuple[int, ...], classes: int, max_iter: int, seed: int, tasks: int
) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
    """Spark's model with weights fitted on cells (features, _y, count), and the loss history."""
    spark = encoded.sparkSession
    one = encoded.select("features", "_y").limit(1)
    width = len(one.first()["features"])
    layers = [width, *hidden, max(classes, 2)]

    def model(**options) -> MultilayerPerceptronClassificationModel:
        learner = MultilayerPerceptronClassifier(layers=layers, labelCol="_y", featuresCol="features", maxIter=0, seed=seed, **options)
        return learner.fit(one)

    rows = encoded.select(vector_to_array("features").alias("x"), F.col("_y").alias("y"), F.col(count).cast("double").alias("n"))
    blocks = rows.coalesce(tasks).mapInArrow(_packed, "x binary, y binary, n binary").rdd.map(
        lambda r: (np.frombuffer(r["x"]).reshape(-1, width), np.frombuffer(r["y"], np.int64), np.frombuffer(r["n"]))
    ).persist()
    size = float(blocks.map(lambda block: block[2].sum()).sum())

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(weights)
        sums = blocks.map(lambda block: loss_and_gradient(shared.value, layers, *block)).treeReduce(lambda a, b: a + b) / size
        shared.destroy()
        return float(sums[0]), sums[1:]

    try:
        # Without an iteration Spark's learner gives the model of its seeded start.
        weights, history = least(objective, model().weights.toArray(), max_iter)
    finally:
        blocks.unpersist()
    return model(initialWeights=Vectors.dense(weights)), history
