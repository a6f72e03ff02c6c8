"""Toxic texts by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences. A sentence is toxic with probability ``sigmoid(bias + sum of the weights of its
features)``, and the document with probability ``1 - (1 - leak) * product(1 - sentence)``, the noisy-or of its sentences and
of a leak that stands for labels no sentence explains. Weights, bias and leak are fitted to document labels alone, by
quasi-Newton steps on the likelihood with a square penalty; the fitted model then tells which sentences offend.

Features of a sentence are its lower-cased words of letters and the beginnings and ends of longer words, so unseen forms
of known stems count too. Only features that at least ``MIN_DOCS`` documents hold and whose share of toxic documents
differs from the mean by ``MIN_Z`` standard errors enter, at most ``FEATURES``. Sentences end after ``.``, ``!``, ``?`` or a
line; those without a word are left out.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the lowest hashes of their ids, each read whole;
its size and that of the gradients is bounded by ``FEATURES``. Each step sums gradients in Spark over the stored bags.
Scoring reads every text whole, and nothing but the text.

Results: one row for each input row. A null or empty text has the leak as its score. An id whose labels differ counts
as toxic; null labels and rows without an id are never learned from. With labels of one kind only, every score is that kind;
without labels it is 0. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import Words, byte_hashes, mix, slices, text_bytes, words_of
from tallyspark.session import stage

SAMPLE = 12_000
FEATURES = 4_096
MIN_DOCS = 5
MIN_Z = 4.0
PENALTY = 0.3
STEPS = 60
MEMORY = 8
PARTS = 8
BEGINNINGS = range(3, 8)
ENDS = range(3, 7)
OFFENDS = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # uint64, sorted
    weights: np.ndarray
    bias: float
    leak: float  # log odds


@dataclass
class Bags:
    """Sentences with a word, text by text, and the known features of each."""

    sentence_text: np.ndarray  # the text of each sentence
    sentence_number: np.ndarray  # its number within the text, sentences without a word counted
    entry_sentence: np.ndarray  # sentences of the (sentence, feature) pairs
    entry_feature: np.ndarray
    n_texts: int

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.entry_sentence, weights[self.entry_feature], len(self.sentence_text))

    def evidence(self, margins: np.ndarray, leak: float) -> np.ndarray:
        """Minus the log probability that neither a sentence nor the leak makes a text toxic."""
        return np.bincount(self.sentence_text, np.logaddexp(0, margins), self.n_texts) + np.logaddexp(0, leak)


def _lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with spaces for the usual punctuation outside ASCII."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    data, bounds = text_bytes(texts)
    data = data.copy()
    wide = np.flatnonzero(data[:-1] == 0xC2)  # signs of Latin-1
    marks = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80))  # general punctuation
    for k in range(2):
        data[wide + k] = 32
    for k in range(3):
        data[marks + k] = 32
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))


def _feature_hashes(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and hashes of one kind of feature after the other."""
    yield np.arange(len(words.hashes)), words.hashes
    chars = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    first, last = np.searchsorted(chars, words.starts), np.searchsorted(chars, words.ends)
    for size in BEGINNINGS:
        own = np.flatnonzero(last - first > size)
        yield own, mix(byte_hashes(words, words.starts[own], chars[first[own] + size]) + np.uint64(size))
    for size in ENDS:
        own = np.flatnonzero(last - first > size)
        yield own, mix(byte_hashes(words, chars[last[own] - size], words.ends[own]) + np.uint64(256 + size))


def make_bags(texts: pa.Array, features: np.ndarray) -> Bags:
    words = words_of(_lowered(texts), _LETTER)
    rows = words.rows()
    stops = np.flatnonzero(_STOP[words.data])
    before = np.searchsorted(stops, words.starts)
    number = before - np.searchsorted(stops, words.text_offsets[:-1])[rows]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (before[1:] != before[:-1])
    sentence = np.cumsum(new) - 1
    pairs = []
    if len(features):
        for own, hashes in _feature_hashes(words):
            place = np.searchsorted(features, hashes)
            place[place == len(features)] = 0
            known = np.flatnonzero(features[place] == hashes)
            pairs.append(sentence[own[known]] * len(features) + place[known])
    entries = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    width = max(1, len(features))
    return Bags(rows[new], number[new], entries // width, entries % width, len(texts))


def _feature_counts(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with how many of the texts, and of the toxic ones, hold them."""
    words = words_of(_lowered(texts), _LETTER)
    rows = words.rows()
    found = [(rows[own], hashes) for own, hashes in _feature_hashes(words)]
    row, hashes = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, hashes))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    features, at = np.unique(hashes, return_index=True)
    bounds = np.append(at, len(hashes))
    toxic = np.concatenate(([0], np.cumsum(labels[row])))
    return features, np.diff(bounds), toxic[bounds[1:]] - toxic[bounds[:-1]]


def loss_and_gradient(bags: Bags, labels: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of the labels; theta: weights, bias, leak."""
    margins = bags.margins(theta[:-2], theta[-2])
    evidence = np.maximum(bags.evidence(margins, theta[-1]), 1e-12)
    with np.errstate(over="ignore"):
        slope = np.where(labels == 1, -1 / np.expm1(evidence), 1.0)
        loss = np.where(labels == 1, -np.log(-np.expm1(-evidence)), evidence).sum()
        pull = slope[bags.sentence_text] / (1 + np.exp(-margins))
        leak = slope.sum() / (1 + np.exp(-theta[-1]))
    weights = np.bincount(bags.entry_feature, pull[bags.entry_sentence], len(theta) - 2)
    return float(loss), np.concatenate((weights, [pull.sum(), leak]))


def minimise(measure: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; ends when a step gains less than a ten-thousandth."""
    loss, gradient = measure(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, shares = gradient.copy(), []
        for move, change in reversed(moves):
            share = (move @ direction) / (move @ change)
            shares.append(share)
            direction -= share * change
        size = np.linalg.norm(gradient)
        if size == 0:
            break
        direction *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / size
        for (move, change), share in zip(moves, reversed(shares)):
            direction += move * (share - (change @ direction) / (move @ change))
        width, down = 1.0, gradient @ direction
        while True:
            tried = theta - width * direction
            new_loss, new_gradient = measure(tried)
            if new_loss <= loss - 1e-4 * width * down or width < 1e-4:
                break
            width *= 0.4
        if new_loss > loss:
            break
        move, change = tried - theta, new_gradient - gradient
        if move @ change > 1e-10:
            moves = [*moves, (move, change)][-MEMORY:]
        gained = loss - new_loss
        theta, loss, gradient = tried, new_loss, new_gradient
        if gained < 1e-4 * abs(loss):
            break
    return theta


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """Stored texts with labels: at most SAMPLE ids, dealt by their hashes, in the same order each time."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.dropna().groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    # Thinned by a hash first, so the sort holds only little more than it keeps.
    total = known.count()
    if total > 2 * SAMPLE:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(total)) < 2 * SAMPLE)
    chosen = known.orderBy(F.pmod(F.xxhash64("id"), F.lit(max(1, total))), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # No more than SAMPLE ids.
    joined = texts.join(F.broadcast(chosen), "id").select("id", "label", F.coalesce("text", F.lit("")).alias("text"))
    dealt = joined.repartition(PARTS, F.xxhash64("id")).sortWithinPartitions("id", F.xxhash64("text"))
    return stage(dealt, "labelled")


def _select(rows: DataFrame, n_docs: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that tell toxic documents, sorted, with their smoothed log lifts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                features, n, toxic = _feature_counts(part.column("text"), part.column("label").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features.view(np.int64)), pa.array(n, pa.int64()), pa.array(toxic, pa.int64())], ["feature", "n", "toxic"]
                )

    counts = rows.select("text", "label").mapInArrow(count, "feature long, n long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    rate = n_toxic / n_docs
    z = F.abs(F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    told = counts.filter(F.col("n") >= MIN_DOCS).withColumn("z", z).filter(F.col("z") >= MIN_Z)
    found = told.orderBy(F.desc("z"), "feature").limit(FEATURES).toArrow()
    features = found.column("feature").to_numpy().view(np.uint64)
    n, toxic = (found.column(c).to_numpy().astype(float) for c in ("n", "toxic"))
    order = np.argsort(features)
    return features[order], np.log((toxic + 5 * rate) / (n + 5) / rate)[order]


def _stored_bags(rows: DataFrame, features: np.ndarray) -> DataFrame:
    """One row for each text: its label, how many sentences it has, and its (sentence, feature) pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bags = make_bags(part.column("text"), shared.value)
                sizes = np.bincount(bags.sentence_text, minlength=bags.n_texts)
                first = np.cumsum(sizes) - sizes
                text = bags.sentence_text[bags.entry_sentence]
                bounds = np.searchsorted(text, np.arange(bags.n_texts + 1)).astype(np.int32)
                lists = (
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()))
                    for values in (bags.entry_sentence - first[text], bags.entry_feature)
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(sizes, pa.int32()), *lists], ["label", "sentences", "sentence", "feature"]
                )

    schema = "label int, sentences int, sentence array<int>, feature array<int>"
    return stage(rows.select("text", "label").mapInArrow(run, schema), "bags")


def _batch_bags(batch: pa.RecordBatch) -> Bags:
    sizes = batch.column("sentences").to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    sentence = batch.column("sentence")
    text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(sentence).to_numpy(zero_copy_only=False))
    return Bags(
        np.repeat(np.arange(batch.num_rows), sizes), np.empty(0, np.int64), first[text] + sentence.flatten().to_numpy(),
        batch.column("feature").flatten().to_numpy().astype(np.int64), batch.num_rows,
    )


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> Model:
    """A model of ``labels`` (id, label) over the texts of ``docs``."""
    rows = _labelled(docs, labels, id_column, text_column, label_column)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not 0 < totals["toxic"] < totals["n"]:
        return Model(np.empty(0, np.uint64), np.empty(0), -np.inf, np.inf if totals["toxic"] else -np.inf)
    features, lifts = _select(rows, totals["n"], totals["toxic"])
    bags = _stored_bags(rows, features)
    context = bags.sparkSession.sparkContext

    def measure(theta: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(theta)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = 0.0, np.zeros(len(shared.value))
            for batch in batches:
                more = loss_and_gradient(_batch_bags(batch), batch.column("label").to_numpy(), shared.value)
                loss, gradient = loss + more[0], gradient + more[1]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "gradient"])

        # One row from each task; sorted, so that the sum does not depend on which task ends first.
        parts = sorted((r["loss"], bytes(r["gradient"])) for r in bags.mapInArrow(run, "loss double, gradient binary").collect())
        shared.unpersist()
        weights = np.append(theta[:-2], (0.0, 0.0))
        loss = sum(p[0] for p in parts) + PENALTY / 2 * float(weights @ weights)
        return loss, sum(np.frombuffer(p[1]) for p in parts) + PENALTY * weights

    # The start: weights by the lift of each feature, a rare sentence, half of the labels left to the leak.
    rate = totals["toxic"] / totals["n"]
    each = max(1.0, (bags.agg(F.sum("sentences")).first()[0] or 0) / totals["n"])
    start = np.concatenate((np.maximum(lifts - 0.7, 0), [np.log(rate / each) - 4, np.log(rate / 2)]))
    theta = minimise(measure, start)
    return Model(features, theta[:-2], float(theta[-2]), float(theta[-1]))


def _spans(texts: pa.Array, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of sentences by their numbers: first and end, on the texts as they are."""
    data, bounds = text_bytes(texts)
    stops = np.flatnonzero(_STOP[data])
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first = np.searchsorted(stops, bounds[:-1])[rows]
    after = np.append(stops, len(data))
    starts = np.where(numbers > 0, after[np.maximum(first + numbers - 1, 0)] + 1, bounds[:-1][rows])
    ends = np.minimum(after[np.minimum(first + numbers, len(stops))] + 1, bounds[1:][rows])
    return points[starts] - points[bounds[:-1][rows]], points[ends] - points[bounds[:-1][rows]]


def score_texts(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the texts; texts, numbers and scores of the sentences that offend.

    A sentence offends at a score of ``OFFENDS``; a text that reaches it only by several sentences shows its highest one.
    """
    bags = make_bags(texts, model.features)
    margins = bags.margins(model.weights, model.bias)
    score = -np.expm1(-bags.evidence(margins, model.leak))
    each = np.exp(-np.logaddexp(0, -margins))
    offends = each >= OFFENDS
    order = np.lexsort((bags.sentence_number, -each, bags.sentence_text))
    texts_with, at = np.unique(bags.sentence_text[order], return_index=True)
    top = order[at]
    offends[top[score[texts_with] >= OFFENDS]] = True
    shown = np.flatnonzero(offends)
    return score, bags.sentence_text[shown], bags.sentence_number[shown], each[shown]


SENTENCES = "sentences array<struct<number:long,start:long,end:long,score:double>>"


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id_column, score, sentences): the sentences that offend, by code points of the text."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, {SENTENCES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                scores, row, number, each = score_texts(texts, shared.value)
                start, end = _spans(texts, row, number)
                values = [pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(each)]
                structs = pa.StructArray.from_arrays(values, ["number", "start", "end", "score"])
                bounds = np.searchsorted(row, np.arange(len(scores) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), structs)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores), lists], ["id", "score", "sentences"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
