"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

The test items are indexed: an inverted index from terms to items with BM25 impacts, divided by the score that an item gives
itself, so that a score is the weighted share of an item's terms that a passage holds. Every training text is cut into
passages of twice the longest item's words, each overlapping the next by half, so a whole item always lies inside one
passage; each passage is a query. As in WAND, terms that together cannot lift an item to half the threshold are optional;
only the others open candidates. Items stand in blocks of ``BLOCK``: the block maxima of a passage's required terms plus the
block's optional rest bound every score in the block, and only blocks whose bound reaches the threshold are scored in
full. All items at or above the threshold are retrieved and verified: enough word runs of the item's question (all but its
last sentence) and of its answer (the last sentence) must stand in the passage.

The index goes to every task in shards of about ``SHARD_ITEMS`` items, so its size is bounded; a larger test set has more
shards, term weights of its own in each, and one pass over the texts for each.

Results: rows (document id, item id, score, question_overlap, answer_overlap), the best passage of each pair; documents without a
leak do not appear. A null or empty text, and an item without terms, match nothing. Rows that repeat an id give one row for
each pair. Other columns are ignored. Terms are lower-cased runs of letters, digits and non-ASCII bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import Words, mix, slices, words_of

K1, B = 1.2, 0.75
BLOCK = 16
SHARD_ITEMS = 20_000
THRESHOLD = 0.6
OVERLAP = 0.6
RUN = 3
_TERM_BYTE = np.zeros(256, dtype=bool)
_TERM_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms_of(texts: pa.Array) -> Words:
    return words_of(pc.utf8_lower(texts), _TERM_BYTE)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` terms."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = mix(out) + hashes[k : k + len(out)]
    return out


def sentences(text: str) -> tuple[str, str]:
    """An item's question, all but its last sentence, and its answer; a single sentence is a question."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s+\S)|\n(?=\s*\S)", text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


@dataclass(frozen=True)
class Parts:
    """Word runs of an item's question and answer, each with its own run length."""

    question: np.ndarray
    question_run: int
    answer: np.ndarray
    answer_run: int


@dataclass(frozen=True)
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    posting_offsets: np.ndarray  # by term
    posting_items: np.ndarray
    posting_impacts: np.ndarray
    block_offsets: np.ndarray  # by term, required terms only
    block_numbers: np.ndarray
    block_maxima: np.ndarray
    optional: np.ndarray  # by block, the most that optional terms can add
    step: int  # words from one passage to the next, half a passage
    parts: list[Parts]


def _part(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    size = min(RUN, len(hashes))
    return (np.unique(runs(hashes, size)), size) if size else (np.empty(0, np.uint64), 0)


def build_index(ids: list, texts: list[str], threshold: float = THRESHOLD) -> Index | None:
    words = terms_of(pa.array(texts, pa.string()))
    lengths = np.diff(words.offsets)
    if not lengths.sum():
        return None
    terms, code = np.unique(words.hashes, return_inverse=True)
    pairs, times = np.unique(words.rows() * len(terms) + code, return_counts=True)
    item, term = np.divmod(pairs, len(terms))
    seen = np.bincount(term, minlength=len(terms))
    n = int((lengths > 0).sum())
    rarity = np.log(1 + (n - seen + 0.5) / (seen + 0.5))
    average = lengths.sum() / n
    impact = rarity[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[item] / average))
    impact = impact / np.bincount(item, weights=impact, minlength=len(ids))[item]
    # Optional: an item's weakest terms as long as they stay below half the threshold together.
    weak = np.lexsort((impact, item))
    first = np.searchsorted(item[weak], item[weak])
    total = np.cumsum(impact[weak])
    running = total - np.where(first > 0, total[first - 1], 0.0)
    is_optional = np.empty(len(pairs), dtype=bool)
    is_optional[weak] = running < threshold / 2
    rest = np.bincount(item[is_optional], weights=impact[is_optional], minlength=len(ids))
    n_blocks = -(-len(ids) // BLOCK)
    optional = np.zeros(n_blocks)
    np.maximum.at(optional, np.arange(len(ids)) // BLOCK, rest)
    needed = ~is_optional
    keys, inverse = np.unique(term[needed] * n_blocks + item[needed] // BLOCK, return_inverse=True)
    maxima = np.zeros(len(keys))
    np.maximum.at(maxima, inverse, impact[needed])
    by_term = np.argsort(term, kind="stable")
    asked = [sentences(t) for t in texts]
    questions, answers = (terms_of(pa.array([a[k] for a in asked], pa.string())) for k in (0, 1))

    def part(w: Words, k: int) -> tuple[np.ndarray, int]:
        return _part(w.hashes[w.offsets[k] : w.offsets[k + 1]])

    return Index(
        ids, terms, np.searchsorted(term[by_term], np.arange(len(terms) + 1)), item[by_term], impact[by_term],
        np.searchsorted(keys // n_blocks, np.arange(len(terms) + 1)), keys % n_blocks, maxima, optional, int(lengths.max()),
        [Parts(*part(questions, k), *part(answers, k)) for k in range(len(ids))],
    )


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def retrieve(index: Index, words: Words, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """Leaks in some texts: (text, item, score, question overlap, answer overlap) for each passage."""
    place = np.searchsorted(index.terms, words.hashes)
    place[place == len(index.terms)] = 0
    known = index.terms[place] == words.hashes
    counts = np.diff(words.offsets)
    windows = np.maximum(1, -(-counts // index.step) - 1)  # passages of each text
    window_offsets = np.concatenate(([0], np.cumsum(windows)))
    hits = np.flatnonzero(known)
    sizes = np.diff(index.block_offsets)[place[hits]]
    hits, sizes = hits[sizes > 0], sizes[sizes > 0]
    row = np.searchsorted(words.offsets, hits, side="right") - 1
    unit = (hits - words.offsets[row]) // index.step
    spread = _ranges(index.block_offsets[place[hits]], sizes)
    block, bound = index.block_numbers[spread], index.block_maxima[spread]
    row, unit = np.repeat(row, sizes), np.repeat(unit, sizes)
    n_blocks = len(index.optional)
    keys = np.concatenate(
        [
            np.where((at >= 0) & (at < windows[row]), (window_offsets[row] + at) * n_blocks + block, -1)
            for at in (unit, unit - 1)
        ]
    )
    inside = keys >= 0
    pairs, inverse = np.unique(keys[inside], return_inverse=True)
    bounds = np.bincount(inverse, weights=np.concatenate((bound, bound))[inside], minlength=len(pairs))
    pairs = pairs[bounds + index.optional[pairs % n_blocks] >= threshold]
    if not len(pairs):
        return []
    # Full scores of the blocks that are left, from the distinct terms of their passages.
    window, block = np.divmod(pairs, n_blocks)
    row = np.searchsorted(window_offsets, window, side="right") - 1
    first = words.offsets[row] + (window - window_offsets[row]) * index.step
    last = np.minimum(first + 2 * index.step, words.offsets[row + 1])
    at = _ranges(first, last - first)
    owner = np.repeat(np.arange(len(pairs)), last - first)
    at, owner = at[known[at]], owner[known[at]]
    owner, term = np.divmod(np.unique(owner * len(index.terms) + place[at]), len(index.terms))
    sizes = np.diff(index.posting_offsets)[term]
    spread = _ranges(index.posting_offsets[term], sizes)
    owner = np.repeat(owner, sizes)
    item = index.posting_items[spread]
    own = item // BLOCK == block[owner]
    score = np.bincount(owner[own] * BLOCK + item[own] % BLOCK, weights=index.posting_impacts[spread][own], minlength=len(pairs) * BLOCK)
    out = []
    held: tuple[int, dict[int, np.ndarray]] = (-1, {})
    for found in np.flatnonzero(score >= threshold - 1e-9).tolist():
        k, item = found // BLOCK, int(block[found // BLOCK]) * BLOCK + found % BLOCK
        if held[0] != window[k]:
            held = (int(window[k]), {})
        passage = words.hashes[first[k] : last[k]]
        parts = index.parts[item]

        def overlap(own_runs: np.ndarray, size: int) -> float:
            if not size:
                return 1.0
            if size not in held[1]:
                held[1][size] = np.unique(runs(passage, size))
            return float(np.isin(own_runs, held[1][size]).mean())

        question, answer = overlap(parts.question, parts.question_run), overlap(parts.answer, parts.answer_run)
        if question >= OVERLAP and answer >= OVERLAP:
            out.append((int(row[k]), item, float(min(1.0, score[found])), question, answer))
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows (id_column, item_column, score, question_overlap, answer_overlap) of all verified leaks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    test = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    doc_kind, item_kind = rows.schema["id"].dataType.simpleString(), test.schema["item"].dataType.simpleString()
    schema = f"id {doc_kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"
    shards = max(1, -(-test.count() // SHARD_ITEMS))
    found = [spark.createDataFrame([], schema)]
    for shard in range(shards):
        part = test.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).orderBy("item", "text").toArrow()
        index = build_index(part.column("item").to_pylist(), part.column("text").to_pylist(), threshold)
        if index is not None:
            found.append(rows.mapInArrow(_searcher(spark.sparkContext.broadcast(index), part.schema, threshold), schema))
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap"), F.struct("score", "question_overlap", "answer_overlap"))
    return reduce(DataFrame.unionByName, found).groupBy("id", "item").agg(best.alias("best")).select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), "best.*"
    )


def _searcher(shared, item_schema: pa.Schema, threshold: float):
    item_type = item_schema.field("item").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                leaks = retrieve(index, terms_of(part.column("text")), threshold)
                if leaks:
                    text, item, *rest = zip(*leaks)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(text, pa.int64())), pa.array([index.ids[i] for i in item], item_type),
                            *(pa.array(values, pa.float64()) for values in rest),
                        ],
                        ["id", "item", "score", "question_overlap", "answer_overlap"],
                    )

    return run
