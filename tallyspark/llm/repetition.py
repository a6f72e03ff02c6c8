"""Quality rules on repetition, by suffix arrays.

Each text's words are put in suffix order; the longest common prefixes of neighbours form intervals, and an
interval whose occurrences do not all continue the same word to the left is a maximal repeat. The spans of all
repeats of ``min_words`` words or more are united; a text fails if they cover more than ``max_share`` of its words or
if its longest repeat has more than ``max_repeat`` words. The base rule fails short texts and texts of repeated windows.

Suffix arrays of many texts are built together by prefix doubling on (text, word) ranks, so nothing crosses from one
text into another; only suffixes whose order is still open take part in a further round.

Results: one row for each input row. A null or empty text has no words and fails the base rule. Repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import Words, byte_hashes, mix, reduce_rows, shingles, slices, words_of

# Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_words: int = 10  # shorter repeats are ordinary language
    max_share: float = 0.4
    max_repeat: int = 100
    base_words: int = 50
    base_percent: int = 50


def suffix_order(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all texts (text by text), and the words each entry shares with the one before it."""
    n = len(words.hashes)
    common = np.zeros(n, np.int64)
    if n == 0:
        return np.empty(0, np.int64), common
    row = words.rows()
    end = words.offsets[1:][row]
    order = np.lexsort((words.hashes, row))
    new = np.ones(n, dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (words.hashes[order][1:] != words.hashes[order][:-1])
    group = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    ranks, span = [rank], 1
    while True:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        item = order[tied]
        tail = np.where(item + span < end[item], rank[np.minimum(item + span, n - 1)], -1)
        inner = np.lexsort((tail, rank[item]))
        item, tail = item[inner], tail[inner]
        head = rank[item]
        order[tied] = item
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        new[tied] = fresh
        rank = rank.copy()
        rank[item] = np.maximum.accumulate(np.where(fresh, tied, 0))
        ranks.append(rank)
        span *= 2
    # Common prefixes: from the widest doubling down, step over equal ranks.
    near = np.flatnonzero(ranks[0][order][1:] == ranks[0][order][:-1]) + 1
    a, b = order[near - 1].copy(), order[near].copy()
    end = end[a]
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        inside = np.flatnonzero((a + width <= end) & (b + width <= end))
        same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        a[same] += width
        b[same] += width
        common[near[same]] += width
    return order, common


def maximal_repeats(
    words: Words, order: np.ndarray, common: np.ndarray, min_words: int
) -> Iterator[tuple[int, int, int]]:
    """Intervals (first place, last place, words) of the suffix order that are maximal repeats."""
    if not len(order):
        return
    place = np.flatnonzero(common >= min_words)
    at_start = np.zeros(len(order), dtype=bool)
    at_start[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
    before = np.where(at_start[order], np.uint64(0), words.hashes[order - 1])
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    stack: list[tuple[int, int]] = []  # (first place, words), lengths growing
    previous = -2
    for at, length in zip([*place.tolist(), len(order) + 1], [*common[place].tolist(), 0]):
        first = at - 1
        if at != previous + 1:
            length_before = 0
            while stack:
                start, length_before = stack.pop()
                if changes[previous] != changes[start]:
                    yield start, previous, length_before
        while stack and stack[-1][1] > length:
            first, longer = stack.pop()
            if changes[at - 1] != changes[first]:
                yield first, at - 1, longer
        if at <= len(order) and (not stack or stack[-1][1] < length):
            stack.append((first, length))
        previous = at


def covered(words: Words, starts: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Words of each text inside the union of word spans."""
    edges = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + widths, 1)
    inside = (np.cumsum(edges[:-1]) > 0).astype(np.int64)
    return reduce_rows(np.add, inside, words.offsets, 0)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Places of keys that occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def _in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one text."""
    return mix(hashes + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def repeated_windows(words: Words, size: int) -> np.ndarray:
    """First words of the windows of ``size`` words that occur twice or more in their text."""
    hashes, offsets = shingles(words, size)
    made = np.diff(offsets)
    rows = np.repeat(np.arange(len(made)), made)
    twice = _repeated(_in_row(hashes, rows))
    return twice + (words.offsets[:-1] - offsets[:-1])[rows[twice]]


def repeated_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(words.data == 10)
    n_texts = len(words.text_offsets) - 1
    own = np.searchsorted(words.text_offsets, breaks, side="right") - 1
    starts = np.concatenate((words.text_offsets[:-1], breaks + 1))
    ends = np.concatenate((breaks, words.text_offsets[1:]))
    rows = np.concatenate((np.arange(n_texts), own))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = ends[np.lexsort((ends, np.concatenate((own, np.arange(n_texts)))))]
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, rows = starts[worded], ends[worded], rows[worded]
    keys = _in_row(byte_hashes(words, starts, ends) + (ends - starts).astype(np.uint64), rows)
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows, minlength=n_texts) - np.bincount(rows[first], minlength=n_texts)


def measure(texts: pa.Array, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """All counts of the rules, one value for each text."""
    words = words_of(texts)
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[words.data])))
    order, common = suffix_order(words)
    repeats = list(maximal_repeats(words, order, common, limits.min_words))
    # The longest interval around an occurrence is the longer prefix it shares with a neighbour, so the union of all
    # occurrences of all maximal repeats is the union of these.
    reach = np.zeros(len(order), np.int64)
    if len(order):
        reach[order] = np.maximum(common, np.append(common[1:], 0))
    held = np.flatnonzero(reach >= limits.min_words)
    n_texts = len(words.offsets) - 1
    rows = words.rows()
    firsts = order[np.array([r[0] for r in repeats], dtype=np.int64)] if repeats else np.empty(0, np.int64)
    windows = repeated_windows(words, 3)
    return {
        "n_words": np.diff(words.offsets),
        "word_chars": reduce_rows(np.add, points[words.ends] - points[words.starts], words.offsets, 0),
        "n_symbols": symbols[words.text_offsets[1:]] - symbols[words.text_offsets[:-1]],
        "n_dup_lines": repeated_lines(words),
        "n_repeat_words": covered(words, windows, 3),
        "n_repeats": np.bincount(rows[firsts], minlength=n_texts),
        "covered_words": covered(words, held, reach[held]),
        "longest_repeat": reduce_rows(np.maximum, reach, words.offsets, 0),
    }


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "covered_words", "longest_repeat",
)


def repetition_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """The counts of each text with ``base_failed`` and the verdict ``kept``."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = measure(part.column("text"), limits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(counts[name], pa.int64()) for name in COUNTS)], ["id", *COUNTS]
                )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{name} long" for name in COUNTS)
    failed = (F.col("n_words") < limits.base_words) | (
        100 * F.col("n_repeat_words") > limits.base_percent * F.col("n_words")
    )
    repeats = (F.col("covered_words") > limits.max_share * F.col("n_words")) | (F.col("longest_repeat") > limits.max_repeat)
    return (
        rows.mapInArrow(run, schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~repeats)
        .withColumnRenamed("id", id_column)
    )
