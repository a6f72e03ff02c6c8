"""Maximal periodic runs of words, found by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q and at least ``max(min_words, 2 q)`` words that no
neighbouring word extends. Equal stretches that lie q words apart fill a run, so every window of words in a run's first
period has a copy q words later, and both windows choose the same minimizer.

Periods below the first scale are found by comparing all words at each such lag. At scale w (doubled until no text is long
enough) every window of w words chooses its least hash of w/2 words, and equal minimizers from w to below 2w apart are
seeds, extended to both sides as far as the lag holds. Minimizers inside a run of a period of at most w/4 would meet in
all pairs; such runs, known from lower scales, seed by their bounds instead. A longer period that changes such a run must
carry its start or its end over to another run of the same words, or else the two runs touch and any lag in phase can hold;
so equal ends, equal starts and, for touching runs, the lags in phase are all the seeds these runs can give. Nothing is
left out and no seed list grows with the square of a text.

Words are compared by 64-bit hashes. Everything runs on whole texts inside tasks, several texts at once, without a
shuffle; a lost executor only repeats its own batches.

Results: one row for each input row. A null or empty text has no words and no run. Repeated rows give repeated
results; ties of the longest run go to the least start, then the least period. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import mix, powers, slices, words_of

MIN_WORDS = 12
FIRST_SCALE = 32  # periods below it are scanned lag by lag; half of it must hold MIN_WORDS
NEIGHBOURS = 8  # equal minimizers, or equal short runs, are at least w/4 apart: no more fit below 2w
_STEP = 0xC2B2AE3D27D4EB4F  # odd
_INVERSE = pow(_STEP, -1, 1 << 64)
_NONE = np.empty(0, np.int64)


@dataclass
class Runs:
    """Runs by start, then period: words ``start`` up to before ``end`` repeat with ``period``."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


class _Sequence:
    """Word codes end to end, with hashes of stretches."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes) * powers(_STEP, n), out=self.sums[1:])

    def grams(self, size: int, end: int) -> np.ndarray:
        """Hashes of the stretches of ``size`` words that start at each place and end by ``end``."""
        count = max(0, end - size + 1)
        return mix((self.sums[size : size + count] - self.sums[:count]) * powers(_INVERSE, count))

    def same(self, a: np.ndarray, lag: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
        """Whether ``width`` words from a equal those ``lag`` later; table: powers of the step."""
        b = a + lag
        return (self.sums[a + width] - self.sums[a]) * table[lag] == self.sums[b + width] - self.sums[b]

    def extend(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest stretch around each place whose words all equal those ``lag`` later; empty if not even its own does."""
        n = len(self.codes)
        table = powers(_STEP, int(lag.max()) + 1) if len(lag) else np.empty(0, np.uint64)
        low, high = at.copy(), at.copy()
        top = max(1, n).bit_length()
        for forward in (True, False):
            open_ = np.arange(len(at))
            # Doubling steps while they hold, then halving ones, so that work follows the stretch and not the text.
            reach = np.zeros(len(at), np.int64)
            for k in range(top):
                if not len(open_):
                    break
                width = 1 << k
                begin = high[open_] if forward else low[open_] - width
                fits = (begin + lag[open_] + width <= n) if forward else begin >= 0
                kept = open_[fits]
                kept = kept[self.same(begin[fits], lag[kept], width, table)]
                if forward:
                    high[kept] += width
                else:
                    low[kept] -= width
                reach[kept] = k + 1
                open_ = kept
            for k in range(int(reach.max()) - 1 if len(reach) else -1, -1, -1):
                width = 1 << k
                tried = np.flatnonzero(reach > k)
                begin = high[tried] if forward else low[tried] - width
                fits = (begin + lag[tried] + width <= n) if forward else begin >= 0
                kept = tried[fits]
                kept = kept[self.same(begin[fits], lag[kept], width, table)]
                if forward:
                    high[kept] += width
                else:
                    low[kept] -= width
        return low, high


def _lag_scans(codes: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of periods below ``first``: stretches of words that equal the words one lag later."""
    found = []
    for lag in range(1, min(first, len(codes))):
        equal = np.flatnonzero(codes[:-lag] == codes[lag:])
        needed = max(MIN_WORDS - lag, lag)
        if len(equal) < needed:
            continue
        breaks = np.flatnonzero(np.diff(equal) != 1)
        starts = equal[np.concatenate(([0], breaks + 1))]
        ends = equal[np.concatenate((breaks, [len(equal) - 1]))] + 1
        long = np.flatnonzero(ends - starts >= needed)
        if len(long):
            found.append((starts[long], ends[long] + lag, np.full(len(long), lag)))
    return found


def _smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Runs:
    """One run for each stretch: a longer period of the same stretch is a multiple of the smallest."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return Runs(start[new], end[new], period[new])


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that are the first least value of some ``window`` consecutive ones."""
    n = len(grams)
    if n < window:
        return _NONE
    bits = np.uint64(n.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    # The place fills the low bits, so the least key is the first place of the least value.
    keys = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        keys = np.minimum(keys[: len(keys) - width], keys[width:])
        width *= 2
    if width < window:
        rest = window - width
        keys = np.minimum(keys[: len(keys) - rest], keys[rest:])
    chosen = (keys & mask).astype(np.int64)
    return chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]


def _phases(seq: _Sequence, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """For each run a code of the words that it repeats, and the place of its least rotation modulo the period."""
    code = np.empty(len(runs.start), np.uint64)
    phase = np.empty(len(runs.start), np.int64)
    for period in np.unique(runs.period).tolist():
        own = np.flatnonzero(runs.period == period)
        at = runs.start[own][:, None] + np.arange(period)
        grams = mix((seq.sums[at + period] - seq.sums[at]) * powers(_INVERSE, len(seq.codes) + 1)[at])
        least = grams.argmin(axis=1)
        code[own] = grams[np.arange(len(own)), least]
        phase[own] = (runs.start[own] + least) % period
    return code, phase


def _seeds_of_runs(seq: _Sequence, runs: Runs, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which runs of short periods, and all that covers them, can repeat."""
    if len(runs.start) < 2:
        return _NONE, _NONE
    code, phase = _phases(seq, runs)
    order = np.lexsort((runs.start, code, runs.period))
    start, end, period = runs.start[order], runs.end[order], runs.period[order]
    code, phase = code[order], phase[order]
    places, lags = [], []
    for step in range(1, NEIGHBOURS + 1):
        if step >= len(start):
            break
        a = np.flatnonzero((code[step:] == code[:-step]) & (period[step:] == period[:-step]))
        b = a + step
        for place, lag in ((start[a], start[b] - start[a]), (end[a] - 1, end[b] - end[a])):
            wanted = (lag >= scale) & (lag < 2 * scale)
            places.append(place[wanted])
            lags.append(lag[wanted])
        if step > 1:
            continue
        touching = np.flatnonzero(start[b] <= end[a])
        for i, j in zip(a[touching].tolist(), b[touching].tolist()):
            q = int(period[i])
            shift = int(phase[j] - phase[i]) % q
            lag = np.arange(scale + (shift - scale) % q, min(2 * scale, int(min(end[i] - start[i], end[j] - start[j])) + 1), q)
            place = np.maximum(start[i], start[j] - lag)
            fits = place < end[i]
            places.append(place[fits])
            lags.append(lag[fits])
    return np.concatenate(places), np.concatenate(lags)


def _seeds(seq: _Sequence, known: Runs, scale: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of one scale, within the words before ``end``."""
    size = scale // 2
    grams = seq.grams(size, end)
    at = _minimizers(grams, scale - size + 1)
    short = np.flatnonzero((known.period <= scale // 4) & (known.end - known.start >= size) & (known.start < end))
    short = Runs(known.start[short], known.end[short], known.period[short])
    if len(short.start) and len(at):
        reach = np.maximum.accumulate(short.end)
        last = np.searchsorted(short.start, at, side="right") - 1
        covered = (last >= 0) & (reach[np.maximum(last, 0)] >= at + size)
        at = at[~covered]
    places, lags = [], []
    if len(at):
        values = grams[at]
        order = np.lexsort((at, values))
        values, at = values[order], at[order]
        for step in range(1, NEIGHBOURS + 1):
            if step >= len(at):
                break
            lag = at[step:] - at[:-step]
            wanted = np.flatnonzero((values[step:] == values[:-step]) & (lag >= scale) & (lag < 2 * scale))
            places.append(at[:-step][wanted])
            lags.append(lag[wanted])
    more = _seeds_of_runs(seq, short, scale)
    return np.concatenate([*places, more[0]]).astype(np.int64), np.concatenate([*lags, more[1]]).astype(np.int64)


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> Runs:
    """All runs of texts that lie end to end.

    ``sizes``: the words of each text, none longer than the one before it, so that each scale reads only the texts that
    are long enough. Runs are given in places of ``codes``.
    """
    # A code of its own after each text: no run can hold it, so none crosses from one text into the next.
    ends = np.cumsum(sizes)
    spaced = np.insert(codes, ends, mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(0x51ED270B0A1F39C1)))
    bounds = ends + np.arange(1, len(sizes) + 1)
    found = _lag_scans(spaced, FIRST_SCALE)
    parts = [np.concatenate(x) if found else _NONE for x in (zip(*found) if found else ([], [], []))]
    known = _smallest_periods(*parts)
    seq = _Sequence(spaced) if len(sizes) and sizes[0] >= 2 * FIRST_SCALE else None
    scale = FIRST_SCALE
    while seq is not None and sizes[0] >= 2 * scale:
        end = int(bounds[np.searchsorted(-sizes, -2 * scale, side="right") - 1])
        at, lag = _seeds(seq, known, scale, end)
        low, high = seq.extend(at, lag)
        whole = high - low >= lag
        low, high, lag = low[whole], high[whole], lag[whole]
        known = _smallest_periods(
            np.concatenate((known.start, low)), np.concatenate((known.end, high + lag)), np.concatenate((known.period, lag))
        )
        scale *= 2
    text = np.searchsorted(bounds, known.start, side="right")
    return Runs(known.start - text, known.end - text, known.period)


def planted(offsets: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """The place from which each word is taken once texts of some ids repeat a part of themselves to their end.

    With h the CRC-32 of the decimal id and g = h // 10, texts with h % 10 = 0 repeat from word a = g % n on
    with period 1 + (n - a) // (3 + g % 8).
    """
    source = np.arange(offsets[-1])
    for row, own in enumerate(ids):
        n = int(offsets[row + 1] - offsets[row])
        if own is None or not n:
            continue
        h = zlib.crc32(str(own).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        source[offsets[row] + a : offsets[row + 1]] = offsets[row] + a + np.arange(n - a) % period
    return source


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words' bytes, each with a space after it, and the bounds of the words in them."""
    widths = ends - starts + 1
    bounds = np.concatenate(([0], np.cumsum(widths)))
    take = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], widths)
    out = data[np.minimum(take, len(data) - 1)] if len(data) else np.empty(0, np.uint8)
    out[bounds[1:] - 1] = 32
    return memoryview(out), bounds


COLUMNS = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, n_dropped long"
)


def _describe(part: pa.RecordBatch, plant: bool) -> list[pa.Array]:
    words = words_of(part.column("text"))
    offsets = words.offsets
    source = planted(offsets, part.column("id").to_pylist()) if plant else np.arange(offsets[-1])
    codes = words.hashes[source]
    sizes = np.diff(offsets)
    n_texts = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    # Texts by falling length, and their words' places.
    moved = np.concatenate(([0], np.cumsum(sizes[order])))
    place = np.arange(offsets[-1]) + np.repeat(offsets[:-1][order] - moved[:-1], sizes[order])
    runs = find_runs(codes[place], sizes[order])
    own = order[np.searchsorted(moved[1:], runs.start, side="right")] if len(runs.start) else _NONE
    shift = place[runs.start] - runs.start if len(runs.start) else _NONE
    start, end = runs.start + shift, runs.end + shift
    edges = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(edges, start + runs.period, 1)
    np.subtract.at(edges, end, 1)
    dropped = np.cumsum(edges[:-1]) > 0
    kept = source[~dropped]
    text, bounds = _joined(words.data, words.starts[kept], words.ends[kept])
    kept_before = np.concatenate(([0], np.cumsum(~dropped)))[offsets]
    by_text = np.lexsort((runs.period, start, own))
    own, start, end, period = own[by_text], start[by_text], end[by_text], runs.period[by_text]
    first = np.searchsorted(own, np.arange(n_texts + 1))
    start, length = start - offsets[own], end - start
    longest = np.lexsort((period, start, -length, own))
    best = np.full(n_texts, -1)
    full = np.flatnonzero(np.diff(first))
    best[full] = longest[first[:-1][full]]
    listed, collapsed = [], []
    rows = np.column_stack((start, length, period)).tolist()
    for row in range(n_texts):
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in rows[first[row] : first[row + 1]])
        listed.append(hashlib.sha256(lines.encode()).hexdigest())
        low, high = bounds[kept_before[row]], bounds[kept_before[row + 1]]
        collapsed.append(hashlib.sha256(text[low : max(low, high - 1)]).hexdigest())

    def of_best(values: np.ndarray) -> pa.Array:
        taken = values[np.maximum(best, 0)] if len(values) else np.zeros(n_texts, np.int64)
        return pa.array(taken, pa.int64(), mask=best < 0)

    return [
        pa.array(sizes, pa.int64()), pa.array(np.diff(first), pa.int64()), of_best(start), of_best(length), of_best(period),
        of_best(1000 * length // np.maximum(period, 1)), pa.array(listed), pa.array(collapsed),
        pa.array(sizes - np.diff(kept_before), pa.int64()),
    ]


def describe_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = False) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the text with runs cut to one period.

    ``plant`` first lets some texts repeat a part of themselves, as ``planted`` says; rows without an id stay as they are.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}"
    names = ["id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *_describe(part, plant)], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def list_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every run as a row (id, start, length, period), in word numbers from 0."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                sizes = np.diff(words.offsets)
                order = np.argsort(-sizes, kind="stable")
                moved = np.concatenate(([0], np.cumsum(sizes[order])))
                place = np.arange(words.offsets[-1]) + np.repeat(words.offsets[:-1][order] - moved[:-1], sizes[order])
                runs = find_runs(words.hashes[place], sizes[order])
                row = np.searchsorted(moved[1:], runs.start, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(order[row], pa.int64())), pa.array(runs.start - moved[row], pa.int64()),
                        pa.array(runs.end - runs.start, pa.int64()), pa.array(runs.period, pa.int64()),
                    ],
                    ["id", "start", "length", "period"],
                )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, period long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
