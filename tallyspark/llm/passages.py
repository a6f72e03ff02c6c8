"""Near-duplicate passages across documents by compact windows.

A passage is ``WORDS`` words, seen as the sequence of its word 5-grams. For each of several hash functions the Cartesian tree
of a text's hash values has a node for every position that is the least of some stretch; a node with the stretch it
rules, from left to right, is a compact window: all passages inside it that hold the node share its value as min-hash.
Only windows as long as a passage are kept, a few for each passage's worth of text. The windows of two functions are
joined on their intervals inside a text, so a signature stands for a run of passages that share two min-hashes. Documents
meet at equal signatures, each with the words around its anchor there. All pairs of a signature's rows count that are like each other: a row's
passages reach from the first to the last place where one is like one of another document, and rows are connected. A pair that can change
neither is not compared, equal surroundings are one row, and in a crowd rows are found by the 5-grams that they share near the
same place; so a passage that many documents share costs a few comparisons for each. A link needs passages around the anchor with similarity
``SIMILARITY`` or more. Equal texts are one document until then; each of the others is linked to the least id, over its whole length.

Results: rows (id_column, class_id, start_word, end_word), the united spans of each document that repeat in another
document; ``class_id`` is the least id among the documents connected by such passages. Documents without one do not appear.
Null texts, texts under ``WORDS`` words and rows without an id have none; rows that repeat an id are one document. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.words import mix, shingles, slices, words_of
from tallyspark.session import stage

SIZE = 5
WORDS = 50
SIMILARITY = 0.8
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000  # of 24 bytes
TEXT_BYTES = 1 << 19  # of the texts that a task turns into arrays at once
HELD_ROWS = 65_536  # different surroundings of one signature; beyond them equal ones of several batches are united
POSTED_ROWS = 192  # of one signature; beyond them rows are found by the 5-grams that they share
COMPARED_ROWS = 16_384  # pairs compared at once
PROBED_ROWS = 1 << 20  # entries of 5-grams looked at together
STARS = 8  # rows of a crowd that all others are held against first
SHARED = 3  # 5-grams of a choice that must be shared
BANDS = 4  # signatures of two functions each
_WIDTH = WORDS - SIZE + 1
_FACTORS = np.random.Generator(np.random.PCG64(6_050)).integers(0, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = np.uint64(28)
_CELLS = np.random.Generator(np.random.PCG64(6_051)).integers(0, 2**63, 2 * _WIDTH + SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every stretch of ``width`` values, by doubling."""
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - span : width - span + len(values) - width + 1])


def compact_windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, node, right) of the Cartesian trees of several texts, for nodes that rule at least ``width`` values.

    A node rules so many values exactly if it is the least of some stretch of that width, and the ancestors of such a
    node do as well; so the nearest smaller values to both sides are found among these nodes alone.
    """
    n = len(hashes)
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, none
    keyed = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    least = sliding_least(keyed, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[: n - width + 1] == row[width - 1 :]
    least = least[whole]
    if not len(least):
        none = np.empty(0, np.int64)
        return none, none, none
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    value = np.unique(least)
    node = (value & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    order = np.argsort(node)
    node, value = node[order], value[order]
    own = row[node]

    def nearest(step: int) -> np.ndarray:
        """The next node to one side with a smaller value, by jumping over larger ones; len(node) if the text has none."""
        low = np.concatenate((value, [np.uint64(0)]))
        text = np.concatenate((own, [-1]))
        at = np.arange(len(node)) + step
        at[at < 0] = len(node)
        jump = np.concatenate((at, [len(node)]))
        jump[:-1][text[jump[:-1]] != own] = len(node)
        over = np.flatnonzero(low[jump[:-1]] > value)
        while len(over):
            # Those that have arrived stay; whatever others jump over is larger than where they started.
            jump[over] = jump[jump[over]]
            over = over[low[jump[over]] > value[over]]
        return jump[:-1]

    left, right = nearest(-1), nearest(1)
    edge = np.concatenate((node, [0]))
    return (
        np.where(left < len(node), edge[left] + 1, offsets[:-1][own]), node,
        np.where(right < len(node), edge[right] - 1, offsets[1:][own] - 1),
    )


def signatures(hashes: np.ndarray, offsets: np.ndarray, width: int = _WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band, signatures and the node (a position in ``hashes``) that anchors each of them."""
    for band in range(BANDS):
        starts, nodes, keys = [], [], []
        for factor in _FACTORS[2 * band : 2 * band + 2]:
            values = mix(hashes * factor)
            left, node, right = compact_windows(values, offsets, width)
            start = np.maximum(left, node - width + 1)  # first passage of this width that the window holds
            order = np.argsort(start)
            starts.append(start[order])
            nodes.append(node[order])
            keys.append(values[node[order]])
        if not len(starts[0]):
            continue
        # Both functions divide the passages of a text into intervals: join them where they overlap.
        start = np.unique(np.concatenate(starts))
        one, two = (np.searchsorted(s, start, side="right") - 1 for s in starts)
        yield mix(keys[0][one] ^ mix(keys[1][two] + np.uint64(band))), nodes[0][one]


def _lies(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last true place of each row, -1 in rows without one."""
    some = good.any(axis=1)
    first, last = good.argmax(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1)
    return np.where(some, first, -1), np.where(some, last, -1)


def _sums(flags: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros((flags.shape[0], flags.shape[1] + 1), np.int16)
    np.cumsum(flags, axis=1, out=total[:, 1:])
    return total[:, width:] - total[:, :-width]


def same_passages(a: np.ndarray, b: np.ndarray, width: int = _WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """First and last place where near-duplicate passages of two surroundings begin, row by row; -1 where none does.

    A row holds the 5-grams around an anchor, 0 beyond the text. Passages at the same place count if enough 5-grams agree place by
    place, or, where words were put in or left out, if enough of either occur anywhere in the other.
    """
    need = _needed(width)
    hit = (a == b) & (b != 0)
    inside = _sums((a != 0) & (b != 0), width) == width  # passages that lie in both texts
    first, last = _lies((_sums(hit, width) >= need) & inside)
    rest = np.flatnonzero(first < 0)
    rest = rest[hit[rest].sum(axis=1) > 1]
    if not len(rest):
        return first, last
    x, y, hit, inside = a[rest], b[rest], hit[rest], inside[rest]
    for d in range(1, width - need + 1):
        hit[:, d:] |= (x[:, d:] == y[:, :-d]) & (y[:, :-d] != 0)
        hit[:, :-d] |= (x[:, :-d] == y[:, d:]) & (y[:, d:] != 0)
    maybe = (_sums(hit, width) >= need) & inside
    some = np.flatnonzero(maybe.any(axis=1))
    for k in range(0, len(some), 4_096):
        part = some[k : k + 4_096]
        good = maybe[part] & (_occurring(x[part], y[part], width) >= need)
        part, good = part[good.any(axis=1)], good[good.any(axis=1)]
        good &= _occurring(y[part], x[part], width) >= need
        first[rest[part]], last[rest[part]] = _lies(good)
    return first, last


def _occurring(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """How many 5-grams of the passage of x that begins at each place occur in the passage of y at the same place.

    Of the places where a 5-gram of x lies in y only the nearest to either side matter: a passage that holds the 5-gram and any place
    on that side holds the nearest one.
    """
    size, rows = x.shape[1], len(x)
    x, y = np.ascontiguousarray(x.T), np.where(y.T, y.T, 2)  # 5-grams are odd
    before, after = np.full((2, size, rows), width, np.int8)  # distances to the nearest places
    for d in range(width - 1, -1, -1):
        np.copyto(before[d:], np.int8(d), where=x[d:] == y[: size - d])
        np.copyto(after[: size - d], np.int8(d), where=x[: size - d] == y[d:])
    found = np.zeros((size - width + 1, rows), np.int16)
    for s in range(size - width + 1):
        # The passage from s to s + width: places before a 5-gram count up to the one at s, places after it up to the last one.
        room = np.arange(width, dtype=np.int8)[:, None]
        found[s] = ((before[s : s + width] <= room) | (after[s : s + width] < width - room)).sum(axis=0)
    return found.T


class _Postings:
    """Rows of a signature by the 5-grams that they hold.

    All passages around an anchor hold the middle place, so each of them holds one of two stretches of about half a passage that end there.
    Rows that are like each other miss few 5-grams of a passage, so they share most of any choice from that stretch; the rarest are chosen.
    """

    def __init__(self, around: np.ndarray):
        self.around = around
        n, size = around.shape
        keys = np.unique((around.astype(np.int64) * n + np.arange(n)[:, None]).ravel())
        self.bounds = np.searchsorted(keys, np.arange(1 << 16) * n)
        self.bounds = np.append(self.bounds, len(keys))
        self.rows = (keys % n).astype(np.int32)
        self.counts = np.diff(self.bounds)
        middle = size // 2
        half = middle // 2
        self.sides = (slice(middle - half, middle + 1), slice(middle, middle + half + 1))

    def like(self, row: int) -> np.ndarray:
        """All rows that may be like one row, in order."""
        width = self.around.shape[1] // 2 + 1
        missing = width - _needed(width)
        found = []
        for side in self.sides:
            grams = self.around[row, side]
            if (grams == 0).any():
                continue  # no passage on this side
            rare = grams[np.argsort(self.counts[grams], kind="stable")[: missing + SHARED]]
            hits = np.concatenate([self.rows[self.bounds[g] : self.bounds[g + 1]] for g in rare.tolist()])
            some, times = np.unique(hits, return_counts=True)
            found.append(some[times >= SHARED])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _needed(width: int) -> int:
    """5-grams that two passages of one width share at least, if they are like each other."""
    return int(np.ceil(2 * width * SIMILARITY / (1 + SIMILARITY) - 1e-9))


def _held_against(around: np.ndarray, start: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return same_passages(around[others], np.broadcast_to(around[start], (len(others), around.shape[1])))


def group_links(group: np.ndarray, ids: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (one, two, first, last) of rows to the representatives of their signatures, and those representatives.

    Two rows that are like different representatives are not compared here; ``_Signatures`` settles all pairs.
    ``group`` is sorted, and ``ids`` within it. A row that is like no earlier representative of its signature becomes one itself; every row is held
    against all representatives and linked to each one that it is like, so no row hides another. A document's
    own repeats are linked like others; only links of groups with two documents count.
    """
    n = len(group)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((head, [n])))
    top = np.repeat(head, size)
    first, last = same_passages(around, around[top])
    one, two = [top], [np.arange(n)]
    lows, highs = [first], [last]
    first[head] = -1
    keep = np.zeros(n, dtype=bool)
    keep[head] = True
    open_row = first < 0
    open_row[head] = False
    keep[open_row & (size[np.searchsorted(head, top)] == 2)] = True
    for k in np.unique(top[open_row]):
        to = k + size[np.searchsorted(head, k)]
        if to - k == 2:
            continue
        left = [*np.flatnonzero(open_row[k:to]) + k]
        postings = _Postings(around[k:to]) if to - k > POSTED_ROWS else None
        while left:
            new = left[0]
            keep[new] = True
            # Rows before a representative were like an earlier one, yet may be like this one too.
            others = np.arange(k + 1, to) if postings is None else postings.like(new - k) + k
            others = others[~keep[others]]
            low, high = _held_against(around, new, others)
            like = low >= 0
            one.append(np.full(like.sum(), new))
            two.append(others[like])
            lows.append(low[like])
            highs.append(high[like])
            gone = set(others[like].tolist())
            left = [r for r in left[1:] if r not in gone]
    links = np.stack([np.concatenate(x) for x in (one, two, lows, highs)], axis=1)
    return links[links[:, 2] >= 0], keep


def _signed(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                words = words_of(part.column("text"))
                grams, offsets = shingles(words, SIZE)
                for keys, nodes in signatures(grams, offsets):
                    row = np.searchsorted(offsets, nodes, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), part.column("id").take(pa.array(row)), pa.array(nodes - offsets[row], pa.int32())],
                        ["signature", "id", "at"],
                    )

    return rows.mapInArrow(run, f"signature long, id {kind}, at int")


def _met(signed: DataFrame) -> DataFrame:
    """The rows of signatures that at least two documents share."""
    whole = Window.partitionBy("signature")
    shared = signed.withColumn("low", F.min("id").over(whole)).withColumn("high", F.max("id").over(whole))
    return shared.filter("low < high").select("signature", "id", "at")


def _surroundings(met: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (signature, id, at, around): the words of a document, as 16-bit hashes, that make up the 5-grams around the anchors that it shares."""
    kind = rows.schema["id"].dataType.simpleString()
    places = met.groupBy("id").agg(F.collect_list(F.struct("signature", "at")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                words = words_of(part.column("text"))
                offsets = words.offsets
                short = np.maximum((words.hashes >> np.uint64(48)).astype(np.uint16), 1)
                place = part.column("places")
                counts = pc.list_value_length(place).to_numpy(zero_copy_only=False)
                flat = place.flatten()
                row, at = np.repeat(np.arange(part.num_rows), counts), flat.field("at").to_numpy()
                known = np.flatnonzero(at < np.diff(offsets)[row] - SIZE + 1)  # an id's other text may be shorter
                for k in range(0, len(known), 8_192):
                    some = known[k : k + 8_192]
                    low, high = offsets[row[some]][:, None], offsets[row[some] + 1][:, None]
                    at_word = low + at[some][:, None] + np.arange(1 - _WIDTH, _WIDTH + SIZE - 1)
                    inside = (at_word >= low) & (at_word < high)
                    around = short[np.clip(at_word, 0, len(short) - 1)] * inside
                    yield pa.RecordBatch.from_arrays(
                        [
                            flat.field("signature").take(pa.array(some)), part.column("id").take(pa.array(row[some])),
                            flat.field("at").take(pa.array(some)), _packed(around),
                        ],
                        ["signature", "id", "at", "around"],
                    )

    return rows.join(places, "id").select("id", "text", "places").mapInArrow(run, f"signature long, id {kind}, at int, around binary")


def _grams_of(cells: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The 5-grams of rows of words in an order, 0 where one reaches beyond the text; rows of 5-grams stay as they are."""
    size = 2 * _WIDTH - 1
    if cells.shape[1] == size:
        return cells[order]
    out = np.zeros((len(order), size), np.uint32)
    for k in range(0, len(order), COMPARED_ROWS):
        part, words = out[k : k + COMPARED_ROWS], cells[order[k : k + COMPARED_ROWS]]
        least = words[:, :size]
        for w in range(SIZE):
            part *= np.uint32(0x9E3779B1)
            part += words[:, w : w + size]
            least = np.minimum(least, words[:, w : w + size])
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x85EBCA6B)
        part ^= part >> np.uint32(13)
        part |= np.uint32(1)
        part *= least > 0
    return out


def _packed(around: np.ndarray) -> pa.Array:
    bounds = np.arange(len(around) + 1, dtype=np.int32) * (around.shape[1] * 2)
    return pa.Array.from_buffers(pa.binary(), len(around), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(around, np.uint16))])


def _joined(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Labels of rows after pairs are joined: the least row that each one is connected to."""
    while True:
        a, b = label[one], label[two]
        some = np.flatnonzero(a != b)
        if not len(some):
            return label
        one, two, a, b = one[some], two[some], a[some], b[some]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while len(np.flatnonzero((up := label[label]) != label)):
            label = up


def _by_parts(made: Callable[[slice], np.ndarray], n: int) -> np.ndarray:
    """What is made of rows, a bounded number at a time."""
    return np.concatenate([made(slice(k, min(n, k + COMPARED_ROWS))) for k in range(0, n, COMPARED_ROWS)])


class _Signatures:
    """Different surroundings (rows) of some signatures, and how far each repeats in another document.

    ``group`` is sorted; ``low`` and ``high`` are the least and largest document of each row, so a row whose two differ repeats as a whole.
    Of a row only the first and the last place count where a passage begins that is like one of another document, and the rows that it is
    connected to. A pair that can change neither needs no comparison; every other pair that may be alike is compared.
    """

    def __init__(self, group: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray, around: np.ndarray):
        self.around, self.low, self.high, self.times = around, low, high, times
        n = len(group)
        self.valid = _by_parts(lambda part: _sums(around[part] != 0, _WIDTH) == _WIDTH, n)
        self.least, self.most = _lies(self.valid)
        whole = (low < high) & (self.least >= 0)
        self.first, self.last = np.where(whole, self.least, _WIDTH), np.where(whole, self.most, -1)
        self.label = np.arange(n)
        self.head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.size = np.diff(np.append(self.head, n))

    def compare(self, one: np.ndarray, two: np.ndarray) -> None:
        for k in range(0, len(one), COMPARED_ROWS):
            a, b = one[k : k + COMPARED_ROWS], two[k : k + COMPARED_ROWS]
            more = self._may_gain(a, b)
            a, b = a[more], b[more]
            low, high = same_passages(self.around[a], self.around[b])
            like = low >= 0
            a, b, low, high = a[like], b[like], low[like], high[like]
            for r in (a, b):
                np.minimum.at(self.first, r, low)
                np.maximum.at(self.last, r, high)
            self.label = _joined(self.label, a, b)

    def _open(self, row: np.ndarray) -> np.ndarray:
        return (self.least[row] >= 0) & ((self.first[row] > self.least[row]) | (self.last[row] < self.most[row]))

    def _may_gain(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = (self.low[a] == self.high[b]) & (self.high[a] == self.low[b])  # one document, the same
        return ~own & (self._open(a) | self._open(b) | (self.label[a] != self.label[b]))

    def run(self) -> None:
        n, all_heads = len(self.label), np.repeat(np.arange(len(self.head)), self.size)
        order = np.lexsort((-np.arange(n), self.times, all_heads))
        star = order[self.head + self.size - 1][all_heads]
        self.compare(star[star != np.arange(n)], np.flatnonzero(star != np.arange(n)))
        for m in np.unique(self.size[(self.size > 2) & (self.size <= POSTED_ROWS)]).tolist():
            one, two = np.triu_indices(m, 1)
            heads = self.head[self.size == m]
            for k in range(0, len(heads), step := max(1, (1 << 20) // len(one))):
                a, b = (np.add.outer(side, heads[k : k + step]).ravel() for side in (one, two))
                more = (star[a] != a) & (star[a] != b) & self._may_gain(a, b)
                self.compare(a[more], b[more])
        for g in np.flatnonzero(self.size > POSTED_ROWS).tolist():
            self._crowd(slice(self.head[g], self.head[g] + self.size[g]))

    def _crowd(self, own: slice) -> None:
        """A row that is like another at one place holds all but a few of its 5-grams there, so it holds some of any choice; the rarest are chosen."""
        start, around = own.start, self.around[own]
        n, missing = len(around), _WIDTH - _needed(_WIDTH)
        code, rows, bounds, lonely = _near_places(around, missing, self.low[own], self.high[own])
        lengths = np.diff(bounds)
        maybe = self.valid[own] & _by_parts(lambda part: _sums(lonely[code[part]], _WIDTH) <= missing, n)
        common = _by_parts(lambda part: lengths[code[part]].sum(axis=1), n)
        some = np.flatnonzero(_by_parts(lambda part: (maybe[part] & self._wanted(own, np.arange(n)[part, None], np.arange(_WIDTH))).any(axis=1), n))
        code, maybe = code[some], maybe[some]
        row, place = np.nonzero(maybe)
        for k in range(STARS + 1):
            wanted = self._wanted(own, some[row], place)
            row, place = row[wanted], place[wanted]
            if k == STARS or not len(left := some[np.unique(row)]):
                break
            most = left[np.argmax(common[left])]
            self.compare(np.full(len(left), start + most), start + left)
            common[most] = -1
        chosen = np.empty((len(row), missing + SHARED), np.int32)
        for k in range(0, len(row), COMPARED_ROWS):
            part = slice(k, k + COMPARED_ROWS)
            window = code[row[part, None], place[part, None] + np.arange(_WIDTH)]
            rare = np.argpartition(lengths[window], np.arange(missing, missing + SHARED), axis=1)[:, : missing + SHARED]
            chosen[part] = np.take_along_axis(window, rare, axis=1)
        # One of the rarest must be shared as well; where the others are common it is found by those alone.
        count = lengths[chosen]
        few = count[:, missing + 1 :].sum(axis=1) > count[:, : missing + 1].sum(axis=1)
        count[few, missing + 1 :] = 0
        todo, entries, row = np.arange(len(row)), count.sum(axis=1), some[row]
        while len(todo):
            k = max(1, int(np.searchsorted(np.cumsum(entries[todo]), PROBED_ROWS, side="right")))
            some, todo = todo[:k], todo[k:]
            some = some[self._wanted(own, row[some], place[some]) & (entries[some] > 0)]
            if not len(some):
                continue
            probe, listed = np.repeat(np.arange(len(some)), entries[some]), count[some].ravel()
            skip = np.repeat(bounds[chosen[some].ravel()] - np.cumsum(listed) + listed, listed)
            pairs, times = np.unique(probe * n + rows[skip + np.arange(len(probe))], return_counts=True)
            enough = times >= np.where(few[some], 1, SHARED)[pairs // n]
            pairs, times = pairs[enough], times[enough]
            probe, other = pairs // n, start + pairs % n
            order = np.lexsort((-times, probe))
            self._probe(start + row[some][probe[order]], other[order], place[some][probe[order]], probe[order], missing)

    def _wanted(self, own: slice, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of rows of a crowd and places, those where a partner would change something."""
        main = np.bincount(self.label[own] - own.start).argmax() + own.start
        row = own.start + row
        return (place < self.first[row]) | (place > self.last[row]) | (self.label[row] != main)

    def _probe(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, probe: np.ndarray, missing: int) -> None:
        """Compare rows that may be like each other at one place, a few for each probe at first: what they find leaves others without anything to change."""
        rank, step = np.arange(len(one)) - np.searchsorted(probe, probe), 4
        while len(one):
            new = (place < self.first[one]) | (place > self.last[one]) | (self.label[one] != self.label[two])
            own = (self.low[one] == self.high[two]) & (self.high[one] == self.low[two])
            more = new & ~own
            one, two, place, rank = one[more], two[more], place[more], rank[more]
            now = rank < step
            near = self._near(one[now], two[now], place[now], missing)
            pairs = np.unique(one[now][near] * len(self.label) + two[now][near])
            self.compare(pairs // len(self.label), pairs % len(self.label))
            one, two, place, rank, step = one[~now], two[~now], place[~now], rank[~now], step * 4

    def _near(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, missing: int) -> np.ndarray:
        """Whether enough 5-grams of the passage of one that begins at a place lie in the other near where they lie in it."""
        out = np.empty(len(one), bool)
        size = self.around.shape[1]
        for k in range(0, len(one), COMPARED_ROWS):
            part = slice(k, k + COMPARED_ROWS)
            at = place[part, None] + np.arange(_WIDTH)
            x = self.around[one[part, None], at]
            wide = place[part, None] + np.arange(-missing, _WIDTH + missing)
            y = self.around[two[part, None], np.clip(wide, 0, size - 1)]
            y[(wide < 0) | (wide >= size)] = 0
            hit = x == y[:, missing : missing + _WIDTH]
            for d in range(2 * missing + 1):
                hit |= x == y[:, d : d + _WIDTH]
            out[part] = hit.sum(axis=1) >= _WIDTH - missing
        return out


def _near_places(around: np.ndarray, most: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A code for each 5-gram of each row, the rows that hold it at most so many places away (and some that hold it a little further), and whether those are one document's."""
    n, size = around.shape
    code = np.zeros((n, size), np.int32)
    held, starts, lonely, codes, total = [], [], [], 0, 0
    for begin in range(0, size, most + 1):
        left, right = max(0, begin - most), min(size, begin + 2 * most + 1)
        width = right - left
        keyed = (around[:, left:right].astype(np.uint64) << np.uint64(32)).ravel()
        keyed |= np.arange(n * width, dtype=np.uint64)
        keyed.sort()
        gram, at = (keyed >> np.uint64(32)).astype(np.uint32), keyed.astype(np.uint32)
        del keyed
        fresh = np.concatenate(([True], gram[1:] != gram[:-1]))
        number = np.empty(n * width, np.int32)
        number[at] = np.cumsum(fresh, dtype=np.int32) - 1
        here = slice(begin - left, min(begin + most + 1, size) - left)
        code[:, begin : begin + most + 1] = number.reshape(n, width)[:, here] + np.int32(codes)
        del number
        row, heads = (at // np.uint32(width)).view(np.int32), np.flatnonzero(fresh)
        del gram, at
        alone = np.minimum.reduceat(low[row], heads) == np.maximum.reduceat(high[row], heads)
        fresh[1:] |= row[1:] != row[:-1]  # each row once for each 5-gram
        fresh &= ~np.repeat(alone, np.diff(np.append(heads, len(row))))
        counts = np.add.reduceat(fresh, heads, dtype=np.int64)
        held.append(row[fresh])
        starts.append(total + np.cumsum(counts) - counts)
        lonely.append(alone)
        codes, total = codes + len(heads), total + int(counts.sum())
    return code, np.concatenate(held), np.append(np.concatenate(starts), total), np.concatenate(lonely)


@dataclass
class _Piece:
    """Rows of whole signatures, or of a part of one, with their different surroundings."""

    group: np.ndarray
    ids: pa.Array
    at: np.ndarray
    key: np.ndarray  # of the signature and what is around
    known: np.ndarray  # keys of the different ones, in order
    cells: np.ndarray  # and what is around

    def part(self, rows: slice) -> _Piece:
        some = np.unique(self.key[rows])
        return _Piece(self.group[rows], self.ids[rows], self.at[rows], self.key[rows], some, self.cells[np.searchsorted(self.known, some)])


def _piece(batch: pa.RecordBatch) -> _Piece:
    packed = batch.column("around")
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    cells = np.frombuffer(packed.buffers()[2], np.uint16)[bounds[0] // 2 : bounds[-1] // 2].reshape(len(packed), -1)
    group = batch.column("signature").to_numpy()
    key = mix(mix(cells.astype(np.uint64) @ _CELLS[: cells.shape[1]]) ^ mix(group.view(np.uint64)))
    known, first = np.unique(key, return_index=True)
    return _Piece(group, batch.column("id"), batch.column("at").to_numpy(), key, known, cells[first])


def _together(pieces: list[_Piece]) -> _Piece:
    if len(pieces) == 1:
        return pieces[0]
    known = np.unique(np.concatenate([p.known for p in pieces]))
    cells = np.empty((len(known), pieces[0].cells.shape[1]), np.uint16)
    group, at, key = (np.concatenate([getattr(p, name) for p in pieces]) for name in ("group", "at", "key"))
    ids = pa.concat_arrays([p.ids for p in pieces])
    while pieces:
        piece = pieces.pop()
        cells[np.searchsorted(known, piece.known)] = piece.cells
    return _Piece(group, ids, at, key, known, cells)


def _linked(surroundings: DataFrame) -> DataFrame:
    """Links (a, b) of documents with the span of words that they share in either, from streams of rows sorted by signature.

    A signature is compared as a whole, however many batches it goes on for; rows with the same surroundings are compared once.
    """
    kind = surroundings.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = [], HELD_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = _piece(batch)
            if held and held[-1].group[-1] == piece.group[-1]:
                held.append(piece)
            else:
                goes_on = int(np.searchsorted(piece.group == piece.group[-1], True))
                done = [*held, piece.part(slice(0, goes_on))] if goes_on else held
                if done:
                    yield from _rows_of_links(_together(done))
                done, held, limit = [], [piece.part(slice(goes_on, None))], HELD_ROWS
            if sum(len(p.known) for p in held) > limit:
                held = [_together(held)]
                limit = HELD_ROWS + 2 * len(held[0].known)
        if held:
            yield from _rows_of_links(_together(held))

    ordered = surroundings.repartition("signature").sortWithinPartitions("signature", "id", "at")
    return ordered.mapInArrow(run, f"a {kind}, b {kind}, start_a int, end_a int, start_b int, end_b int")


def _rows_of_links(piece: _Piece) -> list[pa.RecordBatch]:
    code = np.unique(piece.ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    row_of = np.searchsorted(piece.known, piece.key)
    # Number the different surroundings as their signatures come.
    begin = np.full(len(piece.known), len(row_of))
    np.minimum.at(begin, row_of, np.arange(len(row_of)))
    order = np.argsort(begin)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    row_of, begin = place[row_of], begin[order]
    low, high = code[begin], code[begin]
    np.minimum.at(low, row_of, code)
    np.maximum.at(high, row_of, code)
    around, piece.cells = _grams_of(piece.cells, order), None
    found = _Signatures(piece.group[begin], low, high, np.bincount(row_of, minlength=len(begin)), around)
    found.run()
    rows = np.flatnonzero(found.last[row_of] >= 0)
    if not len(rows):
        return []
    some = row_of[rows]
    start, end = piece.at[rows] - _WIDTH + 1 + found.first[some], piece.at[rows] - _WIDTH + 1 + found.last[some] + WORDS
    label, doc = found.label[some], code[rows]
    # One span for those of a document that meet.
    order = np.lexsort((end, start, doc, label))
    start, end, label, doc, rows = start[order], end[order], label[order], doc[order], rows[order]
    change = np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])))
    room = int(end.max()) + WORDS + 1
    reach = np.maximum.accumulate(end + np.cumsum(change) * room) - np.cumsum(change) * room
    fresh = change.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    start, end, label, rows = start[head], np.maximum.reduceat(end, head), label[head], rows[head]
    lead = np.searchsorted(label, label)
    other = np.flatnonzero(lead != np.arange(len(lead)))
    lead = lead[other]
    sides = [piece.ids.take(pa.array(rows[r])) for r in (lead, other)]
    spans = [pa.array(side[r], pa.int32()) for r in (lead, other) for side in (start, end)]
    return [pa.RecordBatch.from_arrays([*sides, *spans], ["a", "b", "start_a", "end_a", "start_b", "end_b"])]


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null and text is not null")
    keyed = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    equal = keyed.groupBy("h1", "h2").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.max(F.regexp_count("text", F.lit(WORD))).alias("words"))
    copies = stage(keyed.select("id", "h1", "h2").distinct().join(equal.filter("leader < last"), ["h1", "h2"]).drop("last"), "copies")
    others = copies.filter("id != leader").select("id", "h1", "h2")
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    single = keyed.join(others, ["id", "h1", "h2"], "left_anti").select("id", "text")
    met = stage(_met(_signed(single)), "met")
    found = stage(_linked(_surroundings(met, single)).distinct(), "passages")
    whole = copies.filter(F.col("words") >= WORDS)
    roots = components(found.select("a", "b").unionByName(whole.select(F.col("leader").alias("a"), F.col("id").alias("b"))))
    spans = found.select(F.col("a").alias("id"), F.col("start_a").alias("start"), F.col("end_a").alias("end")).unionByName(
        found.select(F.col("b").alias("id"), F.col("start_b").alias("start"), F.col("end_b").alias("end"))
    )
    spans = spans.unionByName(whole.select("id", F.lit(0).alias("start"), F.col("words").alias("end"))).distinct()
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    united = spans.groupBy("id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return united.join(roots.withColumnRenamed("node", "id"), "id").select(
        F.col("id").alias(id_column), F.col("root").alias("class_id"), "start_word", "end_word"
    )
