"""N-gram Jaccard join by a MinHash LSH forest.

A document's set of word 5-grams gives each tree of the forest a label of ``DEPTH`` min-hashes; the labels of a tree, sorted,
are a prefix trie. Matching starts from whole labels; the matched prefix is shortened until a pair at the least similarity
is found by one of the trees with the target recall. All pairs of a bucket under the shortened prefix are candidates: those of
a small bucket are listed; documents that meet in larger buckets form crowds, and all pairs of a crowd are held against each
other, block against block inside tasks, which give back counts and spanning links, not pairs. Candidates are verified on
their whole texts: the Jaccard similarity of the two sets of 5-grams.

Texts with the same words are one class from the start and only their least id enters the forest. A text under five words
has one n-gram, all its words; texts without a word are similar to nothing.

Results: one row for each distinct id, null left out. Rows that repeat an id are one document with several texts, which
is linked if one of them is. ``class_id`` is the least id that a document is connected to by links, its own if it has none;
``n_links`` counts the documents it is linked to, copies included. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.words import digests, reduce_rows, shingles, slices, words_of
from tallyspark.session import stage

SIZE = 5
SIMILARITY = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.997
NEIGHBOURS = 8  # a bucket with more than one document besides these is large
CROWD_DOCS = 512  # of a block
CROWD_BYTES = 4 << 20
TILE = 4  # blocks of a crowd that travel together: a task holds the block pairs of two tiles
DENSE_GRAMS = 16  # n-grams of more texts than that are counted by a matrix product
DENSE_COLUMNS = 4_096
_SEED = np.random.Generator(np.random.PCG64(8_051)).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of that similarity matches in some tree with the recall asked for."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, two digests, and the labels (texts x trees x depth, big-endian) of texts."""
    words = words_of(texts)
    grams, offsets = shingles(words, SIZE)
    first, second = digests(words)
    labels = np.empty((len(offsets) - 1, TREES * DEPTH), dtype=">u4")
    buffer = np.empty_like(grams)
    for k, factor in enumerate(_SEED):
        np.multiply(grams, factor, out=buffer)
        labels[:, k] = reduce_rows(np.minimum, buffer, offsets, 0) >> np.uint64(32)
    return np.diff(offsets), first, second, labels


def _sign(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, first, second, labels = signatures(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(counts, pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                        pa.array([row.tobytes() for row in labels], pa.binary()),
                    ],
                    ["id", "grams", "d1", "d2", "labels"],
                )

    return rows.mapInArrow(run, f"id {kind}, grams long, d1 long, d2 long, labels binary")


def _buckets(leaders: DataFrame) -> DataFrame:
    """Rows (id, near, head): the earlier documents of a small bucket under the shortened prefix, or the first one of a large bucket."""
    width, prefix = DEPTH * 4, prefix_length() * 4
    trees = leaders.select(
        "id", F.posexplode(F.array(*[F.substring("labels", 1 + t * width, width) for t in range(TREES)])).alias("tree", "label")
    )
    trees = trees.select("id", F.xxhash64("tree", F.substring("label", 1, prefix)).alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    large = F.count(F.lit(1)).over(whole) > NEIGHBOURS + 1
    near = F.array_distinct(F.array_compact(F.array(*[F.lag("id", k).over(order) for k in range(1, NEIGHBOURS + 1)])))
    found = trees.select("id", near.alias("near"), F.first("id").over(whole).alias("head"), large.alias("large"))
    return found.select("id", F.when(~F.col("large"), F.col("near")).alias("near"), F.when(F.col("large"), F.col("head")).alias("head")).filter(
        "head is not null or size(near) > 0"
    )


def _candidates(buckets: DataFrame, crowds: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of leaders that share a small bucket and are not of one crowd."""
    pairs = buckets.select("id", F.explode("near").alias("other")).filter("id != other")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(crowds.select(F.col("node").alias(side), F.col("root").alias(f"crowd_{side}")), side, "left")
    return pairs.filter("coalesce(crowd_a != crowd_b, true)").select("a", "b")


def gram_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted."""
    grams, offsets = shingles(words_of(texts), SIZE)
    return [np.unique(grams[offsets[k] : offsets[k + 1]]) for k in range(len(offsets) - 1)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts in ``docs`` (id, text) reach the similarity, with it.

    The first text comes to all partners of a document together, so it is hashed once for each run of them.
    """
    kind = docs.schema["id"].dataType.simpleString()
    with_b = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = object(), np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text_b"):
                ids = part.column("a").to_pylist()
                fresh = [k for k, i in enumerate(ids) if i != (ids[k - 1] if k else last)]
                sets = dict(zip(fresh, gram_sets(part.column("text_a").take(pa.array(fresh, pa.int64())))))
                score = np.empty(len(ids))
                for k, other in enumerate(gram_sets(part.column("text_b"))):
                    held = sets.get(k, held)
                    score[k] = jaccard(held, other)
                last = ids[-1]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(score)], ["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, similarity double").filter(
        F.col("similarity") >= similarity
    )


def shared_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many values each of the first ``split`` sets shares with each of the others; with all, if there are no others."""
    n, rows = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    often = np.diff(np.concatenate((first, [len(values)])))
    counts = np.zeros((n, n))
    for f in range(2, DENSE_GRAMS + 1):
        start = first[often == f]
        for k in range(0, len(start), 16_384):
            own = rows[start[k : k + 16_384, None] + np.arange(f)]
            counts += np.bincount((own[:, :, None] * n + own[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    left, right = (slice(0, split), slice(split, n)) if split < n else (slice(0, n), slice(0, n))
    counts = counts[left, right]
    dense = np.flatnonzero(often > DENSE_GRAMS)
    for k in range(0, len(dense), DENSE_COLUMNS):
        some = dense[k : k + DENSE_COLUMNS]
        at = np.repeat(first[some] - np.concatenate(([0], np.cumsum(often[some])[:-1])), often[some]) + np.arange(often[some].sum())
        held = np.zeros((n, len(some)), np.float32)
        held[rows[at], np.repeat(np.arange(len(some)), often[some])] = 1
        counts += held[left] @ held[right].T
    return counts


def linked_texts(sets: list[np.ndarray], split: int, similarity: float = SIMILARITY) -> np.ndarray:
    """The similarity of each of the first ``split`` sets with each of the others (with all, if there are none), 0 below the least."""
    both, size = shared_counts(sets, split), np.array([len(s) for s in sets])
    left, right = (size[:split], size[split:]) if split < len(sets) else (size, size)
    score = both / np.maximum(1, left[:, None] + right[None, :] - both)
    return np.where(score >= similarity, score, 0.0)


def _nearest_roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric table of links, the first node that it is connected to."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] >= 0:
            continue
        reached = np.zeros(len(linked), dtype=bool)
        reached[k] = True
        edge = np.array([k])
        while len(edge):
            fresh = linked[edge].any(axis=0) & ~reached
            reached |= fresh
            edge = np.flatnonzero(fresh)
        root[reached] = k
    return root


def _block_pairs(rows: DataFrame, crowds: DataFrame, sizes: DataFrame) -> DataFrame:
    """Texts of crowds (i, j, block, id, copies, text), each once for every pair of blocks (i, j) that its block is in.

    Rows are spread by pairs of tiles, so that no crowd is the work of one task.
    """
    texts = rows.join(crowds.select(F.col("node").alias("id"), F.col("root").alias("crowd")), "id")
    texts = texts.join(sizes.select(F.col("leader").alias("id"), "copies"), "id")
    many = texts.groupBy("crowd").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CROWD_DOCS), F.ceil(F.sum(F.octet_length("text")) / CROWD_BYTES), F.lit(1)).alias("blocks")
    )
    texts = texts.join(many, "crowd").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Each text travels once for every tile, and is copied for the blocks of that tile only after the exchange.
    texts = texts.withColumn("other_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / TILE))))
    tile = F.floor(F.col("block") / TILE)
    texts = texts.withColumns({"tile_i": F.least(tile, "other_tile"), "tile_j": F.greatest(tile, "other_tile")})
    texts = texts.repartition("crowd", "tile_i", "tile_j")
    first = F.col("other_tile") * TILE
    texts = texts.withColumn("other", F.explode(F.sequence(first, F.least(first + TILE, "blocks") - 1)))
    return texts.select(
        "crowd", "tile_i", "tile_j", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id",
        "copies", "text",
    )


def _crowd_tables(kind: str, similarity: float, listed: bool):
    """A function of the texts of two blocks: rows (id, root, degree) of their documents with links, or the links (a, b, similarity)."""
    names = ["a", "b", "similarity"] if listed else ["id", "root", "degree"]

    def run(table: pa.Table) -> pa.Table:
        kinds = [table.schema.field("id").type, table.schema.field("id").type, pa.float64() if listed else pa.int64()]
        table = table.sort_by([("block", "ascending"), ("id", "ascending")]).combine_chunks()
        block, ids = table.column("block").to_numpy(), table.column("id").to_pylist()
        within = table.column("i")[0] == table.column("j")[0]
        fresh = np.array([k == 0 or ids[k] != ids[k - 1] for k in range(len(ids))])
        starts = np.flatnonzero(fresh)
        ids, copies = [ids[k] for k in starts], table.column("copies").to_numpy()[starts]
        text_split = len(block) if within else int((block == block[0]).sum())
        split = int(fresh[:text_split].sum())
        if not within and block[0] == block[-1]:
            return pa.table([pa.array([], k) for k in kinds], names)  # the other block is empty
        texts = table.column("text").combine_chunks()
        sets = []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            sets += gram_sets(part.column("text"))
        score = linked_texts(sets, text_split, similarity)
        lower = starts[split:] - text_split if not within else starts
        score = np.maximum.reduceat(np.maximum.reduceat(score, starts[:split], axis=0), lower, axis=1)
        if within:
            np.fill_diagonal(score, 0.0)
        if listed:
            one, two = np.nonzero(np.triu(score) if within else score)
            value, two = score[one, two], two if within else two + split
            pairs = [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(one.tolist(), two.tolist())]
            return pa.table([pa.array([p[0] for p in pairs], kinds[0]), pa.array([p[1] for p in pairs], kinds[1]), pa.array(value)], names)
        linked = score > 0
        if not within:
            all_linked = np.zeros((len(ids), len(ids)), dtype=bool)
            all_linked[:split, split:] = linked
            all_linked[split:, :split] = linked.T
            linked = all_linked
        degree = (linked @ copies.astype(np.float64)).astype(np.int64)
        root, kept = _nearest_roots(linked), np.flatnonzero(degree)
        return pa.table(
            [pa.array([ids[k] for k in kept], kinds[0]), pa.array([ids[root[k]] for k in kept], kinds[1]), pa.array(degree[kept])], names
        )

    return run, f"a {kind}, b {kind}, similarity double" if listed else f"id {kind}, root {kind}, degree long"


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Memberships (id_column, class_id, n_links), and the verified links (a, b, similarity) between leaders of copies."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("id").isNotNull())
    signed = stage(_sign(rows), "signatures")
    members = signed.filter("grams > 0").select("id", "d1", "d2").distinct()
    copies = members.groupBy("d1", "d2").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("copies"))
    members = stage(members.join(copies, ["d1", "d2"]), "copies")
    led = members.filter("id = leader").select("id", "d1", "d2")
    leaders = signed.select("id", "d1", "d2", "labels").join(led, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"])
    sizes = stage(members.groupBy("leader").agg(F.max("copies").alias("copies")), "sizes")
    buckets = stage(_buckets(leaders), "buckets")
    crowds = stage(components(buckets.filter("head is not null").select(F.col("head").alias("a"), F.col("id").alias("b"))), "crowds")
    pairs = stage(_candidates(buckets, crowds), "candidates")
    links = stage(
        verified(pairs, rows).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "similar"
    )
    kind = rows.schema["id"].dataType.simpleString()
    blocks = _block_pairs(rows, crowds, sizes).groupBy("crowd", "tile_i", "tile_j", "i", "j")
    crowded = stage(blocks.applyInArrow(*_crowd_tables(kind, SIMILARITY, False)), "crowded")
    linked = links.select("a", "b").unionByName(
        members.filter("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    )
    roots = components(linked.unionByName(crowded.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.join(sizes.withColumnRenamed("leader", "b"), "b").select("a", F.col("copies").alias("degree")).unionByName(
        crowded.select(F.col("id").alias("a"), "degree")
    )
    degrees = degrees.groupBy("a").agg(F.sum("degree").alias("degree"))
    counted = members.join(degrees.withColumnRenamed("a", "leader"), "leader", "left").groupBy("id").agg(
        F.sum(F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")
    )
    found = (
        signed.select("id").distinct().join(counted, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    )
    return (
        found.select(
            F.col("id").alias(id_column), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        ),
        # The links inside crowds, as many as the square of a crowd, are only listed if they are read.
        links.unionByName(blocks.applyInArrow(*_crowd_tables(kind, SIMILARITY, True))),
    )
