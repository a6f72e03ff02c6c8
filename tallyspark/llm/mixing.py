"""Mixing sources to target weights, by blocks.

Each source's words are one stream: its documents in the order of a seeded hash. The stream is packed into blocks of
``block`` words, of which the last may be shorter. A source buys slots until their blocks hold its target's words (the last
slot may be partial); the slots are dealt to output shards by a multinomial draw for each source, so every shard gets its own
random mixture while the sums stay exact. A
slot's number is mapped to a block through pseudorandom permutations of the source's block numbers, a new one for each
pass over the source, and a join by source and block number brings slots and documents together.

Targets: weights 1, 2, 3, 1, ... by source in code-point order, null last, share all words; a target stops at ``MOST``
times its source's words and the excess is shared by weight among the rest, until none is above. No block is taken in
more than ``MOST`` passes, so no document is taken more often than that.

Results: one row for each input row. A null text has no words; a source without words has target 0. Repeated rows are
documents of their own. Draws depend on seed, sources and contents only, so reruns agree. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import stage

BLOCK = 64
SHARD_SLOTS = 1 << 14
MOST = 3
SEED = 20_240
BUCKET_ROWS = 100_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame) -> DataFrame:
    """For each source (columns no_source, source): number, words, rows and target.

    Sources fill in the order of cap over weight: one is full if the common level that the rest would reach without it
    is not below its cap. There is one row for each source here, however many documents.
    """
    totals = sized.groupBy("no_source", "source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    named = Window.orderBy("no_source", "source")
    totals = totals.withColumn("number", F.row_number().over(named) - 1)
    totals = totals.withColumn("weight", (F.col("number") % 3 + 1).cast("double")).withColumn("cap", F.col("words") * MOST)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = totals.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("number"), F.col("level")))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_level["level"] * F.col("weight"))
    return levels.select("no_source", "source", "number", "words", "rows", F.coalesce(target, F.lit(0.0)).alias("target"))


def _source_seed(seed: int, no_source: bool, source: str, use: str) -> int:
    name = "null" if no_source else f"'{source}"
    return int.from_bytes(hashlib.blake2b(f"{seed}|{use}|{name}".encode(), digest_size=8).digest(), "big")


def _scrambled(x: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    x = (x + key + np.uint64(turn * 0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Pseudorandom permutations of range(n): a four-round Feistel network on the next even number of bits, walked until inside.

    ``back`` gives the inverse.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            if back:
                left, right = right ^ (_scrambled(left, k, 3 - turn) & m), left
            else:
                left, right = right, left ^ (_scrambled(right, k, turn) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _pass_keys(key: int, turn: np.ndarray) -> np.ndarray:
    return np.uint64(key) + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)


def slots_of(words: int, target: int, key: int, block: int = BLOCK) -> tuple[int, int]:
    """How many slots hold the target's words, and how many words the last one takes.

    A whole pass holds all words of the source. In the last, partial one all blocks are full but the source's last, so
    its place in that pass tells how many are needed.
    """
    blocks = -(-words // block)
    passes, rest = divmod(target, words)
    if not rest:
        return passes * blocks, block
    short = words - (blocks - 1) * block
    place = int(permute(np.array([blocks - 1]), np.array([blocks]), _pass_keys(key, np.array([passes])), back=True)[0])
    if place * block >= rest:
        slots = -(-rest // block)
        return passes * blocks + slots, rest - (slots - 1) * block
    after = max(0, -(-(rest - place * block - short) // block))  # full blocks that follow the short one
    last = rest - place * block if not after else rest - (place + after - 1) * block - short
    return passes * blocks + place + 1 + after, last


def deal(targets: DataFrame, seed: int = SEED, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of the mixture: (number, shard, slot, block_no, words), for the sources of ``source_targets``."""
    per_pass = F.ceil(F.col("words") / block)
    most = F.least(F.ceil(F.col("target") / block) + F.ceil(F.col("target") / F.col("words")), per_pass * MOST)
    total = targets.filter("words > 0").agg(F.sum(most)).first()[0] or 0
    shards = max(1, -(-total // shard_slots))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.Generator(np.random.PCG64(_source_seed(seed, row["no_source"], row["source"], "draw")))
                key = _source_seed(seed, row["no_source"], row["source"], "order") >> 1
                target = min(int(round(row["target"])), MOST * row["words"])
                slots, last = slots_of(row["words"], target, key, block)
                counts = rng.multinomial(slots, np.full(shards, 1.0 / shards))
                first = np.concatenate(([0], np.cumsum(counts)))[:-1]
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), row["number"]), pa.int32()), pa.array(used, pa.int32()),
                        pa.array(first[used], pa.int64()), pa.array(counts[used], pa.int64()),
                        pa.array(np.full(len(used), -(-row["words"] // block)), pa.int64()),
                        pa.array(np.full(len(used), slots - 1), pa.int64()),
                        pa.array(np.full(len(used), last), pa.int64()), pa.array(np.full(len(used), key), pa.int64()),
                    ],
                    ["number", "shard", "first", "slots", "blocks", "last", "last_words", "key"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                slot = row["first"] + np.arange(row["slots"])
                turn, index = np.divmod(slot, row["blocks"])
                place = permute(index, np.full(len(slot), row["blocks"]), _pass_keys(row["key"], turn))
                words = np.where(slot == row["last"], row["last_words"], block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slot), row["number"]), pa.int32()), pa.array(np.full(len(slot), row["shard"]), pa.int32()),
                        pa.array(slot), pa.array(place), pa.array(words, pa.int32()),
                    ],
                    ["number", "shard", "slot", "block_no", "words"],
                )

    counts = targets.filter("words > 0").select("no_source", "source", "number", "words", "target").mapInArrow(
        draw, "number int, shard int, first long, slots long, blocks long, last long, last_words long, key long"
    )
    dealt = counts.repartition("number", "shard")
    return dealt.mapInArrow(spread, "number int, shard int, slot long, block_no long, words int")


def streams(docs: DataFrame, keep: list[str], text_column: str, source_column: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, and the sources with their targets.

    Places are running sums in the order of a hash: sums over buckets of the hash first, then inside each bucket, so a
    source of any size is spread over many tasks.
    """
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source_column).isNull().alias("no_source"),
        F.coalesce(F.col(source_column), F.lit("")).alias("source"), count_words(F.col(text_column)).alias("size"),
    )
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), F.to_json("row"), "size"))
    sized = stage(rows, "sizes")
    targets = stage(source_targets(sized), "targets")
    largest = targets.agg(F.max("rows")).first()[0] or 0
    bits = max(0, (largest // BUCKET_ROWS).bit_length())
    bucket = F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long")
    named = sized.join(targets.select("no_source", "source", "number", "words", "target"), ["no_source", "source"])
    named = named.withColumn("bucket", bucket)
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.groupBy("number", "bucket").agg(F.sum("size").alias("bucket_size")).select(
        "number", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("number", "bucket").orderBy("order", F.to_json("row")).rowsBetween(Window.unboundedPreceding, 0)
    placed = named.join(offsets, ["number", "bucket"]).withColumn("stop", F.col("offset") + F.sum("size").over(inside))
    return placed.withColumn("start", F.col("stop") - F.col("size")).drop("bucket", "offset", "order"), targets


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that it reaches into: from_word and words are bounds inside the block."""
    parts = placed.filter("size > 0").withColumn(
        "block_no", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}")))
    )
    low = F.greatest(F.col("start") - F.col("block_no") * block, F.lit(0))
    high = F.least(F.col("stop") - F.col("block_no") * block, F.lit(block))
    return parts.withColumn("low", low).withColumn("high", high)


def mix(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", source_column: str = "source",
    seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """Rows (row, size, source_size, target, taken): how many of a document's words the mixture takes, repeats counted."""
    placed, targets = streams(docs, list(keep), text_column, source_column, seed)
    placed = stage(placed, "streams")
    # Stored, so that the planner sees how many slots a few sources have become.
    slots = stage(deal(targets, seed, block).groupBy("number", "block_no", "words").agg(F.count(F.lit(1)).alias("times")), "slots")
    pieces = _pieces(placed.select("row", "number", "size", "start", "stop"), block)
    # A partial slot takes the first words of its block.
    share = F.greatest(F.least(F.col("high"), F.col("words")) - F.col("low"), F.lit(0)) * F.col("times")
    taken = pieces.join(slots, ["number", "block_no"]).groupBy("number", "start", "stop").agg(F.sum(share).alias("taken"))
    # Places in a stream do not overlap, so (number, start, stop) names a document that has words.
    joined = placed.join(taken, ["number", "start", "stop"], "left")
    return joined.select(
        "row", "size", F.col("words").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
    )


def mixed_blocks(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """The mixture itself: rows (shard, slot, source_number, words), the word array of every slot of every shard."""
    placed, targets = streams(docs, [id_column, text_column], text_column, source_column, seed)
    pieces = _pieces(placed, block).withColumn(
        "part",
        F.slice(
            F.regexp_extract_all(F.col(f"row.{text_column}"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
            (F.greatest(F.col("block_no") * block - F.col("start"), F.lit(0)) + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"),
        ),
    )
    packed = pieces.groupBy("number", "block_no").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("low", "part"))), lambda p: p["part"])).alias("all")
    )
    slots = stage(deal(targets, seed, block), "slots")
    return slots.join(packed, ["number", "block_no"]).select(
        "shard", "slot", F.col("number").alias("source_number"), F.slice("all", 1, F.col("words")).alias("words")
    )
