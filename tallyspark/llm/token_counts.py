"""Token counts without ids: pieces are counted once per distinct pre-token.

Texts are split into pre-tokens by the tokenizer's own pattern, each distinct pre-token is encoded once to learn its
number of pieces, and a document's count is the sum of its pre-token frequencies times those numbers.

Common pre-tokens would make the join between frequencies and pieces one huge shuffle, so a head of them, at most
``HEAD_SIZE`` pre-tokens of at most ``HEAD_BYTES`` bytes each, goes to every task; only the frequencies of other
pre-tokens are shuffled. Which pre-tokens form the head changes the speed, never a count.

Results: one row for each input row. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give
repeated results. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

# Fixed value: the byte-level pattern of the tokenizer file, with Unicode white space.
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD_BYTES = 32
HEAD_SIZE = 1 << 19
HEAD_SAMPLE = 24_000


@lru_cache(maxsize=4)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def special_strings(name: str) -> list[str]:
    """Strings that the tokenizer turns into one special token wherever they stand in a text."""
    return [token.content for token in _tokenizer(name).get_added_tokens_decoder().values()]


def pieces_of(pre_tokens: list[str], name: str) -> np.ndarray:
    """Number of tokens of each pre-token."""
    tok, out = _tokenizer(name), np.empty(len(pre_tokens), np.int64)
    for at in range(0, len(pre_tokens), 4096):
        part = tok.encode_batch_fast(pre_tokens[at : at + 4096], add_special_tokens=False)
        out[at : at + len(part)] = [len(e) for e in part]
    return out


def split_by_library(text: str, name: str) -> list[str]:
    """Pre-tokens by the tokenizer's own splitter; special strings are kept whole."""
    tok, out, at = _tokenizer(name), [], 0
    marks = special_strings(name)
    while at < len(text):
        to, _, mark = min(((p, -len(s), s) for s in marks if (p := text.find(s, at)) >= 0), default=(len(text), 0, ""))
        part = text[at:to]
        out += [part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part)]
        out += [mark] if mark else []
        at = to + len(mark)
    return out


def _is_odd(text: Column, name: str) -> Column:
    """Texts with a special string, or with a code point that the JVM's Unicode tables do not know."""
    odd = text.rlike(r"\p{Cn}")
    for mark in special_strings(name):
        odd = odd | F.contains(text, F.lit(mark))
    return odd


def _pre_tokens(docs: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    """Columns id, row_key, n_bytes, pre (pre-tokens split by the JVM) and odd (texts left to the library)."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.select("id", "text", _is_odd(F.col("text"), name).alias("is_odd"))
    return rows.select(
        "id",
        F.xxhash64("id", "text").alias("row_key"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(~F.col("is_odd"), F.regexp_extract_all("text", F.lit(PRE_TOKEN), F.lit(0))).alias("pre"),
        F.when(F.col("is_odd"), F.col("text")).alias("odd"),
    )


def _lists(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of a batch end to end, with the bounds of each row."""
    pre, odd = batch.column("pre"), batch.column("odd")
    if odd.null_count < len(odd):
        own = pa.array([None if t is None else split_by_library(t, name) for t in odd.to_pylist()], pre.type)
        pre = pc.coalesce(pre, own)
    sizes = pc.fill_null(pc.list_value_length(pre), 0).to_numpy(zero_copy_only=False)
    return pre.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def _head(docs: DataFrame, id_column: str, text_column: str, name: str) -> tuple[pa.Array, np.ndarray]:
    """Frequent pre-tokens of about ``HEAD_SAMPLE`` rows and their piece counts, at most ``HEAD_SIZE``."""
    share = min(1.0, HEAD_SAMPLE / max(1, docs.count()))
    some = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1
    )
    words = _pre_tokens(some, "id", "text", name).select(F.explode("pre").alias("pre"))
    top = words.filter(F.octet_length("pre") <= HEAD_BYTES).groupBy("pre").count().orderBy(F.desc("count"), "pre")
    head = [row.pre for row in top.limit(HEAD_SIZE).select("pre").toLocalIterator()]
    return pa.array(head, pa.string()), pieces_of(head, name)


def count_tokens(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "byte_bpe_50k.json"
) -> DataFrame:
    """Rows (id_column, n_bytes, n_tokens), one for each row of ``docs``."""
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(_head(docs, id_column, text_column, name))
    kind = docs.schema[id_column].dataType

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over head pre-tokens, and frequencies of the others."""
        keys, pieces = head.value
        pieces = np.concatenate((pieces, [0]))
        for batch in batches:
            values, bounds = _lists(batch, name)
            coded = values.dictionary_encode()
            found = pc.fill_null(pc.index_in(coded.dictionary, value_set=keys), len(keys)).to_numpy()
            codes = coded.indices.to_numpy()
            places = found[codes] if len(codes) else np.empty(0, np.int64)
            sums = np.concatenate(([0], np.cumsum(pieces[places])))
            rest = np.flatnonzero(places == len(keys))
            row = np.searchsorted(bounds, rest, side="right") - 1
            pairs, times = np.unique(row * max(1, len(coded.dictionary)) + codes[rest], return_counts=True)
            row, code = np.divmod(pairs, max(1, len(coded.dictionary)))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            entry = pa.StructArray.from_arrays(
                [coded.dictionary.take(pa.array(code)), pa.array(times, pa.int64())], ["pre", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("row_key"), batch.column("n_bytes"),
                    pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entry),
                ],
                ["id", "row_key", "n_bytes", "tokens", "rest"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pieces_of(batch.column("pre").to_pylist(), name)
            yield pa.RecordBatch.from_arrays([batch.column("pre"), pa.array(counts)], ["pre", "pieces"])

    schema = f"id {kind.simpleString()}, row_key long, n_bytes long, tokens long, rest array<struct<pre string, times long>>"
    first = stage(_pre_tokens(docs, id_column, text_column, name).mapInArrow(known, schema), "pretokens")
    rest = first.select("row_key", F.explode("rest").alias("e")).select("row_key", "e.pre", "e.times")
    pieces = rest.select("pre").distinct().mapInArrow(learn, "pre string, pieces long")
    late = rest.join(pieces, "pre").select("row_key", (F.col("times") * F.col("pieces")).alias("tokens"))
    no_id = F.lit(None).cast(kind)
    parts = first.select("row_key", "id", "n_bytes", "tokens", F.lit(1).alias("own")).unionByName(
        late.select("row_key", no_id.alias("id"), F.lit(None).cast("long").alias("n_bytes"), "tokens", F.lit(0).alias("own"))
    )
    total = parts.groupBy("row_key").agg(
        F.max("id").alias(id_column), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"), F.sum("own").alias("own")
    )
    # Equal rows share a key: their sum is divided among them again.
    return total.select(
        id_column, "n_bytes", F.expr("tokens div own").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias("copy")
    ).drop("copy")
