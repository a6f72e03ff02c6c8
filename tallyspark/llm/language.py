"""Language identification by words first, then by shorter and shorter character n-grams.

The model holds, for each language, log frequencies of its commonest words and of character n-grams of one to five letters
of padded words. A known word scores by its word frequencies; an unknown word by the mean over its longest n-grams that
are known at all, falling back from five letters to one. A text's score in a language is the sum over its words.

Training reads whole texts of at most ``DOCS_PER_LANGUAGE`` labelled documents of each language, those with the lowest
hashes of id and language, and keeps at most ``WORDS`` words and ``GRAMS`` n-grams in all, so the model's size is bounded.
Prediction reads every text whole, and nothing but the text.

Results: one row for each input row. A text that is null or has no letter gets ``und`` with score 0. Among equally likely
languages the first by name wins; without any labelled row every text gets ``und``. Rows without an id are never
used for training. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.words import Words, slices, words_of
from tallyspark.session import bounded_rows, stage

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 1_000
MAX_LANGUAGES = 1_000
WORDS = 240_000
GRAMS = 240_000
LONGEST = 5
CACHE = 200_000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    word_hashes: np.ndarray  # sorted
    word_scores: np.ndarray  # words x languages, log frequencies
    grams: dict[str, int]
    gram_scores: np.ndarray


def letters(text: Column) -> Column:
    """Lower-cased words of letters, by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def _scores(counts: np.ndarray) -> np.ndarray:
    """Add-half-smoothed log frequencies of each language's column."""
    return np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * max(1, len(counts)))


def _table(counts: DataFrame, key: str, size: int, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The commonest keys of each language, ``size`` in all, with their counts in every language."""
    share = max(1, size // len(languages))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), key)
    kept = counts.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= share).select(key).distinct()
    wide = counts.join(kept, key).groupBy(key).agg(
        *[F.sum(F.when(F.col("lang") == code, F.col("n")).otherwise(0)).alias(f"c{i}") for i, code in enumerate(languages)]
    )
    rows = wide.limit(size).toArrow()  # no more keys than size by construction
    columns = [rows.column(i + 1).to_numpy() for i in range(len(languages))]
    return rows.column(0).to_pylist(), np.stack(columns, axis=1).astype(float) if len(rows) else np.zeros((0, len(languages)))


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """A model of the languages in ``labelled``; rows without id, text or language are left out."""
    rows = labelled.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", "lang"), "id")
    # Ranks come from ids and languages alone; the chosen ids are few by construction, so their texts are looked up by broadcast.
    chosen = rows.select("id", "lang").withColumn("place", F.row_number().over(order))
    chosen = chosen.filter(F.col("place") <= DOCS_PER_LANGUAGE).select("id", "lang").distinct()
    texts = rows.join(F.broadcast(chosen), ["id", "lang"]).select("lang", letters(F.col("text")).alias("text"))
    words = texts.select("lang", F.explode(F.split("text", " ")).alias("word")).filter(F.col("word") != "")
    counts = stage(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "langwords")
    languages = sorted(r.lang for r in bounded_rows(counts.select("lang").distinct(), MAX_LANGUAGES, "languages"))
    if not languages:
        return Model([], np.empty(0, np.uint64), np.zeros((0, 0)), {}, np.zeros((0, 0)))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    size = F.length("word") + 2
    grams = F.flatten(
        F.array(
            *[
                F.when(
                    size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i, n=n: F.substr(padded, i, F.lit(n)))
                ).otherwise(F.array().cast("array<string>"))
                for n in range(1, LONGEST + 1)
            ]
        )
    )
    gram_counts = counts.select("lang", "n", F.explode(grams).alias("gram")).filter(F.trim("gram") != "")
    gram_counts = gram_counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known, word_counts = _table(counts, "word", WORDS, languages)
    pieces, piece_counts = _table(gram_counts, "gram", GRAMS, languages)
    hashes = words_of(pa.array(known, pa.string())).hashes
    order = np.argsort(hashes)
    return Model(
        languages, hashes[order], _scores(word_counts)[order], {g: i for i, g in enumerate(pieces)}, _scores(piece_counts)
    )


class Scorer:
    """Scores words with a model; scores of unknown words are kept for a while."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.kept: dict[int, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        padded, grams = f" {word} ", self.model.grams
        for n in range(min(LONGEST, len(padded)), 0, -1):
            found = [grams[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in grams]
            if found:
                return self.model.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.model.languages))

    def words(self, words: Words) -> np.ndarray:
        """Log frequencies of every word: words x languages."""
        model = self.model
        place = np.searchsorted(model.word_hashes, words.hashes)
        place[place == len(model.word_hashes)] = 0
        known = model.word_hashes[place] == words.hashes if len(model.word_hashes) else np.zeros(len(place), dtype=bool)
        out = np.zeros((len(words.hashes), len(model.languages)))
        out[known] = model.word_scores[place[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            distinct, first, inverse = np.unique(words.hashes[rest], return_index=True, return_inverse=True)
            if len(self.kept) > CACHE:
                self.kept.clear()
            table = np.empty((len(distinct), len(model.languages)))
            data = words.data.tobytes()
            for k, (code, at) in enumerate(zip(distinct.tolist(), rest[first].tolist())):
                score = self.kept.get(code)
                if score is None:
                    score = self.kept[code] = self.unseen(data[words.starts[at] : words.ends[at]].decode())
                table[k] = score
            out[rest] = table[inverse]
        return out

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its share of the likelihood for texts that ``letters`` has prepared."""
        words = words_of(texts)
        full = np.diff(words.offsets) > 0
        names = [UNKNOWN] * len(full)
        score = np.zeros(len(full))
        if self.model.languages and full.any():
            total = np.add.reduceat(self.words(words), words.offsets[:-1][full], axis=0)
            share = np.exp(total - total.max(axis=1, keepdims=True))
            best = share.argmax(axis=1)
            score[full] = 1.0 / share.sum(axis=1)
            for row, language in zip(np.flatnonzero(full).tolist(), best.tolist()):
                names[row] = self.model.languages[language]
        return names, score


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id_column, lang_pred, score), one for each row of ``docs``."""
    made = _run(docs.select(F.col(id_column).alias("id"), letters(F.col(text_column)).alias("letters")), model)
    return made.select(F.col("id").alias(id_column), "lang_pred", "score")


def annotate(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` packed in a struct ``row``, with lang_pred and score."""
    return _run(docs.select(F.struct("*").alias("row"), letters(F.col(text_column)).alias("letters")), model)


def _run(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [name for name in rows.columns if name != "letters"]
    limit = (8 << 20) // max(4, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "letters", limit):
                names, score = scorer.texts(part.column("letters"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in kept), pa.array(names, pa.string()), pa.array(score)],
                    [*kept, "lang_pred", "score"],
                )

    schema = rows.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
