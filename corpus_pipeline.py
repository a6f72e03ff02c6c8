"""A corpus pipeline of five stages over the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, language, mixing, ngram_join, secret_scan
from tallyspark.llm.queries import held_out
from tallyspark.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts that all languages of the model fit equally well."""
    model = language.train(docs.filter(~held_out()))
    even = 1 / len(model.languages) if len(model.languages) > 1 else 0.0
    made = language.annotate(docs, model)
    return made.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > even)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the least id; rows without an id, and null or empty texts, stay.

    Of rows that share an id the first by text, source and lang stays; extra columns may have any names.
    """
    members, _ = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    dropped = stage(members.filter("doc_id != class_id").select("doc_id"), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    counts = docs.select("doc_id").filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = stage(counts.filter("rows > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("row.doc_id").orderBy("row.text", "row.source", "row.lang")
    packed = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    one = packed.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; rows without an id are known by their text.

    Null and empty texts hold no item and stay; equal rows share their verdict; extra columns may have any names.
    """
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    keyed = docs.select(F.struct("doc_id", key.alias("text_key")).alias("leak"), "text")
    leaks = decontamination.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="leak")
    leaked = stage(leaks.select(F.col("leak.doc_id").alias("own_id"), F.col("leak.text_key").alias("own_key")).distinct(), "leaked")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_of_row"), key.alias("key_of_row"))
    same = F.col("id_of_row").eqNullSafe(F.col("own_id")) & F.col("key_of_row").eqNullSafe(F.col("own_key"))
    return packed.join(leaked, same, "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. Null texts stay null; extra columns may have any names."""
    found = secret_scan.scan(docs, keep=tuple(docs.columns))
    masked = secret_scan.mask(F.col("row.text"), F.col("spans"))
    changed = F.size("spans") > 0
    columns = {"text": masked, "n_chars": F.when(changed, F.length(masked).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[columns.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with how many of their words it takes.

    Null and empty texts have no words and are not taken; equal rows share what is taken of the first of them that is
    drawn most. Extra columns may have any names, but those called as the four added ones give way to them.
    """
    rows = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("text_key"))
    found = mixing.mix(rows, keep=("doc_id", "text_key")).groupBy("row.doc_id", "row.text_key").agg(
        *[F.max(c).alias(c) for c in ADDED]
    )
    taken = found.filter("taken > 0").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), F.struct(*ADDED).alias("mixed"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_of_row"), F.xxhash64("text").alias("key_of_row"))
    same = F.col("id_of_row").eqNullSafe(F.col("own_id")) & (F.col("key_of_row") == F.col("own_key"))
    kept = [F.col(f"row.{c}") for c in docs.columns if c not in ADDED]
    return packed.join(taken, same).select(*kept, *[F.col(f"mixed.{c}") for c in ADDED])


ADDED = ("size", "source_size", "target", "taken")

STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

# The language model and the seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
