"""Reproducible samples and splits from hashes of the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import hash_text, hash_word

THIN_ABOVE = 1_000_000


def priority_sample(df: DataFrame, keys: list[str], size: int, seed: int = settings.SEED) -> DataFrame:
    """Uniform sample of a fixed size without replacement, the same on every run.

    The priority depends on the key alone, so partitioning does not matter; the key should
    identify a row. Large inputs are first thinned by a threshold on the hash, set so that
    barely more than ``size`` rows reach the final sort, however many tasks there are.
    """
    rest = [c for c in df.columns if c not in keys]
    n = df.count()
    share = (size + 10 * size**0.5 + 100) / max(n, 1)
    kept = df
    while n > THIN_ABOVE and share < 1:
        kept = df.filter(hash_word(seed, *keys, digits=15) < F.lit(int(share * 16**15)))
        if kept.count() >= size:
            break
        share, kept = share * 2, df
    text = hash_text(seed, *keys)
    return kept.withColumn("_p", F.md5(text.cast("binary"))).orderBy("_p", *keys, *rest).limit(size).drop("_p")


def in_train(keys: list[str], share: int = 80, seed: int = settings.SEED):
    """Column: is the row in the training part. Row-local, independent of class and layout."""
    return hash_word(seed, *keys) % 100 < share


def stratified_split(df: DataFrame, keys: list[str], stratum: str, share: int = 80, seed: int = settings.SEED) -> DataFrame:
    """Mark rows train or test; hashing within each stratum keeps its share there."""
    bucket = hash_word(seed, stratum, *keys) % 100
    return df.withColumn("split", F.when(bucket < share, "train").otherwise("test"))


def temporal_folds(df: DataFrame, target: str) -> DataFrame:
    """Expanding folds: for each year after the first, all earlier years train.

    Built from (year, class) counts, one row per pair, so the fold table itself comes
    from a running window over a handful of rows.
    """
    cells = df.filter(F.col("YEAR").isNotNull() & F.col(target).isNotNull()).groupBy("YEAR", target).agg(
        F.count(F.lit(1)).alias("n")
    )
    years = cells.groupBy("YEAR").agg(F.sum("n").alias("n_test"), F.collect_set(target).alias("_classes"))
    gathered = years.agg(F.array_sort(F.collect_list(F.struct("YEAR", "n_test", "_classes"))).alias("_all"))
    folds = gathered.select(F.explode("_all").alias("t"), "_all")
    earlier = F.filter("_all", lambda s: s["YEAR"] < F.col("t.YEAR"))
    return folds.select(
        F.col("t.YEAR").alias("test_year"),
        F.array_join(F.transform(earlier, lambda s: s["YEAR"].cast("string")), " | ").alias("train_years"),
        F.aggregate(earlier, F.lit(0).cast("bigint"), lambda acc, s: acc + s["n_test"]).alias("n_train"),
        F.col("t.n_test").alias("n_test"),
        F.size(F.array_distinct(F.flatten(F.transform(earlier, lambda s: s["_classes"])))).alias("_k"),
    ).filter((F.col("n_train") > 0) & (F.col("_k") >= 2)).drop("_k")
