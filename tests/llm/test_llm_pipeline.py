"""The pipeline's stages against brute force on a small table, and the SQL of the queries on the driver's smallest tables."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from tallyspark.llm import queries  # noqa: E402
from tests_support import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == ""


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.lit(9_000)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.union(docs.limit(2).withColumn("doc_id", F.col("doc_id") + 9_100).withColumn("text", F.lit(None).cast("string")))
    docs = docs.union(odd)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, SMALL)
    assert named.columns == columns and named.count() == docs.filter(r"text rlike '\\p{L}'").count()
    unique = stages["near_duplicates"](spark, named, SMALL).cache()
    assert unique.columns == columns

    def grams(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = [grams(r.text) for r in unique.filter("doc_id is not null").collect()]
    assert not any(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a and b)
    assert unique.filter("doc_id is null").count() == 1 and unique.filter("doc_id = 9000").count() <= 1
    clean = stages["decontamination"](spark, unique, SMALL)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in unique.collect() if any(i in r.text for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and not leaked & left and len(left) >= unique.count() - len(leaked) - 2
    masked = stages["secrets"](spark, clean, SMALL)
    assert masked.columns == columns and masked.count() == clean.count()
    assert not any(re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text) for r in masked.collect())
    mixed = stages["mixing"](spark, masked, SMALL)
    assert mixed.columns[: len(columns)] == columns and mixed.filter("taken <= 0 or taken > 3 * size").count() == 0


def test_leaks_without_an_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(1)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("text is not null").first().text
    bare = docs.withColumn("doc_id", F.lit(None).cast("long"))
    rows = bare.withColumn("text", F.lit(f"before {item} after")).union(bare.withColumn("text", F.lit("a clean row")))
    rows = rows.union(bare.withColumn("text", F.lit(None).cast("string"))).union(docs.withColumn("text", F.lit(item)))
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, rows, SMALL)
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "a clean row"]


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    names = ["size", "taken", "own_id", "own_key", "place", "text_key", "row", "rows", "mixed", "id_of_row", "label"]
    wide = docs.withColumns({name: F.lit(name) for name in names})
    wide = wide.union(wide.limit(2).withColumn("text", F.lit("one more row of an id that is there already")))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, wide, SMALL)
        rows = made.collect()
        assert rows and all(r[c] == c for r in rows for c in names if not (name == "mixing" and c in corpus_pipeline.ADDED))
        assert name == "mixing" or made.columns == wide.columns


def test_a_very_long_token(spark):
    import random

    from tallyspark.llm import secret_scan

    rng = random.Random(3)
    token = "".join(rng.choice(secret_scan.BASE62) for _ in range(300_000))
    docs = spark.createDataFrame([(1, f"before {token} after")], "doc_id long, text string")
    found = secret_scan.scan(docs).first().spans
    assert [(s.kind, s.start, s.end) for s in found if s.kind == "random"] == [("random", 7, 300_007)]
