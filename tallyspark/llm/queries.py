"""The operators' queries over the driver's tables, each on its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import centroids, chat_format, decontamination, html_text, language, mixing, ngram_join, passages
from tallyspark.llm import periodic_runs, repetition, secret_scan, token_counts, toxicity

WORD_LIMIT = 512
PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, folder, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > WORD_LIMIT)


def op2_repetition(spark: SparkSession, folder: str) -> DataFrame:
    ruled = repetition.repetition_rules(_table(spark, folder, "documents"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"
    )


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    made = chat_format.format_conversations(turns.unionByName(probe))
    read = made.select(
        "conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    made = html_text.main_text(_table(spark, folder, "pages"))
    return made.withColumn("n_chars", F.length("text").cast("long"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.train(docs.filter(~held_out()))
    made = language.predict(docs, model)
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, folder, "documents"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, folder, "documents"))
    spans = F.col("spans")

    def number(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select(
        "row.doc_id", number("assign"), number("access"), number("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
    )


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, folder, "documents"))[0]


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.train(docs, _table(spark, folder, "labels").filter(~held))
    made = toxicity.score(docs, model)
    return made.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_offending"),
    )


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    made = periodic_runs.describe_runs(_table(spark, folder, "documents"), plant=True)
    return made.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(centroids.cluster(_table(spark, folder, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_repetition, op3_chat_format, op4_html_text, op5_language_id, op6_passages, op7_secret_scan,
        op8_ngram_join, op9_decontamination, op10_mixing, op11_toxicity, op12_periodic_runs, op13_centroids,
    )
}

_REPEATED = """
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT w.doc_id, w.i + s.k AS i FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + {size} - 1)) AS c
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size} + 2, 1))) AS i FROM w)
    ) w, range({size}) s(k) WHERE w.c > 1
  ) GROUP BY doc_id
"""

_NEAREST = """
a{step} AS MATERIALIZED (
  SELECT vec_id, place, q, min(d * 16 + cluster) % 16 AS cluster, min(d * 16 + cluster) // 16 AS distance FROM (
    SELECT v.vec_id, v.place, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM v CROSS JOIN c{step} c
  ) GROUP BY vec_id, place, q
)"""
_MOVED = """
c{next} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{step} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS q FROM (
      SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
      FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(q) AS x FROM a{step}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)"""

ORACLES: dict[str, str] = {
    "op2_repetition": f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
three AS ({_REPEATED.format(size=3)}),
ten AS ({_REPEATED.format(size=10)}),
long AS ({_REPEATED.format(size=101)}),
base AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(three.n, 0) AS n_repeat_words, coalesce(ten.n, 0) AS covered_words,
    coalesce(long.n, 0) AS long_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN ten USING (doc_id) LEFT JOIN long USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (covered_words > 0.4 * n_words OR long_words > 0) AS kept,
  covered_words
FROM base
""",
    "op3_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS opens,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS chars,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS role_chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + 13 + CASE WHEN opens THEN 7 + role_chars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE list_slice(ws, i, i + 4) END AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE shared * 1.0 / (na.n + nb.n - shared) >= 0.8
),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
)
SELECT d.doc_id, r.class_id, coalesce(l.n_links, 0) AS n_links
FROM documents d JOIN (SELECT node, min(root) AS class_id FROM reach GROUP BY node) r ON r.node = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = d.doc_id
""",
    "op13_centroids": """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q)) - 1 AS cluster, q
  FROM v ORDER BY sha256('1:' || vec_id) NULLS LAST, q LIMIT 16
),"""
    + ",".join(_NEAREST.format(step=i) + "," + _MOVED.format(step=i, next=i + 1) for i in range(3))
    + ","
    + _NEAREST.format(step=3)
    + """
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.cluster = a.cluster
""",
}
