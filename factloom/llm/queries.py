"""The subpackage's registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, divergence, labelled, langid, negatives, packing, quality, secrets, sharding, simhash, toxicity, vectors
from factloom.session import table


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted to a bounded sample of the labels outside the held-out fold."""
    return labelled.fitted(quality.Model, quality.fit, docs, table(spark, sf_dir, "labels"), "quality", 3, 1, quality.SAMPLE)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted to a bounded sample of the labels outside the held-out fold."""
    return labelled.fitted(toxicity.Model, toxicity.fit, docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, toxicity.SAMPLE)


def language_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> langid.Model:
    """Fitted to a bounded sample of the documents outside the held-out fold."""
    return langid.fit(*labelled.language_sample(docs, 3, 1, langid.SAMPLE, langid.CHARS))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's quality."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards by its id."""
    return sharding.jump_shards(table(spark, sf_dir, "documents"), shards=24)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's ids, of the bytes decoded from them, and of the tokens' offsets."""
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"), 256)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), bpe.MULTI)
    encoded = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("starts").alias("starts_sha256"))
    decoded = bpe.decode(encoded, bpe.MULTI, keep=("doc_id", "n_tokens", "ids_sha256", "starts_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"), "starts_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that it reaches."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector."""
    return vectors.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, query_every=100)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every whole text."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.trained_model(spark, docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op7_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector."""
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return bpe.count_tokens(table(spark, sf_dir, "documents"), bpe.GPT, limit=512)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source's words differ from those of the other sources in its language."""
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, top=200)


def op12_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's language."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_languages(docs, language_model(spark, docs, sf_dir))
    return found.select("doc_id", labelled.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "n_words", "n_spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), anchor_every=100, positives=5, negatives=10, window=(30, 90))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_jump_shards": op2_jump_shards,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity_zstd": op7_toxicity_zstd,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_token_counts": op10_token_counts,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_language_crf": op12_language_crf,
    "op13_hard_negatives": op13_hard_negatives,
}
OP8_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), words AS (SELECT row, lang, source, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), counts AS (SELECT w.lang, w.source, w.term, count(*) AS tf FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(c.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS n_lang
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(tf) AS n FROM counts GROUP BY ALL) c USING (lang, source) LEFT JOIN langs l USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.tf, 0) AS tf,
         CAST(1 + (1000000000 * (coalesce(c.tf, 0) + 1)::HUGEINT) // (g.n + g.v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (k.total + 1)::HUGEINT) // (g.n_lang + g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE tf > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s USING (anchor_id)
  WHERE NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op8_exact_top_k": OP8_SQL, "op11_divergence_audit": OP11_SQL, "op13_hard_negatives": OP13_SQL}
