"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm.common import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.sharding import uniform_shards

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = uniform_shards(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.langid import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", "lang"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, with_ids=False)


def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.knn import top_inner

    return top_inner(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), TRUE)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    held_out = F.coalesce(held_out, F.lit(False))
    return toxicity.score(docs, model, with_spans=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs)[0].select("doc_id", "size", "source_size", "target", "taken")


def op8_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.media import store_payloads

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    return store_payloads(docs, keep_media=False)


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.spotsigs import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.divergence import divergence_audit

    return divergence_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total, s.v
  FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // (total + 2 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * CAST(lang_n + 2 AS HUGEINT)) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from convlake.llm.whitening import whitening_report

    return whitening_report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_uniform_shards": op1_uniform_shards,
        "op2_maxent_lm": op2_maxent_lm,
        "op3_language_fusion": op3_language_fusion,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_voronoi_topk": op5_voronoi_topk,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op9_crf_toxicity": op9_crf_toxicity,
        "op7_mix_sources": op7_mix_sources,
        "op8_hyperminhash_neardup": op8_hyperminhash_neardup,
        "op10_flac_media": op10_flac_media,
        "op11_spotsigs": op11_spotsigs,
        "op12_source_divergence": op12_source_divergence,
        "op13_tsqr_whitening": op13_tsqr_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_voronoi_topk": OP5_SQL, "op12_source_divergence": OP12_SQL}
