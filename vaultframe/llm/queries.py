"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.llm import dialogue, fertility, line_dedup, neighbours, packing, piece_codec, sharding, simhash, suffix_dedup, token_store, topk, url_filter, whitening
from vaultframe.llm.common import discard, materialise, read_table

#: Folder of the public vocabulary files; taken from the installed package if not set.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, "url", ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.components(docs, "doc_id", "text", words_in_shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024)


def compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.shard_documents(read_table(spark, sf_dir, "documents"), "doc_id")
    return table.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), "shard", "shard_bytes", "tier")


def line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_report(docs, "doc_id", "text")


def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeat_digest(docs, "doc_id", "text", length=400, passage=240)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.measure(docs, "doc_id", "text", "lang", tokenizer_path("piece_bpe_32k.model"))


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.round_trip_digest(docs, "doc_id", "text", tokenizer_path("piece_bpe_32k.model"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    root = token_store.write_store(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_digest(spark, root, "doc_id")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = topk.top_k(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), k=5)
    return found.withColumnRenamed("id", "vec_id")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 100 = 0"), k=10).withColumnRenamed("id", "vec_id")


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, "vec_id", "embedding", components=4).withColumnRenamed("id", "vec_id").drop("residual")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, written = read_table(spark, sf_dir, "conversations"), []
    hurt = dialogue.damaged(rows, "conv_id", "turn", "role", "text")
    edits = dialogue.repair(hurt, "conv", "turn", "role", "text", "copies", every=rows.select(F.col("conv_id").alias("conv")), written=written)
    found = materialise(dialogue.report(edits, arranged=True).withColumnRenamed("conv", "conv_id"), "dialogue-report")
    for df in written:
        discard(df)
    return found


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_filters,
        "op2_simhash": simhash_components,
        "op3_packing": pack_sequences,
        "op4_sharding": compact_shards,
        "op5_line_dedup": line_matches,
        "op6_suffix_dedup": suffix_repeats,
        "op7_quality_rules": quality_rules,
        "op8_sentencepiece": piece_round_trip,
        "op9_token_files": token_files,
        "op10_exact_top_k": exact_top_k,
        "op11_nearest_neighbours": nearest_neighbours,
        "op12_whitening": whitened_embeddings,
        "op13_conversation_repair": conversation_repair,
        "pipeline": pipeline,
    }


def _url_sql() -> str:
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for v, rs in (("allow", ALLOW), ("block", BLOCK)) for r in rs)
    return f"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {rules}),
cut AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page_id, host, path, rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rule_host) DESC) AS r
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT cut.page_id, cut.host, cut.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM cut LEFT JOIN fits ON cut.page_id = fits.page_id AND fits.r = 1"""


_TOP_K_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


_NEAREST_SQL = """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(q.e, c.e)])) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op11_nearest_neighbours": _NEAREST_SQL, "op1_url_filters": _url_sql(), "op10_exact_top_k": _TOP_K_SQL}
