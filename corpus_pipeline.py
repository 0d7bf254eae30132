"""From raw documents to packed training sequences: five stages, each written and read again.

1. quality rules: documents that the rules reject go.
2. line dedup: lines that match an earlier line of the corpus go.
3. SimHash near-dedup: of each group of near copies the document with the least id stays. Near
   copies differ in 4 bits at most, or share 0.8 of their five-word shingles.
4. suffix-array dedup: bytes in strings of PASSAGE bytes that start anywhere else go. A passage of
   over 50 words of prose is longer than that.
5. packing: what is left is cut and packed into sequences of 1024 token ids.

Each stage works on all that the one before kept. All but the last return the columns of
``documents``. A document that lost all its text stays as an empty document until the SimHash
stage, where empty documents are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultframe.llm import fertility, line_dedup, packing, simhash, suffix_dedup
from vaultframe.llm.common import materialise
from vaultframe.llm.queries import tokenizer_path


PASSAGE = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_documents(docs, "text", "lang", tokenizer_path("piece_bpe_32k.model"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, "doc_id", "text", words_in_shingle=5, distance=4, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, "doc_id", "text", length=PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("suffix_dedup", repeats), ("packing", pack)]

#: SQL has no tokenisers, fingerprints or suffix arrays; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
