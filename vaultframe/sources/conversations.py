"""Conversations: format sniffing, normalised messages, exchanges, segments and sentence extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultframe.functions.temporal import strict_timestamp
from vaultframe.functions.text import matches
from vaultframe.operators.windows import segments

LEAST_CHARS = 30
# Wording of decisions and of failures.
DECISIONS = r"\b(decided?\s+to|chose|will\s+use|switching\s+to|going\s+with|selected|adopted|we(?:'ll| will)|let's)\b"
FAILURES = r"\b(didn'?t work|doesn'?t work|failed|broke|wrong|reverted|rolled back|mistake|don'?t use|avoid)\b"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(file, turn, role, text, at) of JSONL transcripts, chat exports, Slack exports and plain text.

    Each line or file is parsed under every known shape; the first that gives messages counts.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    line = "struct<type:string,role:string,timestamp:string,message:struct<role:string,content:string>,content:string,text:string>"
    by_line = raw.where(~F.trim("value").startswith("[") & F.trim("value").startswith("{") & F.col("value").contains("\n")).select("file", F.posexplode(F.split("value", "\n")).alias("turn", "l"))
    parsed = by_line.select("file", "turn", F.from_json("l", line).alias("j")).select("file", "turn", F.coalesce("j.message.role", "j.role", "j.type").alias("role"), F.coalesce("j.message.content", "j.content", "j.text").alias("text"), strict_timestamp("j.timestamp").alias("at"))
    item = "array<struct<sender:string,role:string,text:string,content:string,created_at:string,ts:string,user:string,type:string,chat_messages:array<struct<sender:string,text:string,created_at:string>>>>"
    arrays = raw.where(F.trim("value").startswith("[")).select("file", F.posexplode(F.from_json("value", item)).alias("n", "j"))
    nested = arrays.where("j.chat_messages is not null").select("file", F.posexplode("j.chat_messages").alias("turn", "m")).select("file", "turn", F.col("m.sender").alias("role"), "m.text", strict_timestamp("m.created_at").alias("at"))
    flat = arrays.where("j.chat_messages is null").select("file", F.col("n").alias("turn"), F.coalesce("j.role", "j.sender", F.when(F.col("j.user").isNotNull(), "user")).alias("role"), F.coalesce("j.text", "j.content").alias("text"), F.coalesce(strict_timestamp("j.created_at"), F.col("j.ts").try_cast("double").cast("timestamp")).alias("at"))
    plain = raw.where(~F.trim("value").startswith("[") & ~F.trim("value").startswith("{")).select("file", F.posexplode(F.split("value", "\n")).alias("turn", "l")).select("file", "turn", F.when(F.col("l").rlike("(?i)^(user|human|>):?"), "user").when(F.col("l").rlike("(?i)^(assistant|ai):"), "assistant").alias("role"), F.regexp_replace("l", "(?i)^(user|human|assistant|ai|>):?\\s*", "").alias("text"), F.lit(None).cast("timestamp").alias("at"))
    human = F.when(F.col("role").isin("human", "user"), "user").when(F.col("role").isin("assistant", "ai", "bot"), "assistant").otherwise(F.col("role"))
    return parsed.unionByName(nested).unionByName(flat).unionByName(plain).withColumn("role", human).where("role is not null and text is not null")


def exchanges(messages: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(conv_id, exchange, first_turn, text): a user's message and all assistant messages up to the next one."""
    numbered = segments(messages.where(F.col("role").isin("user", "assistant")), ["conv_id"], ["turn"], F.col("role") == "user", "exchange").where("exchange > 0")
    grouped = numbered.groupBy("conv_id", "exchange").agg(F.min("turn").alias("first_turn"), F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda m: m.text)).alias("text"))
    return grouped.where(F.length("text") >= least)


def sentences(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n, sentence)."""
    parts = F.posexplode(F.split("text", r"(?<=[.!?])\s+"))
    return messages.select("conv_id", "turn", "role", parts.alias("n", "sentence"))


def extract_sentences(messages: DataFrame, pattern: str = DECISIONS, shortest: int = 20, longest: int = 400, most: int = 10) -> DataFrame:
    """(conv_id, turn, n, sentence): assistant sentences that match, one per 80-character key, ten per conversation."""
    s = sentences(messages.where("role = 'assistant'")).where(F.length("sentence").between(shortest, longest) & matches("sentence", pattern))
    key = F.lower(F.substring("sentence", 1, 80))
    once = s.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", key).orderBy("turn", "n"))).where("r = 1")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "n"))).where(F.col("k") <= most).select("conv_id", "turn", "n", "sentence")


def priority(messages: DataFrame, budget: int) -> DataFrame:
    """Transcript packing: first user message and last reply always stay, then by class and recency
    while the budget lasts; the result is in the order of turns."""
    by = Window.partitionBy("conv_id")
    first_user = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(by)
    last_reply = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(by)
    rank = F.when(F.col("turn") == first_user, 0).when(F.col("turn") == last_reply, 1).when(F.col("role") == "tool", 2).otherwise(3)
    ordered = messages.withColumn("priority", rank)
    running = F.sum(F.length("text")).over(by.orderBy("priority", F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("spent", running).where((F.col("priority") <= 1) | (F.col("spent") <= budget))

