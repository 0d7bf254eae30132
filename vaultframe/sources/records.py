"""Line-based sources and sinks: issue trackers, gold labels, configuration, transcripts and spooled jobs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions.temporal import strict_timestamp

ISSUE = "id string, title string, status string, priority int, description string, created_at string, dependencies array<struct<depends_on_id:string,type:string>>"
GOLD = "id string, query string, mode string, force_intent string, budget_tokens int, include_internal boolean, collection string, gold_evidence array<struct<collection:string,path:string,hash:string,chunk_seq:int,weight:double>>, gold_answer string, tags array<string>, _corrupt string"


def issues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(issues, links) of a tracker's JSONL export."""
    raw = spark.read.schema(ISSUE).json(path)
    rows = raw.where("id is not null").select(F.col("id").alias("issue_id"), "title", "status", "priority", "description", strict_timestamp("created_at").cast("timestamp_ntz").alias("created_at")).dropDuplicates(["issue_id"])
    links = raw.select(F.col("id").alias("source"), F.explode("dependencies").alias("d")).select("source", F.col("d.depends_on_id").alias("target"), F.col("d.type").alias("kind")).where("source <> target").distinct()
    return rows, links


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels; raises on lines that do not parse, lack a field or repeat an id."""
    raw = spark.read.schema(GOLD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    bad = raw.where("_corrupt is not null or id is null or query is null or gold_evidence is null").limit(1).count()
    twice = raw.groupBy("id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("gold labels: " + ("a line does not parse" if bad else "an id is repeated"))
    return raw.drop("_corrupt").withColumn("mode", F.coalesce("mode", F.lit("query"))).withColumn("include_internal", F.coalesce("include_internal", F.lit(False)))


def resolve_gold(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, id, weight, pin_differs) of evidence that is active; a pinned hash that differs is flagged."""
    e = examples.select(F.col("id").alias("qid"), F.explode("gold_evidence").alias("g")).select("qid", "g.*")
    d = documents.where("active").select("id", "collection", "path", F.col("hash").alias("now_hash"))
    return e.join(d, ["collection", "path"]).select("qid", "id", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce(F.col("hash") != F.col("now_hash"), F.lit(False)).alias("pin_differs"))


def collections_table(spark: SparkSession, config: dict) -> DataFrame:
    """(collection, path, pattern, prefix, context) of a parsed configuration."""
    rows = []
    for name, c in (config.get("collections") or {}).items():
        for prefix, context in ({"": config.get("global_context")} | (c.get("context") or {})).items():
            rows.append((name, c.get("path"), c.get("pattern", "**/*.md"), prefix.strip("/"), context))
    return spark.createDataFrame(rows, "collection string, path string, pattern string, prefix string, context string")


def transcripts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Transcript lines as (file, line); a stream's checkpoint is the cursor."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def spool(rows: DataFrame, path: str) -> str:
    """Writes jobs as JSON lines under a name of their own and returns it."""
    at = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.json(at)
    return at


def artifacts(report: DataFrame, traces: DataFrame, path: str) -> None:
    """A run's summary as one file, its traces as many."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/run")
    traces.write.mode("overwrite").json(f"{path}/traces")


def summary(report: DataFrame) -> str:
    """The few summary rows as markdown."""
    rows = [r.asDict() for r in report.limit(1000).collect()]
    if not rows:
        return ""
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(json.dumps(r[h], default=str) for h in head) + " |" for r in rows)])
