"""Retrieval evaluation: set metrics, reciprocal rank, graded gain and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, jaccard, precision, recall, hit, mrr) of ranked(qid, id, rank) against gold(qid, id)."""
    both = ranked.select("qid", "id", "rank").join(gold.select("qid", "id", F.lit(1).alias("gold")).distinct(), ["qid", "id"], "full_outer")
    g = both.groupBy("qid").agg(F.count("rank").alias("found"), F.count("gold").alias("wanted"), F.sum(F.when(F.col("rank").isNotNull() & F.col("gold").isNotNull(), 1).otherwise(0)).alias("both"), F.min(F.when(F.col("gold").isNotNull(), F.col("rank"))).alias("first"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.select("qid", ratio(F.col("both"), F.col("found") + F.col("wanted") - F.col("both")).alias("jaccard"), ratio(F.col("both"), F.col("found")).alias("precision"), ratio(F.col("both"), F.col("wanted")).alias("recall"), (F.col("both") > 0).cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def ndcg(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg) with gains 2^grade - 1 over log2(rank + 1); null where no ideal gain exists."""
    from vaultframe.operators.windows import top_per

    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = ranked.where(F.col("rank") <= k).select("qid", "id", "rank").join(grades, ["qid", "id"]).groupBy("qid").agg(F.sum(gain).alias("dcg"))
    ideal = top_per(grades.where("grade > 0"), ["qid"], [F.desc("grade"), F.col("id")], k).groupBy("qid").agg(F.sum(gain).alias("ideal"))
    qids = ranked.select("qid").union(grades.select("qid")).distinct()
    return qids.join(got, "qid", "left").join(ideal, "qid", "left").select("qid", (F.coalesce("dcg", F.lit(0.0)) / F.nullif("ideal", F.lit(0.0))).alias("ndcg"))


def by_tag(metrics: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    """Means of metrics for each distinct tag of tags(qid, tags)."""
    flat = tags.select("qid", F.explode(F.array_distinct("tags")).alias("tag"))
    return metrics.join(flat, "qid").groupBy("tag").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in names))


def replicated(runs: DataFrame) -> DataFrame:
    """(metric, least, most, mean, stable) over two or more runs(run, metric, value, delta): is the direction the same?"""
    g = runs.groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.min(F.signum("delta")).alias("lo"), F.max(F.signum("delta")).alias("hi"))
    return g.where("n >= 2").select("metric", "least", "most", "mean", (F.col("lo") == F.col("hi")).alias("stable"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that differ between two runs, or are in one only."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def rerank_probe(triples: DataFrame, margin: float = 0.25, floor: float = 0.05) -> DataFrame:
    """(healthy, worst_margin) of triples(relevant, hard_negative) scores."""
    gap = F.col("relevant") - F.col("hard_negative")
    return triples.agg((F.min(gap >= margin) & (F.max("relevant") >= floor)).alias("healthy"), F.min(gap).alias("worst_margin"))


def hook_cases(cases: DataFrame) -> DataFrame:
    """Per case of (case_id, injected, must, must_not, expect_abstain, prior_leg, prior_leg_enabled, elapsed_ms, budget_ms):
    rates that don't apply are null."""
    n, hits = F.size("injected"), F.size(F.array_intersect("must", "injected"))
    bad = F.size(F.filter("injected", lambda p: F.array_contains("must_not", p)))
    none = (n == 0).cast("int")
    prior = F.when(F.col("prior_leg") == "required", F.col("prior_leg_enabled").cast("int")).when(F.col("prior_leg") != "harmless", (~F.col("prior_leg_enabled")).cast("int"))
    return cases.select(
        "case_id",
        n.alias("injected"),
        bad.alias("must_not_count"),
        F.when(n > 0, bad / n).alias("must_not_rate"),
        F.when(F.size("must") > 0, hits / F.size("must")).alias("must_recall"),
        F.when(F.col("expect_abstain"), none).alias("abstention_correct"),
        F.when(~F.col("expect_abstain") & (F.size("must") > 0), none).alias("false_abstain"),
        prior.alias("prior_leg_ok"),
        "elapsed_ms",
        (F.col("elapsed_ms") > F.col("budget_ms")).alias("timed_out"),
    )


def hook_summary(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means and rates over hook_cases, nulls left out; one row, or one a key."""
    return metrics.groupBy(*(keys or [])).agg(
        F.count("*").alias("cases"),
        F.avg((F.col("must_not_count") > 0).cast("double")).alias("must_not_case_rate"),
        (F.sum("must_not_count") / F.nullif(F.sum("injected"), F.lit(0))).alias("must_not_doc_rate"),
        F.avg("must_recall").alias("must_recall"),
        F.avg("abstention_correct").alias("abstention_accuracy"),
        F.avg("false_abstain").alias("false_abstain_rate"),
        F.avg("prior_leg_ok").alias("prior_leg_accuracy"),
        F.avg(F.col("timed_out").cast("double")).alias("timeout_rate"),
    )
