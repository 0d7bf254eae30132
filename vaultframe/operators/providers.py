"""Scores of an outside model as a column: each distinct text once, in small batches, failures as data.

A provider is a function of a query and up to ``batch`` texts that gives a score for each, or None.
It runs where the rows are, in Arrow batches. What it raises fails its batch and the query's
batches after it in that task, not the job: the texts stay without score and carry the error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.operators.windows import top_per

Provider = Callable[[str, list[str]], list[float | None]]
#: Texts sent at once, and characters of a text that are sent.
BATCH, SENT_CHARS = 4, 400
SCORED = "query string, text string, score double, error string"


def cache_key(query: str, text: str, model: str):
    """A digest of what decides a score; parts are told apart by their lengths."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(F.lit(model)), part(F.col(query)), part(F.col(text))), 256)


def score_distinct(asked: DataFrame, provider: Provider, batch: int = BATCH, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(query, text, score, error) for distinct asked(query, text); scores that are not finite count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        query, failed = None, None

        def send() -> pa.RecordBatch:
            nonlocal failed
            scores: list[float | None] = [None] * len(held)
            if failed is None:
                try:
                    given = list(provider(query, [t[:sent_chars] for t in held]))
                    scores = [float(s) if isinstance(s, int | float) and math.isfinite(s) else None for s in given[: len(held)]]
                    scores += [None] * (len(held) - len(scores))
                except Exception as e:  # a provider's failure is data, of whatever kind it is
                    failed = f"{type(e).__name__}: {e}"
            error = [failed if s is None and failed else "no score" if s is None else None for s in scores]
            out = pa.RecordBatch.from_arrays([pa.array([query] * len(held)), pa.array(held), pa.array(scores, pa.float64()), pa.array(error, pa.string())], ["query", "text", "score", "error"])
            held.clear()
            return out

        for b in batches:
            for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (q != query or len(held) == batch):
                    yield send()
                if q != query:
                    query, failed = q, None
                held.append(t)
        if held:
            yield send()

    distinct = asked.select("query", "text").where("query is not null and text is not null").distinct()
    # a query's texts are spread over tasks; within a task they come together
    return distinct.repartition("query", F.pmod(F.xxhash64("text"), F.lit(16))).sortWithinPartitions("query", "text").mapInArrow(run, SCORED)


def rerank(candidates: DataFrame, provider: Provider, model: str = "provider", cache: DataFrame | None = None, intent: str | None = None, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(ranked, fresh) for candidates(qid, query, id, text).

    ranked: (qid, id, score, covered, error, place), best first; what has no score counts as 0 and as not covered. Null
    queries or texts are never sent. cache(key, score) saves its pairs the call; fresh(key, score) is what to add to it.
    """
    asked = candidates.withColumn("query", F.concat(F.lit(intent), F.lit("\n\n"), "query") if intent else F.col("query"))
    pairs = asked.select("query", "text").where("query is not null and text is not null").distinct().withColumn("key", cache_key("query", "text", model))
    if cache is not None:
        known = pairs.join(cache.select("key", "score"), "key").select("query", "text", "score", F.lit(None).cast("string").alias("error"))
        left = pairs.join(cache.select("key"), "key", "left_anti")
    else:
        known, left = None, pairs
    fresh = score_distinct(left, provider, batch)
    scored = fresh if known is None else fresh.unionByName(known)
    out = asked.join(scored, ["query", "text"], "left").select("qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNotNull().alias("covered"), "error")
    return top_per(out, ["qid"], [F.desc("score"), F.col("id")], None, "place"), fresh.where("score is not null").select(cache_key("query", "text", model).alias("key"), "score")


def coverage(ranked: DataFrame) -> DataFrame:
    """(qid, n, missing): how many candidates have no score; a strict caller refuses a query with missing > 0."""
    return ranked.groupBy("qid").agg(F.count("*").alias("n"), F.sum((~F.col("covered")).cast("long")).alias("missing"))


# What shows that a reply is a template or a thought, control marks, kinds of a query and the stub's opening.
JUNK = [r"</?think>", r"keyword search terms \(", r"semantic search queries \(", "hypothetical document passage that answers the query"]
CONTROL_MARKS = r"(?i)(?:^|\s)/(?:no_)?think(?=\s|$)"
KINDS = ["lex", "vec", "hyde"]
STUB = "Information about "
Writer = Callable[[str], str]


def replies(asked: DataFrame, provider: Writer) -> DataFrame:
    """(query, reply, error) for distinct asked(query): one call each; a failure is an error without reply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q in b.column(0).to_pylist():
                try:
                    rows.append((q, provider(q), None))
                except Exception as e:  # a provider's failure is data, of whatever kind it is
                    rows.append((q, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["query", "reply", "error"])

    return asked.select("query").where("query is not null").distinct().mapInArrow(run, "query string, reply string, error string")


def expand(queries: DataFrame, provider: Writer, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(expansions, fresh) for queries(qid, query): more queries of kind lex (keywords), vec or hyde (vectors).

    expansions: (qid, n, kind, text, fallback), in order of the reply. A line ``kind: text`` counts unless it is residue of
    a template or a thought, a repeat, or the query itself; stray control marks go. A query without a usable line gets the
    stub of kind hyde as fallback. cache(query, reply) saves calls; fresh(query, reply) holds what to add: only usable replies.
    """
    asked = queries.select("query").where("query is not null").distinct()
    known = None if cache is None else asked.join(cache.select("query", "reply"), "query")
    made = replies(asked if cache is None else asked.join(cache.select("query"), "query", "left_anti"), provider).select("query", "reply", F.lit(True).alias("made"))
    both = made if known is None else made.unionByName(known.withColumn("made", F.lit(False)))
    line = F.posexplode(F.split(F.coalesce("reply", F.lit("")), "\n")).alias("at", "line")
    cut = both.select("query", "reply", "made", line).select("query", "reply", "made", "at", F.trim(F.substring_index("line", ":", 1)).alias("kind"), F.when(F.col("line").contains(":"), F.expr("substring(line, instr(line, ':') + 1)")).alias("text"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", CONTROL_MARKS, " "), r"\s+", " "))
    good = cut.where(F.col("kind").isin(*KINDS)).withColumn("text", clean).where((F.col("text") != "") & ~F.col("text").rlike("(?i)" + "|".join(JUNK)) & (F.col("text") != F.col("query")))
    once = good.groupBy("query", "kind", "text").agg(F.min("at").alias("at"), F.first("reply").alias("reply"), F.first("made").alias("made"))
    some = once.select("query", "at", "kind", "text", F.lit(False).alias("fallback"))
    none = asked.join(once.select("query").distinct(), "query", "left_anti").select("query", F.lit(0).alias("at"), F.lit("hyde").alias("kind"), F.concat(F.lit(STUB), "query").alias("text"), F.lit(True).alias("fallback"))
    out = queries.select("qid", "query").join(some.unionByName(none), "query")
    return top_per(out, ["qid"], [F.col("at"), F.col("kind")], None, "n").select("qid", "n", "kind", "text", "fallback"), once.where("made").select("query", "reply").distinct()
