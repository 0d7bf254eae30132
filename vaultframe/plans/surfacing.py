"""The prompt handler as one plan over a batch of prompts: gates, lanes, pool, ranks, admission and packing.

The same plan serves a table of prompts and, through foreachBatch, a stream of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions import guards, text
from vaultframe.functions.scoring import composite
from vaultframe.operators import fts, fusion
from vaultframe.operators.windows import duplicates_with_refresh, top_per, within_budget
from vaultframe.plans.hybrid import eligible
from vaultframe.sources.scratch import written

LANES = {"current": 1.0, "prior": 0.5}
PRIVATE_PARTS = ["/private/", "/secrets/", ".env"]
LEAST_CHARS = 20
#: Share of title words from which a target is clear whatever the second.
CLEAR = 0.7
TIER_CHARS = {"HOT": 300, "WARM": 150, "COLD": 80}


def gated(prompts: DataFrame) -> DataFrame:
    """prompts(pid, session_id, prompt, at) that call for retrieval; a repeat within ten minutes does not."""
    seen = duplicates_with_refresh(prompts, ["session_id", "prompt"], "at", "pid", 600)
    long_enough = (F.length(F.trim("prompt")) >= LEAST_CHARS) | text.matches("prompt", *text.FORCE_PROMPTS)
    return seen.where(~F.col("duplicate") & long_enough & ~text.skip_retrieval("prompt") & ~text.heartbeat("prompt") & ~F.trim("prompt").startswith("/")).drop("duplicate")


def prior_prompts(asked: DataFrame, history: DataFrame, lookback: int = 2, minutes: int = 10) -> DataFrame:
    """(pid, prompt): the last different prompts of the session in the minutes before."""
    h = history.select("session_id", F.col("prompt").alias("earlier"), F.col("at").alias("earlier_at"))
    near = asked.join(h, "session_id").where((F.col("earlier_at") < F.col("at")) & (F.col("earlier_at") >= F.col("at") - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("earlier") != F.col("prompt")))
    last = near.groupBy("pid", "earlier").agg(F.max("earlier_at").alias("earlier_at"))
    return top_per(last, ["pid"], [F.desc("earlier_at"), F.col("earlier")], lookback).select("pid", F.col("earlier").alias("prompt"))


def surface(prompts: DataFrame, docs: DataFrame, meta: DataFrame, now: Column, max_results: int = 10, budget: int = 800) -> DataFrame:
    """(pid, rank, id, tier, tokens, line): what is put before each prompt.

    Words of a prompt are alternatives here: each of its rarer words is a query of its own, and
    the lists are fused, so a long prompt need not match as a whole.
    """
    asked = gated(prompts)
    ok = eligible(meta)
    if "snoozed_until" in meta.columns:
        ok = ok.where(F.coalesce(F.col("snoozed_until") <= now, F.lit(True)))
    for part in PRIVATE_PARTS:
        ok = ok.where(~F.col("path").contains(part))
    words = lambda df, lane: df.select("pid", F.lit(lane).alias("lane"), F.explode(F.filter(F.array_distinct(text.tokens("prompt")), lambda w: F.length(w) > 2)).alias("word"))
    all_words = written(words(asked, "current").unionByName(words(prior_prompts(asked, prompts), "prior")), "words")
    # a word's list is the same for all prompts that have it
    hits = fts.search(docs, all_words.select(F.col("word").alias("qid"), F.col("word").alias("query")).distinct(), 10, ok)
    lists = written(hits.groupBy(F.col("qid").alias("word")).agg(F.collect_list(F.struct("id", "rank", "score")).alias("list")), "lists")
    lanes = lists.join(all_words, "word").select("pid", "lane", F.explode("list").alias("hit")).select("pid", "lane", "hit.*").select(F.col("pid").alias("qid"), "lane", F.when(F.col("lane") == "current", LANES["current"]).otherwise(LANES["prior"]).alias("weight"), (F.col("lane") == "current").alias("is_current"), "id", "rank", "score")
    pool = fusion.select_pool(lanes, max_results)
    scored = composite(pool.join(ok, "id").withColumn("quality_score", F.lit(0.5)), now)
    admitted = fusion.admission(scored).where("admitted")
    ranked = top_per(admitted, ["qid"], [F.col("band"), F.desc(F.round("mass", 12)), F.desc(F.round("composite", 9)), F.col("id")], max_results)
    bodies = docs.where(~text.retrieved_noise("body")).select("id", "title", F.substring("body", 1, max(TIER_CHARS.values())).alias("body"))
    # a document has one line of each tier, whatever the prompts that get it
    ranked = written(ranked.select("qid", "rank", "id", fusion.tier(F.col("composite")).alias("tier")), "ranked")
    size = F.element_at(F.create_map(*(F.lit(x) for kv in TIER_CHARS.items() for x in kv)), F.col("tier"))
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), guards.sanitized(F.expr("body").substr(F.lit(1), size)))
    lines = ranked.select("id", "tier").distinct().join(bodies, "id").select("id", "tier", line.alias("line"))
    lined = ranked.join(lines, ["id", "tier"]).withColumn("tokens", text.estimate_tokens("line"))
    return within_budget(lined, ["qid"], [F.col("rank")], F.col("tokens"), budget).select(F.col("qid").alias("pid"), "rank", "id", "tier", "tokens", "line")


def surface_batches(docs: DataFrame, meta: DataFrame, now: Column, sinks: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: surfaces each batch of prompts once and hands it to every sink."""

    def handle(batch: DataFrame, number: int) -> None:
        out = surface(batch, docs, meta, now).persist()
        try:
            for sink in sinks:
                sink(out, number)
        finally:
            out.unpersist()

    return handle


def decompose(prompts: DataFrame) -> DataFrame:
    """(pid, kind, priority, clause): one keyword and one vector clause for simple questions, parts of complex ones else."""
    complex_one = text.matches("prompt", *text.COMPLEX_SIGNALS)
    parts = F.filter(F.transform(F.split("prompt", r"(?i)\?|\band\s+(?:also|what|how|why)\b|\b(?:additionally|as well as|along with)\b"), lambda p: F.trim(p)), lambda p: F.length(p) > 3)
    simple = F.array(F.struct(F.lit("bm25").alias("kind"), F.lit(1).alias("priority"), F.col("prompt").alias("clause")), F.struct(F.lit("vector").alias("kind"), F.lit(2).alias("priority"), F.col("prompt").alias("clause")))
    several = F.transform(F.slice(parts, 1, 4), lambda p, i: F.struct(F.lit("bm25").alias("kind"), (i + 1).alias("priority"), p.alias("clause")))
    return prompts.select("pid", F.explode(F.when(complex_one & (F.size(parts) > 1), several).otherwise(simple)).alias("c")).select("pid", "c.kind", "c.priority", "c.clause")


def _most_words(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(asked, id, hit): the two of titles(id, words) with the most words of each of asked(asked); the second may be missing from CLEAR on.

    Titles of the same words stand together as their two least ids. Lists first meet titles by their rarest word alone, then by twice as
    many, until no title without these words can be among the two.
    """
    two = top_per(titles, ["words"], [F.col("id")], 2, "r").groupBy("words").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    two = written(two, "titles")
    terms = two.select("words", "ids", F.explode("words").alias("word"))
    each = asked.select("asked", F.explode("asked").alias("word"))
    df = terms.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    by_df = each.join(df, "word", "left").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("o"))
    left, out, first = written(by_df.select("asked", F.transform("o", lambda x: x["word"]).alias("rare")), "rare"), None, 1
    while True:
        met = left.select("asked", F.explode(F.slice("rare", 1, first)).alias("word")).join(terms, "word").select("asked", "words", "ids").distinct()
        hits = met.select("asked", F.size(F.array_intersect("asked", "words")).alias("hit"), F.explode("ids").alias("id"))
        top = written(top_per(hits, ["asked"], [F.desc("hit"), F.col("id")], 2, "place"), "tops")
        sure = top.groupBy("asked").agg(F.max("hit").alias("one"), F.max(F.when(F.col("place") == 2, F.col("hit"))).alias("two"))
        rest = F.size("asked") - first  # words that a title not met can have
        done = sure.where((rest <= 0) | (F.col("one") > rest) & ((F.col("one") / F.size("asked") >= CLEAR) | F.coalesce(F.col("two") > rest, F.lit(False)))).select("asked")
        part = top.join(done, "asked", "left_semi").select("asked", "id", "hit")
        out = part if out is None else out.unionByName(part)
        left = written(left.join(done, "asked", "left_anti").where(F.size("asked") > first), "rare")
        if not left.limit(1).count():
            return out
        first *= 2


def lifecycle_target(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(wid, id, confident) for wanted(wid, text): an exact path, else the greatest share of title words.

    Confident: the best has .7 or more, or .2 more than the second.
    """
    exact = wanted.join(docs.select("id", "path"), wanted["text"] == docs["path"]).select("wid", "id", F.lit(1.0).alias("score"))
    words = lambda c: F.array_sort(F.array_distinct(text.tokens(c)))
    asks = written(wanted.select("wid", words("text").alias("asked")).where(F.size("asked") > 0), "asks")
    best = _most_words(asks.select("asked").distinct(), docs.select("id", words("title").alias("words")).where(F.size("words") > 0))
    overlap = asks.join(best, "asked").select("wid", "id", (F.col("hit") / F.size("asked")).alias("score"))
    ranked = top_per(exact.unionByName(overlap).groupBy("wid", "id").agg(F.max("score").alias("score")), ["wid"], [F.desc(F.round("score", 9)), F.col("id")], 2)
    g = ranked.groupBy("wid").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("b"))
    return g.select("wid", "id", ((F.col("a") >= CLEAR) | (F.col("a") - F.col("b") >= 0.2)).alias("confident"))
