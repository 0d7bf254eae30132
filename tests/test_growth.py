"""Steps whose cost must not grow faster than the input: planted cases against plain code."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vaultframe.functions import text
from vaultframe.operators import consolidation, fts, fusion, lifecycle


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_query_words_go_to_the_postings(no_broadcast):
    terms = no_broadcast.createDataFrame([("the", 1, 1.0), ("then", 2, 1.0), ("of", 1, 1.0)], "term string, id long, wtf double")
    met = fts.meet(terms, no_broadcast.createDataFrame([(1, "the")], "qid int, word string"))
    assert sorted((r.qid, r.term) for r in met.collect()) == [(1, "the"), (1, "then")]
    assert "SortMergeJoin" not in plan(met)  # all of a common word's postings in one task
    # an aggregate behind it is dealt out by document too
    assert "hashpartitioning(qid" in plan(met.groupBy("qid", "word", "id").agg(F.sum("wtf")))


def test_merge_gate_counts_trigrams_of_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["Alpha", "beta", "gamma", "delta-9"]) + str(rng.randrange(50)) for _ in range(12_000))
    rows = [(1, long, long), (2, long, long[: len(long) // 2]), (3, "", long), (4, "ab", "ab"), (5, None, "x"), (6, "a  É b", "A b")]
    d = spark.createDataFrame(rows, "id int, a_text string, b_text string")
    got = {r.id: r.similarity for r in lifecycle.merge_gate(d).collect()}  # a pass per distinct trigram did not end

    def plain(x, y):
        import collections
        import re

        cut = lambda s: re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", s.lower())).strip()
        grams = lambda s: collections.Counter(s[i : i + 3] for i in range(max(len(s) - 2, 1))) if s else {}
        a, b = grams(cut(x)), grams(cut(y))
        norm = sum(n * n for n in a.values()) ** 0.5 * sum(n * n for n in b.values()) ** 0.5
        return sum(n * b.get(g, 0) for g, n in a.items()) / norm if norm else 0.0

    assert got[5] is None
    assert all(got[i] == pytest.approx(plain(x, y), abs=1e-12) for i, x, y in rows if x is not None)
    assert [r.n for r in spark.createDataFrame([("a b c",)], "t string").select(F.size(text.trigrams("t")).alias("n")).collect()] == [3]


def test_names_that_start_alike_are_not_all_tried(spark):
    names = [f"The {w}" for w in ("One", "Two", "One Two Three Four Five", "X-ray", "Ünit")] + ["The", "C++", "++", ".The"]
    nodes = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)] + [(f"f{i}", f"The far{i}") for i in range(500)], "entity_id string, name string")
    pool = spark.createDataFrame([(1, "c", ""), (2, "c", "")], "id long, collection string, text string")
    mentions = nodes.select(F.lit(2).cast("long").alias("doc_id"), "entity_id").unionByName(spark.createDataFrame([(1, "own")], "doc_id long, entity_id string"))
    says = ["the one of c++", "the one two three four five", "the x-ray", "the ünit .the", "see the two++", "other", "bathe one", "c++x the-one"]
    drafts = spark.createDataFrame([(i, "c", s, [1]) for i, s in enumerate(says)], "draft_id long, collection string, conclusion string, source_ids array<long>")
    found = consolidation.contamination(drafts, pool, mentions, nodes)
    import re

    want = {(i, n) for i, s in enumerate(says) for n in names if re.search("(?<![a-z0-9])" + re.escape(n.lower()) + "(?![a-z0-9])", s)}
    assert {(r.draft_id, r.hit) for r in found.collect()} == want
    assert "slice(runs" in found._jdf.queryExecution().optimizedPlan().toString()  # keys of several words, not of the first alone


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.8])
def test_near_duplicates_lose_no_pair_to_their_bounds(spark, threshold):
    rng = random.Random(5)
    base = [[f"w{min(int(rng.paretovariate(0.5)), 400)}" for _ in range(40)] for _ in range(12)]
    rows = [(i, sorted({w if rng.random() > share else f"w{rng.randrange(400)}" for w in rng.choice(base)} | set())) for i, share in enumerate(rng.choice([0.0, 0.1, 0.3, 0.5]) for _ in range(120))]
    rows += [(200, ["x"]), (201, ["x"]), (202, ["x", "y"]), (203, [])]
    found = fusion.near_duplicates(spark.createDataFrame(rows, "id long, grams array<string>"), threshold)
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0
    want = {(i, j): round(s, 9) for i, x in rows for j, y in rows if i < j and (s := alike(x, y)) >= threshold}
    assert {(r.a, r.b): round(r.similarity, 9) for r in found.collect()} == want and len(want) > 20
    assert "array_except(marks_a" in found._jdf.queryExecution().optimizedPlan().toString()  # whole grams went along with every pair before
