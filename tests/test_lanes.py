"""Prompt rules, entity resolution, causal chains and counter repair against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from vaultframe.functions import prompts, text
from vaultframe.operators import entities, fts, graph, lifecycle, worklists
from vaultframe.plans import catalogue, catalogue_lanes

SF = "/root/testdata/sf0.001"

PROMPTS = {
    "as you said, the cache and the index and the shuffle partitions": "conversation-backref",
    "go deeper on that shuffle with partitions spill memory bytes rows files tasks": "continuation-deictic",
    "ok, expand on this": "continuation-deictic",
    "now write a security report about this authentication middleware session token refresh cookie header": "self-sufficient",
    "also list the broadcast limits": "continuation-opener",
    "fix this broken shuffle stage": "anaphora-low-content",
    "shuffle": "underspecified",
    "describe how broadcast joins choose their build side": "self-sufficient",
    "[cron: daily] more": "continuation-opener",
    "Conversation info (untrusted metadata):\n{}\n\nshuffle": "underspecified",
    "[Mon 2024-01-01 10:00 UTC] also more": "continuation-opener",
    "été cité itérable quantité variété": "anaphora-low-content",  # boundaries know ASCII words only: it|érable
}


def test_prior_context(spark):
    df = spark.createDataFrame([(p,) for p in PROMPTS], "p string")
    assert {r.p: r.why for r in df.select("p", prompts.prior_context("p").alias("why")).collect()} == PROMPTS


def test_normalised_prompt_and_hint(spark):
    df = spark.createDataFrame([("  [Mon 2024-01-01 10:00 UTC] why did it fail ",), ("what else is there",), ("hello",), (None,)], "p string")
    got = df.select(text.normalised_prompt("p").alias("t"), prompts.routing_hint("p").alias("h")).collect()
    assert [r.t for r in got] == ["why did it fail", "what else is there", "hello", None]
    assert ["find_similar" in (r.h or "") for r in got] == [False, True, False, False] and "intent_search" in got[0].h


def plain_cut(t, most):
    """The rule of smart_truncate in plain Python."""
    if len(t) <= most:
        return t
    c = t[:most]
    if c.rfind("\n\n") > most / 2:
        return c[: c.rfind("\n\n")].rstrip()
    m = re.match(r"^(.+[.!?])\s", c, re.S)
    if m and len(m[1]) > most / 2:
        return m[1]
    if c.rfind("\n") > most / 2:
        return c[: c.rfind("\n")].rstrip()
    return (c[: c.rfind(" ")].rstrip() if c.rfind(" ") > most / 2 else c.rstrip()) + "..."


def test_smart_truncate(spark):
    texts = ["", "short", "aaaa bbbb. cccc dddd", "aaaa bbbb\n\ncccc dddd", "aaaa bbbb\ncccc dddd", "aaaa bbbb cccc dddd", "a" * 30, "aaaa bbbb! cc\n\n\n\nddd", "x y" + " " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(prompts.smart_truncate("t", 14).alias("c")).collect()] == [plain_cut(t, 14) for t in texts]


def test_fragments_of_bad_json(spark):
    row = spark.createDataFrame([("body", "no json", "n" * 60), ("b", '["' + "f" * 60 + '", "short"]', None)], "b string, f string, n string")
    got = [[(p.type, len(p.content)) for p in r.p] for r in row.select(prompts.observation_fragments("b", "f", "n").alias("p")).collect()]
    assert got == [[("full", 4), ("narrative", 60)], [("full", 1), ("fact", 60)]]


def plain_resolve(nodes, query):
    words = lambda s: [w for w in re.split(r"[^\w]+|_", s.lower()) if w]
    query = query.strip()
    best = lambda hits: sorted(hits, key=lambda n: (-n[2], n[0]))
    if not query:
        return []
    if any(str(n[0]) == query for n in nodes):
        return [("canonical-id", query)]
    if re.fullmatch(r"[a-z][a-z0-9-]*:[a-z_]+:[a-z0-9_]+", query):
        return []
    exact = [n for n in nodes if n[1].lower() == query.lower()]
    if exact:
        return [("exact-name", n[0]) for n in exact]

    def digits(name):
        at, want = 0, re.findall(r"\d+", query)
        for run in re.findall(r"\d+", name):
            at += at < len(want) and run == want[at]
        return at == len(want)

    for via, fits in (("name-word", str.__eq__), ("name-prefix", str.startswith)):
        hits = [n for n in nodes if digits(n[1]) and any(fits(t, w) for t in words(n[1]) for w in words(query))]
        if hits:
            return [(via, best(hits)[0][0])]
    return []


def test_resolve_query(spark):
    nodes = [("v:tool:node_200", "Node 200", 1), ("v:tool:node_202", "Node 202", 9), ("v:place:node_202", "node 202", 2), ("v:tool:spark", "Spark SQL 4", 5), ("v:org:sparkle", "Sparkle", 7), ("v:org:x", "Ünit 7 20", 0)]
    asked = ["v:tool:spark", "v:tool:gone", "NODE 202", "node", "node 200 of spark", "spark", "spar", "Spar 4", "spark 5", "nothing", " ", "7 of ünit", "20 7 ünit"]
    out = entities.resolve_query(spark.createDataFrame(nodes, "entity_id string, name string, mention_count int"), spark.createDataFrame(list(enumerate(asked)), "qid int, query string"))
    want = sorted((i, via, str(e)) for i, q in enumerate(asked) for via, e in plain_resolve(nodes, q))
    assert sorted((r.qid, r.via, r.entity_id) for r in out.collect()) == want


def test_resolve_entities_query(spark):
    nodes = [tuple(r) for r in catalogue_lanes._nodes(spark, SF).collect()]
    asked = catalogue_lanes._entity_queries(spark, SF).collect()
    want = sorted((r.qid, via, int(e)) for r in asked for via, e in plain_resolve(nodes, r["query"]))
    assert sorted(tuple(r) for r in catalogue.QUERIES["resolve_entities"](spark, SF).select("qid", "via", "entity_id").collect()) == want


def test_causal_chain_is_deep_and_says_when_it_is_cut(spark):
    edges = [(i, i + 1, "causal", 0.5) for i in range(30)] + [(i, 0, "causal", 0.9) for i in range(100, 140)] + [(5, 6, "semantic", 1.0)]
    rel = spark.createDataFrame(edges, "source_id long, target_id long, relation_type string, weight double")
    got = graph.causal_chain(rel, 15, 10).collect()
    assert {(r.depth, r.source_id, r.direction) for r in got} == {(d, 14 + d, "effect") for d in range(1, 11)} | {(d, 15 - d, "cause") for d in range(1, 11)}
    assert not any(r.truncated for r in got)
    few = graph.causal_chain(rel, 0, 10, 12).collect()
    assert len(few) == 12 and all(r.truncated and r.depth == 1 and r.direction == "cause" for r in few)
    loop = spark.createDataFrame([(1, 2, "causal", 1.0), (2, 1, "causal", 1.0)], rel.schema)
    assert len(graph.causal_chain(loop, 1, 10).collect()) == 4


def test_counters_go_forth_and_back(spark):
    docs = spark.createDataFrame([(1, 3, None), (2, 0, None), (3, 1, None)], "id long, access_count long, last_accessed_at timestamp_ntz")
    ledger = spark.sql("SELECT id, CAST(at AS timestamp_ntz) AS referenced_at FROM VALUES (1L, '2024-01-01'), (1L, '2024-01-03'), (2L, NULL), (3L, '2024-01-02') t(id, at)")
    images = worklists.counter_repair(docs, ledger)
    assert sorted((r.id, r.before_count, r.after_count) for r in images.collect()) == [(1, 3, 2), (3, 1, 1)]
    after = worklists.apply_repair(docs, images)
    assert worklists.counter_repair(after, ledger).count() == 0
    later = after.withColumn("access_count", F.when(F.col("id") == 1, 9).otherwise(F.col("access_count")))  # read again since
    assert {r.id: r.access_count for r in worklists.apply_repair(later, images, "before").collect()} == {1: 9, 2: 0, 3: 1}


@pytest.mark.parametrize("query", ["und von", "anat", "reon", "nothingofthekind"])
def test_search_without_an_index_ranks_as_with_one(spark, query):
    docs = catalogue.fields(spark, SF)
    asked = spark.createDataFrame([(1, query)], "qid int, query string")
    pick = lambda d: sorted((r.id, r.rank, round(r.bm25, 9)) for r in d.collect())
    assert pick(fts.search(docs, asked)) == pick(fts.bm25(fts.postings(docs), asked))


def test_similar_observation_between_two_tables(spark):
    rows = [("a", 1, "one two six nine"), ("a", 2, "one two six ten"), ("b", 3, "one two six nine"), ("a", 4, "other words here"), ("a", 5, "one two six nine")]
    d = spark.createDataFrame(rows, "collection string, id long, text string")
    both = lambda x, y: sorted((r.new_id, r.old_id) for r in lifecycle.similar_observation(x, y).collect())
    assert both(d, d) == [(1, 5), (2, 1), (5, 1)]
    assert both(d.where("id = 2"), d.where("id in (3, 5)")) == [(2, 5)]
    assert both(d.limit(0), d) == []
