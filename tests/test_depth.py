"""Resolution by type, targets of lifecycle requests and proximity on planted cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vaultframe.operators import context, entities, fusion
from vaultframe.plans import cascade

NODE = "entity_id string, name string, entity_type string, seq long"


def resolved(spark, asked, nodes, **kw):
    found = entities.canonical(spark.createDataFrame(asked, "name string, entity_type string"), spark.createDataFrame(nodes, NODE), **kw)
    return {(r.name, r.entity_type): (r.entity_id, r.via) for r in found.collect()}


def test_names_resolve_within_their_bucket(spark):
    nodes = [("p1", "Dre Konrad", "person", 1), ("t1", "Mercury Engine", "project", 2), ("t2", "mercury engine", "tool", 3), ("o1", "Mercury Engines", "org", 4), ("v2", "Node 202", "vm", 5), ("v1", "Node 200", "vm", 6), ("x", None, "org", 7), ("y", "Nothing", None, 8)]
    asked = [(" MERCURY ENGINE ", "concept"), ("Mercury Enginee", "service"), ("Mercury Enginee", "org"), ("Dre A. Konrad", "person"), ("Dre A. Konrad", "org"), ("Nodes 202", "vm"), ("Node 201", "vm"), ("Merc", "tool"), ("", "org"), (None, None), ("Mercury Enginee", "org"), ("nothing", None)]
    found = resolved(spark, asked, nodes)
    assert found == {
        (" MERCURY ENGINE ", "concept"): ("t1", "exact-name"),  # the oldest of the bucket
        ("Mercury Enginee", "service"): ("t1", "alike"),
        ("Mercury Enginee", "org"): ("o1", "alike"),
        ("Dre A. Konrad", "person"): ("p1", "alike"),  # 10 of 13 characters: enough for persons in any case
        ("Dre A. Konrad", "org"): (None, None),
        ("Nodes 202", "vm"): ("v2", "alike"),
        ("Node 201", "vm"): (None, None),
        ("Merc", "tool"): (None, None),
        ("", "org"): ("x", "exact-name"),
        ("", ""): (None, None),
        ("nothing", ""): ("y", "exact-name"),
    }
    assert resolved(spark, [("Kit Moor Blane", "person"), ("Kit Moor Blane", "org")], [("a", "Kit Blane", "person", 1), ("b", "Kit Blane", "org", 2)])["Kit Moor Blane", "org"] == (None, None)
    assert resolved(spark, [("Dre Konrads", "person")], [("p", "Konrad", "person", 1)])["Dre Konrads", "person"] == (None, None)
    assert resolved(spark, [("a", "org")], []) == {("a", "org"): (None, None)} and resolved(spark, [], nodes) == {}


def test_common_words_lead_to_the_oldest_nodes_as_brute_force_does(spark):
    rng = random.Random(4)
    kinds = ["person", "org", "tool", "service", "thing"]
    nodes = [(f"e{i}", f"node {rng.choice(['alpha', 'alphas', 'beta', 'betas', 'gamma'])} {rng.choice('abcde')}{rng.choice('abcde')}", rng.choice(kinds), i) for i in range(400)]
    asked = sorted({(f"{rng.choice(['node', 'nod'])} {rng.choice(['alpha', 'alp', 'beta', 'gamma', 'delta'])} {rng.choice('abcde')}", rng.choice(kinds)) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def plain(name, kind):
        bucket = lambda k: entities.ENTITY_BUCKETS.get(k, k)
        same = [n for n in nodes if n[1] == name and bucket(n[2]) == bucket(kind)]
        if same:
            return same[0][0], "exact-name"
        words = name.split()
        first = [n for n in nodes if set(n[1].split()) & set(words)][:7]
        more = [n for n in nodes if any(t.startswith(w) for t in n[1].split() for w in words)][:7]
        best = (None, None, 0.0)
        for n in (first + [m for m in more if m not in first])[:7]:
            ratio = 1 - distance(name, n[1]) / max(len(name), len(n[1]))
            if bucket(n[2]) == bucket(kind) and ratio >= (0.65 if kind == "person" else 0.75) and ratio > best[2]:
                best = (n[0], "alike", ratio)
        return best[:2]

    assert resolved(spark, asked, nodes, candidates=7) == {a: plain(*a) for a in asked}


def test_the_first_step_that_finds_gives_the_target(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    docs = [
        (1, "notes", "a/plan.md", "Release plan for the autumn", day(1), False),
        (2, "work", "a/plan.md", "Deployment checklist", day(2), False),
        (3, "work", "b/fusion.md", "Fusion weights and their floor", day(3), False),
        (4, "work", "b/fusion-old.md", "Fusion weights, earlier", day(4), True),
        (5, "work", "c/other.md", None, day(5), False),
        (6, "work", "c/later.md", "fusion floor notes", day(6), False),
        (7, "work", "b/100%_done.md", "Done", day(7), None),
    ]
    d = spark.createDataFrame(docs, "id long, collection string, path string, title string, modified_at timestamp, legacy boolean")
    asked = [
        (1, "/work/a/plan.md"), (2, "a/plan.md"), (3, "B/FUSION"), (4, "b/fusion-old.md"), (5, "the fusion of floors floor"), (6, "keyword one"), (7, "unheard of"),
        (8, None), (9, ""), (10, "/"), (11, "100%_d/"), (12, "0%_done.md"), (13, "b/nowhere.md fusion weights"), (14, "as of the"), (15, "x" * 5000 + "/")]
    w = spark.createDataFrame(asked, "wid long, text string")
    calls = []

    def keyword(q):
        calls.append(sorted(r.qid for r in q.collect()))
        return q.where("query = 'keyword one'").select("qid", F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("score"), F.lit(k).alias("rank")) for i, s, k in [(3, 0.6, 1), (1, 0.5, 2)]))).alias("r")).select("qid", "r.*")

    def semantic(q):
        calls.append(sorted(r.qid for r in q.collect()))
        return q.where("qid = 7").select("qid", F.lit(5).alias("id"), F.lit(0.3).alias("score"), F.lit(1).alias("rank"))

    found = cascade.candidates(w, d, keyword, semantic)
    got = {r.wid: (r.step, r.id, r.score and round(r.score, 6), r.outcome, r.forget_outcome) for r in cascade.targets(w, found).collect()}
    missing = (None, None, None, "missing", "missing")
    assert got == {
        1: ("path", 2, 1.0, "found", "found"),
        2: ("path", 1, 1.0, "ambiguous", "ambiguous"),
        3: ("path", 3, 1.0, "found", "found"),
        4: ("path", 4, 1.0, "found", "found"),  # named exactly
        5: ("title", 6, 0.666667, "found", "ambiguous"),  # the later of two titles with 2 of 3 words
        6: ("fts", 3, 0.6, "found", "ambiguous"),
        7: ("vec", 5, 0.3, "found", "ambiguous"),  # alone, but weak
        8: missing, 9: missing, 11: missing, 14: missing, 15: missing,
        10: ("path", 1, 1.0, "found", "found"),
        12: ("path", 7, 1.0, "found", "found"),
        13: ("title", 3, 0.666667, "found", "ambiguous"),
    }
    assert [r.id for r in found.where("wid = 10").orderBy("place").collect()] == [1, 2, 3, 5, 6] and [r.id for r in found.where("wid = 3").collect()] == [3]
    assert calls == [[5, 6, 7, 9, 11, 13, 14, 15], [7, 9, 11, 14, 15]]
    assert cascade.candidates(w.limit(0), d, keyword).count() == 0 and cascade.candidates(w, d.limit(0), keyword).where("step <> 'fts'").count() == 0


def test_titles_meet_by_parts_of_words_as_brute_force_does(spark):
    rng = random.Random(8)
    words = ["plan", "planner", "an", "fusion", "fus", "floor", "flo", "or", "note-book", "Note", "b2", "éa", "weights!"]
    docs = [(i, "c", f"{i}", rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(0, 5))), dt.datetime(2024, 1, rng.randint(1, 9)), False) for i in range(150)]
    asked = [(i, " ".join(rng.choices([*words, "the", "of"], k=rng.randint(1, 6)))) for i in range(80)]
    found = cascade.by_title(spark.createDataFrame(asked, "wid long, text string"), spark.createDataFrame(docs, "id long, collection string, path string, title string, modified_at timestamp, legacy boolean"), 5)
    import re

    want = {}
    for wid, text in asked:
        ws = [x for x in (re.sub("[^a-z0-9]", "", x) for x in text.lower().split() if len(x) >= 2 and x not in cascade.TITLE_STOPWORDS) if len(x) >= 2]
        hits = [(-sum(x in t.lower() for x in ws), -m.timestamp(), i) for i, _, _, t, m, _ in docs]
        want[wid] = [(i, round(-h / len(ws), 6)) for h, _, i in sorted(hits) if ws and -h >= max(2, -(-len(ws) // 2))][:5]
    got = {wid: [] for wid, _ in asked}
    for r in found.orderBy("wid", "place").collect():
        got[r.wid].append((r.id, round(r.score, 6)))
    assert got == want and any(want.values())


def test_close_words_come_first(spark):
    docs = [
        (1, "p", "t", "red x x x x x x blue"),
        (2, "p", "t", "blue x reds"),
        (3, "p", "redish blueish", "nothing"),
        (4, "p", None, None),
        (5, "p", "t", "red x x x x blue"),
        (6, "red", "blue", ""),
    ]
    d = spark.createDataFrame(docs, "id long, path string, title string, body string")
    found = spark.createDataFrame([(q, i, i) for q in (1, 2, 3, 4) for i in range(1, 7)] + [(5, 3, 1)], "qid int, id long, rank int")
    queries = spark.createDataFrame([(1, "red blue RED"), (2, "red"), (3, "re red"), (4, None), (5, "red blue")], "qid int, query string")
    got = {}
    for r in context.proximity_rank(found, d, queries).orderBy("place").collect():
        got.setdefault(r.qid, []).append((r.id, r["class"], r.field))
    assert got[1] == [(3, 0, "title"), (2, 1, "body"), (5, 1, "body"), (1, 2, None), (4, 2, None), (6, 2, None)]
    for q in (2, 3, 4):
        assert got[q] == [(i, None, None) for i in range(1, 7)]
    assert got[5] == [(3, None, None)]


def test_topics_and_partners_change_scores(spark):
    rows = [(1, 1, "Red plan", "p", "x"), (1, 2, None, "red/PLAN", None), (1, 3, "red", "p", "y" * 800 + "plan"), (2, 1, "Red plan", "p", ""), (3, 1, "a", "p", ""), (4, 1, "Red", "p", "")]
    df = spark.createDataFrame(rows, "qid int, id long, title string, path string, body string").withColumn("score", F.lit(1.0))
    topics = spark.createDataFrame([(1, " RED  plan a"), (2, "none such"), (3, "a"), (5, "red")], "qid int, topic string")
    got = {(r.qid, r.id): r.boosted for r in fusion.topic_boost(df, topics).collect()}
    assert got == {(1, 1): 1.4, (1, 2): 1.4, (1, 3): 0.75, (2, 1): 1.0, (3, 1): 1.0, (4, 1): 1.0}
    assert {r.boosted for r in fusion.topic_boost(df, topics, demote=0.1).where("qid = 1").collect()} == {1.4, 0.5}
    ranked = spark.createDataFrame([(1, i, i, 1.0) for i in range(1, 9)] + [(2, 5, 1, 1.0)], "qid int, id long, input_rank int, composite double")
    pairs = spark.createDataFrame([(1, 2, 50), (1, 3, 1), (1, 5, 1), (4, 2, 9), (2, 5, 1), (1, 6, 1), (1, 7, 1), (1, 8, 1)], "a long, b long, n long")
    got = {(r.qid, r.id): round(r.composite, 6) for r in fusion.co_activation_boost(ranked, pairs).collect()}
    # 1 and 2 lead; 1 knows 2, 3, 5, 6, 7 best, 2 knows 1, 4, 5
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 1.1, (1, 4): 1.15, (1, 5): 1.15, (1, 6): 1.1, (1, 7): 1.1, (1, 8): 1.0, (2, 5): 1.0}
