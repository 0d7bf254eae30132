"""Every query against its SQL twin on the smallest tables; the others against plain Python."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from vaultframe.plans import catalogue, catalogue_depth, catalogue_extra, catalogue_lanes, catalogue_more, catalogue_store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
assert catalogue_depth.query is catalogue_more.query is catalogue_extra.query is catalogue_lanes.query is catalogue_store.query is catalogue.query


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    cur = con.execute(catalogue.SQL[name])
    order = [c[0] for c in cur.description]
    assert sorted(order) == cols
    theirs = sorted(tuple(norm(r[order.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs


def rows(spark, name):
    return [r.asDict() for r in catalogue.QUERIES[name](spark, SF).collect()]


def test_fixed_windows(spark, con):
    want, last = {}, {}
    for e, u, t, ts in con.execute("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts, event_id").fetchall():
        opened = last.get((u, t))
        opens = opened is None or (ts - opened).total_seconds() >= 36000
        if opens:
            last[u, t] = ts
        want[e] = (opens, last[u, t])
    assert {r["event_id"]: (r["opens"], r["opened_at"]) for r in rows(spark, "dedupe_fixed_window")} == want


def test_save_memory_counts_every_row(spark):
    found = rows(spark, "save_memory")
    assert sum(r["duplicate_count"] for r in found) == 1000
    assert len({r["id"] for r in found}) == len(found)


def shingles(text):
    w = [x for x in re.split(r"\s+", re.sub(r"[^\w\s]", "", text.lower(), flags=re.A)) if x]
    return {" ".join(p) for p in zip(w, w[1:], strict=False)} | {x for x in w if len(x) > 3}


def test_diversity_is_a_permutation_with_alike_rows_last(spark, con):
    found = rows(spark, "mmr_diversity")
    bodies = dict(con.execute("SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 60) || ' ' || text FROM documents").fetchall())
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r["position"]):
        by[r["qid"]].append(r["id"])
    for ids in by.values():
        assert len(set(ids)) == len(ids)
        chosen, late = [], False
        for i in ids:
            g = shingles(bodies[i])
            alike = any(len(g & o) > 0.6 * len(g | o) for o in chosen)
            assert alike or not late
            late = late or alike
            if not alike:
                chosen.append(g)


def test_beam(spark, con):
    from vaultframe.operators.graph import INTENT_WEIGHTS

    docs = [i for (i,) in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    n, active = len(docs), {i for i in docs if i % 19}
    edges = set()
    for i in docs:
        for kind, step, m in (("causal", 7, 3), ("semantic", 11, 4), ("semantic", 13, 5), ("entity", 17, 6), ("temporal", 1, 7), ("supporting", 23, 8)):
            e = (i, (i + step) % n, kind, (i % m + 1) / m)
            edges.add(e)
            if kind in ("semantic", "entity"):
                edges.add((e[1], e[0], kind, e[3]))
    score = {i: (1.0 / (1 + i % 5), 0) for i in docs if i % 20 == 0 and i < 200}
    front = dict(score)
    for hop in (1, 2):
        new = {}
        for a, b, kind, w in edges:
            if a in front and b in active and b not in score:
                s = front[a][0] * 0.9 + math.exp(0.6 * INTENT_WEIGHTS["WHY"].get(kind, 1.0)) * w
                new[b] = max(s, new.get(b, 0))
        front = {i: (s, hop) for s, i in sorted(((s, i) for i, s in new.items()), key=lambda x: (-round(x[0], 9), x[1]))[:10]}
        score |= front
    want = sorted((h, -round(s, 6), i) for i, (s, h) in score.items())[:30]
    assert sorted((r["hops"], -r["score"], r["id"]) for r in rows(spark, "beam_traversal")) == want


def test_merge_gate_and_decisions(spark):
    assert all(0 <= r["similarity"] <= 1.000001 and (not r["accepted"] or r["similarity"] >= 0.93) for r in rows(spark, "merge_gate"))
    per = Counter(r["conv_id"] for r in rows(spark, "decision_sentences"))
    assert per and max(per.values()) <= 10


def openings(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "prompt string")


def test_constraints_and_gates(spark):
    import datetime as dt

    from vaultframe.functions import temporal, text
    from vaultframe.sources.adapter import now

    df = openings(spark, catalogue.PROMPTS)
    got = {r.prompt: (r.start_day, r.end_day) for r in df.select("prompt", temporal.temporal_constraint("prompt", now()).alias("c")).select("prompt", "c.*").collect()}
    day = dt.date
    assert got["when was the schema decided last week"] == (day(2024, 1, 25), day(2024, 2, 1))
    assert got["what happened in january 2024 and also why"] == (day(2024, 1, 1), day(2024, 1, 31))
    assert got["3 days ago we met"] == (day(2024, 1, 29), day(2024, 2, 1))
    assert got["since march 2023"] == (day(2023, 3, 1), day(2024, 2, 1))
    assert got["last 10 days of work"] == (day(2024, 1, 22), day(2024, 2, 1))
    assert got["2 months ago"] == (day(2023, 12, 1), day(2024, 2, 1))
    assert got["yesterday"] == (day(2024, 1, 31), day(2024, 1, 31))
    assert got["what is a vault"] == (None, None)
    gates = {r.prompt: r for r in df.select("prompt", text.skip_retrieval("prompt").alias("skip"), text.heartbeat("prompt").alias("heartbeat")).collect()}
    assert gates["hello there"].skip and gates["ok"].skip and gates["npm install fails"].skip
    assert not gates["remember the plan"].skip and not gates["yesterday"].skip
    assert gates["status check"].heartbeat and gates["/help"].heartbeat and not gates["are we scoping this?"].heartbeat


def test_contradictions(spark):
    from vaultframe.operators import lifecycle

    pairs = [("we do not use it", "we use it", "negation"), ("port 8080", "port 9090", "numbers"), ("port 8080 or 1,000", "port 1000", "none"), ("fine", "fine", "none")]
    df = spark.createDataFrame(pairs, "a_text string, b_text string, want string")
    assert all(r.reason == r.want and r.contradictory == (r.want != "none") for r in lifecycle.contradictions(df).collect())


def test_words_end_where_other_letters_begin(spark):
    from vaultframe.functions import text

    df = openings(spark, ["éAiler aneé 12é", "pas de why-not", "whyé"])
    assert [r[0] for r in df.select(text.anchors("prompt")).collect()] == [["ailer"], [], []]
    assert [r[0] for r in df.select(text.matches("prompt", r"\bwhy\b")).collect()] == [False, True, True]


def test_hybrid_and_tags(spark):
    found = rows(spark, "hybrid_with_temporal_entity")
    assert {r["qid"] for r in found} == {1, 2, 3, 4, 5} and all(r["fused"] > 0 for r in found)
    assert {r["tag"] for r in rows(spark, "eval_by_tag")} == {"en", "de", "fr", "es"}
    assert all(r["similarity"] > 0.5 for r in rows(spark, "similar_observation"))


def test_guards(spark):
    from vaultframe.functions import guards

    df = openings(spark, catalogue_extra.ATTACKS).select("prompt", guards.injection("prompt").alias("i"), guards.placeholder("prompt").alias("placeholder")).select("prompt", "i.*", "placeholder")
    got = {r.prompt: r.asDict() for r in df.collect()}
    found = rows(spark, "injection_guard")
    assert len(found) == spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").count() and {r["detector"] for r in found} >= {"legacy_pattern", "instruction_override", "homoglyph"}
    want = ["legacy_pattern", "role_injection", "instruction_override", "delimiter_injection", "unicode_obfuscation", "homoglyph", "normalization", None]
    assert [got[a]["detector"] for a in catalogue_extra.ATTACKS[:8]] == want
    assert got[""]["placeholder"]


def test_json_repair():
    from vaultframe.functions.guards import repair_json

    assert repair_json('text ```json\n{"a": [1, 2,], "b": "}"}\n``` more') == '{"a": [1, 2], "b": "}"}'
    assert repair_json("no json") is None and repair_json(None) is None and repair_json("{broken [1]") == "[1]"


def test_turn_batches(spark, con):
    want, state = {}, {}
    for c, t, x in con.execute("SELECT conv_id, turn, text FROM conversations ORDER BY 1, 2").fetchall():
        b, n, chars = state.get(c, (0, 0, 0))
        if n and (n + 1 > 3 or chars + len(x) > 600):
            b, n, chars = b + 1, 0, 0
        state[c] = (b, n + 1, chars + len(x))
        want[c, t] = b
    assert {(r["conv_id"], r["turn"]): r["batch"] for r in rows(spark, "turn_batches")} == want


def test_surfacing(spark):
    found = rows(spark, "surfacing")
    by = defaultdict(list)
    for r in found:
        by[r["pid"]].append(r)
    assert by
    for rs in by.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and len({r["id"] for r in rs}) == len(rs) <= 10
        assert sum(r["tokens"] for r in rs) <= 800 or len(rs) == 1
        assert all(r["id"] % 19 for r in rs)
    assert sum(r["id"] == r["wid"] or not r["confident"] for r in rows(spark, "lifecycle_targets")) > 0


def test_whole_prompts_and_documents(spark):
    longest = catalogue_extra._asked(spark, SF).selectExpr("max(length(prompt)) AS n").first()["n"]
    assert longest == spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").selectExpr("max(least(length(text), 10000)) AS n").first()["n"] > 160
    assert max(r["doc_id"] for r in rows(spark, "evidence_sentences")) >= 50
