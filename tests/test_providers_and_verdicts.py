"""Provider scores, facts with evidence, prompt facts, and verdicts as a stream against the batch fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vaultframe.operators import context, entities, providers, verdicts
from vaultframe.streaming import jobs

CAND = "qid int, query string, id long, text string"


def test_provider_scores_each_text_once(spark, tmp_path):
    log = tmp_path / "calls"

    def provider(query, texts):
        with log.open("a") as f:
            f.write("".join(f"{query}|{t}\n" for t in texts) + "--\n")
        return [float(len(t)) for t in texts]

    rows = [(1, "q", i, t) for i, t in enumerate(["a", "bb", "a", "ccc", "bb", None, "dddd", "eeeee", "x" * 900])] + [(2, "r", 0, "a"), (2, "r", 1, ""), (3, None, 0, "a")]
    c = spark.createDataFrame(rows, CAND).repartition(1)
    ranked, fresh = providers.rerank(c, provider)
    got = {(r.qid, r.id): (r.score, r.covered, r.place) for r in ranked.collect()}
    assert got[1, 8] == (400.0, True, 1) and got[1, 0][:2] == got[1, 2][:2] == (1.0, True) and got[1, 5] == (0.0, False, 9) and got[3, 0] == (0.0, False, 1) and got[2, 1] == (0.0, True, 2)
    calls = [x for x in log.read_text().split("\n") if "|" in x]
    assert len(calls) == len(set(calls)) == 8 and max(len([x for x in b.split("\n") if "|" in x]) for b in log.read_text().split("--")) <= 4
    # what is cached is not asked again
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    log.unlink()
    again, more = providers.rerank(spark.createDataFrame([*rows, (2, "r", 5, "new")], CAND), provider, cache=cache)
    assert {(r.qid, r.id): r.score for r in again.collect()} == {k: v[0] for k, v in got.items()} | {(2, 5): 3.0}
    assert more.count() == 1 and set(x for x in log.read_text().split("\n") if "|" in x) == {"r|new"}
    # another model shares nothing; an intent is part of what is asked
    assert providers.rerank(c, provider, model="other", cache=cache)[1].count() == 8
    assert providers.rerank(c, provider, intent="why", cache=cache)[1].count() == 8


def test_provider_failures_are_data(spark):
    def provider(query, texts):
        if query == "bad":
            raise TimeoutError("gone")
        return [float("nan") if t == "nan" else 1.0 for t in texts if t != "short"]

    rows = [(1, "bad", i, f"t{i}") for i in range(9)] + [(2, "good", 0, "nan"), (2, "good", 1, "fine")] + [(3, "cut", 0, "a"), (3, "cut", 1, "short")]
    ranked, fresh = providers.rerank(spark.createDataFrame(rows, CAND), provider)
    assert {r.error for r in ranked.where("qid = 1").collect()} == {"TimeoutError: gone"}
    assert {(r.qid, r.n, r.missing) for r in providers.coverage(ranked).collect()} == {(1, 9, 9), (2, 2, 1), (3, 2, 1)}
    assert fresh.count() == 2


TRIPLE = "id long, subject string, predicate string, object_entity string, object_literal string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double"
NEW = "seq long, subject string, predicate string, object_entity string, object_literal string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, doc_id long, fact string"


def test_facts_seen_again_gain_evidence(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    t = spark.createDataFrame([(1, "a", "depends_on", "b", None, None, None, 1.0), (2, "a", "depends_on", "c", None, None, dt.datetime(2024, 1, 1), 1.0)], TRIPLE)
    e = spark.createDataFrame([(1, None, None, dt.datetime(2024, 1, 1)), (1, 7, "x", dt.datetime(2024, 1, 2))], "triple_id long, doc_id long, fact string, created_at timestamp_ntz")
    rows = [
        (1, "a", "Depends On", "b", "beside", None, None, None, None, None),  # unattributed again
        (2, "a", "depends on", "b", None, None, None, None, 7, "x"),  # the same sighting
        (3, "a", "depends on", "b", None, None, None, None, 7, "y"),
        (4, "a", "depends on", "c", None, None, None, 0.4, None, None),  # the old one is closed
        (5, "a", "depends on", "c", None, None, None, 0.9, 9, None),
        (6, "a", "named", None, "A", None, None, None, 9, None),
        (7, "a", "named", None, "A", None, None, None, 9, ""),  # null and empty are one
    ]
    fresh, proofs = entities.add_facts(t, e, spark.createDataFrame(rows, NEW), now)
    assert sorted((r.id, r.predicate, r.object_entity, r.object_literal, r.confidence) for r in fresh.collect()) == [(3, "depends_on", "c", None, 0.4), (4, "named", None, "A", 1.0)]
    assert sorted((r.triple_id, r.doc_id or 0, r.fact or "") for r in proofs.collect()) == [(1, 7, "y"), (3, 0, ""), (3, 9, ""), (4, 9, "")]
    again = entities.add_facts(t.unionByName(fresh), e.unionByName(proofs), spark.createDataFrame(rows, NEW), now)
    assert again[0].count() == 0 and again[1].count() == 0
    docs = spark.createDataFrame([(7, "c", "p.md")], "id long, collection string, path string")
    names = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "entity_id string, name string")
    told = {(r.entity_id, r.direction, r.id): r for r in entities.with_evidence(t.unionByName(fresh), e.unionByName(proofs), docs, names, 2).collect()}
    r = told["b", "incoming", 1]
    assert (r.subject, r.object, r.evidence_count, [(s.doc_id, s.path, s.fact) for s in r.sources]) == ("Alpha", "Beta", 3, [(7, "p.md", "y"), (7, "p.md", "x")])
    assert told["c", "incoming", 2].evidence_count == 0 and not told["c", "incoming", 2].current and told["c", "incoming", 2].object == "c"


def test_prompt_facts(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    nodes = spark.createDataFrame([("v:tool:bun", "Bun"), ("v:tool:forge-stack", "forge-stack"), ("v:concept:two", "Two Words"), ("v:tool:twin", "Twin"), ("v:concept:twin", "twin"), ("v:tool:api", "API")], "entity_id string, name string")
    prompts = spark.createDataFrame([(1, "Does (forge-stack) need Bun? see v:concept:twin."), (2, "two words on the API"), (3, "Twin only"), (4, ""), (5, None)], "pid long, prompt string")
    found = {(r.pid, r.place): (r.entity_id, r.via) for r in context.prompt_entities(prompts, nodes).collect()}
    assert found == {(1, 1): ("v:concept:twin", "canonical-id"), (1, 2): ("v:tool:bun", "proper-noun"), (1, 3): ("v:tool:forge-stack", "ngram"), (2, 1): ("v:tool:api", "proper-noun"), (2, 2): ("v:concept:two", "ngram")}
    rows = [(1, "v:tool:forge-stack", "uses", "v:tool:bun", None, None), (2, "v:tool:bun", "is", None, "fast", dt.datetime(2024, 1, 1)), (3, "v:tool:bun", "is", None, "new", dt.datetime(2024, 3, 1))]
    triples = spark.createDataFrame(rows, "id long, subject string, predicate string, object_entity string, object_literal string, valid_to timestamp_ntz")
    block = context.vault_facts(prompts, nodes, triples, now).collect()
    assert [(r.pid, r.entities, r.n_facts, r.block) for r in block] == [(1, 3, 2, "<vault-facts>\nBun is new\nforge-stack uses Bun\n</vault-facts>")]
    assert context.vault_facts(prompts, nodes, triples, now, budget=12).first().n_facts == 1
    assert context.vault_facts(prompts, nodes, triples, now, budget=11).count() == 0


EVIDENCE = "session string, seq long, at timestamp_ntz, kind string, hash string, words array<string>, usage_id long"


def talk(seed, sessions=6):
    r = random.Random(seed)
    rows, usage = [], 0
    for s in range(sessions):
        at, seq = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(600)), 0
        for _ in range(r.randrange(2, 9)):
            sha = f"h{r.randrange(12)}"
            at += dt.timedelta(seconds=r.randrange(20, 500))
            seq += 1
            rows.append((f"s{s}", seq, at, "human", sha, None, None))
            for _ in range(r.randrange(3)):
                at += dt.timedelta(seconds=r.randrange(1, 60))
                seq += 1
                rows.append((f"s{s}", seq, at, "assistant", None, r.sample("abcdef", 3), None))
            if r.random() < 0.3:
                seq += 1
                rows.append((f"s{s}", seq, at + dt.timedelta(seconds=1), "stop", None, None, None))
            for _ in range(r.randrange(3)):
                usage += 1
                seq += 1
                rows.append((f"s{s}", seq, at - dt.timedelta(seconds=r.choice([0, 5, 300, 900])), "usage", sha if r.random() < 0.8 else "none", r.sample("abcdefgh", 4), usage))
    return rows


@pytest.mark.parametrize("ended", [False, True])
def test_session_fold_equals_windows(spark, ended):
    rows = talk(1, 12)
    want = {(r.session, r.usage_id): (r.state, r.reason, tuple(r.references)) for r in verdicts.fold(spark.createDataFrame(rows, EVIDENCE), ended=ended).collect()}
    micro = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    got = {}
    for s in {r[0] for r in rows}:
        mine = [(micro(r[2]), *r[1:2], *r[3:]) for r in rows if r[0] == s]
        random.Random(2).shuffle(mine)
        got |= {(s, u): v for u, v in verdicts.Session(mine).verdicts(ended=ended).items()}
    assert got == want and {v[0] for v in want.values()} >= ({"final", "unattributable"} if ended else {"final", "provisional"})


def test_verdict_stream_equals_the_batch_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = talk(3)
    batch = {(r.session, r.usage_id): (r.state, tuple(r.references)) for r in verdicts.fold(spark.createDataFrame(rows, EVIDENCE)).collect()}
    shuffled = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=random.Random(str(x)).randrange(500)))  # late by less than the watermark allows
    end = [("zz", 1, dt.datetime(2024, 1, 3), "human", "end", None, None)]  # time goes on
    for i, part in enumerate([shuffled[k : k + len(rows) // 4 + 1] for k in range(0, len(rows), len(rows) // 4 + 1)] + [end, [("zz", 2, dt.datetime(2024, 1, 4), "human", "end", None, None)]]):
        spark.createDataFrame(part, EVIDENCE).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        df = jobs.verdicts(spark.readStream.schema(EVIDENCE).json(f"file://{tmp_path}/in"))
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None, i
    seen: dict = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.revision):
        key = r.session, r.usage_id
        assert r.revision == seen.get(key, (0,))[0] + 1  # revisions rise one by one
        assert key not in seen or seen[key][1] not in ("final", "unattributable")  # and nothing follows a conclusion
        seen[key] = (r.revision, r.state, tuple(r.references))
    assert {k: v[1:] for k, v in seen.items()} == batch
    assert max(v[0] for v in seen.values()) > 1  # some verdicts were revised


def test_expansion_replies_are_cleaned(spark):
    texts = {
        "one": "lex: first words\nvec: a question /no_think here\nlex: first words\nlex: one\nnoise\nother: x\nhyde: <think>hm</think>\nhyde: it is: so",
        "two": "lex: keyword search terms (x)\nvec:   ",
        "three": None,
    }

    def writer(query):
        if texts.get(query) is None:
            raise ConnectionError("down")
        return texts[query]

    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "one"), (5, None)], "qid int, query string")
    found, fresh = providers.expand(q, writer)
    got = sorted((r.qid, r.n, r.kind, r.text, r.fallback) for r in found.collect())
    first = [(1, "lex", "first words", False), (2, "vec", "a question here", False), (3, "hyde", "it is: so", False)]
    assert got == [(1, *x) for x in first] + [(2, 1, "hyde", "Information about two", True), (3, 1, "hyde", "Information about three", True)] + [(4, *x) for x in first]
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert [r.query for r in cache.collect()] == ["one"]
    texts.clear()
    again, more = providers.expand(q.where("qid = 1"), writer, cache)
    assert again.count() == 3 and more.count() == 0


def test_query_with_models(spark, tmp_path):
    from vaultframe.vault import Vault

    v = Vault(spark, f"file://{tmp_path}/v", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    rows = [("c", "a.md", "Engines", "spark runs the engine", "note"), ("c", "b.md", "Boats", "a sail and an engine", "note"), ("c", "d.md", "Motors", "electric motors only", "note")]
    v.index(spark.createDataFrame(rows, "collection string, path string, title string, body string, content_type string"))
    plain_order = [r.path for r in v.query("engine").collect()]
    assert set(plain_order) == {"a.md", "b.md"}
    plain = v.query("engine", expand=lambda q: "lex: motors").collect()
    assert {r.path for r in plain} == {"a.md", "b.md", "d.md"}
    best = v.query("engine", score=lambda q, texts: [1.0 if "sail" in t else 0.01 for t in texts]).first()
    assert best.path == "b.md"

    def broken(q, texts):
        raise TimeoutError

    assert [r.path for r in v.query("engine", score=broken).collect()] == plain_order
    v.commit(entities=spark.createDataFrame([("v:tool:spark", "Spark"), ("v:tool:jvm", "JVM")], "id string, name string"), triples=spark.createDataFrame([(1, "v:tool:spark", "runs_on", "v:tool:jvm")], "id long, subject string, predicate string, object string"))
    assert v.facts_for("what does Spark need").first().block == "<vault-facts>\nSpark runs_on JVM\n</vault-facts>"
