"""Consolidation, contamination, trace rules, mirrors and token chunks on planted cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vaultframe.operators import consolidation, invariants, verdicts
from vaultframe.sources import token_chunks


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


PATTERN = "id long, collection string, text string, source_doc_ids array<long>"
OBSERVATION = "id long, collection string, observation string, source_doc_ids array<long>, status string, created_at timestamp_ntz"


def test_patterns_join_what_they_belong_to(spark):
    base = "the Engine prefers small batches when memory is short and large batches otherwise"
    other = "Deployments on Fridays often need another careful review before release"
    day = dt.datetime(2024, 1, 1)
    o = [(1, "c", base + " today", [1, 2], "active", day), (2, "d", base + " today", [3], "active", day), (3, "c", other, [4], "archived", day)]
    p = [
        (10, "c", base + " again", [2, 5, 5]),  # belongs to 1
        (11, "c", base + " again now", [6, 7]),  # best partner is 10, so it ends at 1 too
        (12, "c", other, [8, 9]),  # new: the like one is archived
        (13, "c", other + " now", [9, 10]),  # joins 12
        (14, "c", base + " today", [11, 11]),  # a single source
        (15, "e", base, [1, 2]),  # alone in its collection
        (16, "c", base.replace("Engine", "Motor"), [1, 12]),  # names that the others don't have
    ]
    found = {(r.observation_id, r.head): r for r in consolidation.consolidate(spark.createDataFrame(p, PATTERN), spark.createDataFrame(o, OBSERVATION), now()).collect()}
    assert set(found) == {(1, None), (None, 12), (None, 15), (None, 16)}
    one = found[1, None]
    assert (one.source_doc_ids, one.proof_count, one.members, one.observation, one.trend) == ([1, 2, 5, 6, 7], 5, 2, base + " again now", "STRENGTHENING")
    assert found[None, 12].source_doc_ids == [8, 9, 10] and found[None, 12].observation == other + " now" and found[None, 12].trend == "NEW"
    none = consolidation.consolidate(spark.createDataFrame([], PATTERN), spark.createDataFrame([], OBSERVATION), now())
    assert none.count() == 0


def test_foreign_names_in_conclusions(spark):
    pool = spark.createDataFrame([(1, "c", "Alpha report"), (2, "c", "Beta report"), (3, "c", "Gamma report on Delta"), (4, "d", "Zeta things")], "id long, collection string, text string")
    mentions = spark.createDataFrame([(1, "e1"), (2, "e2"), (3, "e3"), (3, "e4"), (4, "e5")], "doc_id long, entity_id string")
    nodes = spark.createDataFrame([("e1", "Alpha"), ("e2", "auth-service"), ("e3", "C++"), ("e4", ".NET"), ("e5", "Zeta"), ("e6", "Unused")], "entity_id string, name string")
    drafts = spark.createDataFrame(
        [
            (1, "c", "Alpha uses the AUTH-SERVICE, c++ and Zeta", [1]),  # e5 is of another pool
            (2, "c", "preauth-service and c++x are other words; Alpha", [1]),
            (3, "c", "auth-service and .net", [2, 3]),  # supported
            (4, "d", "Alpha in Gamma", [9]),  # its source has no entity: words of the pool
            (5, "c", "Gamma and Beta and Delta", [7]),  # so here, and no source has any word
        ],
        "draft_id long, collection string, conclusion string, source_ids array<long>",
    )
    found = {(r.draft_id, r.method, r.hit) for r in consolidation.contamination(drafts, pool, mentions, nodes).collect()}
    assert found == {(1, "entity", "auth-service"), (1, "entity", "C++"), (5, "lexical", "gamma"), (5, "lexical", "beta"), (5, "lexical", "delta")}


def test_deductive_candidates(spark):
    d = spark.createDataFrame([(1, True, "decision", "x", ["f"], dt.datetime(2024, 1, 30), None), (2, True, "decision", "x", ["f"], dt.datetime(2024, 1, 1), None), (3, True, "note", "x", ["f"], dt.datetime(2024, 1, 30), None), (4, True, "problem", None, ["f"], dt.datetime(2024, 1, 30), None), (5, True, "milestone", "x", ["f"], dt.datetime(2024, 1, 30), None), (6, True, "deductive", "x", None, dt.datetime(2024, 1, 30), [5])], "id long, active boolean, content_type string, observation_type string, facts array<string>, modified_at timestamp_ntz, source_doc_ids array<long>")
    assert [r.id for r in consolidation.deductive_candidates(d, now()).collect()] == [1]


TRACE = "trace_id long, outcome string, empty_reason string, ranking_key string, has_injection boolean, has_admission boolean, prior_certified boolean, current_mass double, discounted_mass double, expansion_contribution double, protected_slots int, admitted_current int, rerank_attempted boolean, rerank_failed boolean, ordering_applied boolean, gated boolean, degenerate boolean, finalization_ms int"
FINE = dict(outcome="injected", empty_reason=None, ranking_key="rrf", has_injection=True, has_admission=True, prior_certified=False, current_mass=1.0, discounted_mass=0.5, expansion_contribution=0.1, protected_slots=1, admitted_current=1, rerank_attempted=True, rerank_failed=False, ordering_applied=True, gated=True, degenerate=False, finalization_ms=10)


def test_each_rule_finds_its_breach_and_nothing_else(spark):
    changes = {
        0: {},
        1: {"outcome": None},
        2: {"outcome": "empty"},
        3: {"has_injection": False},
        4: {"has_admission": False},
        5: {"ranking_key": "composite"},
        6: {"discounted_mass": 1.0},
        7: {"current_mass": 0.0, "expansion_contribution": 0.0},
        8: {"current_mass": 0.0, "discounted_mass": 0.0},
        9: {"protected_slots": 2},
        10: {"degenerate": True},
        11: {"finalization_ms": 501},
        12: {}, 13: {}, 14: {}, 15: {}, 16: {}, 17: {"rerank_failed": True, "ordering_applied": False}, 18: {},
    }
    names = [f.split(" ")[0] for f in TRACE.split(", ")]
    traces = spark.createDataFrame([tuple({"trace_id": k, **FINE, **c}[n] for n in names) for k, c in changes.items()], TRACE)
    cand, comp, adm, paths, inj, order = [], [], [], [], [], []
    for k in changes:
        for n, p in enumerate("ab", 1):
            leg = "expansion-vec" if (k, p) == (17, "b") else "bm25"
            cand.append((k, f"v:{p}", p, leg, (k, p) != (12, "a"), leg == "bm25", False, (k, p) != (16, "b"), "general"))
            comp += [(k, p)] if (k, p) != (13, "b") else []
            adm += [(k, f"v:{p}")] if (k, p) != (14, "b") else []
            if k not in (2,):
                paths.append((k, n, p))
                inj.append((k, n, f"v:{p}", p))
            order.append((k, 3 - n if k == 15 else n, f"v:{p}", 0, 0.5 if k == 18 else 1.0 / n))
        if k == 18:
            order[-2:] = [(k, 1, "v:b", 0, 0.5), (k, 2, "v:a", 0, 0.5)]
    frames = [
        spark.createDataFrame(cand, "trace_id long, candidate string, path string, leg string, pooled boolean, current_supported boolean, gate_passed boolean, covered boolean, vault string"),
        spark.createDataFrame(comp, "trace_id long, path string"),
        spark.createDataFrame(adm, "trace_id long, candidate string"),
        spark.createDataFrame(paths, "trace_id long, n int, path string"),
        spark.createDataFrame(inj, "trace_id long, n int, candidate string, path string"),
        spark.createDataFrame(order, "trace_id long, n int, candidate string, band int, key double"),
    ]
    found: dict = {}
    for r in invariants.violations(traces, *frames).collect():
        found.setdefault(r.trace_id, set()).add((r.rule, r.subject, r.breach))
    assert found == {
        1: {("trace-complete", None, "no outcome")},
        2: {("trace-complete", None, "empty without a reason")},
        3: {("trace-complete", None, "no injection record"), ("single-ranking-key", None, "no injection record")},
        4: {("trace-complete", None, "no admission record")},
        5: {("single-ranking-key", None, "ordered by composite")},
        6: {("expansion-mass-cap", None, "discounted mass is not below")},
        7: {("expansion-mass-cap", None, "discounted mass without certificate")},
        8: {("expansion-mass-cap", None, "expansion without current mass")},
        9: {("expansion-mass-cap", None, "protected slots")},
        10: {("degeneracy-gate-honored", None, "degenerate scores applied")},
        11: {("finalization-fits-reserve", None, "over the reserve")},
        12: {("trace-complete", "a", "no pooled candidate")},
        13: {("trace-complete", "b", "no composite score")},
        14: {("admission-honored", "v:b", "not admitted")},
        15: {("single-ranking-key", "v:b", "not in the final order")},
        16: {("rerank-coverage-or-fallback", "b", "not covered")},
        17: {("no-expansion-leak-on-failed-rerank", "b", "not arbitrated")},
        18: {("metadata-band-only", "v:a", "tie out of order"), ("single-ranking-key", "v:b", "not in the final order")},
    }


def test_mirrors_end_alike_in_any_order(spark):
    mirrors = spark.createDataFrame([(1, 10, "pending", None, 1), (2, 11, "provisional", 2, 1), (3, None, "pending", None, 1), (4, 12, "attributed", 1, 1), (5, 13, "pending", None, 1), (6, 99, "pending", None, 1)], "usage_id long, source_id long, state string, source_revision long, revision long")
    references = spark.createDataFrame([(10, "w", "b"), (10, "w", "a"), (10, "x", "z"), (11, "w", "q")], "source_id long, vault string, path string")
    stages = [[(10, "provisional", 1), (11, "provisional", 2), (13, "pending", 1)], [(10, "attributed", 2), (11, "attributed", 3), (12, "unattributable", 5), (13, "unattributable", 2)]]
    ends = []
    for order in ([0, 1], [1, 0], [1], [0, 0, 1, 1, 0]):
        m = mirrors
        for i in order:
            source = spark.createDataFrame(stages[i], "source_id long, state string, revision long")
            m = spark.createDataFrame(verdicts.mirrored(m, verdicts.mirror(m, source, references, "w")).collect(), mirrors.schema)
        ends.append({r.usage_id: (r.state, r.source_revision) for r in m.collect()})
    assert all(e == ends[0] for e in ends)
    assert ends[0] == {1: ("attributed", 2), 2: ("attributed", 3), 3: ("unattributable", None), 4: ("attributed", 1), 5: ("unattributable", 2), 6: ("pending", None)}
    first = {r.usage_id: (r.state, r.reason, r.revision, list(r.paths)) for r in verdicts.mirror(mirrors, spark.createDataFrame(stages[1], "source_id long, state string, revision long"), references, "w").collect()}
    assert first == {1: ("attributed", None, 2, ["a", "b"]), 2: ("attributed", None, 2, ["q"]), 3: ("unattributable", "no-source", 2, []), 5: ("unattributable", "source-unattributable", 2, [])}


def test_token_chunks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeéü日") for _ in range(r.randrange(1, 9)))
    prose = lambda n: "".join(word() + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "! "]) for _ in range(n))
    texts = [None, "", "short", prose(30), prose(900), "x" * 4000, "word " * 1500, prose(400) + "y" * 3000]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by: dict = {}
    for c in token_chunks.chunks(df, "id", "text", path, 200, 30).orderBy("id", "seq").collect():
        by.setdefault(c.id, []).append(c)
    for i, text in enumerate(t or "" for t in texts):
        offsets = [s for s, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
        mine, whole = by[i], ""
        for n, c in enumerate(mine):
            assert c.seq == n and text[c.pos : c.pos + len(c.chunk)] == c.chunk and len(text[: c.pos].encode()) == c.byte_pos
            assert c.tokens == sum(c.pos <= o < c.pos + len(c.chunk) for o in offsets) and c.tokens <= 200
            assert c.pos <= len(whole)
            whole = whole[: c.pos] + c.chunk
        assert whole == text and (len(mine) == 1) == (len(offsets) <= 200)


def test_token_starts_are_the_library_s():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(2)
    piece = lambda: r.choice(["und", "Straße", "日本", "😀👍🏽", "é", "x" * 40, "1.5", "l'été", "<|endoftext|>", "a<|endoftext|>b", "don't", "“q”", "\u00a0", "\u3000", "\x0b", "", "_", "#!", "\u0301"]) + r.choice([" ", "  ", "\n", "\r\n", "\t", "", " \n "])
    texts = [None, "", " ", "\n\n", *("".join(piece() for _ in range(r.randrange(80))) for _ in range(200))]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = [[s for s, _ in tokenizer.encode(t or "", add_special_tokens=False).offsets] for t in texts]
    starts = token_chunks.token_starts(path)
    assert token_chunks._byte_level(path) and list(starts(pa.array(texts))) == want and list(starts(pa.array(texts, pa.large_string()).slice(3, 50))) == want[3:53]
    other = public_tokenizers.path("word_bpe_49k.json")  # not byte-level: the library's own offsets
    tokenizer = Tokenizer.from_file(other)
    assert not token_chunks._byte_level(other) and list(token_chunks.token_starts(other)(pa.array(texts))) == [[s for s, _ in tokenizer.encode(t or "", add_special_tokens=False).offsets] for t in texts]
