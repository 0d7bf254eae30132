"""Searches over texts without an index: nothing but results leaves a task, whatever the queries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vaultframe.operators import fts, fusion, posting_store


def _vault(spark):
    rng = random.Random(3)
    words = [a + b + c for a in ("th", "re", "on", "É") for b in ("a", "on", "e") for c in ("", "n", "ter", "9")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "_x"]) for _ in range(n))
    rows = [(i, f"en {i} md", text(4), text(rng.randrange(60))) for i in range(150)] + [(200, "", "", ""), (201, None, None, None), (202, "a", "tha", None)]
    docs = spark.createDataFrame(rows, "id long, path string, title string, body string")
    asks = [(i, " ".join(rng.sample(words, rng.randrange(1, 5)))) for i in range(60)] + [(100, "TH"), (101, "th re on"), (102, "zzqqx tha"), (103, "!"), (104, None), (105, "en md"), (106, "tha tha")]
    return docs, spark.createDataFrame(asks, "qid int, query string")


@pytest.mark.parametrize("limits", [{}, {"BLOCK_WORDS": 20, "HELD": 10}, {"SENT_IDS": 5, "FEW_WORDS": 0}])
@pytest.mark.parametrize("top", [3, None])
def test_search_in_tasks_equals_ranks_over_postings(spark, monkeypatch, limits, top):
    docs, asks = _vault(spark)
    ok = docs.where("id % 7 <> 3").select("id")
    shape = lambda df: sorted((r.qid, r.id, round(r.bm25, 8), round(r.score, 8), r["rank"]) for r in df.collect())
    want = shape(fts.bm25(fts.postings(docs), asks, top, ok))
    for k, v in limits.items():
        monkeypatch.setattr(fts, k, v)
    found = fts.search(docs, asks, top, ok)
    assert shape(found) == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # before, each query word's postings were grouped by query, word and document
    assert "Generate" not in plan and "Aggregate" not in plan


def test_few_words_send_only_what_starts_with_them_to_python(spark, monkeypatch):
    docs, _ = _vault(spark)
    asks = spark.createDataFrame([(1, "th re"), (2, "tha"), (3, "É9"), (4, "thater 9")], "qid int, query string")
    real, seen = fts._kept, []
    monkeypatch.setattr(fts, "_kept", lambda cut, known: seen.append(cut) or real(cut, known))
    shape = lambda df: sorted((r.qid, r.id, round(r.bm25, 8), r["rank"]) for r in df.collect())
    assert shape(fts.search(docs, asks, 5)) == shape(fts.bm25(fts.postings(docs), asks, 5)) != []
    rows = {r.id: r for r in seen[0].collect()}
    terms = {t for r in rows.values() for f in fts.WEIGHTS for t in (r[f] or "").split()}
    assert terms and all(t.startswith(("th", "re", "é9", "9")) for t in terms)  # whole texts were sent
    assert {i: r.n for i, r in rows.items() if r.n} == {r.id: r.dl for r in fts.lengths(fts.postings(docs)).collect()}
    assert fts.search(docs, asks.where("qid < 0"), 5).count() == 0


def test_diversity_sends_ranked_rows_to_the_texts(spark):
    from vaultframe.plans import catalogue

    found = catalogue.QUERIES["mmr_diversity"](spark, "/root/testdata/sf0.001")
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()  # all texts were shuffled to meet a few rows
    assert sorted(found.groupBy("qid").count().collect()) == sorted(catalogue._scored(spark, "/root/testdata/sf0.001").groupBy("qid").count().collect())


@pytest.mark.parametrize("part", [1 << 24, 500])
def test_an_index_counts_words_where_texts_are_read(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(posting_store, "PART_BYTES", part)
    docs, asks = _vault(spark)
    plan = posting_store.counted(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # before, every word of every text was grouped by a shuffle
    state = posting_store.apply(spark, f"file://{tmp_path}/index", posting_store.empty(), docs, None)
    kept = posting_store.postings(spark, state)
    rows = lambda df: sorted((r.term, r.id, r.wtf) for r in df.collect())
    assert rows(kept) == rows(fts.postings(docs)) and state["segments"][0]["rows"] == kept.count()
    assert sorted(map(tuple, posting_store.lengths(spark, state).collect())) == sorted(map(tuple, fts.lengths(fts.postings(docs)).collect()))
    # a segment of an earlier version holds rows
    old = {k: v for k, v in state["segments"][0].items() if k != "blocks"} | {"path": f"file://{tmp_path}/old"}
    kept.write.parquet(f"{old['path']}/postings")
    shape = lambda df: sorted((r.qid, r.id, round(r.bm25, 8), r["rank"]) for r in df.collect())
    want = shape(fts.bm25(fts.postings(docs), asks, 5))
    assert shape(posting_store.search(spark, state, asks, 5)) == shape(posting_store.search(spark, state | {"segments": [old]}, asks, 5)) == want


def test_a_pool_keeps_the_best_score_of_each_document(spark):
    lanes = spark.createDataFrame([(1, "current", 1.0, True, 5, 1, 0.2), (1, "prior", 0.5, False, 5, 1, 0.9), (1, "prior", 0.5, False, 6, 2, 0.4)], "qid int, lane string, weight double, is_current boolean, id long, rank int, score double")
    pool = fusion.select_pool(lanes, 5)
    assert {(r.id, r.score) for r in pool.collect()} == {(5, 0.9), (6, 0.4)}
    assert "Join" not in pool._jdf.queryExecution().optimizedPlan().toString()  # lanes were made twice and joined
    assert "score" not in fusion.select_pool(lanes.drop("score"), 5).columns
    assert fusion.select_pool(lanes.where(F.lit(False)), 5).count() == 0


@pytest.mark.parametrize("limits", [{}, {"BUCKETS": 64, "FULLEST": 3, "HELD": 20}])
def test_themes_count_phrases_of_full_buckets_alone(spark, monkeypatch, limits):
    from collections import Counter

    from vaultframe.operators import stats

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "of", "épsilon", "x1y2"]) + rng.choice(["", ",", "_"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "solo"]
    n = Counter()
    for t in texts:
        w = [x for x in (t or "").lower().replace(",", " ").replace("_", " ").split() if len(x) > 3]
        n.update(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    want = sorted(((p, c) for p, c in n.items() if c >= 3), key=lambda x: (-x[1], -len(x[0]), x[0]))
    for k, v in limits.items():
        monkeypatch.setattr(stats, k, v)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for top in (20, 1000):
        found = stats.phrase_themes(df, "text", top=top)
        assert [(r.phrase, r.n) for r in found.collect()] == want[:top]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # all phrases of all texts were grouped


def test_names_of_facts_look_at_the_front_of_texts_alone(spark, tmp_path):
    from vaultframe.plans import catalogue_store

    texts = ["One two three", "  ¿Uno—dos", "solo", "solo 12 !", "", None, "a\nB c", "Él l'a x", "x" * 5000 + "  y z"]
    rows = [(i, t, "en") for i, t in enumerate(texts * 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    import re

    want = {}
    for i, t, _ in rows:
        w = re.findall("[A-Za-z]+", t or "")
        for name in ([w[0 if i % 2 == 0 else 1]] + ([f"{w[0]} {w[1]}"] if i % 3 == 0 else [])) if len(w) > 1 else []:
            key = f"default:{'tool' if i % 5 == 0 else 'concept'}:{name.lower().replace(' ', '_')}"
            want[key] = (min(name, want[key][0]), min(i, want[key][1])) if key in want else (name, i)
    found = catalogue_store.named_nodes(spark, str(tmp_path))
    assert {r.entity_id: (r.name, r.first_doc) for r in found.collect()} == want
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()  # all words of all texts were cut


def test_lines_of_traces_are_grouped_once(spark, tmp_path):
    from datetime import datetime

    from vaultframe.plans import catalogue_store

    spark.createDataFrame([(k,) for k in range(1, 40)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, k * n, k + n, n, datetime(2024, 1, 1)) for k in range(1, 40) for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue_store.trace_violations(spark, str(tmp_path))
    assert found.count() > 50
    assert "lineitem.parquet" not in "".join(found.inputFiles())  # each rule read and grouped the lines anew


def test_texts_are_cut_once_whatever_the_words(spark, monkeypatch):
    docs, asks = _vault(spark)
    monkeypatch.setattr(fts, "FEW_WORDS", 1)
    found = fts.search(docs, asks, 5)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()  # a second pass cut them again
    shape = lambda df: sorted((r.qid, r.id, round(r.bm25, 8), r["rank"]) for r in df.collect())
    assert shape(found) == shape(fts.bm25(fts.postings(docs), asks, 5)) != []


@pytest.mark.parametrize("top", [1, 3, None])
def test_queries_of_one_word_keep_the_best_of_each(top):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    rng, rows = random.Random(3), []
    tops = fts._Tops(4, top)
    for _ in range(6):
        part = [(rng.randrange(4), -rng.choice([0.5e-9, 1.5e-9, 2.49e-9, 2.51e-9, 0.1234567885, 7.0]), rng.randrange(10**6)) for _ in range(20)]
        rows += part
        w, s, i = map(np.array, zip(*part, strict=True))
        tops.add(w, s, i)
        tops.cut()
    place = lambda s: Decimal(repr(s)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
    want = [(w, i, s) for word in range(4) for _, i, s, w in sorted((place(s), i, s, w) for w, s, i in rows if w == word)[:top]]
    word, ids, score = tops.take()
    assert list(zip(word.tolist(), ids.tolist(), score.tolist(), strict=True)) == want and tops.held == 0
