"""Columns with hand-computed expectations."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from vaultframe.functions import scoring, temporal, text
from vaultframe.operators import evaluation, fusion, graph, lifecycle, stats


def NOW():  # noqa: N802
    return F.lit("2026-03-01 12:00:00").cast("timestamp_ntz")


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(columns) == 1 else tuple(r)


def test_reciprocal_ranks(spark):
    lists = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "b", 1, 1.0), (1, "c", 2, 1.0), (1, "z", 1, 0.0)], "qid int, id string, rank int, weight double")
    got = {r.id: r.fused for r in fusion.reciprocal_ranks(lists).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 0.05, "b": 1 / 62 + 0.02 + 1 / 61 + 0.05, "c": 1 / 62 + 0.02})


def test_bm25_transform_and_cosine(spark):
    assert one(spark, scoring.bm25_to_score(F.lit(-5.67))) == pytest.approx(5.67 / 6.67)
    assert one(spark, scoring.bm25_to_score(F.lit(0.0)), scoring.bm25_to_score(F.lit(3.0))) == (0.0, 0.0)
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, scoring.cosine(a, b)) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, scoring.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert one(spark, scoring.clamp_weight(F.lit(1.7)), scoring.clamp_weight(F.lit(None).cast("double"))) == (1.0, 0.0)


def test_recency(spark):
    at = lambda days: NOW() - F.make_dt_interval(days=F.lit(days))
    assert one(spark, scoring.recency(at(60), F.lit("note"), NOW())) == pytest.approx(0.5)
    assert one(spark, scoring.recency(at(0), F.lit("note"), NOW()), scoring.recency(at(-5), F.lit("note"), NOW()), scoring.recency(at(900), F.lit("hub"), NOW())) == (1.0, 1.0, 1.0)
    slow = one(spark, scoring.half_life(F.lit("note"), F.lit(10_000_000), at(0), NOW()))
    assert slow == 180.0


def test_composite_identity(spark):
    rows = [(i, 0.1 * i, dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 1), t, i, dt.datetime(2026, 2, 3), 0.5 + 0.1 * (i % 3), i % 2 == 0, 200 * i, i, i + 1, 0.4) for i, t in enumerate(["note", "hub", "decision", "progress"])]
    df = spark.createDataFrame(rows, "id int, score double, effective_at timestamp_ntz, modified_at timestamp_ntz, content_type string, access_count int, last_accessed_at timestamp_ntz, confidence double, pinned boolean, body_length int, revision_count int, duplicate_count int, quality_score double")
    for r in scoring.composite(df, NOW()).collect():
        assert r.weighted * r.quality_factor * r.length_factor * r.frequency_factor + r.pin_boost == pytest.approx(r.composite)
        assert r.length_factor >= 0.3 and r.frequency_factor <= 1.1


def test_text_functions(spark):
    assert one(spark, text.shingles(F.lit("The quick, Quick fox!"))) == ["the quick", "quick quick", "quick fox", "quick"]
    assert one(spark, text.trigrams(F.lit("A-b c!"))) == ["a b", " b ", "b c"]
    assert one(spark, text.trigrams(F.lit("ab"))) == ["ab"] and one(spark, text.trigrams(F.lit("!!"))) == []
    assert one(spark, text.anchors(F.lit("The Spark engine and DuckDB, not SQLite"))) == ["spark", "duckdb", "sqlite"]
    assert one(spark, text.similarity_ratio(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, text.slug(F.lit(" Hello, World! "))) == "hello-world"
    assert one(spark, text.content_type(F.lit("docs/adr/0001.md"))) == "decision"
    assert one(spark, text.memory_type(F.lit("a.md"), F.lit("note"), F.lit("How to deploy"))) == "procedural"
    assert one(spark, text.escape_csv(F.lit('a"b,c'))) == '"a""b,c"' and one(spark, text.escape_xml(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(spark, text.line_slice(F.lit("a\nb\nc"), 2, 2)) == "b\nc"
    assert one(spark, text.add_line_numbers(F.lit("a\nb"), 5)) == "5: a\n6: b"
    assert one(spark, text.snippet(F.lit("x\ny\nfind me\nz\nw"), ["find"])) == "y\nfind me\nz\nw"
    assert one(spark, text.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, text.quality_score(F.lit("x" * 20))) == 0.2


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("src/{a,b}/?.ts", "src/b/x.ts", True), ("src/{a,b}/?.ts", "src/c/x.ts", False)])
def test_globs(spark, glob, path, fits):
    assert one(spark, F.lit(path).rlike(text.glob_pattern(glob))) is fits


def test_time_functions(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, temporal.proximity(t("2024-01-16 00:00:00"), t("2024-01-01 00:00:00"), t("2024-01-31 00:00:00"))) == 1.0
    assert one(spark, temporal.quiet_hours(t("2024-01-01 23:00:00"), 22, 6), temporal.quiet_hours(t("2024-01-01 12:00:00"), 22, 6), temporal.quiet_hours(t("2024-01-01 12:00:00"), 5, 5)) == (True, False, False)
    assert one(spark, temporal.trend(F.lit(3), F.lit(90), F.lit(9))) == "NEW"
    assert one(spark, temporal.trend(F.lit(30), F.lit(5), F.lit(4))) == "STRENGTHENING"
    assert one(spark, temporal.strict_timestamp(F.lit("2024-02-30T00:00:00Z"))) is None
    assert one(spark, temporal.strict_timestamp(F.lit("yesterday"))) is None


def test_blend_falls_back(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 1e-9), (1, 2, 0.25, None), (2, 1, 0.5, 0.8), (2, 2, 0.25, None)], "qid int, id int, fused double, rerank double")
    got = {(r.qid, r.id): r.blended for r in fusion.blend_rerank(df).collect()}
    assert got == pytest.approx({(1, 1): 1.0, (1, 2): 0.5, (2, 1): 0.1 + 0.72, (2, 2): 0.05})


def test_lanes(spark):
    lanes = spark.createDataFrame([(1, "vec", 1.0, True, i, i) for i in range(1, 4)] + [(1, "prior", 0.5, False, i, i) for i in range(1, 30)], "qid int, lane string, weight double, is_current boolean, id int, rank int")
    pool = fusion.select_pool(lanes, 5).collect()
    assert len(pool) == 10 and {r.id for r in pool} >= {1, 2, 3}
    assert all(r.mass < 2 * r.current_mass for r in pool if r.band == 0)


def test_evaluation(spark):
    ranked = spark.createDataFrame([("hit", 1, 1), ("miss", 9, 1)], "qid string, id int, rank int")
    gold = spark.createDataFrame([("hit", 1), ("hit", 2), ("miss", 3)], "qid string, id int")
    m = {r.qid: r for r in evaluation.document_metrics(ranked, gold).collect()}
    assert (m["hit"].precision, m["hit"].recall, m["hit"].jaccard, m["hit"].mrr) == (1.0, 0.5, 0.5, 1.0)
    assert (m["miss"].precision, m["miss"].recall, m["miss"].jaccard, m["miss"].mrr) == (0.0, 0.0, 0.0, 0.0)
    runs = spark.createDataFrame([("a", "p", 1.0, 0.1), ("b", "p", 2.0, 0.2), ("a", "q", 1.0, -0.1), ("b", "q", 2.0, 0.2), ("a", "r", 1.0, 1.0)], "run string, metric string, value double, delta double")
    assert {r.metric: (r.mean, r.stable) for r in evaluation.replicated(runs).collect()} == {"p": (1.5, True), "q": (1.5, False)}


def test_recall_stats(spark):
    at = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, "aabb", 0.8, at, True), (1, "ccdd", 0.6, at, False), (1, "aabb", 0.7, at, False)], "doc_id int, query_hash string, search_score double, surfaced_at timestamp_ntz, was_referenced boolean")
    r = stats.recall_stats(e).first()
    assert (r.recall_count, r.unique_queries, r.negatives, r.max_score, r.spacing) == (3, 2, 2, 0.8, 0.2) and r.total_score == pytest.approx(2.1)


def test_graph_edges(spark):
    r = spark.createDataFrame([(1, 2, "causal", 0.4), (1, 2, "causal", 0.9), (3, 3, "causal", 1.0)], "source_id int, target_id int, relation_type string, weight double")
    assert [tuple(x) for x in graph.upsert(r.limit(1), r).collect()] == [(1, 2, "causal", 0.9)]


def test_retries(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    got = [one(spark, lifecycle.next_retry(at, F.lit(k))) - dt.datetime(2024, 1, 1) for k in (1, 3, 5, 9)]
    assert [g.total_seconds() / 60 for g in got] == [1, 30, 720, 720]
