"""What a search finds is few: it is made once and sent to the documents, which are not shuffled to meet it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vaultframe.plans import catalogue, catalogue_depth, catalogue_extra, catalogue_more, catalogue_store, hybrid  # noqa: F401
from vaultframe.sources import adapter

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rank_explain", "raw_primary_rank"])
def test_scores_are_made_of_found_rows(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    assert "MapInArrow" not in _plan(found) and found.count() > 20  # of unknown size, so that all documents and labels were shuffled


def test_metadata_of_some_documents(spark):
    meta = adapter.metadata(spark, SF)
    ids = spark.createDataFrame([(i,) for i in (3, 3, 40, 41, 199, 10**9)], "id long")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(adapter.metadata(spark, SF, ids)) == rows(meta.where(F.col("id").isin(3, 40, 41, 199))) != []


def test_edges_of_some_nodes_are_those_of_all(spark):
    from vaultframe.operators import graph

    rel, ok = adapter.relations(spark, SF), hybrid.eligible(adapter.metadata(spark, SF))
    starts = spark.createDataFrame([(i,) for i in (2, 2, 19, 57, 120)], "node long")
    rows = lambda df: sorted((r.node, r.next, r.weight, r.share) for r in df.collect())
    for kind in ("entity", "semantic"):
        few = graph.typed_edges(rel, kind, ok, 3, nodes=starts)
        assert rows(few) == rows(graph.typed_edges(rel, kind, ok, 3).where(F.col("node").isin(2, 19, 57, 120))) != []
        assert "Generate" not in _plan(few)  # the edges of all nodes were shuffled and ranked


def test_hybrid_makes_its_lists_once(spark):
    assert "MapInArrow" not in _plan(catalogue.QUERIES["hybrid_with_temporal_entity"](spark, SF))


def test_proximity_reads_what_was_found_once(spark):
    found = catalogue.QUERIES["proximity_rerank"](spark, SF)
    assert "MapInArrow" not in _plan(found) and found.count() > 20  # the search was in the plan for each of its uses


def test_a_provider_gets_texts_that_few_rows_met(spark):
    found = catalogue.QUERIES["rerank_provider"](spark, SF)
    assert not any("documents.parquet" in f for f in found.inputFiles()) and found.count() > 20  # the openings of all texts were shuffled


def test_a_budget_is_of_found_rows(spark):
    found = catalogue.QUERIES["context_budget"](spark, SF)
    assert "MapInArrow" not in _plan(found) and found.count() > 4  # of unknown size, so that all documents were shuffled


def test_hybrid_lists_are_filled_after_the_filters(spark, monkeypatch):
    import numpy as np

    taken = []
    fuse = hybrid.fuse
    monkeypatch.setattr(hybrid, "fuse", lambda lists, top=30: taken.extend(lists) or fuse(lists, top))
    assert catalogue.QUERIES["hybrid_with_temporal_entity"](spark, SF).count() > 0
    _, (vector, _), _, (via, _) = taken
    ok = {r.id for r in hybrid.eligible(adapter.metadata(spark, SF)).select("id").collect()}
    v = {r.id: np.array(r.embedding) for r in catalogue.embedded(spark, SF).collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in v.items()}
    want = {q: [i for _, i in sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in ok & v.keys() if i != q)][:20] for q in range(1, 6)}
    got = {q: [r.id for r in vector.where(f"qid = {q}").orderBy("rank").collect()] for q in range(1, 6)}
    assert got == want  # the 20 were taken of all vectors, and those not in use dropped after
    for rows in (via.where(f"qid = {q}").collect() for q in range(1, 6)):
        assert sorted(r["rank"] for r in rows) == list(range(1, len({r.id for r in rows}) + 1))  # one that two nodes lead to took two places


def test_vectors_without_a_direction_take_no_place(spark):
    from vaultframe.operators import vectors

    odd = [[float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0], None]
    rows = [(i, [1.0, i / 10]) for i in range(6)] + [(100 + i, e) for i, e in enumerate(odd)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = [(r.qid, r.id) for r in vectors.nearest(v, v.where("id in (0, 100)"), 3).orderBy("qid", "rank").collect()]
    assert found == [(0, 1), (0, 2), (0, 3)]  # each took a place among the three or failed


def test_a_line_is_made_once_for_all_its_prompts(spark):
    found = catalogue.QUERIES["surfacing"](spark, SF)
    assert any("/ranked-" in f for f in found.inputFiles())  # each prompt's line went through the guard
    rows = found.collect()
    assert len({(r.id, r.tier) for r in rows}) < len(rows) and len({(r.id, r.tier, r.line) for r in rows}) == len({(r.id, r.tier) for r in rows})
