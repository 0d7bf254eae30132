"""Sets that are alike are found in blocks: neither sets nor pairs are shuffled, and none is lost."""

from __future__ import annotations

import random

import pytest

from vaultframe.operators import alike
from vaultframe.plans import catalogue, catalogue_extra, catalogue_more  # noqa: F401

SF = "/root/testdata/sf0.001"


def jaccard(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.4, 0.8])
@pytest.mark.parametrize("grams", [700, 6_000_000])
def test_all_pairs_whatever_the_blocks(spark, monkeypatch, threshold, grams):
    monkeypatch.setattr(alike, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(alike, "STEP", grams // 10)
    rng = random.Random(5)
    base = [[f"w{min(int(rng.paretovariate(0.5)), 400)}" for _ in range(40)] for _ in range(12)]
    rows = [(i, f"c{i % 3}", sorted({w if rng.random() > share else f"w{rng.randrange(400)}" for w in rng.choice(base)})) for i, share in enumerate(rng.choice([0.0, 0.1, 0.3, 0.5]) for _ in range(120))]
    rows += [(200, "c0", ["x"]), (201, "c0", ["x"]), (202, "c1", ["x", "y"]), (203, "c1", []), (204, "c1", None), (205, None, ["x"]), (206, None, ["x"])]
    df = spark.createDataFrame(rows, "id long, c string, grams array<string>")
    for group in (None, "c"):
        want = {(i, j): round(s, 9) for i, c, x in rows for j, d, y in rows if i < j and (group is None or c == d and c) and (s := jaccard(x, y)) >= threshold}
        found = alike.alike(df, threshold, group).collect()
        assert len(found) == len(want) > 10 and {(r.a, r.b): round(r.similarity, 9) for r in found} == want


def test_ids_are_of_any_type_and_no_rows_give_none(spark):
    df = spark.createDataFrame([("p10", ["a", "b"]), ("p9", ["b", "a"]), ("é", ["a", "b"])], "id string, grams array<string>")
    assert sorted((r.a, r.b) for r in alike.alike(df).collect()) == [("p10", "p9"), ("p10", "é"), ("p9", "é")]
    assert alike.alike(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["similar_observation", "duplicate_consolidation", "shingle_jaccard_neardup"])
def test_only_pairs_leave_the_tasks(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    assert not any("documents.parquet" in f for f in found.inputFiles()) and found.count() > 0  # all grams, then all pairs with grams, were shuffled


def test_patterns_are_gated_where_texts_are(spark, monkeypatch):
    import collections
    import re

    from vaultframe.operators import consolidation

    monkeypatch.setattr(consolidation, "BLOCK_CHARS", 900)
    monkeypatch.setattr(consolidation, "ROW_PAIRS", 2)
    rng = random.Random(7)
    words = [f"word{i}" for i in range(40)] + ["Alpha", "Berlin", "Cedar"]
    base = [[rng.choice(words) for _ in range(12)] for _ in range(4)]
    texts = [(f"{'po'[i % 2]}{i}", f"c{i % 4 // 2}", " ".join(rng.choice(words) if rng.random() < 0.06 else w for w in base[rng.randrange(4)])) for i in range(60)] + [("p98", "c0", "éééé"), ("p99", "c0", "éééé"), ("p97", None, "same text here"), ("p96", None, "same text here")]
    found = consolidation.gated_pairs(spark.createDataFrame(texts, "id string, collection string, text string"), wanted="a like 'p%' or b like 'p%'")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # trigrams of texts went along with every pair

    def grams(t):
        s = re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", t.lower())).strip()
        return collections.Counter(s[k : k + 3] for k in range(max(len(s) - 2, 1))) if s else {}

    def cosine(x, y):
        x, y = grams(x), grams(y)
        norm = sum(n * n for n in x.values()) ** 0.5 * sum(n * n for n in y.values()) ** 0.5
        return sum(n * y.get(g, 0) for g, n in x.items()) / norm if norm else 0.0

    long = lambda t: [w for w in t.lower().split() if len(w) > 3]
    want = {(i, j): cosine(x, y) for i, c, x in texts for j, d, y in texts if i < j and c == d and c and "p" in i + j and jaccard(long(x), long(y)) > 0.5}
    got = found.collect()
    assert {(r.a, r.b): round(r.score, 9) for r in got} == {p: round(s, 9) for p, s in want.items()} and len(got) == len(want) > 50 and any(r.accepted for r in got)
