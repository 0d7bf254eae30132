"""Nearest neighbours, whitening and conversation repair against brute-force versions."""

import functools
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultframe.llm import dialogue, neighbours, whitening
from vaultframe.llm.queries import queries

VECTORS = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


# nearest neighbours


def plain_nearest(rows, asked, k):
    """(query, rank, id, distance) by comparing everything with everything."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and usable(v) and any(x != 0 for x in v)]
    asked = [(i, v) for i, v in good if i in asked]
    dims = max((len(v) for _, v in good), default=0)
    full = lambda v: np.concatenate([v, np.zeros(dims - len(v))])
    out = []
    for q in sorted({i for i, _ in asked}):
        best = {}
        for v in (v for i, v in asked if i == q):
            for i, w in good:
                if i != q:
                    d = float(np.sqrt(np.cumsum((full(v) - full(w)) ** 2)[-1]))
                    best[i] = min(best.get(i, np.inf), d)
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1)]
    return out


def awkward_vectors(dims, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dims).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, (np.array(rows[3][1]) * (1 + 1e-6 * i)).astype(np.float32).tolist()) for i in range(60)]  # nearer than int8 can tell
    rows += [(2000 + i, rows[5][1]) for i in range(40)]  # copies
    rows += [(3000, None), (3001, [0.0] * dims), (3002, [1.0, None]), (3003, [float("nan")] * dims), (3004, []), (3005, [float("inf")]), (None, rows[0][1]), (20, rows[5][1]), (40, rows[7][1]), (3007, [0.5])]
    rows += [(3008, [1e30] * dims), (3009, [1e-30] * dims)]
    return rows


@pytest.mark.parametrize("dims, shard", [(3, 1 << 19), (64, 1 << 19), (64, 2000)])
def test_nearest(spark, monkeypatch, dims, shard):
    monkeypatch.setattr(neighbours, "SHARD_COMPONENTS", shard)
    monkeypatch.setattr(neighbours, "BLOCK_COMPONENTS", shard)
    rows = awkward_vectors(dims)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    found = neighbours.nearest(df, "vec_id", "embedding", df.where("vec_id % 20 = 0"), k=7)
    want = plain_nearest(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 7)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [3.0], 0)], VECTORS)
    assert [tuple(r) for r in neighbours.nearest(df, "vec_id", "embedding", df.where("vec_id = 0"), k=7).collect()] == [(0, 1, 1, 2.0)]
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding", df.limit(0)).count() == 0
    assert neighbours.nearest(df, "vec_id", "embedding", df.limit(0)).count() == 0


def test_tiles_rule_out_most_pairs_and_keep_the_nearest():
    r = np.random.default_rng(4)
    v, q = r.normal(size=(4000, 64)).astype(np.float32), r.normal(size=(50, 64)).astype(np.float32)
    flat = lambda x: (x.reshape(-1), np.full(len(x), 64))
    block = neighbours.Asking(np.arange(10_000, 10_050), *flat(q), 10)
    for s in range(0, 4000, 1000):
        block.meet(np.arange(s, s + 1000), *flat(v[s : s + 1000]))
    assert block.again < 0.05 * block.pairs
    d = np.sqrt(((q[:, None].astype(float) - v[None]) ** 2).sum(axis=2))
    recall = np.mean([len({c for _, c in best} & set(np.argsort(row, kind="stable")[:10].tolist())) / 10 for best, row in zip(block.best, d, strict=True)])
    assert recall == 1.0


# whitening


def plain_whitening(x, k):
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], x.shape[1]))
    e, u = e[::-1], u[:, ::-1]
    return n, (x - mean) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), [int(((n * row.astype(object) - fit.sum(axis=0).astype(object)) ** 2).sum()) for row in x]


@pytest.mark.parametrize("dims", [3, 20, 64])
def test_whitening(spark, dims):
    r = np.random.default_rng(dims)
    v = (r.normal(size=(400, dims)) * (1 + np.arange(dims) / dims)).astype(np.float32)
    v[50:90] = v[0]  # copies count once in the fit
    rows = [(i, row.tolist(), 0) for i, row in enumerate(v)] + [(900, None, 0), (901, [float("nan")] * dims, 0), (902, [None] * dims, 0), (903, [float("-inf")] * dims, 0)]
    k = min(4, dims)
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), "vec_id", "embedding").orderBy("id", "component").collect()
    n, white, share, deviation = plain_whitening(np.floor(256 * v.astype(float)).astype(np.int64), k)
    assert [(r.id, r.component, r.n, r.deviation) for r in found] == [(i, c + 1, n, deviation[i]) for i in range(400) for c in range(k)]
    got = np.array([r.whitened for r in found]).reshape(400, k)
    got *= np.sign((got * white).sum(axis=0))
    assert np.abs(got - white).max() < 1e-8
    assert np.allclose([r.explained for r in found[:k]], share, rtol=1e-10)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10 and max(r.residual for r in found) < 1e-8 * 256**2


def test_whitening_of_close_eigenvalues_and_large_means():
    r = np.random.default_rng(9)
    x = np.rint(r.normal(size=(3000, 64)) * 300).astype(np.int64) + 10**9

    class Dense(whitening.Covariance):
        def __init__(self):
            self.n, self.dims, self.passes = len(x), 64, 0
            self.whole, self.part = whitening.means(self.n, [int(s) for s in x.sum(axis=0)])

        def times(self, block, with_trace=False):
            self.passes += 1
            y = whitening.centred(x, self.whole, self.part)
            out = y.T @ (y @ block)
            return (np.concatenate([out, (y * y).sum(axis=0)[:, None]], axis=1) if with_trace else out) / self.n

    v = Dense()
    values, vectors, trace, residuals = whitening.lobpcg(v, 4)
    e, u = np.linalg.eigh(np.cov((x - 10**9).T.astype(float), bias=True))
    assert np.allclose(values, e[::-1][:4], rtol=1e-12) and np.isclose(trace, e.sum(), rtol=1e-12)
    assert np.abs(np.abs((vectors * u[:, ::-1][:, :4]).sum(axis=0)) - 1).max() < 1e-12
    assert residuals.max() <= 1e-10 * values[0] and v.passes < 40


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], VECTORS)
    found = whitening.whiten(one, "vec_id", "embedding").collect()
    assert len(found) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in found} == {(1, 0, None, 0.0)}
    assert whitening.whiten(one.limit(0), "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0)], VECTORS), "vec_id", "embedding").count() == 0
    ragged = spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 3.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 0)], VECTORS)
    found = whitening.whiten(ragged, "vec_id", "embedding", components=2).where("component = 1").collect()
    assert {r.n for r in found} == {3} and len(found) == 4
    huge = spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [5.0, -7.0], 0)], VECTORS)
    assert whitening.whiten(huge, "vec_id", "embedding").count() == 6


# conversation repair

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(turns):
    """Report of one conversation: turns(turn, role, text) in order; least cost and letters by recursion from the end."""
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    given = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, g, added):
        found = []
        if i == len(turns):
            if g in ("", "a"):
                found.append((0, ""))
        else:
            role, fault = turns[i][1], faults[i]
            extra = 5 if fault == "truncated" else 0
            steps = [(2, "D", g)]
            if fault not in ("blank", "duplicate"):
                if (g, role[:1]) in follow:
                    steps.append((extra, "K", follow[g, role[:1]]))
                steps.append((1 + extra, "R", given[g]))
            for price, letter, to in steps:
                cost, rest = best(i + 1, to, 0)
                found.append((price + cost, letter + rest))
        if added < 3:
            cost, rest = best(i, given[g], added + 1)
            found.append((5 + cost, "I" + rest))
        return min(found, default=(10**9, ""))

    for i in range(len(turns), -1, -1):  # fills the cache from the end, so that recursion stays flat
        for g in ("", "s", "u", "a"):
            best(i, g, 0)
    cost, audit = best(0, "", 0)
    g, lines, i = "", [], 0
    for letter in audit:
        if letter == "I":
            g = given[g]
            lines.append(full[g] + ":")
            continue
        _, role, text = turns[i]
        i += 1
        if letter == "K":
            g = role[:1]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            g = given[g]
            lines.append(f"{full[g]}:{text}")
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_report(rows, every):
    groups = {c: [] for c in every}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest())
    return {c: plain_repair(sorted(t, key=order)) for c, t in groups.items()}


def talk(seed, conversations=120, long=(70, 333)):
    r = random.Random(seed)
    texts = ["Yes.", "no", "What?", "", "  ", "Go on!", "x" * 200, "Ends. ", "\n", "é!", None]
    rows = []
    for c in range(conversations):
        for t in range(long[c] if c < len(long) else r.randrange(1, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("assistant" if t % 2 else "user")
            role = r.choice(["system", "tool", "", None, "user"]) if r.random() < 0.1 else role
            text = r.choice(texts) if r.random() < 0.4 else f"Turn {r.randrange(10**6)}" + r.choice([".", "?", ""])
            rows.append((c if c else None, None if r.random() < 0.05 else t - r.randrange(2), role, text))
        if r.random() < 0.3:
            rows.append(rows[-1])
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_rows", [1 << 17, 23])
def test_conversation_repair(spark, monkeypatch, part_rows):
    monkeypatch.setattr(dialogue, "PART_ROWS", part_rows)
    rows = talk(5)
    df = spark.createDataFrame(rows, TALK).repartition(3).withColumn("conv", F.lit("clash"))
    edits = dialogue.repair(dialogue.damaged(df, "conv_id", "turn", "role", "text"), "conv", "turn", "role", "text", "copies", every=df.select(F.col("conv_id").alias("conv")))
    found = {r.conv: tuple(r)[1:] for r in dialogue.report(edits, arranged=True).collect()}
    assert found == plain_report(plain_damage(rows), {r[0] for r in rows})
    if part_rows == 23:  # written edits give the same report
        again = {r.conv: tuple(r)[1:] for r in dialogue.report(spark.createDataFrame(edits.collect(), edits.schema)).collect()}
        assert again == found


def test_one_conversation_holds_most_rows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "PART_ROWS", 100)
    r = random.Random(2)
    rows = [(7, t, r.choice(["user", "assistant"]), f"Line {r.randrange(10**5)}" + r.choice([".", ""])) for t in range(700)] + [(7, 3, "user", "Same.")] * 500 + [(7, t, "user", "Copy.") for t in range(800, 1000)] + [(8, 0, "user", "Alone.")]
    df = spark.createDataFrame(rows, TALK)
    found = {x.conv: tuple(x)[1:] for x in dialogue.report(dialogue.repair(df, "conv_id", "turn", "role", "text"), arranged=True).collect()}
    assert found == plain_report(rows, {7, 8})


def test_layers_against_recursion():
    r = random.Random(8)
    for _ in range(300):
        turns = [(t, r.choice(["system", "user", "assistant", "x"]), f"{r.random()}" + r.choice(["a", "."])) for t in range(r.randrange(1, 11))]
        kinds = np.array([dialogue.initial(role) + 4 * (text[-1] != ".") for _, role, text in turns])
        layers = dialogue.Layers(kinds[:, None], dialogue.ENDS[None, :], 1, 60)
        codes, state = layers.trace(np.zeros(1, np.int64))
        audit = "".join("I" * (c // 3) + "DKR"[c % 3] for c in codes[:, 0].tolist()) + "I" * (dialogue.ENDS[state[0]] // 5)
        assert (int(layers.cost[0, 0]), audit) == plain_repair(turns)[5:7]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TALK)
    assert dialogue.report(dialogue.repair(none, "conv_id", "turn", "role", "text"), arranged=True).count() == 0
    gone = spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")
    found = {tuple(r) for r in dialogue.report(dialogue.repair(none, "conv_id", "turn", "role", "text", every=gone), arranged=True).collect()}
    assert found == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (5, None)}


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    v = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    found = queries()["op11_nearest_neighbours"](spark, sf)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_nearest(v, {i for i, _ in v if i % 100 == 0}, 10))
    found = queries()["op12_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    x = np.floor(256 * np.array([row for _, row in sorted(v)], float)).astype(np.int64)
    n, white, share, deviation = plain_whitening(x, 4)
    got = np.array([r.whitened for r in found]).reshape(-1, 4)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-8 and [r.deviation for r in found[::4]] == deviation and found[0].n == n
    assert np.allclose([r.explained for r in found[:4]], share, rtol=1e-10) and found[0].identity_error < 1e-10
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    found = queries()["op13_conversation_repair"](spark, sf)
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == plain_report(plain_damage(rows), {r[0] for r in rows})
