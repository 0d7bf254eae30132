"""Each operator against a brute-force version on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultframe.llm import common, fertility, line_dedup, packing, piece_codec, sharding, simhash, suffix_dedup, token_store, topk, url_filter
from vaultframe.llm.queries import ALLOW, BLOCK, oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def awkward(seed=3, n=60):
    """Texts with nulls, empties, very long words, exact and near copies and shared passages."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" + r.choice(["", ",", ".", "é", "###"]) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = prose(120)
    texts = [None, "", " ", "\n\n", "One", "ONE", "a" * 3000, "ab" * 700, "x\x1cy z  q", "日本語 テキスト 🙂" * 5, "tab\tand\x0bvt  ", "<|endoftext|> and <|startoftext|>"]
    for _ in range(n):
        lines = [prose(r.randrange(3, 60)) for _ in range(r.randrange(1, 6))]
        texts.append("\n".join(lines))
        kind = r.randrange(5)
        if kind == 0:
            texts.append(texts[-1])
        elif kind == 1:
            w = texts[-1].split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(prose(20) + "\n" + passage[: r.randrange(380, 700)] + "\n" + prose(9))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(awkward()), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return awkward()


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# 1


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
    path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    best = None
    for verdict, rules in (("allow", ALLOW), ("block", BLOCK)):
        for rule in rules:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
    return host, path, best and best[0], best[1] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://example.org", "http://example.org?x", "https://badexample.org/es/1", "http://x.com/fr/1://y", "http://x.com/de", "http://x.com/de/", "http://com/fr/", "ftp://u@h.org:80/p", "http://É.com/de/ü", "http://a.b.c.d.example.org/es/" + "z" * 5000]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_urls(spark, bound):
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    out = url_filter.judge_urls(table, "url", ALLOW, BLOCK, max_broadcast_bytes=bound)
    assert got(out.withColumn("rule", F.coalesce("rule", F.lit(""))), "page_id", "host", "path", "rule", "verdict") == sorted((i, h, p, r or "", v) for i, u in enumerate(URLS * 2) for h, p, r, v in [plain_url(u)])
    assert url_filter.judge_urls(table.limit(0), "url", ALLOW, BLOCK).count() == 0


# 2


def plain_fingerprint(text, k):
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, texts):
    fps = {i: plain_fingerprint(t, 4) for i, t in enumerate(texts)}
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    parts = closure(fps, edges)
    out = {r.doc_id: r for r in simhash.components(docs, "doc_id", "text", 4, 4).collect()}
    assert {i: r.fp & (2**64 - 1) for i, r in out.items()} == fps
    assert {i: r.component_id for i, r in out.items()} == parts
    kept = {r.doc_id for r in simhash.keep_first(docs, "doc_id", "text", 4, 4).collect()}
    assert kept == {i for i, c in parts.items() if i == c}


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6, 9])
def test_links_of_clustered_fingerprints(spark, distance):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(8)]
    fps = set(base)
    while len(fps) < 300:
        f = r.choice(base)
        for _ in range(r.randrange(0, 9)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    signed = lambda f: f - 2**64 if f >> 63 else f
    edges = [(signed(a), signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= distance]
    want = closure([signed(f) for f in fps], edges)
    found = [tuple(x) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), distance).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= distance for a, b in found)
    assert closure([signed(f) for f in fps], found) == want


def test_near_copies_of_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    texts = [None, "", "one two", "One  two", "one two three"]
    for n in [8, 30, 90, 250, 600] * 4:
        words = [f"w{r.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for k in r.sample(range(n), r.randrange(1, 2 + n // 25)):
                copy[k] = f"v{r.randrange(5000)}"
            texts.append(" ".join(copy))
    shingled = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [shingled((t or "").lower().split()) for t in texts]
    fps = [plain_fingerprint(t, 5) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    alike = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(set(alike) - set(near)) > 20
    parts = closure(range(len(texts)), near + alike)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    assert kept == {i for i in range(len(texts)) if parts[i] == i}
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SF).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = dict(tuple(r) for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_packing(docs, texts):
    tok = library("byte_bpe_50k.json")
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    out = packing.pack_documents(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), capacity=64).collect()
    at = {i: 0 for i in ids}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(map(len, ids.values())) / (64 * len(sequences)) > 0.9
    assert packing.pack_documents(docs.limit(0), "doc_id", "text", tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plan_keeps_the_histogram():
    r = random.Random(5)
    for _ in range(30):
        histogram = {r.randrange(1, 101): r.randrange(1, 50) for _ in range(r.randrange(1, 60))}
        plan = packing.plan(histogram, 100)
        assert Counter({k: v for k, v in histogram.items()}) == sum((Counter({k: c * n for k, c in Counter(p).items()}) for p, n in plan), Counter())
        assert all(sum(p) <= 100 for p, _ in plan)


# 4


def test_sharding(spark, docs):
    table = sharding.shard_documents(docs.withColumn("file", F.lit("clash")), "doc_id", arrivals=16, unit_bytes=1024, fan_in=4, target_bytes=40_000)
    out = table.read()
    assert got(out.fillna(""), "doc_id", "text") == got(docs.fillna(""), "doc_id", "text")
    tiers = Counter(r["tier"] for r in table.manifest()["runs"])
    assert all(n < 4 for n in tiers.values())
    at = table.manifest()
    version = table.append(docs.limit(0))
    assert version == at["version"] + 1 and table.read().count() == docs.count()
    with pytest.raises(Exception, match="(?i)exist"):
        table.commit([], at)  # somebody else was first
    assert table.read(version).count() == docs.count()


def test_sharding_of_an_empty_table(spark, docs):
    table = sharding.shard_documents(docs.limit(0), "doc_id")
    assert table.read().count() == 0 and table.read().columns == [*docs.columns, "shard", "shard_bytes", "tier"]
    table.append(docs)
    assert table.read().count() == docs.count()
    with pytest.raises(ValueError, match="no version"):
        sharding.ShardedTable(spark, common.scratch(spark, "none")).read()


def test_sharding_keeps_columns_that_only_some_arrivals_have(spark):
    table = sharding.ShardedTable(spark, common.scratch(spark, "shards"), fan_in=4)
    table.append(spark.createDataFrame([(1, 7)], "id long, n int"))
    table.append(spark.createDataFrame([(2, 2**60 + 1, "x")], "id long, n long, extra string"))
    table.append(spark.createDataFrame([(3, 0.5)], "id long, n double"))
    table.append(spark.createDataFrame([(4, "y", True)], "id long, extra string, flag boolean"))
    want = [(1, "7", None, None), (2, str(2**60 + 1), "x", None), (3, "0.5", None, None), (4, None, "y", True)]
    assert sorted(tuple(r) for r in table.read().select("id", "n", "extra", "flag").collect()) == want
    table.compact()
    assert len(table.manifest()["runs"]) == 1
    assert sorted(tuple(r) for r in table.read().select("id", "n", "extra", "flag").collect()) == want
    table.append(spark.createDataFrame([(5, "two")], "id long, n string"))
    assert {r.id: r.n for r in table.read().collect()}[5] == "two"


def test_common_types_lose_nothing():
    from pyspark.sql import types as T

    one = lambda *kinds: sharding.common_schema([T.StructType.fromDDL(f"x {k}") for k in kinds])["x"].dataType.simpleString()
    assert (one("int", "long"), one("int", "double"), one("short", "float"), one("int", "float"), one("float", "double")) == ("bigint", "double", "float", "double", "double")
    assert one("long", "float") == one("long", "double") == one("double", "long") == one("decimal(20,2)", "double") == one("date", "int") == "string"
    assert one("array<int>", "array<int>") == "array<int>"
    for a, b in [("array<int>", "string"), ("binary", "string"), ("timestamp", "string"), ("struct<a:int>", "struct<a:long>")]:
        with pytest.raises(ValueError, match="no common type"):
            one(a, b)


def test_sharding_takes_names_that_differ_in_case_as_one_column(spark):
    table = sharding.ShardedTable(spark, common.scratch(spark, "shards"), fan_in=4)
    table.append(spark.createDataFrame([(1, 7)], "id long, x int"))
    first = table.read()
    table.append(spark.createDataFrame([(2**60 + 1, 2)], "X long, ID long"))
    table.append(spark.createDataFrame([(3, 0.5, [1])], "id long, X double, more array<int>"))
    want = [(1, "7", None), (2, str(2**60 + 1), None), (3, "0.5", [1])]
    seen = lambda: sorted(tuple(r) for r in table.read().select("id", "x", "more").collect())
    assert seen() == want and table.read().columns[:3] == ["id", "x", "more"] and first.collect()[0]["x"] == 7
    version = table.manifest()["version"]
    with pytest.raises(ValueError, match="no common type"):
        table.append(spark.createDataFrame([(4, "y")], "id long, More string"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="case only"):
            table.append(spark.createDataFrame([(5, 1, 2)], "id long, x int, X int"))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert table.manifest()["version"] == version and seen() == want
    table.append(spark.createDataFrame([(9,)], "id long"))
    table.compact()
    assert len(table.manifest()["runs"]) == 1 and seen() == [*want, (9, None, None)]


def test_sharding_deletes_what_is_due_by_its_manifest_alone(spark, monkeypatch):
    table = sharding.ShardedTable(spark, common.scratch(spark, "shards"), fan_in=2, retain=0)
    for i in range(5):
        table.append(spark.range(i * 10, i * 10 + 10))
        table.compact()
    manifest = table.manifest()
    assert table.versions() == [manifest["version"]] and table.read().count() == 50
    assert {f["path"] for f in table._files(f"{table.root}/data")} == {f["path"] for r in manifest["runs"] for f in r["shards"]}
    assert len(manifest["replaced"]) == 1
    table.retain = 3600
    monkeypatch.setattr(table, "vacuum", None)
    for i in range(5, 8):
        table.append(spark.range(i * 10, i * 10 + 10))
        table.compact()
    for v in table.versions():
        assert table.read(v).count() in (50, 60, 70, 80)


def test_sharding_keeps_files_for_readers(spark):
    table = sharding.ShardedTable(spark, common.scratch(spark, "shards"), fan_in=4)
    for i in range(4):
        table.append(spark.range(i * 10, i * 10 + 10))
    before = table.read()
    spark.range(3).write.parquet(f"{table.root}/data/failed")  # a writer that never committed
    table.compact()
    assert before.count() == 40 and table.read().count() == 40 and len(table.versions()) == 5
    assert table._files(f"{table.root}/data/failed")
    table.retain = table.orphan = 0
    table.vacuum()
    assert table.versions() == [5] and table.read().count() == 40
    assert not table._files(f"{table.root}/data/failed")
    with pytest.raises(Exception, match="(?i)not_exist|not exist"):
        before.collect()


# 5


def plain_lines(texts, threshold, least):
    import re

    seen, out = [], {}
    for i, t in enumerate(texts):
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0d]+", line))
            if len(s) < least:
                continue
            if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                gone.append(k)
            seen.append(s)
        out[i] = gone
    return out


@pytest.mark.parametrize("tries, few", [(line_dedup.FIRST_TRIES, common.FEW_ROWS), (0, common.FEW_ROWS), (0, 2)])
def test_line_dedup(spark, monkeypatch, tries, few):
    monkeypatch.setattr(line_dedup, "FIRST_TRIES", tries)
    monkeypatch.setattr(line_dedup, "FEW_ROWS", few)  # beyond, nothing is broadcast
    monkeypatch.setattr(common, "FEW_ROWS", few)
    r = random.Random(11)
    lines = [" ".join(f"w{int(r.paretovariate(0.6)) % 500}" for _ in range(r.randrange(2, 45))) for _ in range(60)]
    texts = [None, "", "a b c d e f g h i j", "a b c d e f g h i j k"]
    for _ in range(120):
        own = []
        for _ in range(r.randrange(1, 6)):
            w = r.choice(lines).split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = f"v{r.randrange(40)}"
            own.append(r.choice([" ", "  ", "\t"]).join(w))
        texts.append("\n".join(own))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    for least in (5, 1):
        want = plain_lines(texts, 0.8, least)
        out = {x.doc_id: x.removed_lines for x in line_dedup.line_report(docs, "doc_id", "text", least=least).collect()}
        assert out == want and sum(map(len, want.values())) > 50
    clean = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs, "doc_id", "text").collect()}
    assert clean == {i: t if not want[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in enumerate(texts)}
    assert line_dedup.line_report(docs.limit(0), "doc_id", "text").count() == 0



def test_pipeline_leaves_no_passage_of_50_words_shared(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = f"{SF}/../sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == "suffix_dedup":
            before = {r.doc_id: r.text or "" for r in docs.collect()}
        if name == "packing":
            break
        docs = common.materialise(stage(spark, docs, sf), name)
    after = {r.doc_id: r.text or "" for r in docs.collect()}

    def sharers(texts):
        where = {}
        for i, t in texts.items():
            words = t.split()
            for k in range(len(words) - 49):
                where.setdefault(tuple(words[k : k + 50]), set()).add(i)
        return {i for own in where.values() if len(own) > 1 for i in own}

    assert sharers(before) and not sharers(after) and set(after) == set(before)
    changed = {i for i in after if after[i] != before[i]}
    assert sharers(before) <= changed and len(changed) < 0.1 * len(after)


def test_short_lines(spark, tmp_path):
    r = random.Random(12)
    short = ["one", "one two", "one two two two two two", "a b c", "a b c d", "d c b a", "a b c d e", "a b c d e f", "#", "今日は天気がいいので散歩に行きました。", "- x", "-"]
    texts = ["", None, "\n \n"] + ["\n".join(r.choice([r.choice(short), " ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(1, 8)))]) for _ in range(r.randrange(1, 6))) for _ in range(80)]
    spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_lines(texts, 0.8, 1)
    out = {x.doc_id: x.removed_lines for x in queries()["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert out == want and sum(map(len, want.values())) > 100
    docs = spark.createDataFrame(rows_of(["a b c d", "a b c d e", "今日は天気が", "今日は天気が", "x", "x y"]), SCHEMA)
    assert {x.doc_id for x in line_dedup.line_report(docs, "doc_id", "text", least=1).where("n_removed > 0").collect()} == {1, 3}


# 6


def plain_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        flags = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                flags[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], flags]).astype(int)) == 1).sum())
        out.append((len(r), int(flags.sum()), runs, hashlib.sha256(bytes(b for b, f in zip(r, flags, strict=True) if not f)).hexdigest()))
    return out


def test_suffix_dedup(docs, texts):
    want = plain_repeats(texts, 400)
    out = suffix_dedup.repeat_digest(docs, "doc_id", "text", 400)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == [(i, *w) for i, w in enumerate(want)]
    assert sum(w[1] for w in want) > 10_000
    both = suffix_dedup.repeat_digest(docs, "doc_id", "text", 400, passage=240)
    shared = [w[1] for w in plain_repeats(texts, 240)]
    assert got(both, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage") == [(i, *w, n) for i, (w, n) in enumerate(zip(want, shared, strict=True))]
    assert sum(shared) > sum(w[1] for w in want)
    assert suffix_dedup.repeat_digest(docs.limit(0), "doc_id", "text").count() == 0
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs, "doc_id", "text").collect()}
    assert all(hashlib.sha256((left[i] or "").encode()).hexdigest() == w[3] for i, w in enumerate(want) if i != 9)


def test_suffix_dedup_of_small_alphabets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 3000)
    r = random.Random(2)
    base = "".join(r.choice("ab") for _ in range(3000))
    texts = ["a" * 401, "a" * 400, "ab" * 300, base, base[100:900] + "x" + base[901:1400], base[::-1], base[500:905], base[2000:2399], "\n" + base[1000:1401], base[700:1500] * 2]
    out = suffix_dedup.repeat_digest(spark.createDataFrame(rows_of(texts), SCHEMA), "doc_id", "text", 400)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == [(i, *w) for i, w in enumerate(plain_repeats(texts, 400))]
    out = suffix_dedup.repeat_digest(spark.createDataFrame(rows_of(texts), SCHEMA), "doc_id", "text", 400, passage=240)
    want = [(i, *w, p[1]) for i, (w, p) in enumerate(zip(plain_repeats(texts, 400), plain_repeats(texts, 240), strict=True))]
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage") == want
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(out, "doc_id", "kept_sha256", 401)


# 7


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality(docs, texts):
    import math

    import sentencepiece

    more = texts + ["a b c d e f g h " * 3 + "\nx\nx\n \n ", "one two three four five six seven eight nine " * 6 + " ".join(map(str, range(200)))]
    assert [fertility.base_counts(t) for t in more] == [plain_base(t) for t in more]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in fertility.measure(docs, "doc_id", "text", "lang", tokenizer_path("piece_bpe_32k.model")).collect():
        t = texts[r.doc_id]
        base = plain_base(t)
        assert tuple(r)[1:6] == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        ids = sp.encode(t or "")
        assert r.n_tokens == len(ids)
        if ids:
            counts = Counter(ids)
            assert math.isclose(r.token_entropy, -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()), abs_tol=1e-9)
            assert r.chars_per_token == len(t) / len(ids)
            assert r.byte_share == sum(sp.is_byte(i) and i != sp.piece_to_id("<0x0A>") for i in ids) / len(ids)
            band = fertility.BANDS["en"]
            inside = band.chars_low <= r.chars_per_token <= band.chars_high and r.byte_share <= band.byte_high and band.entropy_low <= r.token_entropy <= band.entropy_high
            assert r.kept == (inside and not r.base_failed)
        else:
            assert not r.kept
    kept = {r.doc_id for r in fertility.keep_documents(docs, "text", "lang", tokenizer_path("piece_bpe_32k.model")).collect()}
    assert kept == {r.doc_id for r in fertility.measure(docs, "doc_id", "text", "lang", tokenizer_path("piece_bpe_32k.model")).collect() if r.kept}


def test_quality_keeps_labelled_good_documents(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    good = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").where("quality = 1")
    rows = fertility.measure(docs, "doc_id", "text", "lang", tokenizer_path("piece_bpe_32k.model")).join(good, "doc_id")
    n, lost = rows.count(), rows.where("not kept and not base_failed").count()
    assert n > 100 and lost == 0


def test_quality_rejects_labelled_bad_documents_of_every_length(spark):
    sf = f"{SF}/../sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    path = tokenizer_path("piece_bpe_32k.model")
    length = F.when(F.col("n_tokens") < 300, 0).when(F.col("n_tokens") < 600, 1).otherwise(2).alias("length")
    for lang, share in (("lang", 0.75), (None, 0.5)):  # by language, and by script alone
        judged = docs.withColumn("lang", F.col(lang) if lang else F.lit(None).cast("string"))
        rows = fertility.measure(judged, "doc_id", "text", "lang", path).where("not base_failed").join(docs.select("doc_id", "quality"), "doc_id")
        found = {(r.quality, r.length): (r.n, r.kept) for r in rows.groupBy("quality", length).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
        for k in range(3):
            (bad, bad_kept), (good, good_kept) = found[0, k], found[1, k]
            assert bad > 40 and bad - bad_kept >= share * bad and good_kept == good


def test_quality_of_other_languages():
    f = fertility.fertility(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(5)
    junk = " ".join("|" + "".join(r.choice("#*$%&<>ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(6)) for _ in range(60))
    for language in ("en", "it", None):
        c, m, failed, kept = fertility.verdict(f, junk, language, fertility.BANDS)
        assert not failed and m[0] < 600 and not kept
    assert fertility.band_of("слово за словом", None, fertility.BANDS) is fertility.BANDS[""]
    assert fertility.band_of("per cento e così", "it", fertility.BANDS) is fertility.BANDS["Latn"]


# 8


def test_piece_codec(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(1)
    codec = piece_codec.codec(tokenizer_path("piece_bpe_32k.model"))
    alphabet = "aeinrst  \n\tABCé▁中🙂 \x00<>s0x0A１²ﬁ́'-.,012345  "
    for t in ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)]:
        ids = codec.encode(t)
        assert ids == sp.encode(t) and codec.decode(ids) == sp.decode(ids)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), 0, 1, 2]) for _ in range(r.randrange(8))]
        assert codec.decode(ids) == sp.decode(ids)
    out = piece_codec.round_trip_digest(docs, "doc_id", "text", tokenizer_path("piece_bpe_32k.model"))
    want = []
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    coded = piece_codec.decode_documents(piece_codec.encode_documents(docs, "text", tokenizer_path("piece_bpe_32k.model")), "ids", tokenizer_path("piece_bpe_32k.model"))
    assert {r.doc_id: r.decoded for r in coded.collect()} == {i: t or "" for i, t in enumerate(texts)}


# 9


def test_token_files(spark, docs, texts):
    tok = library("word_bpe_49k.json")
    root = token_store.write_store(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2, sequence=32)
    start, want, flat = 0, [], []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    assert got(token_store.read_digest(spark, root, "doc_id"), "doc_id", "start", "n_tokens", "ids_crc32") == want
    index = token_store.read_index(spark, root).orderBy("doc_id").collect()
    back, files = [], list(dict.fromkeys(r.file for r in index))
    for f in files:
        shard = token_store.ShardReader(f"{root}/{f}")
        for k in range(sum(shard.file.get_batch(b).num_rows for b in range(shard.file.num_record_batches))):
            ids, mask = shard.row(k)
            assert len(ids) == len(mask) == 32
            back += ids[mask].tolist()
    assert back == flat
    empty = token_store.write_store(docs.limit(0), "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2)
    assert token_store.read_digest(spark, empty, "doc_id").count() == 0


def test_encoder_is_exact_for_both_vocabularies(monkeypatch):
    import pyarrow as pa

    from vaultframe.llm import tokenizers_cached

    monkeypatch.setattr(tokenizers_cached, "PARTS", 50)
    r = random.Random(4)
    alphabet = "aA'sé \t\n\r\x0b\x1c\x85 \u2003\u30001²,.!中🙂e\u0301<|>b\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)] + ["a<|endoftext|> b", "it's we'll  x", "x\n\ny \n z", "", None, "a" * 100]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        mine, theirs = tokenizers_cached.TextEncoder(tokenizer_path(name), keeps), library(name)
        for _ in range(2):
            for lo in range(0, len(texts), 700):
                part = texts[lo : lo + 700]
                ids, bounds = mine.encode(*common.utf8_buffers(pa.array(part)))
                for k, t in enumerate(part):
                    assert ids[bounds[k] : bounds[k + 1]].tolist() == theirs.encode(t or "", add_special_tokens=False).ids, t
            mine._clear()


# 10


def test_top_k(spark):
    r = np.random.default_rng(6)
    v = r.normal(0, 0.12, (500, 64)).round(3).tolist()
    v[40:60] = [v[40]] * 20  # ties
    v[7], v[8], v[9] = None, [None] * 64, [float("nan")] * 64
    v[10][3] = float("inf")
    table = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(v)], "vec_id long, embedding array<float>, score string")
    e = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in enumerate(v) if i not in (7, 8, 9, 10)}
    want = []
    for q in e:
        if q % 10 == 0:
            best = sorted((-int(e[q] @ e[c]), c) for c in e if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    out = topk.top_k(table, "vec_id", "embedding", table.where("vec_id % 10 = 0"))
    assert got(out, "query_id", "rank", "id", "score") == sorted(want)
    few = topk.top_k(table.limit(3), "vec_id", "embedding", table.where("vec_id = 0"))
    assert few.count() == 2
    assert topk.top_k(table.limit(0), "vec_id", "embedding", table.limit(0)).count() == 0


def plain_top_k(rows, asked, k=5):
    """rows, asked: (id, integers); a missing component is zero, a repeated id counts once with its best score."""
    want = []
    for q in sorted({i for i, _ in asked}):
        best = {}
        for i, x in asked:
            for c, y in rows:
                if i == q != c:
                    s = sum(int(a) * int(b) for a, b in zip(x, y, strict=False))
                    s = min(max(s, -topk.MOST), topk.MOST)
                    best[c] = max(best.get(c, s), s)
        want += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k])]
    return sorted(want)


@pytest.mark.parametrize("dim", [8, 64, 768])
@pytest.mark.parametrize("components", [1 << 19, 3000])
def test_top_k_of_any_length_in_many_shards(spark, monkeypatch, dim, components):
    monkeypatch.setattr(topk, "SHARD_COMPONENTS", components)
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", components)
    monkeypatch.setattr(topk, "FEW", 3)
    r = np.random.default_rng(dim)
    v = np.round(r.standard_t(2, (60, dim)), 2)
    v[11] *= 1e8
    v[12] = -v[11]
    v[20:30] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(4, rows[5][1]), (4, rows[4][1]), (6, []), (70, []), (71, [1e8]), (72, rows[9][1][:3]), (73, [0.0] * dim)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    asked = [(i, x) for i, x in whole if i % 2 == 0]
    out = topk.top_k(table, "vec_id", "embedding", table.where("vec_id % 2 = 0"))
    assert got(out, "query_id", "rank", "id", "score") == plain_top_k(whole, asked)


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 5.0]), (3, [1e300, 0.0]), (4, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = [(i, [min(max(math.floor(256 * x), -(2**63)), topk.MOST) for x in v]) for i, v in rows]
    out = topk.top_k(table, "vec_id", "embedding", table)
    assert got(out, "query_id", "rank", "id", "score") == plain_top_k(held, held)


def test_top_k_stops_early_and_stays_exact():
    r = np.random.default_rng(8)
    x = np.floor(r.standard_t(2, (4000, 64)) * 40).astype(int)  # a few large impacts decide
    shard = topk.ImpactShard(np.arange(4000), x.ravel(), np.arange(4001) * 64)
    for i in range(50):
        s = x[i] @ x.T
        best = sorted((-int(s[c]), c) for c in range(4000) if c != i)[:5]
        ids, score = shard.search(i, x[i], 5)
        assert list(zip((-score).tolist(), ids.tolist(), strict=True)) == best
        floor = -best[2][0]
        ids, score = shard.search(i, x[i], 5, floor)
        assert list(zip((-score).tolist(), ids.tolist(), strict=True)) == [b for b in best if -b[0] >= floor]
    assert shard.read < shard.full / 2


# SQL


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    mine = [tuple(r) for r in queries()[name](spark, SF).select(*columns).collect()]
    assert sorted(mine, key=str) == sorted(found, key=str)


# extra columns, repeated rows


def test_clashing_columns_and_repeated_rows(spark, docs):
    names = "rule verdict host path fp component_id start length ids_crc32 sequence_id offset shard tier shard_bytes row spans line removed_lines kept n_words n_tokens score rank id a b node root decoded ids __row text_of".split()
    twice = docs.union(docs.limit(20)).withColumns({n: F.lit("x") for n in names})
    n = twice.count()
    path = tokenizer_path("piece_bpe_32k.model")
    assert simhash.components(twice, "doc_id", "text").count() == n
    assert simhash.keep_first(twice, "doc_id", "text").columns == twice.columns
    assert packing.pack_documents(twice, "doc_id", "text", tokenizer_path("byte_bpe_50k.json")).select("doc_id").distinct().count() == docs.count()
    assert sharding.shard_documents(twice, "doc_id").read().count() == n
    assert line_dedup.dedup_lines(twice.drop("__row"), "doc_id", "text").count() == n
    assert line_dedup.line_report(twice, "doc_id", "text").count() == n
    assert suffix_dedup.remove_repeats(twice.drop("__row"), "doc_id", "text").columns == twice.drop("__row").columns
    assert suffix_dedup.repeat_digest(twice, "doc_id", "text").count() == n
    assert fertility.measure(twice, "doc_id", "text", "lang", path).count() == n
    assert piece_codec.round_trip_digest(twice, "doc_id", "text", path).count() == n
    assert token_store.read_digest(spark, token_store.write_store(twice, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2), "doc_id").count() == n


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", "en", "s", 1), (None, None, None, None, None), (3, "a b c d e f g", "en", "s", 1)], SCHEMA)
    path = tokenizer_path("piece_bpe_32k.model")
    assert simhash.components(docs, "doc_id", "text").count() == 3
    assert simhash.keep_first(docs, "doc_id", "text").count() >= 2
    assert packing.pack_documents(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json")).count() == 3
    assert sharding.shard_documents(docs, "doc_id").read().count() == 3
    assert {r.doc_id: r.n_removed for r in line_dedup.line_report(docs.where("text is not null"), "doc_id", "text").collect()} == {None: 0, 3: 1}
    assert suffix_dedup.repeat_digest(docs, "doc_id", "text").count() == 3
    assert fertility.measure(docs, "doc_id", "text", "lang", path).count() == 3
    assert token_store.read_digest(spark, token_store.write_store(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2), "doc_id").count() == 3
    vectors = spark.createDataFrame([(None, [1.0] * 64), (0, [1.0] * 64), (1, [2.0] * 64)], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, "vec_id", "embedding", vectors).count() == 2


def test_very_long_text(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**5)}" for _ in range(150_000)]
    long = " ".join(words)  # some 0.9 MB in one line
    docs = spark.createDataFrame(rows_of([long, long[: len(long) // 2] + " end", "x" * 300_000]), SCHEMA)
    want = plain_repeats([long, long[: len(long) // 2] + " end", "x" * 300_000], 400)
    assert got(suffix_dedup.repeat_digest(docs, "doc_id", "text"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == [(i, *w) for i, w in enumerate(want)]
    assert line_dedup.line_report(docs, "doc_id", "text").count() == 3
    assert {x.doc_id: x.fp & (2**64 - 1) for x in simhash.fingerprints(docs, "doc_id", "text", 4).collect()} == {0: plain_fingerprint(long, 4), 1: plain_fingerprint(long[: len(long) // 2] + " end", 4), 2: plain_fingerprint("x" * 300_000, 4)}


# the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(21)
    source = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    texts = [t for (t,) in source]
    texts += [texts[3], texts[5].replace(" the ", " thee ", 1), None, ""] + [t[: r.randrange(500, 900)] for t in texts[10:20]]
    rows = rows_of(texts)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = [x.asDict() for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # the same by hand
    f = fertility.fertility(tokenizer_path("piece_bpe_32k.model"))
    docs = {i: t for i, t, lang, _, _ in rows if fertility.verdict(f, t, lang, fertility.BANDS)[3]}
    ids = sorted(docs)
    gone = plain_lines([docs[i] for i in ids], 0.8, 1)
    docs = {i: "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in gone[n]) for n, i in enumerate(ids)}
    fps = {i: plain_fingerprint(t, 5) for i, t in docs.items()}
    parts = closure(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    ids = [i for i in ids if parts[i] == i]
    raws = [docs[i].encode() for i in ids]
    n = corpus_pipeline.PASSAGE
    assert n < 265  # bytes of 50 words of prose, the fewest met
    count = Counter(x[k : k + n] for x in raws for k in range(len(x) - n + 1))
    tok, want = library("byte_bpe_50k.json"), {}
    for i, x in zip(ids, raws, strict=True):
        cut = {b for k in range(len(x) - n + 1) if count[x[k : k + n]] > 1 for b in range(k, k + n)}
        left = bytes(b for k, b in enumerate(x) if k not in cut).decode("utf-8", "replace")
        want[i] = [*tok.encode(left, add_special_tokens=False).ids, 0]
    assert {x["doc_id"] for x in out} == set(want) and len(want) < len(texts)
    for x in out:
        part = want[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert len(part) == x["length"] and x["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and x["doc_tokens"] == len(want[x["doc_id"]])
    assert sum(x["length"] for x in out) == sum(map(len, want.values()))
    first = {name for name, _ in corpus_pipeline.STAGES}
    assert first == {"quality_rules", "line_dedup", "simhash_near_dedup", "suffix_dedup", "packing"}
