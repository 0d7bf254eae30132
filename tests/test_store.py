"""Stored index, change files, the write path and the transcript source."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from vaultframe.functions.stem import stem
from vaultframe.operators import fts, lifecycle, posting_store
from vaultframe.sources import cursor
from vaultframe.sources.schema import TABLES
from vaultframe.vault import Vault



def now_():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


DOCS = "id long, path string, title string, body string"


# Examples of the published algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "adoption": "adopt",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "communism": "commun", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "über": "über", "ab": "ab", "x1y": "x1y", "indexes": "index", "indexing": "index",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def pick(df):
    return {(r.qid, r.id, round(r.bm25, 9), r.rank) for r in df.collect()}


def test_index_follows_its_documents(spark, tmp_path, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "be", "Été"]
    text = lambda i, v: " ".join(words[(i * k + v) % 7] for k in range(1, 4 + i % 9))
    current = {}
    asked = spark.createDataFrame([(1, "alpha"), (2, "be gam"), (3, "alpha alphabet"), (4, "été"), (5, "nothing"), (6, "")], "qid int, query string")
    state, root = posting_store.empty(), f"file://{tmp_path}/index"
    for run in range(5):
        added = {i: (i, f"p{i}.md", f"title {i % 3}", text(i, run)) for i in range(run * 5, run * 5 + 12)} | ({99: (99, "x", None, None)} if run == 2 else {})
        gone = [i for i in current if i % 6 == run % 6 and i not in added]
        state = posting_store.apply(spark, root, state, spark.createDataFrame(list(added.values()), DOCS), spark.createDataFrame([(i,) for i in gone] + [(12345,)], "id long"))
        current = {i: r for i, r in (current | added).items() if i not in gone}
        docs = spark.createDataFrame(list(current.values()), DOCS)
        ok = docs.where("id % 4 <> 1")
        if run in (0, 2, 4):
            want = pick(fts.search(docs, asked, 5, ok))
            assert pick(posting_store.search(spark, state, asked, 5, ok)) == want
            monkeypatch.setattr(fts, "FEW_WORDS", 0)
            assert pick(posting_store.search(spark, state, asked, 5, ok)) == want
            monkeypatch.undo()
    alone = posting_store.apply(spark, root, posting_store.empty(), docs, None)
    assert sorted(map(tuple, posting_store.lengths(spark, state).collect())) == sorted(map(tuple, posting_store.lengths(spark, alone).collect()))
    assert len(state["segments"]) < 5 and len(state["deleted"]) < 4  # merged, and lists that hide nothing are gone


def test_stemmed_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "", "we indexed the relational tables"), (2, "b", "", "an index of relations"), (3, "c", "", "nothing of it")], DOCS)
    state = posting_store.apply(spark, f"file://{tmp_path}/index", posting_store.empty(stemmed=True), docs, None)
    found = posting_store.search(spark, state, spark.createDataFrame([(1, "Indexing"), (2, "indexes relate")], "qid int, query string"))
    assert {(r.qid, r.id) for r in found.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def parts(folder):
    return {os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")}


@pytest.fixture
def files(spark):
    rows = [("c", f"{i:04d}.md", f"Title {i}", f"Document number{i} about topic{i % 7} and " + " ".join(f"word{(i * k) % 613}" for k in range(120)), "note") for i in range(600)]
    return spark.createDataFrame(rows, "collection string, path string, title string, body string, content_type string")


def test_changes_write_what_they_change(spark, tmp_path, files):
    v = Vault(spark, f"file://{tmp_path}/v", now_())
    v.index(files)
    assert {r.id for r in v.table("documents").collect()} == set(range(1, 601)) and v.table("documents").where("path = '0007.md'").first().id == 8
    before, had = size(f"{tmp_path}/v"), parts(f"{tmp_path}/v/documents")
    v.pin([8])
    new = parts(f"{tmp_path}/v/documents") - had
    assert len(new) == 1 and v.table("documents").where("pinned").first().id == 8 and v.table("documents").count() == 600
    pinned = size(f"{tmp_path}/v")
    # a hundredth of the files changes, one goes, one comes: that is what is written
    changed = files.withColumn("body", F.when(F.col("path").isin("0007.md", "0107.md", "0207.md", "0307.md", "0407.md", "0507.md"), F.concat("body", F.lit(" freshly changed"))).otherwise(F.col("body"))).where("path <> '0003.md'")
    extra = spark.createDataFrame([("c", "new.md", "New", "a brand new text", "note")], files.schema)
    v.index(changed.unionByName(extra))
    assert size(f"{tmp_path}/v") - pinned < 0.2 * before
    d = {r.path: r for r in v.table("documents").collect()}
    assert len(d) == 601 and d["new.md"].id == 601 and d["0007.md"].revision_count == 2 and d["0007.md"].pinned and d["0008.md"].revision_count == 1
    assert (d["0003.md"].active, d["0003.md"].deactivated_reason) == (False, "absent")
    assert [r.path for r in v.search("number3 about").collect() if r.path == "0003.md"] == []
    assert {r.path for r in v.search("freshly", 20).collect()} == {"0007.md", "0107.md", "0207.md", "0307.md", "0407.md", "0507.md"}
    # nothing changed: nothing is written but the pointer
    now = size(f"{tmp_path}/v/documents") + size(f"{tmp_path}/v/content")
    v.index(changed.unionByName(extra))
    assert size(f"{tmp_path}/v/documents") + size(f"{tmp_path}/v/content") == now
    # same ranks and scores as a search that reads all texts
    state = v.store.state()
    texts = v._texts(state)
    asked = spark.createDataFrame([(1, "topic3 word1"), (2, "brand"), (3, "document")], "qid int, query string")
    assert pick(posting_store.search(spark, state["index"], asked, 20)) == pick(fts.search(texts, asked, 20))
    # a search plan reads postings and metadata, no texts
    plan = v.search("topic3")._jdf.queryExecution().executedPlan().toString()
    assert "/content/" not in plan and "doc#" not in plan
    # what was forgotten stays so when its file is there, and the absent one comes back
    v.forget([8])
    assert v.search("freshly", 20).count() == 5
    v.index(files.unionByName(extra))
    d = {r.path: r for r in v.table("documents").collect()}
    assert (d["0007.md"].active, d["0007.md"].deactivated_reason) == (False, "forget") and d["0003.md"].active and d["0003.md"].deactivated_reason is None
    assert v.search("freshly", 20).count() == 0 and v.search("number3", 100).where("path = '0003.md'").count() == 1
    v.rename_collection("c", "renamed")
    assert v.search("renamed", 1000).count() == 100


def test_two_writers(spark, tmp_path, files):
    v = Vault(spark, f"file://{tmp_path}/v", now_())
    v.index(files.limit(5))
    state = v.store.state()
    v.pin([1])
    with pytest.raises(Exception, match="(?i)exist"):
        v._changed(v.table("documents").where("id = 2").withColumn("pinned", F.lit(True)), state=state)
    assert {r.id for r in v.table("documents").where("pinned").collect()} == {1}


def plain_save(docs, rows, now):
    """One memory after another, as the rules say; docs is a dict by id."""
    outcomes, top = [], max(docs, default=0)
    window = now - dt.timedelta(minutes=30)
    start = {i: dict(d) for i, d in docs.items()}
    written = {}  # (collection, type, hash) -> id, of this batch
    for r in rows:
        at = next((d for d in docs.values() if (d["collection"], d["path"]) == (r["collection"], r["path"])), None)
        old = start.get(at["id"]) if at else None
        if old and (not old["active"] or old["origin"] == "fs"):
            outcomes.append((r["seq"], "refused"))
            continue
        key = r["collection"], r["content_type"], " ".join(r["body"].lower().split())
        twins = [d for d in start.values() if d["active"] and d["origin"] != "fs" and (d["collection"], d["content_type"], d["text"]) == key and d["created_at"] >= window]
        twin = max(twins, key=lambda d: (d["created_at"], d["id"]))["id"] if twins else written.get(key)
        if twin is not None:
            docs[twin]["duplicate_count"] += 1
            outcomes.append((r["seq"], "deduplicated"))
        elif at:
            at |= {"text": key[2], "revision_count": at["revision_count"] + 1, "title": r["title"], "content_type": r["content_type"]}
            written[key] = at["id"]
            outcomes.append((r["seq"], "updated"))
        else:
            top += 1
            docs[top] = {"id": top, "collection": r["collection"], "path": r["path"], "title": r["title"], "content_type": r["content_type"], "text": key[2], "active": True, "origin": "api", "created_at": now, "duplicate_count": 1, "revision_count": 1}
            written[key] = top
            outcomes.append((r["seq"], "inserted"))
    return outcomes, docs


def test_save_memory(spark, tmp_path):
    import random

    from vaultframe.functions.text import normalized_hash

    r = random.Random(3)
    now = dt.datetime(2024, 2, 1)
    docs = {i: {"id": i, "collection": r.choice("ab"), "path": f"p{i}.md", "title": "t", "content_type": r.choice(["note", "decision"]), "text": f"text {i % 9}", "active": i % 5 != 0, "origin": r.choice(["fs", "api", None]), "created_at": now - dt.timedelta(minutes=r.randrange(60)), "duplicate_count": 1, "revision_count": 1} for i in range(1, 40)}
    rows = [{"seq": s, "collection": r.choice("ab"), "path": f"p{r.randrange(1, 60)}.md", "title": f"m{s}", "body": f"Text  {r.randrange(14)}", "content_type": r.choice(["note", "decision"])} for s in range(80)]
    v = Vault(spark, f"file://{tmp_path}/v", now_())
    table = spark.createDataFrame([tuple(d[c] for c in ("id", "collection", "path", "title", "content_type", "active", "origin", "created_at", "duplicate_count", "revision_count", "text")) for d in docs.values()], "id long, collection string, path string, title string, content_type string, active boolean, origin string, created_at timestamp_ntz, duplicate_count long, revision_count long, text string")
    table = table.withColumns({"normalized_hash": normalized_hash("text"), "hash": F.sha2("text", 256)})
    v.commit(documents=table, content=table.select("hash", F.col("text").alias("doc")).distinct())
    found = v.save_memory(spark.createDataFrame([tuple(x.values()) for x in rows], "seq long, collection string, path string, title string, body string, content_type string"))
    outcomes, want = plain_save(docs, rows, now)
    assert sorted((x.seq, x.action) for x in found.collect()) == sorted(outcomes)
    assert found.where("action <> 'refused' and id is null").count() == 0
    got = {(d.collection, d.path): (d.duplicate_count, d.revision_count, d.title) for d in v.table("documents").collect()}
    assert got == {(d["collection"], d["path"]): (d["duplicate_count"], d["revision_count"], d["title"]) for d in want.values()}
    again = v.save_memory(spark.createDataFrame([(1, "b", "fresh.md", "x", "Quite unheard of", "note")], "seq long, collection string, path string, title string, body string, content_type string"))
    assert [(x.action, x.revision_count) for x in again.collect()] == [("inserted", 1)] and v.search("unheard").first().path == "fresh.md"


def test_authorship_moves_forward_only(spark):
    d = spark.createDataFrame([], TABLES["documents"])
    rows = spark.createDataFrame([(1, "c", "p", "t", "one", "note", dt.datetime(2024, 1, 5)), (2, "c", "p", "t", "two", "note", dt.datetime(2023, 1, 5)), (3, "c", "q", "t", "two", "note", dt.datetime(2024, 1, 9))], "seq long, collection string, path string, title string, body string, content_type string, authored_at timestamp_ntz")
    outcomes, changed = lifecycle.save_batch(d, rows, now_())
    assert [(r.action, r.revision_count, r.duplicate_count, r.path) for r in outcomes.orderBy("seq").collect()] == [("inserted", 1, None, "p"), ("updated", 2, None, "p"), ("deduplicated", None, 2, "p")]
    row = changed.first()
    assert changed.count() == 1 and (row.body, row.revision_count, row.duplicate_count, row.authored_at) == ("two", 2, 2, dt.datetime(2024, 1, 9))


# transcripts


def follow(spark, tmp_path, n, **options):
    """One run of a stream that takes what is there and ends; its rows."""
    df = cursor.transcripts(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cursors", **options)
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((os.path.basename(r.file), r.epoch, r.start, r.line if not r.oversized else f"<{r.end - r.start}>") for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_transcripts_give_each_line_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.jsonl", tmp_path / "in/b.jsonl"
    a.write_text('{"n": 1}\n{"n": 2}\n{"n": ')
    b.write_bytes(b"first\n" + b"x" * 5000 + b"\nlast \xff\n")
    want = [("a.jsonl", 0, 0, '{"n": 1}'), ("a.jsonl", 0, 9, '{"n": 2}'), ("b.jsonl", 0, 0, "first"), ("b.jsonl", 0, 6, "<5001>"), ("b.jsonl", 0, 5007, "last �")]
    assert follow(spark, tmp_path, 1, maxLineBytes="1000") == want
    # a restart goes on where the line broke off
    with a.open("a") as f:
        f.write("3}\n")
    want.append(("a.jsonl", 0, 18, '{"n": 3}'))
    assert follow(spark, tmp_path, 2, maxLineBytes="1000") == sorted(want)
    assert follow(spark, tmp_path, 3, maxLineBytes="1000") == sorted(want)
    # rotation: another file of this name; truncation: the same file, rewritten with the same first line
    os.rename(a, tmp_path / "old")
    a.write_text('{"n": 9}\n')
    with b.open("r+b") as f:
        f.truncate(6)
        f.seek(6)
        f.write(b"again\n" + b"y" * 6000 + b"\n")
    want += [("a.jsonl", 1, 0, '{"n": 9}'), ("b.jsonl", 1, 0, "first"), ("b.jsonl", 1, 6, "again"), ("b.jsonl", 1, 12, "<6001>")]
    assert follow(spark, tmp_path, 4, maxLineBytes="1000") == sorted(want)
    with a.open("a") as f:
        f.write('{"n": 10}\n')
    want.append(("a.jsonl", 1, 9, '{"n": 10}'))
    assert follow(spark, tmp_path, 5, maxLineBytes="1000") == sorted(want)


def test_reader_plans_from_start_and_end_alone(tmp_path):
    (tmp_path / "in").mkdir()
    a = tmp_path / "in/a.jsonl"
    a.write_bytes(b"".join(b"line %d\n" % i for i in range(100)))
    make = lambda: cursor.TranscriptReader({"path": str(tmp_path / "in"), "cursors": str(tmp_path / "cursors"), "maxbytesperfile": "100"})
    read = lambda r, start, end: [line for s in r.partitions(start, end) for b in r.read(s) for line in b.column("line").to_pylist()]
    r, start, got = make(), {}, []
    for i in range(40):
        end = r.latestOffset()
        if end == start:
            break
        again = make()
        assert read(again, start, end) == (now := read(r, start, end))  # a replayed batch reads the same
        got += now
        start = end
        r = make() if i % 3 == 0 else r  # restarts know the planned offset
    assert got == [f"line {i}" for i in range(100)] and i > 5
    # planned before a restart replayed a later batch: the start decides
    stale = make().latestOffset()
    with a.open("ab") as f:
        f.write(b"more\n")
    end = make().latestOffset()
    assert read(make(), stale, end) == ["more"]
    # rewritten between planning and reading: nothing is read, then a new epoch
    with a.open("ab") as f:
        f.write(b"even more\n")
    r = make()
    planned = r.latestOffset()
    a.write_bytes(b"line 0\nother text of a fresh file\n" + b"z" * 2000 + b"\n")
    assert read(r, end, planned) == []
    later = r.latestOffset()
    assert later[str(a)]["epoch"] == planned[str(a)]["epoch"] + 1
    assert read(r, planned, later) == ["line 0", "other text of a fresh file"]


def test_line_of_64_mib(tmp_path):
    path = tmp_path / "big"
    with path.open("wb") as f:
        f.write(b"small\n" + b"q" * (65 << 20) + b"\nend\n")
    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        got = [(s, e, text, len(beginning or b"")) for s, e, text, _, beginning in cursor.lines(f, 0, f.size(), 64 << 20)]
    big = 6 + (65 << 20) + 1
    assert got == [(0, 6, b"small", 0), (6, big, None, cursor.PREFIX_BYTES), (big, big + 4, b"end", 0)]
    assert json.dumps(cursor.SCHEMA)
