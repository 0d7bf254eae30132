"""File sources, the vault facade, and streams against their batch twins."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vaultframe.operators import windows
from vaultframe.sources import conversations, formats, markdown
from vaultframe.streaming import jobs
from vaultframe.vault import Vault

DOC = "---\ntitle: My plan\ntags: [a, b]\ndomain: work\nauthored_at: 2024-01-02\n---\n# Heading\n\nWe decided to use Spark for the engine because it scales out well.\n\n- item one is here and is long enough\n- item two is here and is long enough\n\n```\ncode line one that is long enough to be kept as a fragment\n```\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs/adr").mkdir(parents=True)
    (tmp_path / "docs/node_modules").mkdir()
    (tmp_path / "docs/adr/one.md").write_text(DOC)
    (tmp_path / "docs/two.md").write_text("plain text without heading about fusion and ranking")
    (tmp_path / "docs/skip.txt").write_text("no")
    (tmp_path / "docs/node_modules/x.md").write_text("no")
    return tmp_path


def test_markdown(spark, folder):
    files = markdown.scan(spark, f"file://{folder}/docs", "c")
    parsed = {r.path: r for r in markdown.parse(files).collect()}
    assert set(parsed) == {"adr/one.md", "two.md"}
    one = parsed["adr/one.md"]
    assert (one.title, one.tags, one.domain, one.content_type) == ("My plan", ["a", "b"], "work", "decision")
    assert one.body.startswith("# Heading") and parsed["two.md"].title == "two"
    stored = spark.createDataFrame([("c", "two.md", "old", True), ("c", "gone.md", "x", True)], "collection string, path string, hash string, active boolean")
    assert {r.path: r.change for r in markdown.changes(stored, files).collect()} == {"adr/one.md": "added", "two.md": "changed", "gone.md": "absent"}
    kinds = [r.kind for r in markdown.lateral(markdown.parse(files).where("path = 'adr/one.md'"), markdown.Fragments, "body").orderBy("seq").collect()]
    assert kinds[0] == "full" and {"section", "list", "code"} <= set(kinds)
    long = spark.createDataFrame([("word. " * 2000,)], "text string")
    chunks = markdown.lateral(long, markdown.CharChunks, "text").orderBy("pos").collect()
    assert len(chunks) > 3 and all(len(r.chunk) <= 3200 for r in chunks)
    assert chunks[0].text[: len(chunks[0].chunk)] == chunks[0].chunk and chunks[-1].pos + len(chunks[-1].chunk) == 12000


def test_conversations(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"type": r, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": r, "content": t}}) for r, t in (("user", "first question is long enough"), ("assistant", "an answer"))))
    (tmp_path / "b.json").write_text(json.dumps([{"chat_messages": [{"sender": "human", "text": "hello"}, {"sender": "assistant", "text": "hi"}]}]))
    (tmp_path / "c.json").write_text(json.dumps([{"type": "message", "user": "U1", "text": "slack line", "ts": "1704067200.5"}]))
    (tmp_path / "d.txt").write_text("user: plain\nassistant: text")
    got = {(r.file[-6:], r.role, r.text) for r in conversations.read_exports(spark, f"file://{tmp_path}").collect()}
    assert {("a.jsonl"[-6:], "user", "first question is long enough"), ("b.json", "user", "hello"), ("b.json", "assistant", "hi"), ("c.json", "user", "slack line"), ("/d.txt", "user", "plain"), ("/d.txt", "assistant", "text")} <= got


def test_vault(spark, folder):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    v = Vault(spark, f"file://{folder}/vault", now)
    parsed = markdown.parse(markdown.scan(spark, f"file://{folder}/docs", "c"))
    v.index(parsed)
    assert [r.path for r in v.search("fusion").collect()] == ["two.md"]
    doc = v.get("two.md").first()
    assert v.get(doc.hash[:8]).first().id == doc.id and v.get("vault://c/two.md").first().id == doc.id
    assert [r.path for r in v.multi_get("**/*.md").collect()] == ["adr/one.md", "two.md"]
    v.pin([doc.id])
    assert v.search("fusion").first().pinned
    line = v.render(v.search("fusion"), ["fusion"], "json").first().line
    assert json.loads(line)["path"] == "two.md"
    for fmt in ("csv", "files", "md", "xml"):
        assert "two.md" in v.render(v.search("fusion"), ["fusion"], fmt).first().line
    (folder / "docs/two.md").unlink()
    v.index(markdown.parse(markdown.scan(spark, f"file://{folder}/docs", "c")))
    assert v.search("fusion").count() == 0 and v.table("documents").where("deactivated_reason = 'absent'").count() == 1
    v.build_graphs()
    v.commit(vectors=spark.createDataFrame([(1, 1, 0, [1.0, 0.0]), (2, 2, 0, [0.9, 0.1])], "id long, doc_id long, seq int, embedding array<float>"))
    assert v.query("Spark").count() == 1 and v.memory_rank("Spark").count() == 1 and v.timeline(1).count() == 1
    assert v.find_similar(1).first().id == 2 and v.vsearch([1.0, 0.0]).count() == 1
    v.forget([1])
    assert v.search("Spark").count() == 0 and v.lifecycle_status().first().archived == 2
    formats.export(v.bodies(), f"file://{folder}/export")


def stream(spark, tmp_path, rows, schema):
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(path)
    return spark.readStream.schema(schema).json(path)


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [r.asDict() for r in df.sparkSession.table(name).collect()]


def test_refreshing_dedupe_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "h" if i % 2 else "g", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 5, 100, 500, 550, 1300, 1400, 2500])]
    schema = "id int, k string, at timestamp_ntz"
    batch = {r.id: r.duplicate for r in windows.duplicates_with_refresh(spark.createDataFrame(rows, schema), ["k"], "at", "id", 600).collect()}
    got = drain(jobs.duplicates_with_refresh(stream(spark, tmp_path, rows, schema), ["k"]), tmp_path, "refresh")
    assert {r["id"]: r["duplicate"] for r in got} == batch


def test_turns_and_fixed_dedupe(spark, tmp_path):
    rows = [("s", i, r) for i, r in enumerate("uaauau")] + [("t", i, r) for i, r in enumerate("au")]
    got = drain(jobs.turn_ids(stream(spark, tmp_path, rows, "session string, seq int, role string"), ["session"], F.col("role") == "u"), tmp_path, "turns")
    assert sorted((r["session"], r["seq"], r["turn"]) for r in got) == [("s", 0, 1), ("s", 1, 1), ("s", 2, 1), ("s", 3, 2), ("s", 4, 2), ("s", 5, 3), ("t", 0, 0), ("t", 1, 1)]


def test_debounce_and_sinks(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a.md", "change", t0), ("a.md", "rename", t0 + dt.timedelta(seconds=1)), ("a.md", "change", t0 + dt.timedelta(seconds=30)), ("z.md", "change", t0 + dt.timedelta(hours=2))]
    got = drain(jobs.debounce(stream(spark, tmp_path, rows, "path string, event string, at timestamp_ntz")), tmp_path, "debounce")
    assert sorted((r["path"], r["event"], r["n"]) for r in got if r["path"] == "a.md") == [("a.md", "change", 1), ("a.md", "rename", 2)]
    write = jobs.idempotent_sink(f"file://{tmp_path}/sink", "k")
    one = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    write(one, 0)
    write(one, 0)  # replayed
    write(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"), 1)
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/sink").collect()) == [1, 2, 3]
    good, bad = jobs.dead_letters(one, F.col("k") < 2)
    assert good.count() == 2 and bad.count() == 1


def test_records(spark, tmp_path):
    from vaultframe.sources import records

    (tmp_path / "i.jsonl").write_text("\n".join(json.dumps(x) for x in [{"id": "a", "title": "t", "status": "open", "created_at": "2024-01-01T00:00:00Z", "dependencies": [{"depends_on_id": "b", "type": "blocks"}, {"depends_on_id": "a", "type": "blocks"}]}, {"id": "b", "title": "u", "status": "closed"}]))
    rows, links = records.issues(spark, f"file://{tmp_path}/i.jsonl")
    assert rows.count() == 2 and [tuple(r) for r in links.collect()] == [("a", "b", "blocks")]
    good = {"id": "q1", "query": "x", "gold_evidence": [{"collection": "c", "path": "p", "hash": "old"}]}
    (tmp_path / "g.jsonl").write_text(json.dumps(good))
    g = records.gold(spark, f"file://{tmp_path}/g.jsonl")
    docs = spark.createDataFrame([(1, "c", "p", "new", True)], "id long, collection string, path string, hash string, active boolean")
    assert [tuple(r) for r in records.resolve_gold(g, docs).collect()] == [("q1", 1, 1.0, True)]
    (tmp_path / "h.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good))
    with pytest.raises(ValueError, match="repeated"):
        records.gold(spark, f"file://{tmp_path}/h.jsonl")
    table = records.collections_table(spark, {"global_context": "all", "collections": {"c": {"path": "/p", "context": {"/sub": "part"}}}})
    assert {(r.prefix, r.context) for r in table.collect()} == {("", "all"), ("sub", "part")}
    assert records.transcripts(spark, f"file://{tmp_path}/i.jsonl").count() == 2
    assert spark.read.json(records.spool(rows, f"file://{tmp_path}/spool")).count() == 2
    assert records.summary(rows.select("issue_id").orderBy("issue_id")).splitlines()[2] == '| "a" |'
