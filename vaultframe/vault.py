"""A vault: versioned tables with a stored keyword index, and the verbs over them.

A change writes what it changes: change files over the tables' bases, posting segments and delete
lists of the index. Then the pointer moves (``Snapshots``). Keyword searches read postings and
metadata, never a text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions import text
from vaultframe.functions.scoring import QUERY_WEIGHTS, cosine
from vaultframe.operators import context, entities, fusion, graph, lifecycle, posting_store, providers, stats, vectors, windows
from vaultframe.plans import hybrid
from vaultframe.sources import formats
from vaultframe.sources.snapshots import Snapshots

#: Results of a search at most, and documents that a model scores.
MOST_RESULTS, MOST_SCORED = 100, 30
PROFILES = {"speed": (1000, 5), "balanced": (2000, 10), "deep": (4000, 15)}  # token budget, results


def _bounded(limit: int) -> int:
    return max(1, min(limit, MOST_RESULTS))


class Vault:
    def __init__(self, spark: SparkSession, root: str, now: Column, stemmed: bool = False):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self.store, self.stemmed = Snapshots(spark, root), stemmed

    # snapshots

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, self.store.state())

    def _index(self, state: dict) -> dict:
        return state["index"] or posting_store.empty(self.stemmed)

    def commit(self, **tables: DataFrame) -> int:
        """Writes new snapshots of whole tables and makes them current together; documents or content index anew."""
        state = self.store.state()
        if "documents" in tables and "body_length" not in tables["documents"].columns:
            content = tables["content"] if "content" in tables else self.store.read("content", state)
            tables["documents"] = tables["documents"].join(content.select("hash", F.length("doc").alias("body_length")), "hash", "left")
        for name, df in tables.items():
            state = self.store.replace(state, name, df)
        if {"documents", "content"} & set(tables):
            state["index"] = posting_store.apply(self.spark, f"{self.root}/index", posting_store.empty(self.stemmed), self._texts(state), None)
        return self.store.move(state)

    def _texts(self, state: dict, ids: DataFrame | None = None) -> DataFrame:
        """(id, path, title, body) of active documents as the index takes them."""
        d = self.store.read("documents", state).where("active").select("id", F.concat_ws("/", "collection", "path").alias("path"), "title", "hash")
        d = d if ids is None else d.join(ids, "id", "left_semi")
        return d.join(self.store.read("content", state).select("hash", F.col("doc").alias("body")), "hash").drop("hash")

    def _changed(self, rows: DataFrame, gone: bool = False, back: bool = False, state: dict | None = None) -> int:
        """Writes changed rows of documents. gone, back: they leave or come back to the index."""
        state = self.store.state() if state is None else state
        rows = self._staged(rows)
        after = self.store.change(state, "documents", rows)
        if gone or back:
            ids = rows.select("id")
            after = after | {"index": posting_store.apply(self.spark, f"{self.root}/index", self._index(state), self._texts(after, ids) if back else None, ids if gone else None)}
        return self.store.move(after)

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Written once beside the tables, for steps that read it several times."""
        at, schema = f"{self.root}/_stage/{uuid.uuid4().hex}", rows.schema
        rows.hint("rebalance").write.parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    # reading

    def documents(self, state: dict | None = None) -> DataFrame:
        return self.store.read("documents", state or self.store.state()).withColumn("effective_at", F.coalesce("authored_at", "modified_at"))

    def _keyword(self, state: dict, q: str, top: int | None, meta: DataFrame | None) -> DataFrame:
        return posting_store.search(self.spark, self._index(state), self._queries(q), top, meta)

    def bodies(self) -> DataFrame:
        return self.table("documents").select("id", "path", "title", "hash", "active", "collection").join(self.table("content").select("hash", F.col("doc").alias("body")), "hash")

    def _queries(self, q: str) -> DataFrame:
        return self.spark.createDataFrame([(1, q)], "qid int, query string")

    def search(self, q: str, limit: int = 10, collections: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Keyword search; recency questions rank by composite, others by the raw score."""
        state = self.store.state()
        meta = hybrid.eligible(self.documents(state), collections, exclude)
        found = self._keyword(state, q, None, meta).select("qid", "id", "score")
        scored = hybrid.ranked_with_metadata(found, meta, self.now, top=None).drop("composite_rank")
        return fusion.raw_primary(scored).where(F.col("rank") <= _bounded(limit))

    def vsearch(self, vector: list[float], limit: int = 10, collections: list[str] | None = None) -> DataFrame:
        meta = hybrid.eligible(self.documents(), collections)
        v = self.table("vectors").join(meta.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        q = F.array(*(F.lit(float(x)) for x in vector))
        hits = v.select(F.lit(1).alias("qid"), "doc_id", F.col("id").alias("fragment_id"), cosine("embedding", q).alias("similarity"))
        return vectors.best_fragment(hits).orderBy(F.desc(F.round("similarity", 9)), "doc_id").limit(_bounded(limit))

    def query(self, q: str, vector: list[float] | None = None, limit: int = 10, expand: providers.Writer | None = None, score: providers.Provider | None = None) -> DataFrame:
        """Keyword and vector lists fused, then the composite rank under query weights and diversity.

        expand and score are seams for outside models: more keyword queries at half the weight of the question's own, and
        relevance scores of the best MOST_SCORED documents. Without them, or where they fail, fusion alone decides.
        """
        state = self.store.state()
        meta = hybrid.eligible(self.documents(state))
        asked = self._queries(q)
        lists = [(self._keyword(state, q, 20, meta).select("qid", "id", "rank"), 2.0)]
        if vector:
            near = windows.top_per(self.vsearch(vector, 20), ["qid"], [F.desc(F.round("similarity", 9)), F.col("doc_id")], 20)
            lists.append((near.select("qid", F.col("doc_id").alias("id"), "rank"), 2.0))
        if expand is not None:
            more, _ = providers.expand(asked, expand)
            found = posting_store.search(self.spark, self._index(state), more.where("kind = 'lex'").select(F.col("n").alias("qid"), F.col("text").alias("query")), 20, meta)
            best = windows.top_per(found.groupBy("id").agg(F.min("rank").alias("place")).withColumn("qid", F.lit(1)), ["qid"], [F.col("place"), F.col("id")], 20)
            lists.append((best.select("qid", "id", "rank"), 1.0))
        fused = windows.top_per(hybrid.fuse(lists).drop("rank"), ["qid"], [F.desc(F.round("fused", 9)), F.col("id")], MOST_SCORED)
        if score is None:
            reranked = fused.withColumn("rerank", F.lit(None).cast("double"))
        else:
            texts = self.bodies().select("id", F.concat_ws("\n", "title", "body").alias("text"))
            scored, _ = providers.rerank(fused.select("qid", "id").join(asked, "qid").join(texts, "id"), score)
            reranked = fused.join(scored.select("qid", "id", F.when(F.col("covered"), F.col("score")).alias("rerank")), ["qid", "id"], "left")
        ranked = hybrid.ranked_with_metadata(fusion.blend_rerank(reranked).select("qid", "id", F.col("blended").alias("score")), meta, self.now, QUERY_WEIGHTS, MOST_SCORED)
        grams = ranked.select("qid", "id", F.col("composite_rank").alias("rank")).join(self.bodies(), "id").select("qid", "id", "rank", text.shingles(F.concat_ws(" ", "title", "body")).alias("grams"))
        return ranked.join(fusion.diversify(grams), ["qid", "id"]).where(F.col("position") <= _bounded(limit)).orderBy("position")

    def facts_for(self, prompt: str, budget: int = 200) -> DataFrame:
        """The facts block for a prompt, if it names an entity with current facts."""
        asked = self.spark.createDataFrame([(1, prompt)], "pid long, prompt string")
        nodes = self.table("entities").select(F.col("id").alias("entity_id"), "name")
        known = nodes.select(F.col("entity_id").alias("object"), F.lit(True).alias("named"))
        t = self.table("triples").join(known, "object", "left").select("id", "subject", "predicate", F.when(F.col("named"), F.col("object")).alias("object_entity"), F.when(F.col("named").isNull(), F.col("object")).alias("object_literal"), "valid_to")
        return context.vault_facts(asked, nodes, t, self.now, budget)

    def find_similar(self, doc: int, limit: int = 5) -> DataFrame:
        v = self.table("vectors").where("seq = 0").select(F.col("doc_id").alias("id"), "embedding")
        return vectors.nearest(v, v.where(F.col("id") == doc), limit)

    def get(self, name: str) -> DataFrame:
        """By docid prefix, path, collection/path or path suffix; the first kind that fits counts."""
        b = self.bodies().where("active")
        full = F.concat_ws("/", "collection", "path")
        kind = F.when((full == name) | (F.concat(F.lit("vault://"), full) == name), 0).when(F.col("path") == name, 1).when(F.col("path").endswith(name), 2).when(F.lit(name).rlike("^#?[0-9a-f]{6,64}$") & F.col("hash").startswith(name.lstrip("#")), 3)
        return b.withColumn("kind", kind).where("kind is not null").orderBy("kind", "id").limit(1).drop("kind")

    def multi_get(self, pattern: str, most_bytes: int = 10240) -> DataFrame:
        """A comma list of paths or a glob; bodies that are too large are left out of the row."""
        b = self.bodies().where("active")
        keep = F.col("path").isin(*[p.strip() for p in pattern.split(",")]) if "," in pattern else F.col("path").rlike(text.glob_pattern(pattern)) | F.concat_ws("/", "collection", "path").rlike(text.glob_pattern(pattern))
        large = F.octet_length("body") > most_bytes
        return b.where(keep).select("id", "collection", "path", large.alias("skipped"), F.when(~large, F.col("body")).alias("body")).orderBy("collection", "path")

    def status(self) -> DataFrame:
        return self.documents().where("active").groupBy("collection").agg(F.count("*").alias("n"), F.max("modified_at").alias("last_modified"))

    def memory_stats(self) -> DataFrame:
        return stats.memory_stats(self.documents(), self.now)

    def lifecycle_status(self) -> DataFrame:
        return stats.lifecycle_stats(self.documents(), self.now)

    def memory_rank(self, q: str, limit: int = 10) -> DataFrame:
        state = self.store.state()
        meta = self.documents(state)
        found = self._keyword(state, q, 30, hybrid.eligible(meta)).select("qid", "id", "score", F.col("rank").alias("raw_rank"))
        both = hybrid.ranked_with_metadata(found, meta, self.now, top=None)
        return both.where((F.col("raw_rank") <= _bounded(limit)) | (F.col("composite_rank") <= _bounded(limit)))

    def timeline(self, doc: int, n: int = 5) -> DataFrame:
        m = self.documents().where("active").select("modified_at", "id", "title")
        return windows.neighbours(m, self.spark.createDataFrame([(doc,)], "id long"), ["modified_at", "id"], n)

    def session_log(self, limit: int = 10) -> DataFrame:
        return self.table("sessions").orderBy(F.desc("started_at"), "session_id").limit(limit).withColumn("minutes", F.round((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 60e6))

    def kg_query(self, entity: str, day: Column | None = None, direction: str = "both") -> DataFrame:
        t = self.table("triples")
        t = t if day is None else entities.as_of(t, day)
        mine = {"outgoing": F.col("subject") == entity, "incoming": F.col("object") == entity}
        return t.where(mine.get(direction, mine["outgoing"] | mine["incoming"]))

    def find_causal_links(self, doc: int, depth: int = 5) -> DataFrame:
        return graph.causal_chain(self.table("relations"), doc, depth)

    def intent_search(self, q: str, intent: str, limit: int = 10) -> DataFrame:
        """Keyword anchors, then meta-paths of the intent, merged."""
        state = self.store.state()
        meta = hybrid.eligible(self.documents(state))
        anchors = self._keyword(state, q, 10, meta).select("id", "score")
        reached = graph.meta_path_search(self.table("relations"), anchors, intent, meta)
        return graph.merge_traversal(anchors, reached).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)

    def evolution(self, doc: int, limit: int = 10) -> DataFrame:
        e = self.table("evolution").where(F.col("memory_id") == doc)
        return e.join(self.table("documents").where("active").select(F.col("id").alias("triggered_by"), "title"), "triggered_by").orderBy(F.desc("created_at"), F.desc("version")).limit(max(1, min(100, limit)))

    def profile(self, limit: int = 20) -> DataFrame:
        """The newest preferences, decisions and hubs by authorship."""
        keep = self.documents().where("active").where(F.col("content_type").isin("preference", "decision", "hub"))
        return windows.top_per(keep, ["content_type"], [F.desc("effective_at"), F.col("id")], limit)

    def diary_read(self, domain: str, limit: int = 10) -> DataFrame:
        return self.documents().where((F.col("collection") == "diary") & (F.col("domain") == domain) & F.col("active")).orderBy(F.desc("modified_at"), F.desc("id")).limit(limit)

    def render(self, results: DataFrame, terms: list[str], fmt: str = "json") -> DataFrame:
        named = self.bodies().select("id", "title", "path", "body", text.docid("hash").alias("docid"))
        rows = results.select("id", "rank", "score").join(named, "id").select("rank", "docid", "path", "title", "score", text.snippet("body", terms).alias("snippet"))
        return formats.render(rows, fmt)

    # changing

    def index(self, parsed: DataFrame, collections: list[str] | None = None) -> int:
        """Adds or updates documents(collection, path, title, body, content_type, tags, authored_at ...) of files.

        parsed lists all files of the named collections, or of all. Files that are missing are deactivated as absent, if
        files own their rows; rows of other writers stay. Absent documents whose files are there again come back; what was
        forgotten or archived stays so, and is not updated. Only changed rows, new texts and their postings are written.
        """
        state = self.store.state()
        old = self.store.read("documents", state)
        taken = ["title", "content_type", "tags", "authored_at", "domain", "workstream", "review_by"]
        given = [c for c in taken if c in parsed.columns]
        new = parsed.select("collection", "path", F.struct(F.sha2("body", 256).alias("hash"), "body", *given).alias("n"))
        joined = new.join(old.select("collection", "path", F.struct(*old.columns).alias("o")), ["collection", "path"], "full_outer")
        listed = F.lit(True) if collections is None else F.col("collection").isin(*collections)
        kept_out = ~F.col("o.active") & F.coalesce(F.col("o.deactivated_reason").isin("forget", "archive"), F.lit(False))
        kind = (
            F.when(F.col("o").isNull(), "added")
            .when(F.col("n").isNull(), F.when(F.col("o.active") & listed & (F.col("o.origin") == "fs"), "absent"))
            .when(kept_out, None)
            .when(~F.col("o.active"), "back")
            .when(F.col("n.hash") != F.col("o.hash"), "changed")
            .when(F.coalesce(F.col("n.title") != F.col("o.title"), F.lit(False)), "retitled")
            .when(F.coalesce(F.col("o.origin") != "fs", F.lit(True)), "adopted")
        )
        stage = self._staged(joined.withColumn("kind", kind).where("kind is not null"))
        ids = self._new_ids(stage.where("kind = 'added'").select("collection", "path"), old)
        there, moved = F.col("kind") != "absent", F.col("kind").isin("added", "changed", "back")
        updated = lambda c: F.when(there, F.coalesce(f"n.{c}", f"o.{c}") if c in given else F.col(f"o.{c}")).otherwise(F.col(f"o.{c}"))
        own = {
            "id": F.coalesce("o.id", "new_id"),
            "collection": F.col("collection"),
            "path": F.col("path"),
            "hash": F.when(there, F.col("n.hash")).otherwise(F.col("o.hash")),
            "created_at": F.coalesce("o.created_at", self.now),
            "modified_at": F.when(moved, self.now).otherwise(F.col("o.modified_at")),
            "active": there,
            "deactivated_reason": F.when(~there, "absent"),
            "origin": F.when(there, "fs").otherwise(F.col("o.origin")),
            "quality_score": F.when(moved, text.quality_score("n.body")).otherwise(F.col("o.quality_score")),
            "confidence": F.coalesce("o.confidence", F.lit(0.5)),
            "duplicate_count": F.coalesce("o.duplicate_count", F.lit(1)),
            "revision_count": F.coalesce("o.revision_count", F.lit(1)) + F.when(F.col("kind").isin("changed", "back") & (F.col("n.hash") != F.col("o.hash")), 1).otherwise(0),
            "access_count": F.coalesce("o.access_count", F.lit(0)),
            "pinned": F.coalesce("o.pinned", F.lit(False)),
            "memory_type": F.coalesce("o.memory_type", text.memory_type("path", F.col("n.content_type") if "content_type" in given else F.lit(None).cast("string"), F.col("n.body"))),
            "body_length": F.when(there, F.length("n.body")).otherwise(F.col("o.body_length")),
        }
        rows = self._staged(stage.join(ids, ["collection", "path"], "left").select(*((own[c] if c in own else updated(c)).alias(c) for c in old.columns), F.when(there, F.col("n.body")).alias("body"), "kind"))
        texts = rows.where("body is not null").select("hash", F.col("body").alias("doc"), self.now.alias("created_at")).dropDuplicates(["hash"])
        after = self.store.change(state, "content", texts.join(self.store.read("content", state).select("hash"), "hash", "left_anti"))
        after = self.store.change(after, "documents", rows.drop("body", "kind"))
        added = rows.where("kind in ('added', 'changed', 'back', 'retitled')").select("id", F.concat_ws("/", "collection", "path").alias("path"), "title", "body")
        after = after | {"index": posting_store.apply(self.spark, f"{self.root}/index", self._index(state), added, rows.where("kind = 'absent'").select("id"))}
        return self.store.move(after)

    def _new_ids(self, keys: DataFrame, old: DataFrame) -> DataFrame:
        """(collection, path, new_id): ids above all that are there, in order of the keys.

        A row's id is its place in its partition plus the rows of the partitions before it; only these counts are summed.
        """
        placed = self._staged(keys.repartitionByRange("collection", "path").sortWithinPartitions("collection", "path").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
        counts = placed.groupBy("part").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.sum("n").over(windows.Window.orderBy("part")) - F.col("n")).select("part", "before")
        top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        return placed.join(before, "part").join(F.broadcast(top)).select("collection", "path", (F.col("top") + F.col("before") + F.col("at") + 1).alias("new_id"))

    def save_memory(self, rows: DataFrame) -> DataFrame:
        """Saves memories(seq, collection, path, title, body, content_type, ...) by ``lifecycle.save_batch``; returns each row's outcome."""
        state = self.store.state()
        old = self.store.read("documents", state)
        outcomes, changed = lifecycle.save_batch(old, rows, self.now)
        outcomes, changed = self._staged(outcomes), self._staged(changed)
        fresh = changed.where("id is null").select("collection", "path")
        ids = self._staged(self._new_ids(fresh, old))
        full = self._staged(changed.join(ids, ["collection", "path"], "left").withColumn("id", F.coalesce("id", "new_id")).drop("new_id"))
        texts = full.where("body is not null").select("hash", F.col("body").alias("doc"), self.now.alias("created_at")).dropDuplicates(["hash"])
        after = self.store.change(state, "content", texts.join(self.store.read("content", state).select("hash"), "hash", "left_anti"))
        after = self.store.change(after, "documents", full.drop("body"))
        added = full.where("body is not null").select("id", F.concat_ws("/", "collection", "path").alias("path"), "title", "body")
        after = after | {"index": posting_store.apply(self.spark, f"{self.root}/index", self._index(state), added, None)}
        self.store.move(after)
        return outcomes.join(ids, ["collection", "path"], "left").withColumn("id", F.coalesce("id", "new_id")).drop("new_id")

    def _change(self, ids: list[int], gone: bool = False, **columns: Column) -> int:
        state = self.store.state()
        hit = self.store.read("documents", state).where(F.col("id").isin(*ids))
        return self._changed(hit.withColumns(columns), gone, state=state)

    def pin(self, ids: list[int], on: bool = True) -> int:
        return self._change(ids, pinned=F.lit(on))

    def snooze(self, ids: list[int], until: Column) -> int:
        return self._change(ids, snoozed_until=until)

    def forget(self, ids: list[int]) -> int:
        return self._change(ids, True, active=F.lit(False), deactivated_reason=F.lit("forget"))

    def touch(self, ids: list[int]) -> int:
        return self._change(ids, access_count=F.col("access_count") + 1, last_accessed_at=self.now)

    def lifecycle_sweep(self, policy: dict[str, int] | None = None) -> int:
        state = self.store.state()
        found = lifecycle.archive_candidates(self.store.read("documents", state), self.now, policy)
        return self._changed(found.withColumns({"active": F.lit(False), "archived_at": self.now, "deactivated_reason": F.lit("archive")}), True, state=state)

    def lifecycle_restore(self, collection: str | None = None) -> int:
        """Archived documents come back, also to the index."""
        state = self.store.state()
        found = self.store.read("documents", state).where(F.col("archived_at").isNotNull() & ~F.col("active"))
        found = found if collection is None else found.where(F.col("collection") == collection)
        return self._changed(found.withColumns({"active": F.lit(True), "archived_at": F.lit(None), "deactivated_reason": F.lit(None)}), back=True, state=state)

    def build_graphs(self, threshold: float = 0.7) -> int:
        """Temporal backbone and semantic edges, merged into the relations."""
        meta = self.documents().where("active")
        back = windows.successors(meta.select("modified_at", "id"), ["modified_at", "id"]).select(F.col("id").alias("source_id"), F.col("next_id").alias("target_id"), F.lit("temporal").alias("relation_type"), F.lit(1.0).alias("weight"))
        v = self.table("vectors").where("seq = 0").select(F.col("doc_id").alias("id"), "embedding")
        near = vectors.semantic_graph(v, threshold).withColumn("relation_type", F.lit("semantic")).select("source_id", "target_id", "relation_type", "weight")
        old = self.table("relations").select("source_id", "target_id", "relation_type", "weight")
        return self.commit(relations=graph.upsert(old, back.unionByName(near)))

    def rename_collection(self, old: str, new: str) -> int:
        state = self.store.state()
        hit = self.store.read("documents", state).where(F.col("collection") == old)
        return self._changed(hit.withColumn("collection", F.lit(new)), back=True, state=state)

    def sync_issues(self, issues: DataFrame, links: DataFrame) -> int:
        """Issue tracker: upserts issues and their links, without self-links."""
        kinds = F.create_map(*(F.lit(x) for kv in {"blocks": "causal", "parent-child": "supporting", "related": "semantic", "discovered-from": "supporting"}.items() for x in kv))
        old = self.table("issues").join(issues.select("issue_id"), "issue_id", "left_anti")
        good = links.where("source <> target").withColumn("kind", F.coalesce(F.element_at(kinds, F.col("kind")), F.lit("semantic")))
        return self.commit(issues=old.unionByName(issues, allowMissingColumns=True), issue_links=self.table("issue_links").unionByName(good).distinct())
