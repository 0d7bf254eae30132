"""A stored inverted index: immutable posting segments, delete lists, merges by size.

A segment holds, sorted by term, (term, id, wtf, dl) of the documents that one run added, as blocks
(a term with its values of some documents), and their lengths apart. A run has a number. Replacing or removing a document writes its id with the
run's number into a delete list: it hides the document's postings of all earlier runs. A search
reads only the row groups whose terms can start with a query word, and no text. The number of
documents and of their tokens are kept in the state, so that BM25 needs no scan for them.

Segments of like size are merged once there are FAN of them; hidden postings go then, and a merged
segment counts as of its newest run. Delete lists go when all segments are newer.

The state is a small dict for the caller's manifest; files are never changed in place, so a state
stays readable until its files are deleted.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions.stem import stems
from vaultframe.functions.text import spaced
from vaultframe.operators import fts
from vaultframe.sources.scratch import delete, written

#: Segments of one size class that are merged together; a class is a power of it.
FAN = 4
SEGMENT = "term string, id long, wtf double, dl long"
BLOCK = "term string, ids array<long>, wtfs array<double>, dls array<long>"
#: Bytes of texts whose postings are grouped at a time, and rows of a batch.
PART_BYTES, OUT_ROWS = 1 << 24, 10_000


def empty(stemmed: bool = False) -> dict:
    return {"segments": [], "deleted": [], "run": 0, "docs": 0, "tokens": 0, "stemmed": stemmed}


def _lists(terms: pa.Array, starts: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks, one of each term; starts: where its values begin in the columns, and the end."""
    offsets = pa.array(starts, pa.int32())
    whole = pa.RecordBatch.from_arrays([terms, *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)], ["term", "ids", "wtfs", "dls"])
    for i in range(0, whole.num_rows, OUT_ROWS):
        yield whole.slice(i, OUT_ROWS)


def _blocks_of(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The blocks of some texts (id and the fields, words apart by spaces)."""
    words, docs, weights, n = [], [], [], part.num_rows
    for field, weight in fts.WEIGHTS.items():
        lists = pc.split_pattern(part.column(field).fill_null(""), " ")
        flat = lists.flatten()
        word = pc.not_equal(flat, "")
        words.append(flat.filter(word))
        docs.append(pc.list_parent_indices(lists).filter(word).to_numpy())
        weights.append(np.full(len(docs[-1]), weight))
    doc, terms = np.concatenate(docs).astype(np.int64), pa.concat_arrays(words).dictionary_encode()
    ids, dl = part.column("id").to_numpy(), np.bincount(doc, minlength=n)
    yield from _lists(pa.array([None], pa.string()), np.array([0, n]), ids, np.zeros(n), dl)
    pairs, at = np.unique(terms.indices.to_numpy().astype(np.int64) * n + doc, return_inverse=True)
    wtf, doc = np.bincount(at, np.concatenate(weights), len(pairs)), pairs % n
    yield from _lists(terms.dictionary, np.searchsorted(pairs // n, np.arange(len(terms.dictionary) + 1)), ids[doc], wtf, dl[doc])


def counted(docs: DataFrame) -> DataFrame:
    """The blocks of docs(id, path, title, body), of PART_BYTES of texts at a time; those of null terms hold all lengths.

    A document is one row, so that its words are counted where it is read.
    """
    texts = docs.select(F.col("id").cast("long").alias("id"), *(spaced(f).alias(f) for f in fts.WEIGHTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = sum(pc.binary_length(b.column(f)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fts.WEIGHTS)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // PART_BYTES)) + 1
            for i, k in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i < k:
                    yield from _blocks_of(b.slice(i, k - i))

    return texts.mapInArrow(run, BLOCK)


def _packed(rows: DataFrame) -> DataFrame:
    """rows(term, id, wtf, dl) as blocks, in ranges of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = b.column("term").dictionary_encode().indices.to_numpy()
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                yield from _lists(b.column("term").take(pa.array(first)), np.append(first, b.num_rows), *(b.column(c).to_numpy() for c in ("id", "wtf", "dl")))

    return rows.select("term", "id", "wtf", "dl").repartitionByRange("term", "id").sortWithinPartitions("term", "id").mapInArrow(run, BLOCK)


def _flat(blocks: DataFrame) -> DataFrame:
    """(id, wtf, dl) of blocks, with their other columns."""
    keys = [c for c in blocks.columns if c not in ("ids", "wtfs", "dls")]
    return blocks.select(*keys, F.explode(F.arrays_zip("ids", "wtfs", "dls")).alias("p")).select(*keys, F.col("p.ids").alias("id"), F.col("p.wtfs").alias("wtf"), F.col("p.dls").alias("dl"))


def _stored(spark: SparkSession, segment: dict) -> DataFrame:
    """A segment's blocks and its run; segments of earlier versions hold rows, which are blocks of one document."""
    path = f"{segment['path']}/postings"
    if segment.get("blocks"):
        blocks = spark.read.schema(BLOCK).parquet(path)
    else:
        blocks = spark.read.schema(SEGMENT).parquet(path).select("term", *(F.array(c).alias(f"{c}s") for c in ("id", "wtf", "dl")))
    return blocks.withColumn("run", F.lit(segment["run"]))


def _made(spark: SparkSession, path: str, run: int) -> dict:
    size = _lengths(spark, path).agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    rows = spark.read.schema(BLOCK).parquet(f"{path}/postings").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first()["n"]
    return {"path": path, "run": run, "rows": rows, "docs": size["docs"], "tokens": size["tokens"], "blocks": True}


def _index(docs: DataFrame, root: str, run: int, stemmed: bool) -> dict:
    """A segment of docs. Texts are cut once: blocks are written as they come, then dealt out by term."""
    spark, path = docs.sparkSession, f"{root}/{uuid.uuid4().hex}"
    counted(docs).write.parquet(f"{path}/counted")
    found = spark.read.schema(BLOCK).parquet(f"{path}/counted")
    _flat(found.where("term is null")).where("dl > 0").select("id", "dl").hint("rebalance").write.parquet(f"{path}/lengths")
    blocks, first = found.where("term is not null"), F.col("ids").getItem(0)
    if stemmed:
        blocks = _packed(_flat(blocks).withColumn("term", stems("term")).groupBy("term", "id", "dl").agg(F.sum("wtf").alias("wtf")))
    else:
        blocks = blocks.repartitionByRange("term", first).sortWithinPartitions("term", first)
    blocks.write.parquet(f"{path}/postings")
    delete(spark, f"{path}/counted")
    return _made(spark, path, run)


def _write(rows: DataFrame, root: str, run: int) -> dict:
    spark, path = rows.sparkSession, f"{root}/{uuid.uuid4().hex}"
    _packed(rows).write.parquet(f"{path}/postings")
    kept = _flat(spark.read.schema(BLOCK).parquet(f"{path}/postings"))
    kept.groupBy("id").agg(F.max("dl").alias("dl")).hint("rebalance").write.parquet(f"{path}/lengths")
    return _made(spark, path, run)


def _lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, dl long").parquet(f"{path}/lengths")


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return spark.createDataFrame([], schema) if out is None else out


def _hidden(spark: SparkSession, state: dict) -> DataFrame:
    """(id, hidden): the newest run that took the document out."""
    lists = [spark.read.schema("id long").parquet(d["path"]).withColumn("run", F.lit(d["run"])) for d in state["deleted"]]
    return _union(spark, lists, "id long, run int").groupBy("id").agg(F.max("run").alias("hidden"))


def _shown(rows: DataFrame, spark: SparkSession, state: dict) -> DataFrame:
    """rows(id, run, ...) without what delete lists hide."""
    if not state["deleted"]:
        return rows
    return rows.join(_hidden(spark, state), "id", "left").where("hidden is null or hidden <= run").drop("hidden")


def postings(spark: SparkSession, state: dict, segments: list[dict] | None = None) -> DataFrame:
    """(term, id, wtf, dl) as they count now."""
    parts = [_stored(spark, s) for s in (state["segments"] if segments is None else segments)]
    return _shown(_flat(_union(spark, parts, BLOCK + ", run int")), spark, state).select("term", "id", "wtf", "dl")


def lengths(spark: SparkSession, state: dict) -> DataFrame:
    parts = [_lengths(spark, s["path"]).withColumn("run", F.lit(s["run"])) for s in state["segments"]]
    return _shown(_union(spark, parts, "id long, dl long, run int"), spark, state).drop("run")


def apply(spark: SparkSession, root: str, state: dict, added: DataFrame | None, gone: DataFrame | None) -> dict:
    """The state after a run that adds or replaces added(id, path, title, body) and removes gone(id)."""
    run = state["run"] + 1
    out = state | {"run": run, "segments": list(state["segments"]), "deleted": list(state["deleted"])}
    ids = [df.select("id") for df in (added, gone) if df is not None]
    if state["segments"] and ids:
        leaving = lengths(spark, state).join(_union(spark, ids, "id long").distinct(), "id", "left_semi")
        path = f"{root}/{uuid.uuid4().hex}"
        leaving.hint("rebalance").write.parquet(path)
        left = spark.read.schema("id long, dl long").parquet(path).agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        if not left["docs"]:
            delete(spark, path)
        else:
            out["deleted"].append({"path": path, "run": run})
            out |= {"docs": out["docs"] - left["docs"], "tokens": out["tokens"] - left["tokens"]}
    if added is not None:
        made = _index(added, root, run, state["stemmed"])
        if not made["rows"]:
            delete(spark, made["path"])
        else:
            out["segments"].append(made)
            out |= {"docs": out["docs"] + made["docs"], "tokens": out["tokens"] + made["tokens"]}
    return _merged(spark, root, out)


def _size_class(segment: dict) -> int:
    return int(math.log(max(segment["rows"], 1), FAN))


def _merged(spark: SparkSession, root: str, state: dict) -> dict:
    """Merges size classes that are full; a merge may fill the next class."""
    while True:
        classes: dict[int, list[dict]] = {}
        for s in state["segments"]:
            classes.setdefault(_size_class(s), []).append(s)
        full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
        if full is None:
            break
        made = _write(postings(spark, state, full), root, max(s["run"] for s in full))
        rest = [s for s in state["segments"] if s not in full]
        state = state | {"segments": [*rest, *([made] if made["rows"] else [])]}
    oldest = min((s["run"] for s in state["segments"]), default=state["run"] + 1)
    return state | {"deleted": [d for d in state["deleted"] if d["run"] > oldest]}


def search(spark: SparkSession, state: dict, queries: DataFrame, top: int | None = 20, eligible: DataFrame | None = None) -> DataFrame:
    """BM25 like ``fts.bm25`` from the stored index alone, for queries(qid, query).

    Few query words also prune the scan (``fts.meet`` tests terms as they are read); with more, the join picks the postings.
    """
    words = fts.query_words(queries)
    if state["stemmed"]:
        words = words.withColumn("word", stems("word")).distinct()
    parts = [_stored(spark, s) for s in state["segments"]]
    met = _flat(fts.meet(_union(spark, parts, BLOCK + ", run int"), words))  # a block meets words once, not each of its documents
    hits = written(_shown(met, spark, state).groupBy("qid", "word", "id", "dl").agg(F.sum("wtf").alias("f")), "hits")  # counted and ranked
    corpus = spark.createDataFrame([(state["docs"], state["tokens"] / max(state["docs"], 1))], "n_docs long, avgdl double")
    return fts.rank(hits, words, corpus, top, eligible)
