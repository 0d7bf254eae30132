"""Structured Streaming twins of the ingest, deduplication and attribution steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from vaultframe.operators.verdicts import WINDOW, Session

LATENESS = "10 minutes"


def event_time(df: DataFrame, at: str) -> DataFrame:
    """Watermarks need TIMESTAMP; NTZ columns are read as UTC."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, LATENESS)


def debounce(changes: DataFrame, seconds: int = 2) -> DataFrame:
    """The last event of each run of a file's changes that are at most so many seconds apart."""
    w = F.session_window("at", f"{seconds} seconds")
    return event_time(changes, "at").groupBy("path", w).agg(F.max_by("event", "at").alias("event"), F.max("at").alias("at"), F.count("*").alias("n")).select("path", "event", "at", "n")


def duplicates_with_refresh(prompts: DataFrame, keys: list[str], seconds: int = 600) -> DataFrame:
    """Adds duplicate: the key was seen less than so many seconds before; each sight refreshes.

    A key's state is the time of its last sight, and expires with the watermark.
    """
    fields = event_time(prompts, "at")
    schema = StructType([*fields.schema.fields, StructField("duplicate", BooleanType())])
    names = [f.name for f in schema.fields]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("at", kind="stable")
            flags = []
            for t in pdf["at"]:
                now = int(t.value // 1000)
                flags.append(last is not None and now - last < seconds * 1_000_000)
                last = now if last is None else max(last, now)
            yield pdf.assign(duplicate=flags)[names]
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return fields.groupBy(*keys).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def fixed_dedupe(rows: DataFrame, keys: list[str], minutes: int = 30) -> DataFrame:
    """The first row of each key within the time that the watermark holds state for."""
    return rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", f"{minutes} minutes").dropDuplicatesWithinWatermark(keys)


def idempotent_sink(path: str, key: str, layout: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: a replayed batch overwrites its own folder, and rows written before are left out."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number).select(key)
            rows = rows.join(old, key, "left_anti")
        rows = layout(rows) if layout else rows
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def turn_ids(lines: DataFrame, keys: list[str], opens: Column) -> DataFrame:
    """Adds turn: openers so far in the session. A session's state is one number."""
    fields = lines.withColumn("opens", opens)
    schema = StructType([*fields.schema.fields, StructField("turn", LongType())])
    names = [f.name for f in schema.fields]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        turn = n + pdf["opens"].astype(int).cumsum()
        state.update((int(turn.iloc[-1]),))
        yield pdf.assign(turn=turn)[names]

    return fields.groupBy(*keys).applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def attributions(turns: DataFrame, usages: DataFrame, minutes: int = 10) -> DataFrame:
    """Final verdicts: usages joined to a turn of the same prompt within the time bound, once the watermark passed."""
    t = event_time(turns, "turn_at").alias("t")
    u = event_time(usages, "used_at").alias("u")
    near = (F.col("u.used_at") >= F.col("t.turn_at") - F.expr(f"interval {minutes} minutes")) & (F.col("u.used_at") <= F.col("t.turn_at") + F.expr(f"interval {minutes} minutes"))
    return u.join(t, (F.col("u.prompt_hash") == F.col("t.prompt_hash")) & near, "leftOuter").select("u.usage_id", "u.prompt_hash", "t.turn_id", "u.used_at")


def dead_letters(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined)."""
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good), rows.where(~good).withColumn("attempts", F.lit(1))


VERDICT = "session string, usage_id long, state string, reason string, references array<string>, revision int"


class _Verdicts(StatefulProcessor):
    """Keeps a session's open evidence; gives a verdict whenever it changed, with the next revision."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", "at long, seq long, kind string, hash string, words array<string>, usage_id long")
        self.given = handle.getMapState("given", "usage_id long", "state string, words string, revision int")
        self.handle = handle

    def _decide(self, key: tuple, session: Session, settled: int) -> Iterator[pd.DataFrame]:
        out, concluded = [], set()
        for usage, (state, reason, references) in session.verdicts(self.window, settled=settled).items():
            before = self.given.getValue((usage,)) if self.given.containsKey((usage,)) else None
            words = "\n".join(references)
            if before is None or (before[0], before[1]) != (state, words):
                revision = 1 if before is None else before[2] + 1
                out.append((key[0], usage, state, reason, list(references), revision))
                self.given.updateValue((usage,), (state, words, revision))
            if state in ("final", "unattributable"):
                concluded.add(usage)
        open_usages = [r[0] for r in session.rows if r[2] == "usage" and r[5] not in concluded]
        kept = session.without(concluded, min([settled, *open_usages]) - self.window * 1_000_000)
        for usage in concluded:
            self.given.removeKey((usage,))
        self.rows.put([tuple(r) for r in kept.rows]) if kept.rows else self.rows.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waits = [t for r in kept.rows if r[2] in ("usage", "human", "stop") for t in (r[0], r[0] + self.window * 1_000_000) if t > settled]
        if waits and any(r[2] == "usage" for r in kept.rows):
            self.handle.registerTimer(min(waits) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["session", "usage_id", "state", "reason", "references", "revision"])

    def _stored(self) -> list[tuple]:
        return [tuple(r) for r in self.rows.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [(int(r.at.value // 1000), int(r.seq), r.kind, r.hash, None if r.words is None else list(r.words), None if pd.isna(r.usage_id) else int(r.usage_id)) for pdf in rows for r in pdf.itertuples()]
        yield from self._decide(key, Session(self._stored() + fresh), settled)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._decide(key, Session(self._stored()), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def verdicts(evidence: DataFrame, window: int = WINDOW) -> DataFrame:
    """Verdicts of ``operators.verdicts`` as a stream: a usage's rows have rising revisions, the last one counts.

    Later answers re-open a provisional verdict. It is final when the watermark has passed the end of its turn and the
    pairing window, so that nothing can change it; then its evidence goes. Needs the RocksDB state store.
    """
    rows = event_time(evidence, "at").select("session", "seq", "at", "kind", "hash", "words", "usage_id")
    return rows.groupBy("session").transformWithStateInPandas(_Verdicts(window), VERDICT, "Append", "EventTime")
