"""Whether what a prompt was given was used: verdicts that are provisional until the turn is over.

evidence(session, seq, at, kind, hash, words, usage_id): ``usage`` rows say that for a prompt (hash)
something with these words was given, ``human`` rows open a turn (hash of the prompt), ``assistant``
rows carry the words of an answer, ``stop`` rows close a turn that was answered. Rows of a session
are in order of (at, seq).

A usage belongs to the only turn of its session with its hash whose opening is at most ``window``
seconds away. Its references are its words that answers of the turn have. The verdict is final once
the turn is over: by a later opening, by a stop after an answer, or at the end. Before that it is
provisional, and more answers change it. A usage with no such turn, or several, is unattributable once a
later turn opened; until then it is pending.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 600


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def fold(evidence: DataFrame, window: int = WINDOW, ended: bool = False) -> DataFrame:
    """(session, usage_id, state, reason, references): all verdicts from all evidence. ended: sessions are over.

    References are a sorted array. Windows run within a session; words meet words by an equi-join.
    """
    order = Window.partitionBy("session").orderBy("at", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = evidence.where("kind <> 'usage'").withColumn("turn", F.sum((F.col("kind") == "human").cast("int")).over(upto))
    # a stop closes the turn only after an answer
    answered = F.max(F.when(F.col("kind") == "assistant", F.col("turn"))).over(upto)
    told = told.withColumn("closes", F.coalesce((F.col("kind") == "stop") & (answered == F.col("turn")), F.lit(False)))
    turns = told.groupBy("session", "turn").agg(F.max(F.when(F.col("kind") == "human", F.col("hash"))).alias("hash"), F.min(F.when(F.col("kind") == "human", F.col("at"))).alias("opened"), F.max("closes").alias("stopped")).where("turn > 0")
    later = F.lead("turn").over(Window.partitionBy("session").orderBy("turn")).isNotNull()
    turns = turns.withColumn("over", later | F.col("stopped") | F.lit(ended))
    usages = evidence.where("kind = 'usage'").select("session", "usage_id", "hash", F.col("at").alias("used"), "words")
    near = F.abs(micros("used") - micros("opened")) <= window * 1_000_000
    paired = usages.join(turns, ["session", "hash"]).where(near).groupBy("session", "usage_id").agg(F.count("*").alias("n"), F.min("turn").alias("turn"), F.max("over").alias("over"))
    one = paired.where("n = 1")
    asked = one.join(usages, ["session", "usage_id"]).select("session", "usage_id", "turn", F.explode(F.array_distinct("words")).alias("word"))
    said = told.where("kind = 'assistant'").select("session", "turn", F.explode("words").alias("word")).distinct()
    found = asked.join(said, ["session", "turn", "word"]).groupBy("session", "usage_id").agg(F.sort_array(F.collect_set("word")).alias("references"))
    newest = turns.groupBy("session").agg(F.max("opened").alias("newest"))
    rows = usages.select("session", "usage_id", "used").join(paired, ["session", "usage_id"], "left").join(found, ["session", "usage_id"], "left").join(newest, "session", "left")
    alone = F.col("n") == 1
    passed = F.coalesce(F.col("newest") > F.col("used"), F.lit(False)) | F.lit(ended)
    state = F.when(alone & F.col("over"), "final").when(alone, "provisional").when(passed, "unattributable").otherwise("pending")
    return rows.select("session", "usage_id", state.alias("state"), F.when(state == "unattributable", F.lit("no-unique-pair")).alias("reason"), F.when(alone, F.coalesce("references", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("references"))


@dataclass
class Session:
    """The same fold over one session's rows, for a stream's state: (at in microseconds, seq, kind, hash, words, usage_id)."""

    rows: list[tuple] = field(default_factory=list)

    def verdicts(self, window: int = WINDOW, ended: bool = False, settled: int | None = None) -> dict[int, tuple[str, str | None, tuple[str, ...]]]:
        """settled: nothing earlier can still come, so that only what lies before it is proven over; None: all is known."""
        turns: list[dict] = []
        usages = []
        known = lambda at: settled is None or at <= settled
        for at, _, kind, sha, words, usage in sorted(self.rows, key=lambda r: r[:2]):
            if kind == "usage":
                usages.append((usage, at, sha, set(words or ())))
            elif kind == "human":
                if turns and known(at):
                    turns[-1]["over"] = True
                turns.append({"hash": sha, "at": at, "said": set(), "answered": False, "over": ended})
            elif turns and kind == "assistant":
                turns[-1]["said"] |= set(words or ())
                turns[-1]["answered"] = True
            elif turns and kind == "stop" and turns[-1]["answered"] and known(at):
                turns[-1]["over"] = True
        newest = max((t["at"] for t in turns if known(t["at"])), default=None)
        out = {}
        for usage, at, sha, words in usages:
            mine = [t for t in turns if t["hash"] == sha and abs(t["at"] - at) <= window * 1_000_000]
            if len(mine) == 1:
                out[usage] = ("final" if mine[0]["over"] and (settled is None or at + window * 1_000_000 <= settled) else "provisional", None, tuple(sorted(words & mine[0]["said"])))
            elif ended or newest is not None and newest > at and (settled is None or at + window * 1_000_000 <= settled):
                out[usage] = ("unattributable", "no-unique-pair", ())
            else:
                out[usage] = ("pending", None, ())
        return out

    def without(self, usages: set[int], before: int) -> Session:
        """What later verdicts can still need: no concluded usages, and of turns that opened before, only the last one's rows."""
        rows = sorted((r for r in self.rows if not (r[2] == "usage" and r[5] in usages)), key=lambda r: r[:2])
        openings = [i for i, r in enumerate(rows) if r[2] == "human" and r[0] <= before]
        keep_from = openings[-1] if openings else 0
        return Session([r for i, r in enumerate(rows) if i >= keep_from or r[2] == "usage"])


def mirror(mirrors: DataFrame, source: DataFrame, references: DataFrame, vault: str) -> DataFrame:
    """(usage_id, state, reason, source_revision, revision, paths): the open mirrors that change now, as they become.

    mirrors(usage_id, source_id, state, source_revision, revision) of a named vault follow source(source_id, state, revision)
    of the general one. A pending or provisional mirror takes a verdict of a revision that it has not taken yet, with its
    finality and with the paths of references(source_id, vault, path) for this vault. It closes where the source is
    unattributable or gone. Revisions only rise, so replays change nothing, and slices end alike in whatever order they come.
    """
    open_ = mirrors.where(F.col("state").isin("pending", "provisional"))
    orphaned = open_.where("source_id is null").select("usage_id", "source_id", F.lit("unattributable").alias("state"), F.lit("no-source").alias("reason"), "source_revision", "revision")
    told = source.where("state <> 'pending'").select("source_id", F.col("state").alias("now"), F.col("revision").alias("newest"))
    due = open_.join(told, "source_id").where("source_revision is null or source_revision < newest")
    taken = due.select("usage_id", "source_id", F.col("now").alias("state"), F.when(F.col("now") == "unattributable", F.lit("source-unattributable")).alias("reason"), F.col("newest").alias("source_revision"), "revision")
    mine = references.where(F.col("vault") == vault).groupBy("source_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    out = orphaned.unionByName(taken).join(mine, "source_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("usage_id", "state", "reason", "source_revision", (F.col("revision") + 1).alias("revision"), F.when(F.col("state") != "unattributable", F.coalesce("paths", empty)).otherwise(empty).alias("paths"))


def mirrored(mirrors: DataFrame, changed: DataFrame) -> DataFrame:
    """The mirrors after ``mirror``'s changes."""
    c = changed.select("usage_id", F.struct("state", "source_revision", "revision").alias("c"))
    both = mirrors.join(c, "usage_id", "left")
    return both.select("usage_id", "source_id", *(F.when(F.col("c").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(x)).alias(x) for x in ("state", "source_revision", "revision")))
