"""What every trace of a surfacing run must hold; one row for each breach.

Traces are tables: traces (one row each), and by trace_id their candidates, composite scores,
admitted candidates, final paths, injected entries and final order. Order matters only within a
trace, so each rule is a join on trace_id or a window over it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The legs that only an expansion feeds, and the milliseconds kept for the end of a run.
EXPANSION_LEGS = ["expansion-lex", "expansion-vec"]
RESERVE_MS = 500

#: Rules whose breach fails a run; the others are only observed.
ENFORCED = {"trace-complete": True, "admission-honored": True, "single-ranking-key": True, "expansion-mass-cap": True, "rerank-coverage-or-fallback": False, "no-expansion-leak-on-failed-rerank": True, "degeneracy-gate-honored": True, "metadata-band-only": True, "finalization-fits-reserve": False}


def _row(df: DataFrame, rule: str, subject, breach) -> DataFrame:
    return df.select("trace_id", F.lit(rule).alias("rule"), F.lit(ENFORCED[rule]).alias("enforced"), subject.cast("string").alias("subject"), F.lit(breach).alias("breach") if isinstance(breach, str) else breach.alias("breach"))


def completeness(t: DataFrame, candidates: DataFrame, composite: DataFrame, paths: DataFrame, injected: DataFrame) -> DataFrame:
    """An outcome is recorded; an empty one has a reason and no paths, an injected one paths that a pooled candidate and a composite score stand for, in the order injected."""
    rule, none = "trace-complete", F.lit(None)
    count = paths.groupBy("trace_id").agg(F.count("*").alias("n_paths"))
    full = t.join(count, "trace_id", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))
    on = full.where("outcome = 'injected'")
    mine = paths.join(on.select("trace_id"), "trace_id", "left_semi")
    pooled = candidates.where("pooled").select("trace_id", "path").distinct()
    # both lists side by side, place by place
    both = paths.select("trace_id", "n", "path").join(injected.select("trace_id", "n", F.col("path").alias("entry")), ["trace_id", "n"], "full_outer").where(~F.col("path").eqNullSafe(F.col("entry"))).select("trace_id").distinct()
    parts = [
        _row(full.where("outcome is null"), rule, none, "no outcome"),
        _row(full.where("outcome = 'empty' and empty_reason is null"), rule, none, "empty without a reason"),
        _row(full.where("outcome = 'empty' and n_paths > 0"), rule, none, "empty with paths"),
        _row(on.where("n_paths = 0"), rule, none, "injected without paths"),
        _row(mine.join(pooled, ["trace_id", "path"], "left_anti"), rule, F.col("path"), "no pooled candidate"),
        _row(mine.join(composite.select("trace_id", "path").distinct(), ["trace_id", "path"], "left_anti"), rule, F.col("path"), "no composite score"),
        _row(on.where("not has_injection"), rule, none, "no injection record"),
        _row(on.where("has_injection").join(both, "trace_id", "left_semi"), rule, none, "entries differ from paths"),
        _row(on.where("not has_admission"), rule, none, "no admission record"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def ranking(t: DataFrame, injected: DataFrame, final_order: DataFrame) -> DataFrame:
    """Injected entries follow the final order, by band and falling key, and no composite ordered them.

    An entry fails if the order doesn't have it behind all entries before; from the first failure on all fail.
    """
    rule = "single-ranking-key"
    on = t.where("outcome = 'injected'")
    ordered = final_order.select("trace_id").distinct()
    bare = on.join(ordered, "trace_id", "left_anti")
    audited = on.where("has_injection").join(ordered, "trace_id", "left_semi")
    by = Window.partitionBy("trace_id").orderBy("n")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    e = injected.join(audited.select("trace_id"), "trace_id", "left_semi").join(final_order.select("trace_id", "candidate", F.col("n").alias("place"), "band", "key"), ["trace_id", "candidate"], "left")
    e = e.withColumn("bad", F.col("place").isNull() | F.coalesce(F.col("place") <= F.max("place").over(before), F.lit(False)))
    e = e.withColumn("failed", F.max("bad").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"p_band": F.lag("band").over(by), "p_key": F.lag("key").over(by)})
    fine = e.where("not failed and p_band is not null")
    parts = [
        _row(on.where("ranking_key = 'composite'"), rule, F.lit(None), "ordered by composite"),
        _row(bare, rule, F.lit(None), "no final order"),
        _row(on.where("not has_injection").join(ordered, "trace_id", "left_semi"), rule, F.lit(None), "no injection record"),
        _row(e.where("failed"), rule, F.col("candidate"), "not in the final order"),
        _row(fine.where("band < p_band"), rule, F.col("candidate"), "below a later band"),
        _row(fine.where("band = p_band and key > p_key"), rule, F.col("candidate"), "key rises"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def violations(traces: DataFrame, candidates: DataFrame, composite: DataFrame, admitted: DataFrame, paths: DataFrame, injected: DataFrame, final_order: DataFrame) -> DataFrame:
    """(trace_id, rule, enforced, subject, breach) of all rules."""
    none = F.lit(None)
    on = traces.where("outcome = 'injected'")
    acted = F.col("rerank_attempted") & ~F.col("rerank_failed") & F.col("ordering_applied")
    has_fusion = traces.where("current_mass is not null")
    covered = candidates.where("covered").select("trace_id", "path").distinct()
    # paths that only expansion legs brought, without a gate that let them pass
    legs = candidates.where("pooled").groupBy("trace_id", "path").agg(F.min(F.col("leg").isin(*EXPANSION_LEGS)).alias("only")).where("only").drop("only")
    passed = candidates.where((F.col("vault") != "skill") & (F.col("current_supported") | F.col("gate_passed"))).select("trace_id", "path").distinct()
    by = Window.partitionBy("trace_id").orderBy("n")
    neighbours = final_order.join(on.select("trace_id"), "trace_id", "left_semi").withColumns({"p_band": F.lag("band").over(by), "p_key": F.lag("key").over(by), "p_candidate": F.lag("candidate").over(by)})
    parts = [
        completeness(traces, candidates, composite, paths, injected),
        _row(injected.join(on.where("has_admission and has_injection").select("trace_id"), "trace_id", "left_semi").join(admitted.select("trace_id", "candidate").distinct(), ["trace_id", "candidate"], "left_anti"), "admission-honored", F.col("candidate"), "not admitted"),
        ranking(traces, injected, final_order),
        _row(has_fusion.where("current_mass > 0 and discounted_mass >= current_mass"), "expansion-mass-cap", none, "discounted mass is not below"),
        _row(has_fusion.where("current_mass <= 0 and discounted_mass > 0 and not prior_certified"), "expansion-mass-cap", none, "discounted mass without certificate"),
        _row(has_fusion.where("current_mass <= 0 and expansion_contribution > 0"), "expansion-mass-cap", none, "expansion without current mass"),
        _row(has_fusion.where("admitted_current < protected_slots"), "expansion-mass-cap", none, "protected slots"),
        _row(paths.join(on.where(acted).select("trace_id"), "trace_id", "left_semi").join(covered, ["trace_id", "path"], "left_anti"), "rerank-coverage-or-fallback", F.col("path"), "not covered"),
        _row(paths.join(on.where(~F.coalesce(acted, F.lit(False))).select("trace_id"), "trace_id", "left_semi").join(legs, ["trace_id", "path"], "left_semi").join(passed, ["trace_id", "path"], "left_anti"), "no-expansion-leak-on-failed-rerank", F.col("path"), "not arbitrated"),
        _row(traces.where("gated and degenerate and ordering_applied"), "degeneracy-gate-honored", none, "degenerate scores applied"),
        _row(neighbours.where("band = p_band and key = p_key and not (p_candidate < candidate)"), "metadata-band-only", F.col("candidate"), "tie out of order"),
        _row(traces.where(F.col("finalization_ms") > RESERVE_MS), "finalization-fits-reserve", none, "over the reserve"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)
