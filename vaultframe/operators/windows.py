"""Ranks, neighbourhoods, gaps and running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int | None, name: str = "rank") -> DataFrame:
    """Adds a rank from 1 within each key; rows beyond n go before the shuffle completes (Spark's group limit)."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col(name) <= n)


def latest_per(df: DataFrame, keys: list[str], at: str, tie: str, n: int = 1) -> DataFrame:
    return top_per(df, keys, [F.desc(at), F.desc(tie)], n, "recent")


def duplicates_with_refresh(df: DataFrame, keys: list[str], at: str, tie: str, seconds: int) -> DataFrame:
    """Adds ``duplicate``: the same keys were seen less than so many seconds before; each sight counts."""
    by = Window.partitionBy(*keys).orderBy(at, tie)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(by).cast("timestamp"))
    return df.withColumn("duplicate", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


def fixed_windows(df: DataFrame, keys: list[str], at: str, tie: str, seconds: int) -> DataFrame:
    """Adds ``opens`` and ``opened_at``: rows within so many seconds of the row that opened the window join it.

    The windows of a key depend on one another, so a key's times are folded in order; only
    their times are held, and the result is exploded again.
    """
    unit = F.unix_micros(F.col(at).cast("timestamp"))
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_set(unit)).alias("times"))
    starts = F.aggregate(
        "times",
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= seconds * 1_000_000), F.concat(acc, F.array(t))).otherwise(acc),
    )
    openings = grouped.select(*keys, F.explode(starts).alias("opened"))
    marked = df.withColumn("micros", unit).join(openings, keys).where("opened <= micros").groupBy(*keys, at, tie).agg(F.max("opened").alias("opened"))
    return marked.withColumn("opens", F.row_number().over(Window.partitionBy(*keys, "opened").orderBy(at, tie)) == 1).withColumn("opened_at", F.timestamp_micros("opened").cast("timestamp_ntz")).drop("opened")


def segments(df: DataFrame, keys: list[str], order: list[str], opens: Column, name: str = "segment") -> DataFrame:
    """Adds the number of the segment, a new one at each opening row."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(opens.cast("int")).over(by))


def neighbours(df: DataFrame, focus: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows up to n places before or after each focus(id) in the total order; offset is negative before it.

    Instead of numbering the whole table, each focus takes the n next and n previous rows: a
    top-n on either side, which Spark evaluates without a global sort.
    """
    at = df.select(*order).join(focus, "id")
    outs = []
    key = F.struct(*order)
    for sign in (-1, 1):
        mine = at.select(F.col("id").alias("focus_id"), key.alias("focus_at"))
        side = df.join(F.broadcast(mine), (key < F.col("focus_at")) if sign < 0 else (key > F.col("focus_at")))
        by = Window.partitionBy("focus_id").orderBy(*(F.desc(o) if sign < 0 else F.asc(o) for o in order))
        outs.append(side.withColumn("offset", F.row_number().over(by) * sign).where(F.abs("offset") <= n))
    me = df.join(focus, "id", "left_semi").select("*", F.col("id").alias("focus_id"), F.lit(0).alias("offset"))
    return outs[0].drop("focus_at").unionByName(me).unionByName(outs[1].drop("focus_at"))


def successors(df: DataFrame, order: list[str], ids: str = "id") -> DataFrame:
    """(id, next_id) in the total order without sorting the table in one task.

    Rows are dealt out by the day of the first order column; inside a day the next row is a window's, and each
    day's last row meets the first row of the next day that has any (one row per day is sorted).
    """
    day = F.col(order[0]).cast("date")
    by = Window.partitionBy("part").orderBy(*order)
    cut = df.select(*dict.fromkeys([*order, ids])).withColumn("part", F.datediff(day, F.lit("1970-01-01").cast("date")))
    inner = cut.withColumn("next_id", F.lead(ids).over(by)).withColumn("last", F.lead(ids).over(by).isNull())
    heads = cut.groupBy("part").agg(F.min(F.struct(*order)).alias("head"))
    chain = heads.withColumn("following", F.lead("head").over(Window.orderBy("part"))).select("part", "following")
    joined = inner.join(chain, "part").withColumn("next_id", F.when(F.col("last"), F.col(f"following.{ids}")).otherwise(F.col("next_id")))
    return joined.where("next_id is not null").select(F.col(ids).alias("id"), "next_id")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order until the first that would exceed the budget; the first row is always kept."""
    by = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("rn", F.row_number().over(by)).withColumn("spent", F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("spent") <= budget) | (F.col("rn") == 1))
