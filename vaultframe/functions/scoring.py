"""Score expressions: vectors, BM25 transform, recency, confidence, the composite and its factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.temporal import days_between
from vaultframe.functions.text import col

# Days until a content type's score halves (types not listed here never decay) and base confidence.
HALF_LIVES = {"handoff": 30, "progress": 45, "conversation": 45, "problem": 60, "milestone": 60, "note": 60, "research": 90, "project": 120, "decision": 180}
EVERGREEN = ["preference", "deductive", "hub", "antipattern"]
BASELINES = {"decision": 0.85, "deductive": 0.85, "preference": 0.80, "hub": 0.80, "antipattern": 0.75, "problem": 0.75, "research": 0.70, "milestone": 0.70, "project": 0.65, "handoff": 0.60, "conversation": 0.55, "progress": 0.50, "note": 0.50}
DECAY_EXEMPT = ["decision", "deductive", "hub", "research", "antipattern", "preference"]
DEFAULT_WEIGHTS = (0.5, 0.25, 0.25)
RECENCY_WEIGHTS = (0.1, 0.7, 0.2)
QUERY_WEIGHTS = (0.7, 0.15, 0.15)
PRIORITY_TYPES = ["handoff", "decision", "progress"]


def lookup(c, table: dict[str, float], default: float) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), F.lit(float(default)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 for vectors of different lengths or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(col(a)) != F.size(col(b))) | (norms == 0), 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def bm25_to_score(bm25) -> Column:
    """Negative-is-better BM25 to [0, 1)."""
    m = F.greatest(-col(bm25), F.lit(0.0))
    return m / (1 + m)


def clamp_weight(w) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(col(w), F.lit(0.0)), F.lit(0.0))))


def half_life(kind, access_count, last_accessed_at, now: Column) -> Column:
    """Days; frequently and freshly accessed documents decay up to three times slower."""
    base = lookup(kind, HALF_LIVES, 60)
    fresh = F.when(col(last_accessed_at).isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - days_between(now, col(last_accessed_at)) / 90))
    return F.when(col(access_count) <= 0, base).otherwise(F.least(base * 3, base + base * 0.3 * F.log1p(col(access_count) * fresh)))


def recency(at, kind, now: Column, access_count=None, last_accessed_at=None) -> Column:
    life = lookup(kind, HALF_LIVES, 60) if access_count is None else half_life(kind, access_count, last_accessed_at, now)
    days = days_between(now, col(at))
    return F.when(col(kind).isin(*EVERGREEN), 1.0).when(col(at).isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), days / life))


def confidence(kind, decay_at, access_count, last_accessed_at, modified_at, now: Column) -> Column:
    boost = F.least(F.lit(1.5), 1 + F.log2(1 + F.greatest(F.coalesce(col(access_count), F.lit(0)), F.lit(0))) * 0.1)
    idle = days_between(now, col(last_accessed_at))
    real_access = F.abs(days_between(col(last_accessed_at), col(modified_at))) * 86400 >= 1
    decays = col(last_accessed_at).isNotNull() & ~col(kind).isin(*DECAY_EXEMPT) & real_access & (idle > 0)
    attention = F.when(decays, F.greatest(F.lit(0.5), F.pow(F.lit(0.95), idle / 7))).otherwise(1.0)
    return F.least(F.lit(1.0), lookup(kind, BASELINES, 0.5) * recency(decay_at, kind, now) * boost * attention)


def composite(df: DataFrame, now: Column, weights: tuple[float, float, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Adds each factor and ``composite``, their product and pin boost. Needs ``score`` and a document's metadata.

    (weighted * quality_factor * length_factor * frequency_factor + pin_boost) = composite.
    """
    s, r, c = weights
    out = df.withColumns(
        {
            "recency": recency("effective_at", "content_type", now, "access_count", "last_accessed_at"),
            "computed_confidence": confidence("content_type", "effective_at", "access_count", "last_accessed_at", "modified_at", now),
        }
    )
    stored = F.coalesce(F.col("confidence"), F.lit(0.5))
    blended = F.when(stored == 0.5, F.col("computed_confidence")).otherwise(F.least(F.lit(1.0), F.col("computed_confidence") * (stored / 0.5) * 0.5 + F.col("computed_confidence") * 0.5))
    ratio = F.log2(F.greatest(F.when(F.coalesce(F.col("body_length"), F.lit(0)) == 0, 500).otherwise(F.col("body_length")) / 500, F.lit(1.0)))
    signal = (F.greatest(F.coalesce(F.col("revision_count"), F.lit(1)), F.lit(1)) - 1) * 2 + F.greatest(F.coalesce(F.col("duplicate_count"), F.lit(1)), F.lit(1)) - 1
    out = out.withColumns(
        {
            "blended_confidence": blended,
            "quality_factor": 0.7 + 0.6 * F.coalesce(F.col("quality_score"), F.lit(0.5)),
            "length_factor": F.greatest(F.lit(0.3), 1 / (1 + 0.5 * ratio)),
            "frequency_factor": 1 + F.least(F.lit(0.10), F.log1p(signal) * 0.03),
        }
    )
    out = out.withColumn("weighted", s * F.col("score") + r * F.col("recency") + c * F.col("blended_confidence"))
    plain = F.col("weighted") * F.col("quality_factor") * F.col("length_factor") * F.col("frequency_factor")
    return out.withColumn("before_pin", plain).withColumn("composite", F.when(F.col("pinned"), F.least(F.lit(1.0), F.col("before_pin") + 0.3)).otherwise(F.col("before_pin"))).withColumn("pin_boost", F.col("composite") - F.col("before_pin")).drop("before_pin")
