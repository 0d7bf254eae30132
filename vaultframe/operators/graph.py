"""Property graph: edge building, meta-path push, beam, one-hop and breadth-first traversals.

Hops are joins on the node. Loops run a bounded number of times (two for meta-paths, at most
ten elsewhere); their frontiers are capped by the operators' own limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions.scoring import clamp_weight
from vaultframe.operators.windows import top_per
from vaultframe.sources.scratch import written

ALPHA, PRUNE, EDGES_PER_NODE = 0.15, 1e-4, 10
# Weights of edge types and meta-paths by intent.
INTENT_WEIGHTS = {
    "WHY": {"causal": 5.0, "semantic": 2.0, "temporal": 0.5, "entity": 1.0},
    "WHEN": {"temporal": 5.0, "semantic": 2.0, "causal": 1.0, "entity": 0.5},
    "ENTITY": {"entity": 6.0, "semantic": 3.0, "temporal": 1.0, "causal": 2.0},
    "WHAT": {"semantic": 5.0, "entity": 2.0, "temporal": 1.0, "causal": 1.0},
}
META_PATHS = {
    "WHY": [("semantic", "causal"), ("causal", "semantic"), ("semantic", "semantic")],
    "ENTITY": [("entity", "semantic"), ("entity", "entity"), ("semantic", "entity")],
    "WHEN": [("temporal", "semantic"), ("semantic", "temporal")],
    "WHAT": [("semantic", "semantic"), ("semantic", "supporting")],
}
SYMMETRIC = ["semantic", "entity"]


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Merged relations: no self-loops, weight min(1, greatest)."""
    return existing.unionByName(new).where("source_id <> target_id").groupBy("source_id", "target_id", "relation_type").agg(F.least(F.lit(1.0), F.max(clamp_weight("weight"))).alias("weight"))


def typed_edges(relations: DataFrame, kind: str, eligible: DataFrame, k: int = EDGES_PER_NODE, nodes: DataFrame | None = None) -> DataFrame:
    """(node, next, weight, share): a node's k strongest edges of a type to eligible documents, in-edges too for symmetric types.

    With nodes(node), of these alone: their edges are written, and few edges are sent to the documents.
    """
    own = relations.where(F.col("relation_type") == kind).select("source_id", "target_id", clamp_weight("weight").alias("weight"))
    edges = own.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), "weight")
    if kind in SYMMETRIC:
        edges = edges.unionByName(own.select(F.col("target_id").alias("node"), F.col("source_id").alias("next"), "weight"))
    ok = eligible.select(F.col("id").alias("next"))
    if nodes is not None:
        edges = written(edges.join(nodes, "node", "left_semi"), "edges")
        ok = ok.join(edges, "next", "left_semi")
    edges = edges.join(ok, "next", "left_semi")
    ranked = top_per(edges, ["node"], [F.desc(F.round("weight", 9)), F.col("next")], k, "r").drop("r")
    total = F.sum("weight").over(Window.partitionBy("node"))
    return ranked.withColumn("share", F.col("weight") / F.nullif(total, F.lit(0.0))).where("share is not null")


def meta_path(relations: DataFrame, anchors: DataFrame, path: tuple[str, ...], eligible: DataFrame) -> DataFrame:
    """(id, score): mass pushed from anchors(id, score) along the path's edge types; each stop keeps a share."""
    mass = anchors.select("id", F.col("score").alias("mass"))
    kept = mass.select("id", (F.col("mass") * ALPHA).alias("part"))
    for kind in path:
        moved = mass.where(F.col("mass") > PRUNE).join(typed_edges(relations, kind, eligible), F.col("id") == F.col("node"))
        mass = moved.groupBy(F.col("next").alias("id")).agg(F.sum(F.col("mass") * (1 - ALPHA) * F.col("share")).alias("mass"))
        kept = kept.unionByName(mass.select("id", (F.col("mass") * ALPHA).alias("part")))
    return kept.groupBy("id").agg(F.sum("part").alias("score")).where(F.col("score") > PRUNE)


def meta_path_search(relations: DataFrame, anchors: DataFrame, intent: str, eligible: DataFrame, budget: int = 30) -> DataFrame:
    """(id, score): meta-paths are alternatives, so the best of them counts."""
    found = None
    for path in META_PATHS[intent]:
        one = meta_path(relations, anchors, path, eligible)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc(F.round("score", 9)), "id").limit(budget)


def beam(relations: DataFrame, anchors: DataFrame, intent: str, eligible: DataFrame, similarity: DataFrame | None = None, depth: int = 2, width: int = 10, budget: int = 30) -> DataFrame:
    """(id, score, hops): .9 * parent + exp(.6 * type weight + .4 * similarity) * edge weight, best width per hop.

    A document reached twice in a hop counts once, with its best score.
    """
    kinds = F.create_map(*(F.lit(x) for kv in INTENT_WEIGHTS[intent].items() for x in kv))
    edges = None
    base = relations.select("source_id", "target_id", "relation_type", clamp_weight("weight").alias("weight"))
    for a, b, df in (("source_id", "target_id", base), ("target_id", "source_id", base.where(F.col("relation_type").isin(*SYMMETRIC)))):
        one = df.select(F.col(a).alias("node"), F.col(b).alias("next"), "relation_type", "weight")
        edges = one if edges is None else edges.unionByName(one)
    edges = edges.distinct().join(eligible.select(F.col("id").alias("next")), "next", "left_semi")
    if similarity is not None:
        edges = edges.join(similarity.select(F.col("id").alias("next"), F.col("similarity").alias("sim")), "next", "left")
    else:
        edges = edges.withColumn("sim", F.lit(0.0))
    gain = F.exp(0.6 * F.coalesce(F.element_at(kinds, F.col("relation_type")), F.lit(1.0)) + 0.4 * F.coalesce("sim", F.lit(0.0))) * F.col("weight")
    visited = anchors.select("id", "score", F.lit(0).alias("hops"))
    front = visited
    for hop in range(1, depth + 1):
        step = front.join(edges, F.col("id") == F.col("node")).select(F.col("next").alias("id"), (F.col("score") * 0.9 + gain).alias("score"))
        step = step.join(visited.select("id"), "id", "left_anti").groupBy("id").agg(F.max("score").alias("score"))
        front = step.orderBy(F.desc(F.round("score", 9)), "id").limit(width).withColumn("hops", F.lit(hop))
        visited = visited.unionByName(front)
    return visited.orderBy("hops", F.desc(F.round("score", 9)), "id").limit(budget)


def merge_traversal(found: DataFrame, traversed: DataFrame) -> DataFrame:
    """(id, score): in both, the greater of the original and 1.1 * normalised; new ones .8 * normalised."""
    top = traversed.agg(F.max("score").alias("top"))
    norm = traversed.join(F.broadcast(top)).select("id", (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("norm"))
    both = found.select("id", F.col("score").alias("original")).join(norm, "id", "full_outer")
    return both.select("id", F.when(F.col("norm").isNull(), F.col("original")).when(F.col("original").isNull(), 0.8 * F.col("norm")).otherwise(F.greatest("original", 1.1 * F.col("norm"))).alias("score"))


def one_hop_causal(relations: DataFrame, anchors: DataFrame, eligible: DataFrame, per_anchor: int = 3, overall: int = 10) -> DataFrame:
    """(id, best_rank, best_weight, directions) of neighbours by causal edges of anchors(id, rank), both ways."""
    causal = relations.where("relation_type = 'causal' and source_id <> target_id").select("source_id", "target_id", clamp_weight("weight").alias("weight"))
    a = anchors.select(F.col("id").alias("anchor"), F.col("rank"))
    out = a.join(causal, F.col("anchor") == F.col("source_id")).select("anchor", "rank", F.col("target_id").alias("id"), "weight", F.lit("effect").alias("direction"))
    back = a.join(causal, F.col("anchor") == F.col("target_id")).select("anchor", "rank", F.col("source_id").alias("id"), "weight", F.lit("cause").alias("direction"))
    hits = out.unionByName(back).join(eligible.select("id"), "id", "left_semi")
    capped = top_per(hits, ["anchor"], [F.desc(F.round("weight", 9)), F.col("id"), F.col("direction")], per_anchor, "r")
    ends = capped.groupBy("id").agg(F.min("rank").alias("best_rank"), F.max("weight").alias("best_weight"), F.concat_ws(",", F.sort_array(F.collect_set("direction"))).alias("directions"))
    return ends.orderBy("best_rank", F.desc(F.round("best_weight", 9)), "id").limit(overall)


def causal_chain(relations: DataFrame, start: int, depth: int = 5, most: int = 50) -> DataFrame:
    """(depth, source_id, target_id, weight, direction, truncated): level by level both ways, ``most`` edges in all.

    A node expands once per direction, and only edges that are kept lead on. A level holds at most ``most`` + 1
    edges, so it goes to the driver and the next level is a filter on its nodes, which the scan can use: the plan
    does not grow with the depth. ``truncated`` tells that some level or the whole had more.
    """
    causal = relations.where("relation_type = 'causal'").select("source_id", "target_id", clamp_weight("weight").alias("weight"))
    order = lambda e: (e[0], -round(e[3], 9), e[1], e[2], e[4])
    kept: list[tuple] = []
    cut = False
    fronts = {"effect": {start}, "cause": {start}}
    seen = {d: {start} for d in fronts}
    for level in range(1, min(depth, 10) + 1):
        parts = []
        for direction, near in (("effect", "source_id"), ("cause", "target_id")):
            if fronts[direction]:
                own = causal.where(F.col(near).isin(*sorted(fronts[direction])))
                parts.append(own.select(F.lit(level).alias("depth"), "source_id", "target_id", "weight", F.lit(direction).alias("direction")))
        room = most - len(kept)
        if not parts or room < 0:
            break
        edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        got = sorted((tuple(r) for r in edges.orderBy(F.desc(F.round("weight", 9)), "source_id", "target_id", "direction").limit(room + 1).collect()), key=order)
        cut |= len(got) > room
        got = got[:room]
        kept += got
        fronts = {d: {e[2] if d == "effect" else e[1] for e in got if e[4] == d} - seen[d] for d in fronts}
        for d in fronts:
            seen[d] |= fronts[d]
    schema = "depth int, source_id long, target_id long, weight double, direction string, truncated boolean"
    return relations.sparkSession.createDataFrame([(*e, cut) for e in kept], schema)


def edges_within(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends among ids(id)."""
    return relations.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def meta_path_merge(found: DataFrame, pushed: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """(id, score): a meta-path's normalised score counts 0.9 for what was found, by the greater, and 0.75 for the rest;
    neighbours by entity, if given, come in at 0.7 where nothing else has them."""
    top = pushed.agg(F.max("score").alias("top"))
    norm = pushed.join(F.broadcast(top)).select("id", (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("norm"))
    both = found.select("id", F.col("score").alias("own")).join(norm, "id", "full_outer")
    out = both.select("id", F.when(F.col("norm").isNull(), F.col("own")).when(F.col("own").isNull(), 0.75 * F.col("norm")).otherwise(F.greatest("own", 0.9 * F.col("norm"))).alias("score"))
    if neighbours is None:
        return out
    return out.unionByName(neighbours.join(out.select("id"), "id", "left_anti").groupBy("id").agg((0.7 * F.max("score")).alias("score")))
