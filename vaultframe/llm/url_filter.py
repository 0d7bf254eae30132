"""URL filter: a trie over reversed host labels and path text, longest match wins.

A rule is a host and a path prefix, written ``host/path``. It fits a URL when the URL's host
is the rule's host or a subdomain and the URL's path starts with ``/path``. Of the rules that
fit, the one with the most characters wins; of equally long ones the one with the deeper
host, and of equal rules the blocking one. A URL that no rule fits gets the default verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and
path, so no rule and the default verdict. Repeated rows are judged alike; an empty table gives
an empty result; columns named like the results are replaced, others are kept.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pickled trie up to this size is broadcast; a larger rule set is joined on host suffixes.
MAX_BROADCAST_BYTES = 64 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_column(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Host labels from the top-level domain down; at a host's node, a trie of path segments.

    A path rule ends in a whole-segment node or in a partial last segment, which is kept in
    the node's ``tails`` as (text, rule).
    """

    __slots__ = ("root",)

    def __init__(self, allow: Iterable[str], block: Iterable[str]):
        self.root: dict = {}
        for rules, verdict in ((allow, "allow"), (block, "block")):
            for rule in rules:
                host, _, path = rule.partition("/")
                node = self.root
                for label in reversed(host.split(".")):
                    node = node.setdefault(label, {})
                node = node.setdefault(None, {})
                *whole, tail = path.split("/")
                for segment in whole:
                    node = node.setdefault(segment, {})
                node.setdefault(None, {})[tail] = (rule, verdict)  # block comes last and stays

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        if not host or path[:1] != "/":
            return None, None
        segments = path[1:].split("/")
        best: tuple[str | None, str | None] = (None, None)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(None)
            depth = 0
            while paths is not None:
                rest = segments[depth] if depth < len(segments) else None
                if rest is not None:
                    last = depth == len(segments) - 1
                    tails = paths.get(None, {})
                    for k in range(len(rest) + 1 if tails else 0):
                        entry = tails.get(rest[:k])
                        if entry and len(entry[0]) >= len(best[0] or ""):
                            best = entry
                    paths = None if last else paths.get(rest)
                    depth += 1
                else:
                    break
        return best


def judge_urls(pages: DataFrame, url: str, allow: list[str], block: list[str], default: str = "allow", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (see the module's text for the cases)."""
    if any(not re.fullmatch(r"[^/?#]+/[^?#]*", r) for r in [*allow, *block]):
        raise ValueError("a rule is host/path")
    spark = pages.sparkSession
    based = pages.withColumns({"host": host_column(F.col(url)), "path": path_column(F.col(url))})
    packed = pickle.dumps(UrlTrie(allow, block))
    if len(packed) > max_broadcast_bytes:
        return _joined(based, allow, block, default)
    shared = spark.sparkContext.broadcast(packed)
    loaded: list[UrlTrie] = []

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def verdicts(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        found = [loaded[0].find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())], ["rule", "verdict"])

    out = based.withColumn("__v", verdicts("host", "path"))
    return out.withColumns({"rule": F.col("__v.rule"), "verdict": F.col("__v.verdict")}).drop("__v")


def _joined(based: DataFrame, allow: list[str], block: list[str], default: str) -> DataFrame:
    """Rule sets beyond the broadcast bound: distinct (host, path) meet the rules on host suffixes."""
    spark = based.sparkSession
    verdict = {r: "allow" for r in allow} | {r: "block" for r in block}
    rules = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in verdict.items()], "rule_host string, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = based.where("host <> '' and path <> ''").select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    best = hosts.join(rules, "rule_host").where("startswith(path, rule_path)").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("m"))
    best = best.select("host", "path", "m.rule", "m.verdict")
    return based.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))

