"""Command line: python -m vaultframe.cli ROOT VERB [ARGUMENTS]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vaultframe.sources import markdown
from vaultframe.vault import Vault


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vaultframe")
    p.add_argument("root")
    p.add_argument("verb", choices=["index", "search", "query", "rank", "get", "list", "status", "stats", "lifecycle", "sweep", "restore", "timeline", "causal", "facts", "sessions", "pin", "unpin", "forget", "graphs", "profile", "diary"])
    p.add_argument("argument", nargs="*")
    p.add_argument("--now", required=True, help="the clock, as YYYY-MM-DD HH:MM:SS in UTC")
    p.add_argument("--limit", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    v = Vault(spark, a.root, F.lit(a.now).cast("timestamp_ntz"))
    text = " ".join(a.argument)
    changes = {
        "index": lambda: v.index(markdown.parse(markdown.scan(spark, a.argument[0], a.argument[1]))),
        "sweep": v.lifecycle_sweep,
        "restore": lambda: v.lifecycle_restore(text or None),
        "pin": lambda: v.pin([int(x) for x in a.argument]),
        "unpin": lambda: v.pin([int(x) for x in a.argument], False),
        "forget": lambda: v.forget([int(x) for x in a.argument]),
        "graphs": v.build_graphs,
    }
    if a.verb in changes:
        print(f"version {changes[a.verb]()}")
        return
    reads = {
        "search": lambda: v.search(text, a.limit).select("rank", "id", "collection", "path", "score"),
        "query": lambda: v.query(text, limit=a.limit).select("position", "id", "path", "composite"),
        "rank": lambda: v.memory_rank(text, a.limit),
        "get": lambda: v.get(text),
        "list": lambda: v.documents().where("active").orderBy(F.desc("modified_at"), F.desc("id")).select("id", "collection", "path", "modified_at").limit(a.limit),
        "status": v.status,
        "stats": v.memory_stats,
        "lifecycle": v.lifecycle_status,
        "timeline": lambda: v.timeline(int(text)),
        "causal": lambda: v.find_causal_links(int(text)),
        "facts": lambda: v.kg_query(text),
        "sessions": lambda: v.session_log(a.limit),
        "profile": lambda: v.profile(a.limit),
        "diary": lambda: v.diary_read(text, a.limit),
    }
    reads[a.verb]().show(a.limit, truncate=60)


if __name__ == "__main__":
    main()
