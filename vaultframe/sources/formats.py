"""Result sinks: json, csv, files, markdown and xml lines, and the export of a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.text import escape_csv, escape_xml


def line(fmt: str) -> Column:
    """One output line per result row (docid, path, title, score, snippet)."""
    score = F.format_number("score", 2)
    if fmt == "json":
        return F.to_json(F.struct("docid", "path", "title", F.round("score", 4).alias("score"), "snippet"))
    if fmt == "csv":
        return F.concat_ws(",", *(escape_csv(c) for c in ("docid", "path", "title")), score, escape_csv("snippet"))
    if fmt == "files":
        return F.concat_ws(",", F.concat(F.lit("#"), "docid"), score, "path")
    if fmt == "md":
        return F.concat(F.lit("### "), "title", F.lit("\n`"), "path", F.lit("` ("), score, F.lit(")\n\n"), "snippet", F.lit("\n"))
    if fmt == "xml":
        return F.concat(F.lit('<file docid="#'), "docid", F.lit('" name="'), escape_xml("path"), F.lit('" title="'), escape_xml("title"), F.lit('">'), escape_xml("snippet"), F.lit("</file>"))
    raise ValueError(f"format {fmt}")


def render(results: DataFrame, fmt: str) -> DataFrame:
    return results.select("rank", line(fmt).alias("line"))


def export(docs: DataFrame, path: str) -> None:
    """All active documents with bodies as JSON lines, ranged by (collection, path)."""
    docs.where("active").repartitionByRange("collection", "path").sortWithinPartitions("collection", "path").write.mode("overwrite").json(path)
