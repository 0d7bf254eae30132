"""Markdown collections: scan, frontmatter, change detection, fragments and chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from vaultframe.functions.text import content_type, glob_pattern

# Folders that are never scanned; sizes of chunks and fragments.
EXCLUDED = ["node_modules", ".git", ".hg", ".svn", "dist", "build", "target", "vendor", "__pycache__", ".venv", "venv", ".cache", ".next", "coverage"]
CHUNK_CHARS, OVERLAP_CHARS = 3200, 480
FRAGMENT_LEAST, FRAGMENT_MOST, FRAGMENTS = 50, 2000, 500


def scan(spark: SparkSession, root: str, collection: str, pattern: str = "**/*.md") -> DataFrame:
    """(collection, path, text, hash, modified_at) of the files under root that the glob matches."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"))
    prefix = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    path = F.element_at(F.split("file", prefix, 2), -1)
    skip = F.col("path").rlike(r"(^|/)(" + "|".join(e.replace(".", r"\.") for e in EXCLUDED) + ")/")
    return files.select(F.lit(collection).alias("collection"), path.alias("path"), "text", F.sha2("text", 256).alias("hash"), "modified_at").where(F.col("path").rlike(glob_pattern(pattern)) & ~skip)


def changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(collection, path, change): added, changed, same, or absent since the last scan."""
    a = stored.where("active").select("collection", "path", F.col("hash").alias("old"))
    b = scanned.select("collection", "path", F.col("hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "absent").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return a.join(b, ["collection", "path"], "full_outer").select("collection", "path", kind.alias("change"))


def parse(files: DataFrame) -> DataFrame:
    """Adds body, title and the frontmatter's plain fields. Lists may be written inline or as items."""
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    field = lambda k: F.nullif(F.trim(F.regexp_extract("front", rf"(?m)^{k}:[ \t]*[\"']?([^\"'\n\[]+?)[\"']?[ \t]*$", 1)), F.lit(""))
    inline = F.regexp_extract("front", r"(?m)^tags:[ \t]*\[([^\]]*)\]", 1)
    items = F.regexp_extract("front", r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]*.+\n?)+)", 1)
    tags = F.when(inline != "", F.split(inline, r"\s*,\s*")).when(items != "", F.regexp_extract_all(items, F.lit(r"(?m)^[ \t]*-[ \t]*(.+?)[ \t]*$"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    heading = F.trim(F.regexp_extract("body", r"(?m)^#+\s+(.+)$", 1))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.(md|txt)$", "")
    out = files.withColumns({"front": front, "body": body})
    return out.withColumns({"title": F.coalesce(field("title"), F.when(heading != "", heading), base), "tags": tags, "domain": field("domain"), "workstream": field("workstream"), "content_type": F.coalesce(field("content_type"), content_type("path")), "review_by": field("review_by"), "authored_at": F.try_to_timestamp(field("authored_at"))}).drop("front")


@udtf(returnType="pos int, chunk string")
class CharChunks:
    """Chunks of CHUNK_CHARS with an overlap; a chunk ends at the best break in its last 30 percent."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        n, at = len(text or ""), 0
        if n <= CHUNK_CHARS:
            if n:
                yield 0, text
            return
        while at < n:
            end = min(at + CHUNK_CHARS, n)
            if end < n:
                tail = at + int(CHUNK_CHARS * 0.7)
                for mark in ("\n\n", ". ", "\n", " "):
                    k = text.rfind(mark, tail, end)
                    if k > 0:
                        end = k + len(mark)
                        break
            yield at, text[at:end]
            if end >= n:
                return
            at = max(end - OVERLAP_CHARS, at + 1)


@udtf(returnType="seq int, kind string, label string, fragment string")
class Fragments:
    """The whole document, then sections, lists of two items or more and fenced code, within size bounds."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str | None, str]]:
        text = (text or "")[:500_000]
        if not text:
            return
        out = [("full", None, text)]
        section: list[str] = []
        items: list[str] = []
        code: list[str] | None = None
        label = None

        def close_list() -> None:
            if len(items) >= 2:
                out.append(("list", label, "\n".join(items)))
            items.clear()

        def close_section() -> None:
            close_list()
            body = "\n".join(section).strip()
            if label is not None and body:
                out.append(("section", label, body))
            section.clear()

        for line in text.split("\n"):
            if line.startswith("```"):
                if code is None:
                    close_list()
                    code = []
                else:
                    out.append(("code", label, "\n".join(code)))
                    code = None
                continue
            if code is not None:
                code.append(line)
                continue
            marks = len(line) - len(line.lstrip("#"))
            if 1 <= marks <= 3 and line[marks : marks + 1] == " ":
                close_section()
                label = line[marks:].strip()
                continue
            section.append(line)
            if line.lstrip()[:2] in ("- ", "* "):
                items.append(line)
            elif line.strip():
                close_list()
        close_section()
        seq = 0
        for kind, name, body in out:
            if kind == "full" or len(body) >= FRAGMENT_LEAST:
                yield seq, kind, name, body if kind == "full" else body[:FRAGMENT_MOST]
                seq += 1
            if seq >= FRAGMENTS:
                return


def lateral(df: DataFrame, table_function, text: str) -> DataFrame:
    """df with the table function's rows for each text."""
    return df.lateralJoin(table_function(F.col(text).outer()))
