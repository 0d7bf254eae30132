"""Size-tiered shards with a versioned manifest, in DataFrame operations only.

Arrivals are appended as runs of small immutable Parquet shards. A run's tier is the whole part
of log(bytes / unit) to the base ``fan_in``. When a tier has ``fan_in`` runs or more they are
merged into one run of target-sized files (a coalesced copy, no shuffle), which lands in a
higher tier; so each row is rewritten about once per tier. Every change is a new manifest
``_manifest/v<n>.json`` that lists all live shards with their schema, written aside and then renamed; a rename
onto an existing version fails, so of two writers one has to start over. Readers use one version
and never see half a change. Files that a version dropped stay for ``retain`` seconds after that,
so that readers of the version before can finish; the manifest lists them, so a commit deletes what is due without
listing a folder or reading another manifest. ``vacuum``, on request, also lists the folders and deletes files that no
version names once they are older than ``orphan`` seconds (of writers that failed).

Cases: an empty arrival commits a version without a shard; a table of which no version has a shard
is read as an empty frame with the columns it was given. Repeated rows are kept as they are.
All columns are stored. Arrivals may differ in columns: the manifest has the table's columns, null where an
arrival lacks one. Names that differ in case only are one column, named as it was first seen; an arrival that has two
such names itself is refused. A column of several types is read and merged as the narrowest type that
holds each value exactly: the wider number, or a string for types whose strings read back (so longs next to doubles are
strings; a number already merged with wider ones prints like those). Other mixes (nested types, binary, times) are refused.
What is refused raises ValueError before anything is written or committed. ``read`` puts its own
shard, shard_bytes and tier in place of columns of these names. A table without any version can't be read.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultframe.llm.common import scratch

#: Production sizes: the smallest tier's bytes, runs merged at once, bytes of a merged file.
UNIT_BYTES = 4 << 20
FAN_IN = 4
TARGET_BYTES = 128 << 20
#: Seconds that dropped files stay for readers, and that unnamed files stay for writers.
RETAIN = 24 * 3600
ORPHAN = 24 * 3600
#: Bits of each number type that whole numbers may fill without loss; longs fit no binary fraction.
_WHOLE = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}
_FRACTION = {T.FloatType(): 24, T.DoubleType(): 53}
#: Types whose strings read back as the same value.
_PRINTED = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType)


def common_type(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds each value of both exactly."""
    if a == b:
        return a
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.__getitem__)
    numbers = _WHOLE | _FRACTION
    if a in numbers and b in numbers:
        for fraction, bits in _FRACTION.items():
            if all(numbers[t] <= bits for t in (a, b)):
                return fraction
    if isinstance(a, _PRINTED) and isinstance(b, _PRINTED):
        return T.StringType()
    raise ValueError(f"column {name} has types {a.simpleString()} and {b.simpleString()}, which have no common type")


def common_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns in order of first sight, each nullable and of a type that holds every schema's. Case doesn't tell names apart."""
    out: dict[str, T.StructField] = {}
    for s in schemas:
        if len({f.name.lower() for f in s}) < len(s):
            raise ValueError(f"columns that differ in case only: {', '.join(s.names)}")
        for f in s:
            have = out.get(f.name.lower(), f)
            out[f.name.lower()] = T.StructField(have.name, common_type(have.name, have.dataType, f.dataType))
    return T.StructType(list(out.values()))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


class ShardedTable:
    """One table's folder. Only metadata of shards, never rows, is handled on the driver."""

    def __init__(self, spark: SparkSession, root: str, unit_bytes: int = UNIT_BYTES, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES, retain: float = RETAIN, orphan: float = ORPHAN):
        self.spark, self.root, self.retain, self.orphan = spark, root, retain, orphan
        self.unit, self.fan_in, self.target = unit_bytes, fan_in, target_bytes
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifest

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/_manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self.versions()
        if not versions:
            return {"version": 0, "runs": []}
        stream = self.fs.open(self.path(f"{self.root}/_manifest/v{version or versions[-1]:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, runs: list[dict], base: dict, schema: T.StructType | None = None) -> int:
        """Makes ``runs`` the version after the manifest ``base``; fails if that version is there already.

        Then deletes what is due: files that earlier versions dropped, and manifests that were replaced, ``retain``
        seconds ago. What a commit couldn't delete the next one does.
        """
        version, now = base["version"] + 1, time.time()
        live = {f["path"] for r in runs for f in r["shards"]}
        waiting = lambda kind: [x for x in base.get(kind, []) if now - x["at"] < self.retain]
        self._delete_due(base, now)
        dropped = waiting("dropped") + [{"path": f["path"], "at": now} for r in base["runs"] for f in r["shards"] if f["path"] not in live]
        replaced = waiting("replaced") + [{"version": base["version"], "at": now}] * (base["version"] > 0)
        columns = json.loads(_nullable(schema or self._schema(base)).json())
        manifest = {"version": version, "at": now, "schema": columns, "runs": runs, "dropped": dropped, "replaced": replaced}
        aside = self.path(f"{self.root}/_aside/{uuid.uuid4().hex}.json")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self.path(f"{self.root}/_manifest/v{version:08d}.json")
        self.fs.mkdirs(final.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(aside, final, options)  # throws if it exists
        self._delete_due(manifest, time.time())
        return version

    def _delete_due(self, manifest: dict, now: float) -> None:
        """Deletes the files and versions of a committed manifest's lists that need not be kept any longer."""
        for x in manifest.get("dropped", []):
            if now - x["at"] >= self.retain:
                self.fs.delete(self.path(x["path"]), False)
        for x in manifest.get("replaced", []):
            if now - x["at"] >= self.retain:
                self.fs.delete(self.path(f"{self.root}/_manifest/v{x['version']:08d}.json"), False)

    # runs

    def _files(self, folder: str) -> list[dict]:
        found, files = [], self.fs.listFiles(self.path(folder), True)
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().startswith("part-"):
                found.append({"path": s.getPath().toString(), "bytes": int(s.getLen())})
        return sorted(found, key=lambda x: x["path"])

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.unit, self.fan_in))) if size >= self.unit else 0

    def _run(self, name: str, files: list[dict], schema: T.StructType) -> dict:
        size = sum(f["bytes"] for f in files)
        return {"name": name, "bytes": size, "tier": self.tier(size), "schema": json.loads(_nullable(schema).json()), "shards": files}

    def append(self, df: DataFrame) -> int:
        """One arrival: written once, committed as one run."""
        name = uuid.uuid4().hex
        self._widened(self.manifest(), df.schema)
        df.write.parquet(f"{self.root}/data/{name}")
        at = self.manifest()
        run = self._run(name, self._files(f"{self.root}/data/{name}"), df.schema)
        return self.commit([*at["runs"], run], at, self._widened(at, df.schema))

    def append_all(self, df: DataFrame, arrival: str, compact: bool = True) -> int:
        """Many arrivals, told apart by a column: written in one pass, committed one after another."""
        name, schema = uuid.uuid4().hex, df.drop(arrival).schema
        self._widened(self.manifest(), schema)
        df.write.partitionBy(arrival).parquet(f"{self.root}/data/{name}")
        groups: dict[str, list[dict]] = {}
        for f in self._files(f"{self.root}/data/{name}"):
            groups.setdefault(f["path"].rpartition("/")[0].rpartition("/")[2], []).append(f)
        for k in sorted(groups, key=lambda k: (len(k), k)) or [None]:  # no rows: a version that knows the columns
            at = self.manifest()
            version = self.commit([*at["runs"], self._run(f"{name}-{k}", groups.get(k, []), schema)], at, self._widened(at, schema))
            if compact:
                version = self.compact()
        return version

    def compact(self) -> int:
        """Merges tiers that have fan_in runs until none has; deletes what is no longer retained."""
        while True:
            at = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in at["runs"]:
                tiers.setdefault(r["tier"], []).append(r)
            full = [t for t, runs in sorted(tiers.items()) if len(runs) >= self.fan_in]
            if not full:
                return at["version"]
            old = tiers[full[0]]
            name = uuid.uuid4().hex
            size = sum(r["bytes"] for r in old)
            whole = self._schema(at)
            rows = self._rows(old, whole)
            if rows is not None:
                rows.coalesce(max(1, math.ceil(size / self.target))).write.parquet(f"{self.root}/data/{name}")
            merged = self._run(name, [] if rows is None else self._files(f"{self.root}/data/{name}"), whole)
            merged["tier"] = max(merged["tier"], full[0] + 1)  # packing better than before must not merge again
            gone = {r["name"] for r in old}
            self.commit([*(r for r in at["runs"] if r["name"] not in gone), merged], at, whole)

    def _schema(self, manifest: dict) -> T.StructType:
        return T.StructType.fromJson(manifest["schema"]) if "schema" in manifest else T.StructType()

    def _widened(self, manifest: dict, schema: T.StructType) -> T.StructType:
        """The table's columns with an arrival of this schema; ValueError if it doesn't fit."""
        return common_schema([self._schema(manifest), schema])

    def _rows(self, runs: list[dict], whole: T.StructType, at: str | None = None) -> DataFrame | None:
        """The runs' rows in the table's columns; ``at`` names a column for the file's path below data."""
        groups: dict[str, tuple[dict, list[str]]] = {}
        for r in runs:
            if r["shards"]:
                groups.setdefault(json.dumps(r["schema"]), (r["schema"], []))[1].extend(f["path"] for f in r["shards"])
        out = None
        for schema, paths in groups.values():
            own = T.StructType.fromJson(schema)
            part = self.spark.read.schema(own).parquet(*paths)
            path = [F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias(at)] if at else []
            name = {n.lower(): n for n in own.names}
            part = part.select(*((F.col(f"`{name[f.name.lower()]}`") if f.name.lower() in name else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole), *path)
            out = part if out is None else out.unionByName(part)
        return out

    def vacuum(self) -> None:
        """Deletes what is due by the newest manifest, and files older than ``orphan`` seconds that no version names."""
        manifest, now = self.manifest(), time.time()
        self._delete_due(manifest, now)
        live = {f["path"] for r in manifest["runs"] for f in r["shards"]} | {x["path"] for x in manifest.get("dropped", []) if now - x["at"] < self.retain}
        for folder in ("data", "_aside"):
            if not self.fs.exists(self.path(f"{self.root}/{folder}")):
                continue
            files = self.fs.listFiles(self.path(f"{self.root}/{folder}"), True)
            while files.hasNext():
                s = files.next()
                if now - s.getModificationTime() / 1000 >= self.orphan and s.getPath().toString() not in live:
                    self.fs.delete(s.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, with shard (number in the manifest), shard_bytes and tier."""
        manifest = self.manifest(version)
        if not manifest["version"]:
            raise ValueError("no version yet")
        runs = manifest["runs"]
        shards = sorted(({"path": f["path"], "shard_bytes": f["bytes"], "tier": r["tier"]} for r in runs for f in r["shards"]), key=lambda s: s["path"])
        table = self.spark.createDataFrame([(s["path"].rpartition("/data/")[2], i, s["shard_bytes"], s["tier"]) for i, s in enumerate(shards)], "__at string, shard int, shard_bytes long, tier int")
        rows = self._rows(runs, self._schema(manifest), "__at")
        if rows is None:
            rows = self.spark.createDataFrame([], self._schema(manifest).add("__at", "string"))
        return rows.drop("shard", "shard_bytes", "tier").join(F.broadcast(table) if len(shards) < 100_000 else table, "__at").drop("__at")


def shard_documents(docs: DataFrame, key: str, arrivals: int = 16, root: str | None = None, **sizes: float) -> ShardedTable:
    """Deals ``docs`` into arrivals by the key's hash, appends them in turn and compacts on the way.

    Without a root the table is a new one that nobody reads before this returns, so nothing dropped is
    retained until then.
    """
    table = ShardedTable(docs.sparkSession, root or scratch(docs.sparkSession, "shards"), **({"retain": RETAIN if root else 0} | sizes))
    table.append_all(docs.withColumn("__arrival", F.pmod(F.xxhash64(key), F.lit(arrivals))), "__arrival")
    table.retain = sizes.get("retain", RETAIN)
    return table
