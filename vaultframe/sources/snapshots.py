"""Versioned tables of immutable Parquet parts: a base, change files over it, one pointer.

A manifest names each table's parts. Keyed tables may have change files after the base: a row of a
later part stands for all rows of its key in earlier ones. Append-only tables are the union of
their parts. Other tables have one part. Every change writes new parts only and then moves the
pointer by an exclusive rename, so readers see one version, a lost job changes nothing, and of two
writers that saw the same version the later one fails.

A base is rewritten once its changes are many files or a quarter of its rows, small appended parts
are joined by size, so the work of a change follows its size and reading stays cheap.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.sources.schema import TABLES
from vaultframe.sources.scratch import delete

#: Key of tables that take change files; content is addressed by its hash and only grows.
KEYS = {"documents": "id"}
APPENDED = {"content"}
MOST_CHANGES, CHANGED_SHARE, FAN = 8, 0.25, 4


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")

    def _names(self) -> list[str]:
        folder = self._path("_versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def state(self) -> dict:
        """{version, tables: {name: [{path, rows}]}, index}."""
        names = self._names()
        if not names:
            return {"version": 0, "tables": {}, "index": None}
        stream = self._fs.open(self._path(f"_versions/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def move(self, state: dict) -> int:
        """Makes state, derived from the version it names, the next version; fails if another writer was first."""
        version = state["version"] + 1
        aside = self._path(f"_aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(state | {"version": version}).encode()))
        out.close()
        self._fs.mkdirs(self._path("_versions"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(aside, self._path(f"_versions/v{version:08d}.json"), none)
        return version

    # reading

    def _part(self, name: str, part: dict) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{part['path']}")

    def read(self, name: str, state: dict) -> DataFrame:
        parts = state["tables"].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        base = self._part(name, parts[0])
        if len(parts) == 1:
            return base
        later = None
        for n, p in enumerate(parts[1:]):
            rows = self._part(name, p).withColumn("_n", F.lit(n))
            later = rows if later is None else later.unionByName(rows)
        if name in APPENDED:
            return base.unionByName(later.drop("_n"))
        key = KEYS[name]
        newest = later.groupBy(key).agg(F.max_by(F.struct(*base.columns), "_n").alias("r")).select("r.*")
        return base.join(later.select(key), key, "left_anti").select(base.columns).unionByName(newest)

    # writing

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        kinds = self.spark.createDataFrame([], TABLES[name]).schema
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields))

    def write(self, name: str, df: DataFrame) -> dict:
        """A new part; few rows make one small file."""
        path = f"{name}/{uuid.uuid4().hex}"
        self.shaped(name, df).hint("rebalance").write.parquet(f"{self.root}/{path}")
        return {"path": path, "rows": self._part(name, {"path": path}).count()}

    def replace(self, state: dict, name: str, df: DataFrame) -> dict:
        return state | {"tables": state["tables"] | {name: [self.write(name, df)]}}

    def change(self, state: dict, name: str, df: DataFrame) -> dict:
        """Adds changed or new rows of a keyed table, or new rows of an appended one."""
        part = self.write(name, df)
        if not part["rows"]:
            delete(self.spark, f"{self.root}/{part['path']}")
            return state
        return self._kept_small(state | {"tables": state["tables"] | {name: [*state["tables"].get(name, []), part]}}, name)

    def _kept_small(self, state: dict, name: str) -> dict:
        parts = state["tables"][name]
        if name in APPENDED:
            classes: dict[int, list[dict]] = {}
            for p in parts:
                classes.setdefault(int(math.log(max(p["rows"], 1), FAN)), []).append(p)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
            if full is None:
                return state
            rows = self.read(name, {"tables": {name: full}})
            rest = [p for p in parts if p not in full]
            return self._kept_small(state | {"tables": state["tables"] | {name: [*rest, self.write(name, rows)]}}, name)
        changed = sum(p["rows"] for p in parts[1:])
        if len(parts) - 1 > MOST_CHANGES or changed > CHANGED_SHARE * parts[0]["rows"]:
            return self.replace(state, name, self.read(name, state))
        return state
