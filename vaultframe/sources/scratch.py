"""Where steps write what others read: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The named folder; a temporary one only for a local master that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.applicationId not in _own:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="vault-")
    return _own[context.applicationId]


def fresh(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/vault/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df once and reads it back, for steps that read it several times."""
    path, schema = fresh(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
