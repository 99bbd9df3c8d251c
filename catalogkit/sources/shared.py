"""Folders that a whole cluster shares, tables stored there, and small files."""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one in local runs without it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="catalogkit-")
    return f"{root.rstrip('/')}/{sc.applicationId}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again: its lineage is cut."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    p, fs = at(spark, path)
    target, _ = at(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"can't move {path} to {to}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    p, fs = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    draft, fs = at(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    move(spark, draft.toString(), path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value
