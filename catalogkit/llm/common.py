"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters that separate words in the contracts of ops 5, 7, 9 and 10.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (the folder that the whole
    cluster shares). Only where that setting is absent, as in local tests, a
    temporary folder is set for the application and used instead."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="catalogkit-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{sc.applicationId}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and reread it.
    The table outlives lost executors; it goes with the shared folder."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def free(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made and nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, most: int = 1_000, most_bytes: int = 32 << 20) -> None:
    """Bound what Python workers hold at once: ``most`` rows and about ``most_bytes`` bytes a batch (one
    row at least) in this session, unless it asks for less. Spark reads both settings when a plan runs,
    so they stay set."""
    for name, bound in (("maxRecordsPerBatch", most), ("maxBytesPerBatch", most_bytes)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).removesuffix("b").removesuffix("B")) <= bound:
            spark.conf.set(name, str(bound))


def exact_pandas(t: pa.Table) -> pd.DataFrame:
    """A table for pandas in which whole numbers with nulls stay whole (as floats they would lose digits)."""
    out = t.to_pandas()
    for name, c in zip(t.column_names, t.columns):
        if c.null_count and pa.types.is_integer(c.type):
            out[name] = c.to_pandas(types_mapper=lambda kind: getattr(pd, f"Int{kind.bit_width}Dtype")())
    return out


def map_in_pandas(df: DataFrame, make: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str) -> DataFrame:
    """``mapInPandas`` with ``exact_pandas``."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in make(exact_pandas(pa.Table.from_batches([x])) for x in batches):
            yield from pa.Table.from_pandas(b[made.names], schema=made, preserve_index=False).to_batches()

    return df.mapInArrow(run, schema)


def apply_in_pandas(groups: GroupedData, make: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType) -> DataFrame:
    """``applyInPandas`` with ``exact_pandas``."""
    made = to_arrow_schema(schema)
    return groups.applyInArrow(lambda t: pa.Table.from_pandas(make(exact_pandas(t))[made.names], schema=made, preserve_index=False), schema)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text without other characters takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n (null for a null identifier)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def chunks(texts: list[str], most_chars: int) -> Iterator[list[int]]:
    """Indexes of consecutive texts, at most about ``most_chars`` characters together."""
    at, size = [], 0
    for i, text in enumerate(texts):
        if at and size + len(text) > most_chars:
            yield at
            at, size = [], 0
        at.append(i)
        size += len(text)
    if at:
        yield at


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting (``np.unique`` hashes them, which takes longer)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``key`` so that reruns agree; all
    rows if there are no more than that."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * most / n))
