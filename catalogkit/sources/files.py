"""Readers and writers of catalog tables: CSV, JSON, nested responses, file inventories."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from catalogkit.functions import keys


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header (byte order mark and quoted line breaks allowed); cells are trimmed,
    blank cells null, rows of blank cells out."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    blank = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns]
    df = df.where(F.concat(*blank) != "")
    return df.select(*(F.nullif(F.trim(F.col(f.name)), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema))


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path`` as a stream: a folder, a pattern, or one file (which a stream
    takes as a pattern only)."""
    path = path.rstrip("/")
    pattern = path if re.search(r"[*?\[\]{}\\]", path) else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """The given columns in order; missing ones are blank. Quotes are doubled, as ``read_csv`` takes them."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_json_table(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """A table of JSON records (an array a file, or a document; with ``lines`` one each line, which large files can be
    split at); empty if there is no such path."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


CORRUPT = "corrupt_record"


def write_sources(df: DataFrame, path: str, source: str, form: str = "json", mode: str = "error") -> None:
    """One table for all sources, a folder for each (``source=<name>``); ``form`` is json, csv or parquet. Rows are
    dealt evenly over tasks, not by source, so that a large source is no hot task."""
    writer = df.write.mode(mode).partitionBy(source)
    (writer.option("header", True).option("escape", '"') if form == "csv" else writer).format(form).save(path)


def merged_schema(schemas: list[StructType]) -> StructType:
    """All columns of all schemas in the order they come; a column of two types is an error, but whole numbers widen."""
    widths = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3}
    found: dict[str, StructField] = {}
    for field in (f for s in schemas for f in s):
        old = found.get(field.name)
        a, b = (x.dataType.simpleString() if x else None for x in (old, field))
        if old is None or (a in widths and b in widths and widths[a] < widths[b]):
            found[field.name] = StructField(field.name, field.dataType, True)
        elif a != b and not (a in widths and b in widths):
            raise ValueError(f"{field.name} is {a} and {b}")
    return StructType(list(found.values()))


def read_sources(spark: SparkSession, path: str, schemas: list[StructType], source: str, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of a JSON table that ``write_sources`` wrote, and the lines set aside (``source``, ``corrupt_record``): those
    that are no record of the schema. The columns are those of all ``schemas``; one that a source lacks is null. With
    ``only`` some sources, the files of the others are not read."""
    schema = merged_schema(schemas)
    lines = spark.read.schema(StructType([StructField("value", StringType()), StructField(source, StringType())])).text(path)
    lines = lines.where(F.col(source).isin(only)) if only is not None else lines
    whole = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = lines.select(source, F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select(*(f"r.{f.name}" for f in schema), source), parsed.where(bad).select(source, F.col("value").alias(CORRUPT))


SEARCH_RESPONSE = (
    "fetched_at timestamp, brand_id string, query string, http_status bigint, search_status string, "
    "results array<struct<brandId: string, claimed: boolean, domain: string, name: string, icon: string, _score: double, qualityScore: double, verified: boolean>>"
)


def read_search_responses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_json_table(spark, path, SEARCH_RESPONSE, lines)


def map_records(df: DataFrame, records: str, status: str = "status", accept: str = "matched", score: str = "confidence", least: int = 80) -> DataFrame:
    """A map column of structs as rows (``key``, fields), those accepted with a high enough score."""
    one = df.select(F.explode(records).alias("key", "record")).select("key", "record.*")
    return one.where((F.col(status) == accept) & (F.coalesce(F.col(score), F.lit(0)) >= least))


def marked_ids(df: DataFrame, lists: tuple[str, ...], marks: str, flag: str) -> DataFrame:
    """Identifiers in any of the list columns, or in the map of marks with the flag set."""
    out = df.select(F.explode(F.map_keys(F.map_filter(marks, lambda _, m: F.coalesce(m[flag], F.lit(False))))).alias("id"))
    for c in lists:
        out = out.unionByName(df.select(F.explode(c).alias("id")))
    return out.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "").distinct()


def remapped_ids(marks: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Marks with old identifiers carried over to the new ones that are not marked yet."""
    moved = marks.join(mapping.select(F.col(old).alias("id"), F.col(new).alias("__new")), "id").select(F.col("__new").alias("id"))
    return marks.select("id").unionByName(moved.join(marks.select("id"), "id", "left_anti")).distinct()


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, name, extension, size and time of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", keys.basename(F.col("path")).alias("name"), keys.extension(F.col("path")).alias("format"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder_size(files: DataFrame) -> DataFrame:
    """Number and size of the files directly in each folder."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def folder_rollup(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """For each folder the files directly in it and below it, at any depth: ``folder``, ``depth`` (of the folder, the
    top one 0), ``own_files``, ``own_size``, ``files``, ``size``.

    Files are first added up by their own folder, within tasks; only these sums go up to all the folders above, where they
    are added up within tasks again, so that the top folder is no hot key. A file without a slash lies in the
    top folder, which is the empty path; slashes at the start and doubled ones do not count. Files of null path are left out, null sizes are 0."""
    parts = F.filter(F.split(F.col(path), "/+"), lambda p: p != "")
    own = files.where(F.col(path).isNotNull()).select(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("in"), F.coalesce(F.col(size), F.lit(0)).alias("__size"))
    own = own.groupBy("in").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size"))
    above = F.explode(F.sequence(F.lit(0), F.size("in")))
    lifted = own.select("in", "n", "size", above.alias("depth"))
    here = F.col("depth") == F.size("in")
    total = lifted.groupBy(F.slice("in", 1, F.col("depth")).alias("at"), "depth").agg(F.sum(F.when(here, F.col("n")).otherwise(0)).alias("own_files"), F.sum(F.when(here, F.col("size")).otherwise(0)).alias("own_size"), F.sum("n").alias("files"), F.sum("size").alias("size"))
    return total.select(F.array_join("at", "/").alias("folder"), "depth", "own_files", "own_size", "files", "size")


def expanded_variants(items: DataFrame, fields: dict[str, bool], rest: tuple[str, ...]) -> DataFrame:
    """Rows (``rest`` columns, ``variant``, ``file``, ``wordmark``) from map columns variant -> file;
    a field given as plain string counts as the variant ``default``."""
    out = None
    for field, wordmark in fields.items():
        c = F.col(field)
        as_map = F.when(c.isNotNull(), F.create_map(F.lit("default"), c)) if items.schema[field].dataType.simpleString() == "string" else c
        one = items.select(*rest, F.explode(as_map).alias("variant", "file")).withColumn("wordmark", F.lit(wordmark))
        out = one if out is None else out.unionByName(one)
    return out


def orphans(files: DataFrame, known: DataFrame, file: str) -> DataFrame:
    return files.join(known.select(file).distinct(), file, "left_anti")


def landed(tables: dict[str, DataFrame]) -> DataFrame:
    """Typed union of the collectors' tables with their ``source_type``; missing columns are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("source_type", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def adapted(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One select into another table's columns."""
    return df.select(*(c.alias(name) for name, c in columns.items()))
