"""JSON lines, Parquet with explicit projection, and sinks that commit before their manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a fixed schema (a StructType or DDL): blank lines are skipped, a byte-order mark is dropped, unknown shapes and non-finite numbers fail."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    opts = {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}
    return lines.select(F.from_json("value", schema, opts).alias("r")).select("r.*")


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line) of lines that aren't objects of the schema: the diagnosis after a failed read. Line ids grow along each file part."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("value"))
    t = t.filter(F.trim("value") != "")
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"})
    return t.select("file", "line", parsed.getField("_bad").alias("value")).filter("value IS NOT NULL")


def read_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet with exactly these columns; no other column is read from disk."""
    return spark.read.parquet(path).select(*columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Canonical JSON lines: sorted keys at every level that Spark names, nulls written."""
    ordered = df.select(*[_ordered(f.name, f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    ordered.select(F.to_json(F.struct(*ordered.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def _ordered(name: str, kind: T.DataType):
    c = F.col(f"`{name}`")
    return _sorted_fields(c, kind).alias(name)


def _sorted_fields(c, kind: T.DataType):
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_sorted_fields(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted_fields(x, kind.elementType))
    return c


def _context(spark: SparkSession, path: str):
    """(file context, path) of the file system that the path belongs to, shared storage included."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    p = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)
    return fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file in UTF-8 on any storage that Spark can reach: readers see the old content or the new one, never a part."""
    jvm = spark.sparkContext._jvm
    files, target = _context(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    fs = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(draft, target, how)


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON document, indented by two, without NaN."""
    write_text(spark, path, f"{json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False)}\n")


def collection_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """(rows, digest): a digest of the table with its order columns as part of each row.

    Row digests are added in five 48-bit parts, so no task holds all rows and any partitioning gives the same result; a
    changed, lost, added or renumbered row changes it.
    """
    cols = sorted({*df.columns, *order})
    d = df.select(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return d.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(part(i), F.lit("0")) for i in range(5)]), 256).alias("digest"))


def write_splits(df: DataFrame, path: str, manifest: str | None = None, split: str = "split") -> DataFrame:
    """One directory for each split and, after the data is committed, a manifest of counts; the counts are returned."""
    df.write.partitionBy(split).mode("errorifexists").parquet(path)
    counts = df.sparkSession.read.parquet(path).groupBy(split).agg(F.count("*").alias("n"))
    if manifest:
        write_json(df.sparkSession, manifest, {"splits": {str(r[split]): r["n"] for r in counts.collect()}})
    return counts


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
