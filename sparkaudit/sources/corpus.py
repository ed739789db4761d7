"""Readers for documents, result tables, rules, fixed-width files, folders and nested records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES_SCHEMA = T.StructType(
    [
        T.StructField("abstract_max_words", T.IntegerType()),
        T.StructField("abstract_must_not_cite", T.BooleanType()),
        T.StructField("stale", T.ArrayType(T.StringType())),
        T.StructField("required", T.ArrayType(T.StringType())),
        T.StructField("forbidden", T.ArrayType(T.StringType())),
        T.StructField(
            "csv_counts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("path", T.StringType()),
                        T.StructField("where", T.StringType()),
                        T.StructField("group_by", T.StringType()),
                        T.StructField("expect", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents from Parquet (as stored) or from text files (one file, one document)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "text":
        return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
            F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
        )
    raise ValueError(f"unknown corpus format {fmt}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table with every column as text; a byte-order mark on the first column is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", nullValue=None, emptyValue="")
    return df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])


def results_or_finding(spark: SparkSession, name: str, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The table, or a finding that it is missing; a missing table never raises."""
    try:
        return read_results(spark, path), None
    except Exception as exc:  # the reader reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        row = [(name, "FAIL", f"result table missing: {path}")]
        return None, spark.createDataFrame(row, "check string, status string, detail string")


def load_rules(spark: SparkSession, path: str, one_file: bool = True) -> DataFrame:
    """Rule files, one row each, absent keys filled with their defaults. ``one_file`` false: a rule file on each line."""
    raw = spark.read.schema(RULES_SCHEMA).json(path, multiLine=one_file)
    texts = F.array().cast("array<string>")
    return raw.select(
        "abstract_max_words",
        F.coalesce("abstract_must_not_cite", F.lit(False)).alias("abstract_must_not_cite"),
        *[F.coalesce(c, texts).alias(c) for c in ("stale", "required", "forbidden")],
        F.coalesce("csv_counts", F.array().cast(RULES_SCHEMA["csv_counts"].dataType)).alias("csv_counts"),
    )


def parse_column_dictionary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, name, start, end) from the ``NAME start[-end]`` lines between INPUT and ``;``."""
    entry = r"^\s*([A-Z0-9_]+)\s+(\d+)(?:-(\d+))?"
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?ms)^\s*INPUT(.*?);"), F.lit(1))
    lines = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda s: s.rlike(entry))
    flat = docs.select(F.col(doc_id).alias("doc_id"), F.explode(lines).alias("_s"))
    start = F.regexp_extract("_s", entry, 2).cast("int")
    end = F.nullif(F.regexp_extract("_s", entry, 3), F.lit("")).cast("int")
    return flat.select(
        "doc_id", F.regexp_extract("_s", entry, 1).alias("name"), start.alias("start"),
        F.coalesce(end, start).alias("end"),
    )


def slice_fixed_width(
    lines: DataFrame, dictionary: Mapping[str, tuple[int, int]], variables: Sequence[str], line: str = "value"
) -> DataFrame:
    """Numeric columns cut at 1-based positions; unparsable cells and absent variables are NULL."""
    out = []
    for name in variables:
        if name in dictionary:
            start, end = dictionary[name]
            out.append(F.trim(F.substring(F.col(line), start, end - start + 1)).try_cast("double").alias(name))
        else:
            out.append(F.lit(None).cast("double").alias(name))
    return lines.select(*out)


def read_fixed_width(
    spark: SparkSession, path: str, dictionary: Mapping[str, tuple[int, int]], variables: Sequence[str]
) -> DataFrame:
    return slice_fixed_width(spark.read.text(path), dictionary, variables)


def scan_files(
    spark: SparkSession, root: str, pattern: str = "*", exclude_dirs: Sequence[str] = (".git", "__pycache__"),
    with_hash: bool = True,
) -> DataFrame:
    """Inventory below a folder: path relative to it, bytes, rows of text files and SHA-256.

    Without the hash the file contents are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/').split('/')[-1]}\E/", "")
    for name in exclude_dirs:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    columns = [relative.alias("file"), F.col("length").alias("bytes")]
    if with_hash:
        lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
        columns += [F.when(F.col("path").endswith(".csv"), lines - 1).alias("rows"), F.sha2("content", 256).alias("sha256")]
    return files.select(*columns)


def read_nested(spark: SparkSession, path: str, schema: str, array: str, item: str) -> DataFrame:
    """JSON records with one array exploded; records with an empty array are kept."""
    return spark.read.schema(schema).json(path).withColumn(item, F.explode_outer(array)).drop(array)
