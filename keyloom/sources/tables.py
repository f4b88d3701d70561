"""Inputs: Parquet tables, lines of text and records with a place for those that don't parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REJECTED = "_rejected"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """``value``: the lines of text files without trailing carriage returns. Unreadable files raise."""
    lines = spark.read.option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", False).text(list(paths))
    return lines.select(F.regexp_replace("value", r"\r+$", "").alias("value"))


def read_records(spark: SparkSession, *paths: str, schema: T.StructType, kind: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """Parsed records of CSV or JSON lines, and the lines that don't parse, kept as they are."""
    if kind not in ("csv", "json"):
        raise ValueError("kind is csv or json")
    full = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED, **options}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    parse = F.from_csv("value", ddl, how) if kind == "csv" else F.from_json("value", full, how)
    got = read_lines(spark, *paths).where("value <> ''").select(parse.alias("r"), "value")
    bad = F.col(f"r.{REJECTED}").isNotNull()
    return got.where(~bad).select("r.*").drop(REJECTED), got.where(bad).select(F.col("value").alias("line"))


def records_from(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """Records that the caller holds already."""
    return spark.createDataFrame(rows, schema)
