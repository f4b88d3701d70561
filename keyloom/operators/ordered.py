"""Rows in a total order without a task that sees them all.

A table is range-partitioned on its order, sorted and stored once. What a row needs of the rows before its
own range, their number or the last of them, is a row for each stored file, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path

FILE, ROW = "_file", "_row"


def file_number() -> Column:
    """The number in a part file's name; names themselves sort wrongly from the 100,000th file on."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-([0-9]+)", 1).cast("long")


def stored_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted, with the number of its file and the place in it."""
    clash = {FILE, ROW, "_n", "_start", "_last", "_prior"} & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {', '.join(sorted(clash))}")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = scratch_path(spark, "ordered")
    names = [f"_by{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    keyed.repartitionByRange(parts, *names).sortWithinPartitions(*names).write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored.select(*[F.col(f"`{c}`") for c in df.columns], file_number().alias(FILE), F.col("_metadata.row_index").alias(ROW))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order."""
    placed = stored_in_order(df, order)
    sizes = placed.groupBy(FILE).agg(F.count("*").alias("_n"))  # a row for each file
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(FILE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), FILE).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col(ROW)).alias(name))


def with_prior(df: DataFrame, order: list[Column], carry: list[str], name: str = "prior") -> DataFrame:
    """``df`` with the columns ``carry`` of the row before in the order as a struct; null for the first row."""
    placed = stored_in_order(df, order)
    own = F.struct(*[F.col(f"`{c}`") for c in carry])
    lasts = placed.groupBy(FILE).agg(F.max_by(own, F.col(ROW)).alias("_last"))  # a row for each file
    bounds = lasts.select(FILE, F.lag("_last").over(Window.orderBy(FILE)).alias("_prior"))
    within = F.lag(own).over(Window.partitionBy(FILE).orderBy(ROW))
    chained = placed.select("*", within.alias("_last")).join(F.broadcast(bounds), FILE)
    prior = F.when(F.col(ROW) == 0, F.col("_prior")).otherwise(F.col("_last"))
    return chained.select(*[F.col(f"`{c}`") for c in df.columns], prior.alias(name))
