"""Whole-row operators: unions, duplicates and their counts, and output encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import little_endian_length


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).dropDuplicates()


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row once, or once for its values of ``columns``, which alone are returned then."""
    return df.dropDuplicates() if columns is None else df.select(*columns).dropDuplicates()


def sort_count(df: DataFrame) -> DataFrame:
    """One row ``total, unique_rows, dupes_percent`` without writing anything."""
    each = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    share = F.when(total > 0, F.round((total - F.count("*")) * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return each.agg(total.alias("total"), F.count("*").alias("unique_rows"), share.alias("dupes_percent"))


def text_line(columns: list[str], separators: list[Column] | str = ":") -> Column:
    """Columns as one line; separators may be columns, so that each row keeps its own."""
    between = [F.lit(separators)] * (len(columns) - 1) if isinstance(separators, str) else separators
    out: list[Column] = []
    for i, c in enumerate(columns):
        out += ([between[i - 1]] if i else []) + [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))]
    return F.concat(*out)


def frame(columns: list[str]) -> Column:
    """Columns as one binary: each as its length in four bytes, least first, and its bytes."""
    out: list[Column] = []
    for c in columns:
        data = F.encode(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "UTF-8")
        out += [little_endian_length(data), data]
    return F.concat(*out)
