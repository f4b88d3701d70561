"""Lookups by text key. The predicates are plain comparisons on stored columns, which reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import frame

MODES = ("exact", "prefix", "suffix", "contains")
REVERSED = "_reversed"
SEGMENT = "segment_id"


def with_reversed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the reversed key stored, so that a suffix lookup becomes a prefix lookup."""
    if key + REVERSED in df.columns:
        raise ValueError(f"column name {key + REVERSED} is reserved")
    return df.withColumn(key + REVERSED, F.reverse(F.col(key)))


def data_columns(df: DataFrame) -> list[str]:
    """The columns without those that a store adds: reversed keys and, beside them, the segment."""
    extra = {c + REVERSED for c in df.columns} & set(df.columns)
    return [c for c in df.columns if c not in extra and not (extra and c == SEGMENT)]


def predicate(df: DataFrame, key: str, mode: str, value: str | bytes | bytearray) -> Column:
    """The condition of a lookup; null keys match nothing.

    An empty suffix matches nothing, while an empty prefix or part matches every key. A suffix uses the
    stored reversed key where the table has one. Bytes that are text match as that text does; others are
    compared with the key's bytes.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if key not in df.columns:
        raise ValueError(f"no key column {key}")
    c = F.col(f"`{key}`")
    if isinstance(value, bytes):
        if dict(df.dtypes)[key] == "binary":
            value = bytearray(value)
        else:
            try:
                value = value.decode()
            except UnicodeDecodeError:
                c, value = c.cast("binary"), bytearray(value)
    if mode == "exact":
        return c == F.lit(value)
    if mode == "prefix":
        return F.startswith(c, F.lit(value)) if isinstance(value, bytearray) else c.startswith(value)
    if mode == "contains":
        return F.contains(c, F.lit(value)) if isinstance(value, bytearray) else c.contains(value)
    if not value:
        return c.isNotNull() & F.lit(False)
    if isinstance(value, bytearray):
        return F.endswith(c, F.lit(value))
    stored = key + REVERSED
    if stored in df.columns:
        return F.col(f"`{stored}`").startswith(value[::-1])
    return c.endswith(value)


def lookup(df: DataFrame, key: str, mode: str, value: str | bytes, *, distinct: bool = True) -> DataFrame:
    """Rows whose key matches; each equal row once unless ``distinct`` is false.

    Of a store's table the rows' own columns count and are returned then, so a row in two segments comes
    once.
    """
    found = df.where(predicate(df, key, mode, value))
    return found.select(*[F.col(f"`{c}`") for c in data_columns(df)]).dropDuplicates() if distinct else found


def matched_frames(df: DataFrame, key: str, mode: str, value: str | bytes, columns: list[str], *, distinct: bool = True) -> DataFrame:
    """One binary column ``frame``: the given columns of the rows that match, each combination of them once.

    Columns that aren't named, such as separators, don't tell rows apart.
    """
    found = df.where(predicate(df, key, mode, value)).select(*[F.col(f"`{c}`") for c in columns])
    return (found.dropDuplicates() if distinct else found).select(frame(columns).alias("frame"))


def counters(found: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``found, dupes, saved``: rows, rows that repeat another, distinct rows."""
    cols = columns or found.columns
    each = found.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return each.agg(total.alias("found"), (total - F.count("*")).alias("dupes"), F.count("*").alias("saved"))


def matched_keys(found: DataFrame, key: str, segment: str = SEGMENT) -> DataFrame:
    """One row ``matched``: distinct keys summed over segments, so a key in two segments counts twice."""
    return found.select(segment, key).distinct().agg(F.count("*").alias("matched"))
