"""Dictionaries, posting lists and the joins that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import common_prefix_length
from .ordered import numbered, with_prior

BLOCK = 64
#: Rows between the places where posting lists are cut.
LIST_ROWS = 1 << 16


def dictionary(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys; null counts as empty."""
    return df.select(F.coalesce(F.col(key), F.lit("")).alias(key)).distinct()


def ranked(keys: DataFrame, key: str, *, by: Column | None = None, rank: str = "key_id") -> DataFrame:
    """Distinct keys with their place, from 0, in the order of ``by`` (the key itself by default).

    Keys are range-partitioned, sorted and written once; a key's place is its row number in its file
    after the rows of the files before, so no task sees more than its own range.
    """
    return numbered(keys, [F.col(key) if by is None else by], rank)


def postings(df: DataFrame, key: str, row_id: str, *, list_rows: int = LIST_ROWS) -> DataFrame:
    """Each key's ascending row identifiers as ``key, part, rows``.

    Rows are numbered in the order of key and identifier, and a list ends where the number reaches a
    multiple of ``list_rows``; ``part`` counts those places. So no list is longer than that, and a key
    with any share of the rows is spread over tasks. The lists of a key follow one another by ``part``.
    """
    if list_rows < 1:
        raise ValueError("list_rows is at least 1")
    each = numbered(df.select(key, row_id), [F.col(key), F.col(row_id)], "part")
    cut = each.withColumn("part", F.floor(F.col("part") / list_rows).cast("long"))
    return cut.groupBy(key, "part").agg(F.sort_array(F.collect_list(row_id)).alias("rows"))


def posting_list_deltas(lists: DataFrame) -> DataFrame:
    """Posting lists with each identifier as the difference to the one before in its list."""
    diff = lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("rows"), i - 1))
    return lists.withColumn("deltas", F.transform("rows", diff))


def posting_deltas(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The difference of each row identifier to the one before it under its key, as rows.

    Ranges of the order are separate tasks, so a key with any share of the rows is spread.
    """
    chained = with_prior(df.select(key, row_id), [F.col(key), F.col(row_id)], [key, row_id])
    same = F.col("prior").isNotNull() & F.col(f"prior.{key}").eqNullSafe(F.col(key))
    return chained.select(key, row_id, (F.col(row_id) - F.when(same, F.col(f"prior.{row_id}")).otherwise(F.lit(0))).alias("delta"))


def key_offsets(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """First row and one past the last row of each key."""
    return df.groupBy(key).agg(F.min(row_id).alias("first_row"), (F.max(row_id) + 1).alias("end_row"))


def group_starts(df: DataFrame, key: str, within: str, row_id: str) -> DataFrame:
    """Rows where the key differs from the row before, in the order of ``row_id`` within ``within``.

    The first row of each ``within`` starts a group; a null key equals a null key. Ranges of the order
    are separate tasks.
    """
    chained = with_prior(df.select(within, row_id, key), [F.col(within), F.col(row_id)], [within, key])
    same = F.col("prior").isNotNull() & F.col(f"prior.{within}").eqNullSafe(F.col(within)) & F.col(f"prior.{key}").eqNullSafe(F.col(key))
    return chained.select(within, row_id, key, (~same).alias("starts"))


def front_code(ranked_keys: DataFrame, key: str, rank: str = "key_id", block: int = BLOCK) -> DataFrame:
    """Shared letters with the key before and the rest, anew in each block of keys."""
    w = Window.partitionBy(F.floor(F.col(rank) / block)).orderBy(rank)
    shared = common_prefix_length(F.lag(key).over(w), F.col(key))
    coded = ranked_keys.withColumn("shared", shared)
    return coded.withColumn("rest", F.expr(f"substring(`{key}`, shared + 1)"))


def encode_keys(df: DataFrame, key: str, ranked_keys: DataFrame, rank: str = "key_id") -> DataFrame:
    """``df`` with the key replaced by its place in the dictionary; a null key is the empty one."""
    filled = df.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    return filled.join(ranked_keys.select(key, rank), key).drop(key)


def decode_keys(df: DataFrame, ranked_keys: DataFrame, key: str, rank: str = "key_id") -> DataFrame:
    """``df`` with the key of its place. Spark broadcasts the dictionary only if it is small."""
    return df.join(ranked_keys.select(rank, key), rank)


def gather(lists: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """The rows that posting lists name."""
    return lists.select(F.explode("rows").alias(row_id)).join(rows, row_id)
