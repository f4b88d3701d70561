"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the texts, an external sort places equal texts side by side, and a
window over each run of equal neighbours (compared in full) chooses the row that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, text_or_empty

ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: What splitters are sampled from: a text's start and a hash, so that samples stay small however long
#: texts are, and texts that start alike still spread. The whole text follows in the sort.
_SPLIT_BY = ("_start", "_h", "_salt")


def _start() -> Column:
    return F.substring("_t", 1, 16)


def _frequent(keyed: DataFrame, partitions: int) -> DataFrame:
    """Digests of texts with more copies than half an average partition has rows.

    At most ``2 * partitions`` digests can be that frequent, so the table has a fixed bound. Counting
    is summed before the shuffle. A digest shared by different texts only salts texts that need not be.
    """
    least = max(1, keyed.count() / (2 * partitions))
    counts = keyed.groupBy("_h").agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > least).select("_h", F.lit(True).alias("_hot"))


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; a null text is the empty text. ``keep`` says whether
    the row with the smallest or the largest identifier stays. Null identifiers come last, so such a
    row stays (with a null ``keep_id``) only if its whole group has none. Of repeated rows with the
    same identifier and text one is kept. An empty table gives no rows. Columns besides the two named
    ones are neither read nor returned.

    A text with many copies is dealt over salts, chosen from its identifiers, and only one summed row
    for each task and text is brought together again.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    parts = n_partitions(spark)
    keyed = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).withColumn(
        "_h", F.xxhash64("_t")
    )
    best = F.max if keep == "largest" else F.min
    hot = F.broadcast(_frequent(keyed, parts))

    whole = (
        keyed.join(hot, "_h", "left_semi")
        .groupBy("_h", "_t")
        .agg(best("_id").alias("_hot_id"), F.count("*").alias("_hot_n"))
        .select(F.sha2("_t", 256).alias("_sha"), "_hot_id", "_hot_n", F.lit(True).alias("_known"))
    )

    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(parts))).otherwise(F.lit(0))
    dealt = (
        keyed.join(hot, "_h", "left")
        .select("_id", "_t", "_hot", "_h", _start().alias("_start"), salt.cast("int").alias("_salt"))
        .repartitionByRange(parts, *_SPLIT_BY)
    )
    run = Window.partitionBy(*_SPLIT_BY, "_t")
    first = run.orderBy(F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last())
    local = dealt.select(
        "_id",
        F.sha2("_t", 256).alias("_sha"),
        F.coalesce("_hot", F.lit(False)).alias("_hot"),
        F.row_number().over(first).alias("_rank"),
        F.first("_id").over(first).alias("_keep"),
        F.count("*").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    kept = F.coalesce("_hot_id", "_keep")
    return local.join(F.broadcast(whole), "_sha", "left").select(
        F.col("_id").alias(id_col),
        kept.alias("keep_id"),
        F.coalesce("_hot_n", "_n").alias("group_size"),
        ((F.col("_rank") == 1) & F.col("_id").eqNullSafe(kept)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, one for each distinct text, all columns unchanged.

    Each column rides through the sort, so that no second join on texts is needed.
    """
    text = options.get("text_col", "text")
    ident = options.get("id_col", "doc_id")
    keep = options.get("keep", "largest")
    spark = docs.sparkSession
    parts = n_partitions(spark)
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row")).select(
        "_row",
        F.col(f"_row.`{ident}`").alias("_id"),
        F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit("")).alias("_t"),
    )
    keyed = packed.withColumn("_h", F.xxhash64("_t"))
    best = F.max if keep == "largest" else F.min
    narrow = keyed.select("_id", "_t", "_h")
    hot = F.broadcast(_frequent(narrow, parts))
    whole = (
        narrow.join(hot, "_h", "left_semi")
        .groupBy("_h", "_t")
        .agg(best("_id").alias("_hot_id"))
        .select(F.sha2("_t", 256).alias("_sha"), "_hot_id", F.lit(True).alias("_known"))
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(parts))).otherwise(F.lit(0))
    rest = [c for c in cols if c != text]
    dealt = (
        keyed.join(hot, "_h", "left")
        .select(
            "_id",
            "_t",
            F.col(f"_row.`{text}`").isNull().alias("_null"),
            F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in rest]).alias("_rest"),
            "_h",
            _start().alias("_start"),
            salt.cast("int").alias("_salt"),
            F.coalesce("_hot", F.lit(False)).alias("_hot"),
        )
        .repartitionByRange(parts, *_SPLIT_BY)
    )
    order = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*_SPLIT_BY, "_t").orderBy(order)))
    one = ranked.where("_rank = 1").withColumn("_sha", F.when(F.col("_hot"), F.sha2("_t", 256)))
    kept = one.join(F.broadcast(whole), "_sha", "left").where(
        F.col("_known").isNull() | F.col("_id").eqNullSafe(F.col("_hot_id"))
    )
    value = {c: F.col(f"_rest.`{c}`") for c in rest} | {text: F.when(~F.col("_null"), F.col("_t"))}
    return kept.select(*[value[c].alias(c) for c in cols])
