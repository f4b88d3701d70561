"""SimHash near-duplicates with BK-trees.

Fingerprints within three bits of each other agree in some of their blocks, so each distinct
fingerprint is dealt to shards by blocks of its bits. Each shard holds a BK-tree, whose children hang
at their integer Hamming distance from the parent; a lookup follows only edges within the radius.
Found links are kept as a forest, and components come from joining the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, remove, text_or_empty, written
from .components import Forest, connected_components

RADIUS = 3
#: A shard with more fingerprints is split by blocks of the bits that its key leaves.
MOST_IN_SHARD = 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The majority, bit by bit, of the hashes of the word shingles; ties and no words give zero bits."""
    parts = text.encode().translate(_LOWER).split()  # bytes split at exactly \x20 and \x09-\x0D
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), seed)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate(([0], ends[: -words]))
        hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    every = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 1 << 15):
        total += np.unpackbits(every[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(found, pa.int64())], names=["id", "h", "fp"]
            )

    return run


class BKTree:
    """Numbers by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """The places of the numbers within the radius."""
        near, todo = [], [0] if self.values else []
        values, edges = self.values, self.edges
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                near.append(at)
            below = edges[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    todo += [c for e, c in below.items() if d - radius <= e <= d + radius]
                else:
                    todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return near

    def add(self, value: int) -> None:
        values, edges = self.values, self.edges
        at = 0
        while values:
            d = (values[at] ^ value).bit_count()
            child = edges[at].get(d)
            if child is None:
                edges[at][d] = len(values)
                break
            at = child
        values.append(value)
        edges.append({})

    def link(self, value: int, radius: int) -> list[int]:
        """Add a number; the places of those already there within the radius."""
        near = self.within(value, radius)
        self.add(value)
        return near


def _links(radius: int):
    """Fingerprints sorted by shard -> a forest of the links in a task's shards."""

    def solve(values: list[int], forest: Forest) -> list[tuple[int, int]]:
        if len(values) == 2:
            a, b = values
            return [(a, b)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius and forest.add(a, b) else []
        tree, out = BKTree(), []
        for v in values:
            out += [(v, values[j]) for j in tree.link(v & 0xFFFFFFFFFFFFFFFF, radius) if forest.add(v, values[j])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, forest = None, [], Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, v in zip(batch.column("k").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if k != now:
                    if len(values) > 1:
                        found += solve(values, forest)
                    now, values = k, []
                values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
        found = solve(values, forest) if len(values) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    """Masks such that numbers within the radius on these bits agree under one of them at least."""
    cuts = [bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks)]
    return [sum(1 << b for c in chosen for b in c) for chosen in combinations(cuts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("m"), fp.bitwiseAND(F.lit(_signed(m))).alias("x")) for i, m in enumerate(masks)])


def near_pairs(nodes: DataFrame, *, radius: int = RADIUS, blocks: int | None = None, most: int = MOST_IN_SHARD) -> DataFrame:
    """Links ``u, v`` among distinct fingerprints ``fp`` (longs) that join all that are within the radius.

    ``blocks`` sets how many blocks the 64 bits have, of which ``blocks - radius`` must agree; by
    default as few as keep shards of unlike fingerprints small at the table's size. No pair is lost
    for any value: it only shifts work between more copies and larger shards. Shards over ``most``
    are split once more by blocks of their free bits, which loses nothing either.
    """
    spark = nodes.sparkSession
    if blocks is None:
        count, blocks = nodes.count(), radius + 1
        while blocks < radius + 4 and count >> (64 * (blocks - radius) // blocks) > 64:
            blocks += 1
    masks = _masks(list(range(64)), blocks, radius)
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("x")).select("fp", "x.m", "x.x")
    crowded, path = written(keyed.groupBy("m", "x").agg(F.count("*").alias("c")).where(F.col("c") > most).select("m", "x"), "crowded")
    plain = keyed.select("fp", F.xxhash64("m", "x").alias("k"))
    if not crowded.isEmpty():
        split = keyed.join(crowded, ["m", "x"], "left_semi")
        sub = F.lit(None)
        for i, m in enumerate(masks):
            free = [b for b in range(64) if not m >> b & 1]
            sub = F.when(F.col("m") == i, _keys(F.col("fp"), _masks(free, radius + 1, radius))).otherwise(sub)
        split = split.select("fp", "m", "x", F.explode(sub).alias("y")).select(
            "fp", F.xxhash64("m", "x", F.col("y.m"), F.col("y.x")).alias("k")
        )
        plain = keyed.join(crowded, ["m", "x"], "left_anti").select("fp", F.xxhash64("m", "x").alias("k")).unionByName(split)
    return (
        plain.repartition(n_partitions(spark), "k")
        .sortWithinPartitions("k")
        .mapInArrow(_links(radius), "u long, v long")
    )


def _assigned(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``id, h, fp`` of each row, and ``fp, component`` of each distinct fingerprint, where one row's ids can be seen."""
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    kind = dict(keyed.dtypes)["id"]
    prints, _ = written(keyed.mapInArrow(_fingerprints(words), f"id {kind}, h long, fp long"), "fingerprints")
    nodes, nodes_at = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts, scratch = connected_components(near_pairs(nodes.select("fp"), radius=radius))
    labelled = nodes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label")
    )
    heads = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    groups, _ = written(labelled.join(heads, "label").select("fp", "label", "component_id"), "groups")
    remove(docs.sparkSession, nodes_at, *scratch)
    return prints, groups


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    Texts are lower-cased A-Z, words are what white space (``\\x20 \\x09-\\x0D``) separates, and shingles
    of ``words`` words count as often as they occur; a shorter text is one shingle. A null text, an empty
    one or one without words has fingerprint zero and links like any other. Fingerprints at ``radius`` or
    fewer bits link; ``component_id`` is the least identifier that links reach, null only if a whole
    component has null identifiers. Repeated rows give repeated results; an empty table gives none. Other
    columns are not read.

    Only distinct fingerprints are compared, so copies cost nothing, and only a forest of links is kept.
    """
    prints, groups = _assigned(docs, id_col, text_col, words, radius)
    return prints.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document for each component, the one with the least identifier.

    All columns are unchanged. Where several texts have that identifier, the one with the least hash
    stays, and of wholly repeated rows one. A component whose identifiers are all null keeps one row too.
    """
    prints, groups = _assigned(docs, id_col, text_col, words, radius)
    best = (
        prints.join(groups, "fp")
        .groupBy("label")
        .agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("b"))
        .select(F.col("b.id").alias("_i"), F.col("b.h").alias("_h"))
    )
    return rows_of(docs, best, id_col, text_col)


def rows_of(docs: DataFrame, best: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with the identifiers ``_i`` and text hashes ``_h`` of ``best``, one for each.

    A row rides as one value, so its columns may have any names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    rows = packed.select("row", F.col(f"row.`{id_col}`").alias("i"), F.xxhash64(text).alias("h")).select("*", F.xxhash64("i", "h").alias("k"))
    chosen = best.select("_i", "_h", F.xxhash64("_i", "_h").alias("k"))
    # dealt by k alone, and with k among the keys, the rows stay where the join has them, so that texts are shuffled once;
    # plain equalities would become keys of the join
    same = F.when(F.col("i").isNull(), F.col("_i").isNull()).otherwise(F.coalesce(F.col("i") == F.col("_i"), F.lit(False)))
    kept = rows.join(chosen, "k").where(same & (F.col("h").bitwiseXOR(F.col("_h")) == 0))
    return kept.dropDuplicates(["k", "i", "h"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
