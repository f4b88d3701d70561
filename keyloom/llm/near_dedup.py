"""SimHash near-duplicates at a similarity of word shingles: op4's method with wider fingerprints, and the sets compared.

At a similarity of 0.8 fingerprints of 64 bits differ by some ten bits, and no block of 64 bits that is left
equal is long enough to deal texts to shards. So fingerprints here are as wide as their blocks need: disjoint
blocks of bits deal them to shards, each shard's BK-tree is searched, and the links make components, as in
``simhash``. An exact check follows: within a component the sets of shingles of what a BK-tree finds are
compared themselves, so that a link is never a guess.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, remove, text_or_empty, written
from .components import Forest, connected_components
from .simhash import BKTree, rows_of

WORDS = 5
SIMILARITY = 0.8
#: The most that a pair at the threshold may miss all shards, as a probability; it sets the number of blocks.
#: Pairs that differ by fewer bits than there are blocks always meet.
MISS = 3e-6
#: Leading bits of a fingerprint that trees hold, and how many of them may differ. Large sets of similarity 0.8
#: differ by 29.1 on average; sets of four and five shingles by 36, the most, and by more than this in 1.1 of a
#: million. Unlike sets are this near in 1.1 of a million.
BITS, RADIUS = 192, 63
#: Unlike fingerprints that a shard holds on average; blocks are as short as that allows.
IN_SHARD, LEAST_BLOCK = 64, 8
#: Sets of a group that are compared in one task; larger groups are compared block by block.
MOST_IN_GROUP = 1024
#: Sets of a larger group, about, that every block of it is compared with first.
LEADERS = 32
#: Bits of the maps that rule out most of the unlike sets of a group before they are compared.
MAP = 2048
#: Set sizes whose worst pair is worked out; that of larger sets is no worse than that of the last third.
_SIZES = 48
#: Fingerprints whose shards are made at once, and parts of the shards for each partition.
_AT_ONCE, _PARTS = 2048, 16
_ROW = np.dtype([("k", "<u4"), ("f", f"V{BITS // 8}")])
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words too."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at exactly \x20 and \x09-\x0D
    own = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(own))
    h = np.full(max(len(own) - words, 0) + 1, width, np.uint64)
    for k in range(width):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(h)])
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the sets share so large a part of their union."""
    few, many = sorted((len(a), len(b)))
    if few / many < similarity:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (few + many - both) >= similarity


def bitmap(s: np.ndarray) -> int:
    """A bit for each place that a set's hashes fall on. Two sets have no more in common than their bitmaps have, and
    as many as fall on places that others of the same set are on."""
    bits = np.zeros(MAP, np.uint8)
    bits[s % np.uint64(MAP)] = 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


@lru_cache
def differing(similarity: float) -> tuple[float, ...]:
    """For set sizes up to ``_SIZES``, and last for larger ones, how likely a fingerprint's bit differs from that of
    the worst set that is similar enough."""

    def ones(n: int) -> np.ndarray:
        return np.array([math.comb(n, i) / 2**n for i in range(n + 1)])

    def over(n: int, sums: np.ndarray) -> np.ndarray:
        return np.array([ones(n)[2 * np.arange(n + 1) - n + x > 0].sum() for x in sums])

    worst = [0.0] * (_SIZES + 1)
    for few in range(1, _SIZES + 1):
        for many in range(few, math.floor(few / similarity + 1e-9) + 1):
            both = math.ceil(similarity * (few + many) / (1 + similarity) - 1e-9)
            sums = 2 * np.arange(both + 1) - both
            x, y = over(few - both, sums), over(many - both, sums)
            p = float(ones(both) @ (x * (1 - y) + y * (1 - x)))
            for n in (few, many):
                if n <= _SIZES:
                    worst[n] = max(worst[n], p)
    return *worst, max(*worst[2 * _SIZES // 3 :], math.acos(2 * similarity / (1 + similarity)) / math.pi)


def blocks_needed(differ: float, length: int) -> int:
    """Blocks of ``length`` bits such that two fingerprints agree in none of them with a probability of ``MISS`` at most."""
    agree = (1 - differ) ** length
    return 1 if agree >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-agree))


def _numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What makes words 1 to ``n`` of a shingle's hash from its word 0."""
    return np.random.default_rng(8).integers(0, 1 << 64, n, np.uint64) | np.uint64(1), np.random.default_rng(9).integers(0, 1 << 64, n, np.uint64)


def wide_fingerprint(own: np.ndarray, bits: int, numbers: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The majority, bit by bit, of the hashes of a set of shingles, as whole words of bits; ties give zero bits."""
    more = -(-bits // 64) - 1
    odd, plus = numbers or _numbers(more)
    total = np.zeros(64 * (more + 1), np.int64)
    for at in range(0, len(own), 255):  # as many as a byte counts
        some = own[at : at + 255, None]
        h = np.concatenate((some, _mixed(some * odd[:more] + plus[:more])), axis=1).astype(">u8")
        total += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (total * 2 > len(own)).view(np.uint8)


def fingerprint(own: np.ndarray, bits: int = 64) -> int:
    """The leading bits of a set's fingerprint, as a number."""
    return int.from_bytes(np.packbits(wide_fingerprint(own, bits)[:bits]).tobytes(), "big") >> (-bits % 8)


def shards(prints: np.ndarray, length: int) -> np.ndarray:
    """A row for each fingerprint, given as a row of bits, and in it the shard of each of its blocks."""
    count = prints.shape[1] // length
    values = prints[:, : count * length].reshape(len(prints), count, length) @ (np.uint64(1) << np.arange(length, dtype=np.uint64))
    return (_mixed(values * np.uint64(0x9E3779B97F4A7C15) + np.arange(count, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _prints(words: int, length: int, differ: tuple[float, ...]):
    widths = [max(BITS, blocks_needed(p, length) * length) for p in differ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(max(widths) // 64)
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("t")]
            nodes = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
            found = []
            for s in sets:
                bits = widths[min(len(s), _SIZES + 1)]
                found.append(np.packbits(wide_fingerprint(s, bits, numbers)[:bits]).tobytes())
            own = pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), own, pa.array(found, pa.binary())], names=["id", "h", "node", "fp"])

    return run


def _dealt(length: int, parts: int):
    """Fingerprints -> for each part of the shards one packed row with the shard and the leading bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[bytes]] = {}
            for f in batch.column("fp").to_pylist():
                by_width.setdefault(len(f), []).append(f)
            for width, prints in by_width.items():
                for at in range(0, len(prints), _AT_ONCE):
                    raw = np.frombuffer(b"".join(prints[at : at + _AT_ONCE]), np.uint8).reshape(-1, width)
                    k = shards(np.unpackbits(raw, axis=1), length)
                    rows = np.empty(k.size, _ROW)
                    rows["k"] = k.ravel()
                    rows["f"] = np.repeat(np.ascontiguousarray(raw[:, : BITS // 8]).view(_ROW["f"]).ravel(), k.shape[1])
                    part = rows["k"] % np.uint32(parts)
                    order = np.argsort(part, kind="stable")
                    rows, part = rows[order], part[order]
                    starts = np.flatnonzero(np.diff(part, prepend=-1))
                    packed = [x.tobytes() for x in np.split(rows, starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "rows"])

    return run


def _names(prints: np.ndarray) -> list[int]:
    """The names of fingerprints, rows of bytes, in the graph: their first 64 bits. Those that share them are taken for linked, and checked later."""
    return np.ascontiguousarray(prints[:, :8]).view(">i8").ravel().tolist()


def _near(prints: np.ndarray, radius: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """Links between the places of different fingerprints, rows of bytes, that join all that are within the radius;
    none if there is more to compare than ``most`` allows.

    The BK-tree holds fingerprints of which no two are near. All others are linked to those that it finds, so
    near copies cost no more than a look-up each. What is still apart is compared outright: the linked ones with all, or
    all outside the largest component with all, as two that are near and in no tree together are among either.
    """
    tree, held, linked, out, forest = BKTree(), [], [], [], Forest()
    raw, width = prints.tobytes(), prints.shape[1]
    for i in range(len(prints)):
        value = int.from_bytes(raw[i * width : (i + 1) * width], "big")
        if found := tree.within(value, radius):
            linked.append(i)
            out += [(i, held[j]) for j in found if forest.add(i, held[j])]
        elif most is not None and len(held) == most:
            return None
        else:
            tree.add(value)
            held.append(i)
    if not linked:
        return out
    root = np.array([forest.root(i) for i in range(len(prints))])
    rest = np.flatnonzero(root != np.bincount(root).argmax())
    few = linked if len(linked) < len(rest) else rest.tolist()
    if most is not None and len(few) * len(prints) > 64 * most * most:
        return None
    words = np.ascontiguousarray(prints).view(np.uint64)
    for i in few:
        near = np.bitwise_count(words ^ words[i]).sum(axis=1) <= radius
        out += [(i, j) for j in np.flatnonzero(near & (root != root[i])).tolist() if forest.add(i, j)]
    return out


def met_before(u: np.ndarray, v: np.ndarray, k: np.ndarray, length: int) -> np.ndarray:
    """Whether fingerprints, rows of bytes, that met in shard ``k`` are linked in another: that of the first of the leading bits' blocks in which they agree."""
    count = BITS // length
    apart = np.unpackbits(u ^ v, axis=1)[:, : count * length].reshape(len(u), count, length).any(axis=2)
    first = apart.argmin(axis=1)
    return ~apart.all(axis=1) & (shards(np.unpackbits(u, axis=1), length)[np.arange(len(u)), first] != k)


def _searched(length: int, radius: int, most: int):
    """Packed rows sorted by part -> a forest of the links in a task's shards; shards with more than ``most`` unlike fingerprints come out as they are, cut into blocks.

    Two that agree in several blocks meet as often, and near copies do in most. Only the shard of the first such block
    gives their link out, as far as the leading bits tell; the others use it and leave it to that one.
    """
    width = BITS // 8

    def solve(packed: list[bytes], forest: Forest) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(packed), _ROW)
        rows = rows[np.argsort(rows["k"], kind="stable")]
        raw = np.ascontiguousarray(rows["f"]).view(np.uint8).reshape(-1, width)
        ends = np.flatnonzero(np.diff(rows["k"], append=np.int64(-1))) + 1
        links: list[tuple[int, int]] = []
        found: list[tuple] = []
        at = 0
        for end in ends.tolist():
            if end - at > 1:
                own = _near(raw[at:end], radius, most)
                if own is None:
                    cuts = -(-(end - at) * 2 // most)
                    found += [(i % cuts, cuts, int(rows["k"][at]), f.tobytes()) for i, f in enumerate(raw[at:end])]
                else:
                    links += [(at + i, at + j) for i, j in own]
            at = end
        if links:
            u, v = np.array(links).T
            new = ~met_before(raw[u], raw[v], rows["k"][u], length)
            found += [(a, b, None, None) for a, b in zip(_names(raw[u[new]]), _names(raw[v[new]]), strict=True) if forest.add(a, b)]
        kinds = {"u": pa.int64(), "v": pa.int64(), "k": pa.int64(), "f": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packed, forest = None, [], Forest()
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows"), strict=True):
                if part != now:
                    yield solve(packed, forest)
                    now, packed = part, []
                packed.append(rows.as_py())
        yield solve(packed, forest)

    return run


def _searched_blocks(radius: int):
    """Fingerprints sorted by pair of blocks -> a forest of the links in a task's pairs."""

    def solve(values: list[bytes], forest: Forest) -> list[tuple[int, int]]:
        raw = np.frombuffer(b"".join(values), np.uint8).reshape(-1, BITS // 8)
        names = _names(raw)
        return [(names[i], names[j]) for i, j in _near(raw, radius) or () if forest.add(names[i], names[j])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, forest = None, [], Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, f in zip(batch.column("k").to_pylist(), batch.column("f").to_pylist(), strict=True):
                if k != now:
                    found += solve(values, forest)
                    now, values = k, []
                values.append(f)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
        found = solve(values, forest)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _near_fingerprints(prints: DataFrame, length: int, radius: int, most: int) -> tuple[DataFrame, list[str]]:
    """``node, component`` for the fingerprints that others are near, by their first 64 bits, and scratch paths to remove later."""
    spark = prints.sparkSession
    count = n_partitions(spark)
    packed = prints.select("fp").distinct().mapInArrow(_dealt(length, count * _PARTS), "part int, rows binary")
    searched = packed.repartition(count, "part").sortWithinPartitions("part").mapInArrow(_searched(length, radius, most), "u long, v long, k long, f binary")
    met, met_at = written(searched, "met")
    links, crowded = met.where("k IS NULL").select("u", "v"), met.where("k IS NOT NULL")
    if crowded.isEmpty():
        found, scratch = connected_components(links)
        return found, [met_at, *scratch]
    crowded = crowded.select("f", "k", F.col("u").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("v") - 1)).alias("o"))
    crowded = crowded.select(F.xxhash64("k", F.least("p", "o"), F.greatest("p", "o")).alias("k"), "f")
    more = crowded.repartition(count, "k").sortWithinPartitions("k").mapInArrow(_searched_blocks(radius), "u long, v long")
    found, scratch = connected_components(links.unionByName(more))
    return found, [met_at, *scratch]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column("t")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "node", "fp", "c")), packed], names=["k", "node", "fp", "c", "s"])

    return run


def _links(similarity: float, radius: int):
    """Sets sorted by group -> a forest of the links in a task's groups, each searched by its BK-tree; those of one ``sub`` are linked already."""

    def solve(rows: list[tuple[int, int, int, np.ndarray]], forest: Forest) -> list[tuple[int, int]]:
        tree, out, maps = BKTree(), [], []
        for v, sub, _, _ in rows:
            forest.add(v, sub)
        for v, _, fp, s in rows:
            own, size = bitmap(s), len(s)
            alone = size - own.bit_count()
            for i in sorted(tree.link(fp, radius)):
                other, many, more = maps[i]
                both = (own & other).bit_count() + min(alone, more)  # as many as they can have in common
                if both / (size + many - both) < similarity:
                    continue
                w, _, _, t = rows[i]
                if not forest.joined(v, w) and similar(s, t, similarity):
                    forest.add(v, w)
                    out.append((v, w))
            maps.append((own, size, alone))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, forest = None, [], Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, v, sub, fp, s in zip(*(batch.column(c).to_pylist() for c in ("k", "node", "sub", "fp")), batch.column("s"), strict=True):
                if k != now:
                    found += solve(rows, forest)
                    now, rows = k, []
                rows.append((v, sub, int.from_bytes(fp, "big"), np.frombuffer(s.as_py(), np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
        found = solve(rows, forest)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _block(seed: int, parts: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), parts).cast("int")


def _parts(rows: str, most: int) -> Column:
    return F.ceil(F.col(rows) / (most / 2)).cast("int")


def _linked_sets(sets: DataFrame, similarity: float, radius: int, most: int) -> tuple[DataFrame, list[str]]:
    """``node, component`` of the sets ``k, node, fp, c, s`` (``c`` of them are in group ``k``) that links reach, and scratch paths to remove later.

    A group of over ``most`` is cut into blocks, and some of its sets are compared with every block. Then only what is not in a group's
    largest component is compared with all blocks, as all that is left to be found links one of these.
    """
    spark = sets.sparkSession
    count = n_partitions(spark)

    def links(dealt: DataFrame) -> DataFrame:
        return dealt.repartition(count, "k").sortWithinPartitions("k", "node").mapInArrow(_links(similarity, radius), "u long, v long")

    large, parts = F.col("c") > most, _parts("c", most)
    lead = _block(2, F.ceil(F.col("c") / LEADERS).cast("int")) == 0
    blocks = F.when(large, F.when(lead, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(_block(1, parts)))).otherwise(F.array(F.lit(0)))
    dealt = sets.select("k", "node", F.col("node").alias("sub"), "fp", "s", F.explode(blocks).alias("p"))
    found, scratch = connected_components(links(dealt.withColumn("k", F.xxhash64("k", "p")).drop("p")))
    whole = sets.where(large).select("k", "node", "c")
    if whole.isEmpty():
        return found, scratch
    subs = whole.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("k", "node", F.coalesce("component", "node").alias("sub"))
    subs, subs_at = written(subs, "subs")
    largest = subs.groupBy("k", "sub").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "sub")).alias("m"), F.sum("n").alias("all"))
    largest, largest_at = written(largest.select("k", F.col("m.sub").alias("most_are"), (F.col("all") - F.col("m.n")).alias("r")).where("r > 0"), "largest")
    scratch += [subs_at, largest_at]
    if largest.isEmpty():
        return found, scratch
    # blocks of the rest come first, then those of the largest component; no two of the latter meet
    apart = sets.join(largest, "k").join(subs.select("node", "sub"), "node")
    ours, theirs = _parts("r", most), F.ceil((F.col("c") - F.col("r")) / (most / 2)).cast("int")
    rest = F.col("sub") != F.col("most_are")
    apart = apart.select("k", "node", "sub", "fp", "s", F.when(rest, _block(1, ours)).otherwise(ours + _block(1, theirs)).alias("p"), F.explode(F.sequence(F.lit(0), F.when(rest, ours + theirs - 1).otherwise(ours - 1))).alias("o"))
    dealt = apart.withColumn("k", F.xxhash64("k", F.least("p", "o"), F.greatest("p", "o"))).drop("p", "o")
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found, more = connected_components(links(dealt).unionByName(stars))
    return found, [*scratch, *more]


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, most: int = MOST_IN_GROUP
) -> DataFrame:
    """The rows of ``docs`` with one document for each component, the one with the least identifier.

    Texts link if the sets of their shingles of ``words`` words have a Jaccard similarity of
    ``similarity`` or more. Texts are lower-cased A-Z and words are what white space (``\\x20 \\x09-\\x0D``)
    separates; a shorter text is one shingle, and a null or empty text and texts without words link with one
    another. Where several texts have the least identifier, the one with the least hash stays, and of
    wholly repeated rows one; a component whose identifiers are all null keeps one row too. All columns
    are unchanged.

    Links are exact. A pair at the threshold of 0.8 meets in no shard with a probability of 3 in a million at most,
    at 0.9 of under one in a billion, and is over the radius in 1.1 of a million at worst. Blocks are as many as
    ``similarity`` needs; ``radius`` serves 0.8 and more.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    kind = dict(keyed.dtypes)["id"]
    length = max(LEAST_BLOCK, math.ceil(math.log2(max(docs.count(), 1) / IN_SHARD)))
    prints, prints_at = written(keyed.mapInArrow(_prints(words, length, differing(similarity)), f"id {kind}, h long, node long, fp binary"), "prints")
    near, near_at = _near_fingerprints(prints, length, radius, most)
    # the exact check: sets of a component are compared
    first = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    heads = prints.select("node", "h", F.substring("fp", 1, BITS // 8).alias("fp"))
    nodes = heads.groupBy("node").agg(F.min("h").alias("h"), F.first("fp").alias("fp")).withColumn("first", first)
    nodes = nodes.join(near.withColumnRenamed("node", "n"), F.col("first") == F.col("n"), "left")
    nodes, nodes_at = written(nodes.select("node", "h", "fp", F.coalesce("component", "first").alias("k")), "nodes")
    groups, groups_at = written(nodes.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "groups")
    members, members_at = written(nodes.join(groups, "k"), "groups-met")
    some = keyed.select("h", "t").join(members, "h").dropDuplicates(["h"]).select("k", "node", "fp", "c", "t")
    sets, sets_at = written(some.mapInArrow(_sets(words), "k long, node long, fp binary, c long, s binary"), "sets")
    found, scratch = _linked_sets(sets, similarity, radius, most)
    label = F.coalesce("component", prints["node"]).alias("label")
    best = (
        prints.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
        .select("id", "h", label)
        .groupBy("label")
        .agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("b"))
        .select(F.col("b.id").alias("_i"), F.col("b.h").alias("_h"))
    )
    best, _ = written(best, "kept")
    remove(spark, prints_at, nodes_at, groups_at, members_at, sets_at, *near_at, *scratch)
    return rows_of(docs, best, id_col, text_col)
