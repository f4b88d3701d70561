"""Removal of repeated byte strings with suffix arrays.

Every string of ``length`` bytes has an anchor: the ``gram``-byte string in it whose hash is least.
Equal strings have equal anchors at equal offsets, so it is enough to compare strings that share one.
The strings of a text with the same anchor form a fragment of fewer than twice ``length`` bytes.
Fragments whose anchor occurs once can't repeat and are set aside. The others are summed to distinct
fragments with weights and dealt by anchor to shards. A shard gets a suffix array by Larsson-Sadakane
refinement and common prefixes after Kasai; neighbours that share ``length`` bytes are repeats. An
anchor whose fragments are cut between shards is merged by binary search of the sorted strings. Where
very many different fragments share an anchor, two hashes of each string first tell which can't be
repeated; the fragments are cut down to the others, which leaves few different ones.
"""

from __future__ import annotations

import hashlib
import secrets
import sys
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, remove, text_or_empty, written

GRAM = 64
#: Bytes of text in one suffix array.
SHARD_BYTES = 1 << 17
#: Bytes of distinct fragments that a task holds before it hands them on.
HELD_BYTES = 24 << 20
#: The fragments of an anchor with more distinct ones than this are cut down first.
MOST_FRAGMENTS = 1024
#: Positions of one text that are handled at once.
_CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, _CHUNK + 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def rolling(data: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes."""
    n = len(data)
    powers, inverse = _tables(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * inverse[: n - width + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def fragments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string's start and number of strings, for each run of strings with one anchor."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    strings = len(data) - length + 1
    for at in range(0, max(strings, 0), _CHUNK):
        part = data[at : at + _CHUNK + length - 1]
        h = rolling(part, gram)
        count, w = len(part) - length + 1, length - gram + 1
        keyed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # leftmost among equals
        rows = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        rows[: len(h)] = keyed
        grid = rows.reshape(-1, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        owner = (np.minimum(after[:count], before[w - 1 : w - 1 + count]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.append(first, count))
        out.append((h[owner[first]].view(np.int64), first + at, sizes))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number, zeros after the end; one more place."""
    n = len(data)
    wide = np.zeros(n + 9, np.uint8)
    wide[:n] = data
    key = np.zeros(n + 1, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n + 1]
    return key


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers."""
    zero = np.zeros(len(x), np.int64)
    for bits, count in ((32, 4), (16, 2), (8, 1)):
        high = (x >> np.uint64(64 - bits)) == 0
        zero[high] += count
        x = np.where(high, x << np.uint64(bits), x)
    return np.where(x == 0, 8, zero)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes, and the rank of each: equal if those bytes are.

    Larsson-Sadakane: groups of equal ``h`` bytes are refined by the rank of what follows ``h`` later,
    doubling ``h``; groups of one are left alone.
    """
    n = len(data)
    # seven letters of nine bits, where 0 is past the end: no byte equals it, not even a zero byte
    wide = np.zeros(n + 7, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | wide[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = np.flatnonzero(new)
    head = np.repeat(starts, np.diff(np.append(starts, n)))  # rank: where the group begins
    rank = np.zeros(n + depth + 1, np.int64)
    rank[order] = head + 1
    h = 7
    while h < depth:
        step = min(h, depth - h)
        sizes = np.diff(np.append(starts, n))
        open_groups = sizes > 1
        if not open_groups.any():
            break
        at = np.flatnonzero(np.repeat(open_groups, sizes))  # places in the order
        who = order[at]
        pair = (rank[who] << 32) | rank[who + step]
        by = np.argsort(pair)
        order[at], pair = who[by], pair[by]
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        starts = np.sort(np.concatenate((starts[~open_groups], at[fresh])))
        heads = np.repeat(at[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at))))
        rank[order[at]] = heads + 1
        h += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix shares with the one before it in the order.

    Kasai: if a suffix shares ``l`` bytes with its neighbour, the suffix that starts one later shares
    at least ``l - 1`` with its own. Where the bytes before both are equal it is exactly ``l - 1``, so
    only the other places are compared.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    prior = np.full(n, -1, np.int64)
    prior[order[1:]] = order[:-1]
    words = _words(data)
    where = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (prior[1:] > 0) & (prior[:-1] == prior[1:] - 1) & (data[:-1] == data[prior[1:] - 1])
    base = np.flatnonzero(~reducible)
    shared = np.zeros(len(base), np.int64)
    alive = np.flatnonzero(prior[base] >= 0)
    left, right = base[alive], prior[base[alive]]
    done = 0  # bytes that all places still alive share
    while len(alive):
        x = words[np.minimum(left + done, n)] ^ words[np.minimum(right + done, n)]
        ends = (x != 0) | (np.maximum(left, right) + done + 8 > n)
        if ends.any():
            out = alive[ends]
            # leading zero bytes of the difference are equal bytes; past the text's end nothing is
            shared[out] = done + np.minimum(_zero_bytes(x[ends]), n - np.maximum(left[ends], right[ends]) - done).clip(0)
            alive, left, right = alive[~ends], left[~ends], right[~ends]
        done += 8
    last = np.maximum.accumulate(np.where(reducible, 0, where))
    value = np.zeros(n, np.int64)
    value[base] = shared
    along = np.maximum(value[last] - (where - last), 0)
    return np.minimum(along[order], most)


class _Shard:
    """Distinct fragments, in order of their anchors, that share one suffix array."""

    def __init__(self) -> None:
        self.anchor: list[int] = []
        self.digest: list[int] = []
        self.weight: list[int] = []
        self.data: list[bytes] = []
        self.bytes = 0

    def add(self, anchor: int, digest: int, weight: int, data: bytes) -> None:
        self.anchor.append(anchor)
        self.digest.append(digest)
        self.weight.append(weight)
        self.data.append(data)
        self.bytes += len(data)

    def solve(self, length: int, open_anchor: int | None) -> tuple[list[np.ndarray], tuple | None]:
        """For each fragment, which of its strings are repeated; and the sorted strings of ``open_anchor``."""
        text = np.frombuffer(b"".join(self.data), np.uint8)
        sizes = np.array([len(x) for x in self.data])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        of = np.repeat(np.arange(len(sizes)), sizes)
        valid = np.arange(len(text)) + length <= (begin + sizes)[of]
        order, _ = suffix_array(text, length)
        shared = common_prefixes(text, order, length)
        keep = valid[order]
        # A string in between that crosses fragments shares the bytes too, so the least prefix holds.
        run = np.cumsum(shared < length)[keep]
        at = order[keep]
        weights = np.array(self.weight)[of[at]]
        number = np.unique(run, return_inverse=True)[1] if len(run) else run
        total = np.bincount(number, weights) if len(run) else np.zeros(0)
        repeated = np.zeros(len(text), bool)
        repeated[at] = total[number] >= 2
        flags = [repeated[b : b + n - length + 1] for b, n in zip(begin, sizes, strict=True)]
        if open_anchor is None:
            return flags, None
        mine = np.array(self.anchor) == open_anchor
        at = at[mine[of[at]]]
        view = np.lib.stride_tricks.sliding_window_view(text, length)[at]
        keys = np.ascontiguousarray(view).view(f"S{length}").ravel()
        return flags, (keys, of[at], at - begin[of[at]])


def _deltas(flags: np.ndarray) -> tuple[list[int], list[int]]:
    if flags.all():
        return [0], [len(flags)]
    if not flags.any():
        return [], []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


_RESULT = pa.schema(
    [("anchor", pa.int64()), ("digest", pa.int64()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))]
)


def _search(length: int, shard_bytes: int):
    """Fragments sorted by anchor and digest -> runs of repeated strings of each distinct fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = _Shard(), []
        cut: list[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]] = []  # earlier shards' parts of one anchor
        waiting: list[tuple[int, int, np.ndarray]] = []

        def flush(open_anchor: int | None) -> None:
            nonlocal shard
            if not shard.data:
                return
            first = shard.anchor[0]
            hold = open_anchor if open_anchor is not None else (first if cut else None)
            flags, mine = shard.solve(length, hold)
            flags = [f.copy() for f in flags]
            if cut and mine is not None and hold == first:
                for keys, theirs, their_of, their_at in cut:
                    where = np.searchsorted(keys, mine[0])
                    where[where == len(keys)] = 0
                    hit = keys[where] == mine[0] if len(keys) else np.zeros(len(mine[0]), bool)
                    for o, p in zip(mine[1][hit], mine[2][hit], strict=True):
                        flags[o][p] = True
                    back = np.searchsorted(mine[0], keys)
                    back[back == len(mine[0])] = 0
                    hit = mine[0][back] == keys if len(mine[0]) else np.zeros(len(keys), bool)
                    for o, p in zip(their_of[hit], their_at[hit], strict=True):
                        theirs[o][p] = True
            if open_anchor is not None:
                cut.append((mine[0], flags, mine[1], mine[2]))
            for a, d, f in zip(shard.anchor, shard.digest, flags, strict=True):
                (waiting if a == open_anchor or (cut and a == first == hold) else done).append((a, d, f))
            shard = _Shard()

        def settle() -> None:
            cut.clear()
            done.extend(waiting)
            waiting.clear()

        def out() -> pa.RecordBatch:
            runs = [(a, d, *_deltas(f)) for a, d, f in done]
            done.clear()
            cols = list(zip(*runs, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RESULT.types, strict=True)], schema=_RESULT)

        def anchors() -> Iterator[tuple[int, list[list]]]:
            """Each anchor's distinct fragments, in portions of at most a shard; the flag tells if more follow."""
            now, held, size = None, [], 0
            for batch in batches:
                for a, d, w, x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "weight", "data")), strict=True):
                    if a != now:
                        if held:
                            yield now, held, False
                        now, held, size = a, [], 0
                    elif held[-1][0] == d:
                        held[-1][1] += w
                        continue
                    elif size + len(x) > shard_bytes:
                        yield now, held, True
                        held, size = [], 0
                    held.append([d, w, x])
                    size += len(x)
            if held:
                yield now, held, False

        for anchor, parts, more in anchors():
            if not more and not cut and len(parts) == 1 and not (shard.anchor and shard.anchor[-1] == anchor):
                d, w, x = parts[0]
                if w >= 2:  # the only fragment of its anchor, and its copies
                    done.append((anchor, d, np.ones(len(x) - length + 1, bool)))
                    if len(done) >= 4096:
                        yield out()
                    continue
            if not cut and shard.bytes + sum(len(x) for _, _, x in parts) > shard_bytes:
                flush(None)
                yield out()
            for d, w, x in parts:
                shard.add(anchor, d, w, x)
            if more:
                flush(anchor)
            elif cut:
                flush(None)
                settle()
                yield out()
        flush(None)
        settle()
        yield out()

    return run


_ANCHORS = "id long, h long, n_bytes long, sha string, anchors array<struct<a:long,s:int,n:int>>"


def _find(length: int, gram: int):
    kind = pa.list_(pa.struct([("a", pa.int64()), ("s", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, lists, offsets = [], [], [], [0]
            for t in batch.column("t"):
                data = t.as_py().encode()
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
                found = fragments(np.frombuffer(data, np.uint8), length, gram)
                lists.append(found)
                offsets.append(offsets[-1] + len(found[0]))
            flat = [np.concatenate([x[i] for x in lists]) if lists else np.zeros(0, np.int64) for i in range(3)]
            values = pa.StructArray.from_arrays(
                [pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))], names=["a", "s", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(kind)],
                names=["id", "h", "n_bytes", "sha", "anchors"],
            )

    return run


_PIECES = "id long, h long, start int, anchor long, digest long, weight long, data binary"
_PIECES_ARROW = pa.schema(
    [("id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64()), ("weight", pa.int64()), ("data", pa.binary())]
)


def _cut(length: int, key: bytes):
    """Texts with their shared anchors -> where each fragment is, and each distinct fragment of the task with its weight.

    Fragments are told apart by their anchor and a digest with a key that nobody can know who writes texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def rows(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECES_ARROW.types, strict=True)], schema=_PIECES_ARROW)

        def distinct() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            for i in range(0, len(items), 4096):
                part = items[i : i + 4096]
                none = [None] * len(part)
                yield rows([none, none, none, [k[0] for k, _ in part], [k[1] for k, _ in part], [v[0] for _, v in part], [v[1] for _, v in part]])

        for batch in batches:
            lists = batch.column("found")
            flat = lists.flatten()
            many = np.diff(np.asarray(lists.offsets))
            ids = np.repeat(np.arange(batch.num_rows), many)
            anchor, start, count = (flat.field(c).to_numpy() for c in ("a", "s", "n"))
            digests = np.empty(len(flat), np.int64)
            triples = zip(anchor.tolist(), start.tolist(), (start + count + length - 1).tolist(), strict=True)
            i = 0
            for t, n in zip(batch.column("t"), many.tolist(), strict=True):
                data = t.as_py().encode()
                for a, s, e in islice(triples, n):
                    piece = data[s:e]
                    digest = blake2b(piece, digest_size=8, key=key).digest()
                    digests[i] = d = int.from_bytes(digest, sys.byteorder, signed=True)
                    i += 1
                    seen = held.get((a, d))
                    if seen:
                        seen[0] += 1
                    else:
                        held[a, d] = [1, piece]
                        size += len(piece)
                if size > HELD_BYTES:
                    yield from distinct()
                    size = 0
            none = pa.nulls(len(flat), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids)), batch.column("h").take(pa.array(ids)), pa.array(start), pa.array(anchor), pa.array(digests), none, pa.nulls(len(flat), pa.binary())],
                schema=_PIECES_ARROW,
            )
        yield from distinct()

    return run


def _strings(length: int):
    """Each string of a fragment by two hashes."""
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("weight", pa.int64()), ("at", pa.int32()), ("p", pa.int64()), ("q", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [np.frombuffer(x.as_py(), np.uint8) for x in part.column("data")]
                sizes = [len(x) - length + 1 for x in rows]
                owner = pa.array(np.repeat(np.arange(len(rows)), sizes))
                same = [part.column(c).take(owner) for c in ("anchor", "digest", "weight")]
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                hashes = [pa.array(np.concatenate([rolling(x, length, b) for x in rows]).view(np.int64)) for b in _BASES]
                yield pa.RecordBatch.from_arrays([*same, pa.array(places), *hashes], schema=schema)

    return run


_TRIMMED = "anchor long, digest long, at int, sub long, weight long, data binary"


def _trim(length: int, key: bytes):
    """Fragments and the places of their strings that may be repeated -> a fragment for each run of such places."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["anchor", "digest", "at", "sub", "weight", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for a, d, w, x, ats in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "weight", "data", "ats")), strict=True):
                flags = np.zeros(len(x) - length + 1, bool)
                flags[ats] = True
                for s, n in zip(*_deltas(flags), strict=True):
                    piece = x[s : s + n + length - 1]
                    sub = int.from_bytes(blake2b(piece, digest_size=8, key=key).digest(), sys.byteorder, signed=True)
                    for c, v in zip(out, (a, d, s, sub, w, piece), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _whole_strings(length: int):
    """Each string of a fragment with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, d, w, x = (batch.column(c)[i].as_py() for c in ("anchor", "digest", "weight", "data"))
                n = len(x) - length + 1
                same = [pa.array(np.full(n, v, np.int64)) for v in (a, d, w)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(np.arange(n, dtype=np.int32)), pa.array([x[k : k + length] for k in range(n)], pa.binary())],
                    names=["anchor", "digest", "weight", "at", "s"],
                )

    return run


def _searched(sums: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``anchor, digest, at, n``: runs of repeated strings in each distinct fragment, by suffix arrays."""
    return (
        sums.select("anchor", "digest", "weight", "data")
        .repartition(n_partitions(sums.sparkSession), "anchor")
        .sortWithinPartitions("anchor", "digest")
        .mapInArrow(_search(length, shard_bytes), "anchor long, digest long, starts array<int>, sizes array<int>")
        .select("anchor", "digest", F.explode(F.arrays_zip("starts", "sizes")).alias("r"))
        .select("anchor", "digest", F.col("r.starts").alias("at"), F.col("r.sizes").alias("n"))
    )


def _crowded(sums: DataFrame, most: int) -> tuple[DataFrame, str]:
    """Anchors with more than ``most`` distinct fragments."""
    return written(sums.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > most).select("anchor"), "crowded")


def _cut_down(dense: DataFrame, length: int, shard_bytes: int, most: int, key: bytes) -> tuple[DataFrame, list[str]]:
    """As ``_searched`` for anchors with very many distinct fragments, and scratch paths.

    Equal strings have equal hashes, so strings whose two hashes occur once are not repeated. What is
    left of the fragments is searched like others. Where an anchor has very many different fragments even
    then, each of their strings is repeated, and they are grouped by their bytes.
    """
    strings = dense.select("anchor", "digest", "weight", "data").mapInArrow(
        _strings(length), "anchor long, digest long, weight long, at int, p long, q long"
    )
    many = strings.groupBy("p", "q").agg(F.sum("weight").alias("c")).where("c > 1").select("p", "q")
    hits = strings.join(many, ["p", "q"], "left_semi").groupBy("anchor", "digest").agg(F.collect_list("at").alias("ats"))
    trimmed, trimmed_at = written(
        dense.join(hits, ["anchor", "digest"]).select("anchor", "digest", "weight", "data", "ats").mapInArrow(_trim(length, key), _TRIMMED), "trimmed"
    )
    sums, sums_at = written(
        trimmed.groupBy("anchor", "sub").agg(F.sum("weight").alias("weight"), F.first("data").alias("data")).withColumnRenamed("sub", "digest"), "trimmed-sums"
    )
    crowded, crowded_at = _crowded(sums, most)
    runs = _searched(sums.join(crowded, "anchor", "left_anti"), length, shard_bytes)
    if not crowded.isEmpty():
        whole = sums.join(crowded, "anchor", "left_semi").select("anchor", "digest", "weight", "data").mapInArrow(
            _whole_strings(length), "anchor long, digest long, weight long, at int, s binary"
        )
        equal = whole.groupBy("s").agg(F.sum("weight").alias("c")).where("c > 1").select("s")
        runs = runs.unionByName(whole.join(equal, "s", "left_semi").select("anchor", "digest", "at", F.lit(1).alias("n")))
    back = trimmed.select("anchor", F.col("sub").alias("s"), F.col("digest").alias("d"), F.col("at").alias("from"))
    here = runs.select(F.col("anchor").alias("a"), "digest", "at", "n")
    found = back.join(here, (F.col("anchor") == F.col("a")) & (F.col("s") == F.col("digest")))
    return found.select("anchor", F.col("d").alias("digest"), (F.col("from") + F.col("at")).alias("at"), "n"), [trimmed_at, sums_at, crowded_at]


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal ranges."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)]


_OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _strip(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t, ranges in zip(batch.column("t"), batch.column("ranges"), strict=True):
                data = t.as_py().encode()
                found = ranges.as_py() or []
                removed = spans = 0
                kept = data
                if found:
                    s, e = _joined(np.array([x["s"] for x in found]), np.array([x["e"] for x in found]))
                    spans, removed = len(s), int((e - s).sum())
                    kept = b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True))
                for c, v in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def suffix_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    gram: int = GRAM,
    most_fragments: int = MOST_FRAGMENTS,
    shard_bytes: int = SHARD_BYTES,
    with_kept: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept`` bytes).

    Each byte is removed that a string of ``length`` bytes covers which also starts elsewhere, in the
    same text or another; all copies go, overlaps count, and strings are judged on the input. A null
    text is empty; texts shorter than ``length`` keep all. Repeated rows are copies of each other, also
    with null or equal identifiers (integers). An empty table gives no rows. Other columns aren't read.

    Anchors decide only which strings are compared. A fragment equal to others by 128 bits of anchor and
    keyed digest counts as their copy; the copies that tasks find are summed before fragments are dealt by
    anchor. Of an anchor with over ``most_fragments`` distinct fragments, strings that two hashes show to
    be single are cut off first. No task holds more than that many fragments of an anchor.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    anchors, _ = written(keyed.mapInArrow(_find(length, gram), _ANCHORS), "anchors")
    each = anchors.select("id", "h", F.explode("anchors").alias("x")).select("id", "h", "x.a", "x.s", "x.n")
    # stored first, so that both sides of the joins below are dealt anew and Spark can split a frequent anchor
    shared, shared_at = written(each.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "shared")
    found = (
        each.join(shared, "a", "left_semi")
        .groupBy("id", "h")
        .agg(F.collect_set(F.struct("a", "s", "n")).alias("found"))
        .select(F.col("id").alias("i2"), F.col("h").alias("h2"), "found")
    )
    same = F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))
    likely, _ = written(keyed.join(found, same).select("id", "h", "t", "found"), "likely")
    remove(spark, shared_at)
    key = secrets.token_bytes(16)
    pieces, _ = written(likely.select("id", "h", "t", "found").mapInArrow(_cut(length, key), _PIECES), "fragments")
    sums, sums_at = written(
        pieces.where("data IS NOT NULL").groupBy("anchor", "digest").agg(F.sum("weight").alias("weight"), F.first("data").alias("data")), "sums"
    )
    crowded, crowded_at = _crowded(sums, most_fragments)
    scratch = [sums_at, crowded_at]
    if crowded.isEmpty():
        result = _searched(sums, length, shard_bytes)
    else:
        dense, more = _cut_down(sums.join(crowded, "anchor", "left_semi"), length, shard_bytes, most_fragments, key)
        scratch += more
        result = _searched(sums.join(crowded, "anchor", "left_anti"), length, shard_bytes).unionByName(dense)
    repeated, _ = written(
        result.groupBy("anchor", "digest").agg(F.collect_list(F.struct("at", "n")).alias("runs")), "repeats"
    )
    remove(spark, *scratch)
    ranges = (
        pieces.where("data IS NULL")
        .select("id", "h", "start", "anchor", "digest")
        .join(repeated, ["anchor", "digest"])
        .select("id", "h", "start", F.explode("runs").alias("r"))
        .select("id", "h", (F.col("start") + F.col("r.at")).alias("s"), (F.col("start") + F.col("r.at") + F.col("r.n") + length - 1).alias("e"))
        .groupBy("id", "h")
        .agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
        .select(F.col("id").alias("i2"), F.col("h").alias("h2"), "ranges")
    )
    with_text = keyed if with_kept else likely.select("id", "h", "t")
    out = with_text.join(ranges, same, "left").select("id", "t", "ranges").mapInArrow(_strip(with_kept), _OUT)
    if not with_kept:  # texts without a shared anchor need not be read again
        keys = likely.select(F.col("id").alias("i2"), F.col("h").alias("h2")).distinct()
        whole = anchors.select("id", "h", "n_bytes", "sha").join(keys, same, "left_anti")
        none = F.lit(0).cast("long")
        out = out.unionByName(whole.select("id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else []))
