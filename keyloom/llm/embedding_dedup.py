"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to eight dimensions and decoded to the nearest point of the E8
lattice, in several tables. A vector also probes the lattice points that are next nearest to it.
Vectors that meet in a cell are verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, remove, written
from .components import Forest, connected_components

#: Tables and probes for each projection that a key joins: keys of more projections meet less often.
TABLES = 5
PROBES = 2
#: Vectors of a cell that are compared in one task; larger cells are split into blocks of this size.
MOST_IN_CELL = 2048
#: Vectors per label up to which one projection keeps cells small; beyond it two or more are joined.
PER_BLOCK = 2_000_000

ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.n
)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, r.c AS component_id, v.vec_id = r.c AS kept
FROM embeddings v
JOIN (SELECT n, min(c) AS c FROM reach GROUP BY n) r ON r.n = v.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.vec_id
"""


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(axis=1)
        move = np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        r[odd, worst] += move
    return r


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (integers, or all halves, with an even sum)."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def _roots() -> np.ndarray:
    """The 240 shortest vectors, which lead to the neighbouring points."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    signs = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * -1.0 + 0.5
    return np.array(out + [s for s in signs if (s < 0).sum() % 2 == 0])


def _hash(points: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(points), seed * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF, np.uint64)
    for c in (2 * points).astype(np.int64).view(np.uint64).T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int, probes: int, blocks: int, scale: float, seed: int = 7) -> np.ndarray:
    """Cell hashes of unit vectors, shaped (vectors, tables, 1 + probes): the own cell first."""
    n, dim = x.shape
    roots = _roots()
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        parts, near = [], []
        for b in range(blocks):
            rng = np.random.default_rng([seed, dim, t, b])
            basis = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim]
            y = x @ basis * scale * np.sqrt(max(dim, 8) / 8)
            home = e8(y)
            # distance to home + root, less that to home
            gap = 2.0 - 2.0 * (y - home) @ roots.T
            best = np.argpartition(gap, min(probes, 239), axis=1)[:, : max(probes, 1)] if probes else np.zeros((n, 0), int)
            best = np.take_along_axis(best, np.take_along_axis(gap, best, 1).argsort(1), 1) if probes else best
            parts.append(home)
            near.append([(np.take_along_axis(gap, best, 1)[:, k], home + roots[best[:, k]]) for k in range(probes)])
        own = [_hash(p, t * 64 + b + 1) for b, p in enumerate(parts)]
        joined = own[0].copy()
        for o in own[1:]:
            joined = joined * 31 + o
        out[:, t, 0] = joined
        if probes:  # the nearest of all blocks' neighbours, one block changed at a time
            gaps = np.stack([g for block in near for g, _ in block], axis=1)
            keys = []
            for b, block in enumerate(near):
                for _, point in block:
                    swapped = [_hash(point, t * 64 + b + 1) if i == b else o for i, o in enumerate(own)]
                    k = swapped[0].copy()
                    for o in swapped[1:]:
                        k = k * 31 + o
                    keys.append(k)
            pick = gaps.argsort(axis=1)[:, :probes]
            out[:, t, 1:] = np.take_along_axis(np.stack(keys, axis=1), pick, 1)
    return out


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in column:
        x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        out.append(x / np.abs(x).max())
    return [x / np.linalg.norm(x) for x in out]


def _hashed(tables: int, probes: int, blocks: int, scale: float):
    width = tables * (1 + probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if not part.num_rows:
                    continue
                units = _unit(part.column("embedding"))
                sizes = np.array([len(u) for u in units])
                keys = np.empty((len(units), width), np.int64)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    found = cells(np.stack([units[r] for r in rows]), tables, probes, blocks, scale)
                    keys[rows] = found.reshape(len(rows), width)
                offsets = np.arange(len(units) + 1, dtype=np.int32) * width
                flat = np.concatenate(units)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("nid"), part.column("label"), part.column("w"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    names=["nid", "label", "w", "x", "keys"],
                )

    return run


def _verify(tables: int, probes: int, threshold: float):
    """Rows sorted by cell -> for each vector its new links, and a forest of the links in a task's cells."""
    wide = 1 + probes

    def solve(rows: list[tuple], out: list[list], forest: Forest) -> None:
        nid = np.array([r[0] for r in rows])
        role = np.array([r[1] for r in rows])
        side = np.array([r[2] for r in rows])
        weight = np.array([r[3] for r in rows])
        x = np.stack([r[4] for r in rows])
        keys = np.stack([r[5] for r in rows]).reshape(len(rows), tables, wide)
        table = rows[0][6]
        split = rows[0][7]
        links = np.zeros(len(rows), np.int64)
        names = nid.tolist()
        edges: list[tuple[int, int]] = []
        for a0 in range(0, len(rows), 512):
            a = np.arange(a0, min(a0 + 512, len(rows)))
            sims = x[a] @ x.T
            i, j = np.nonzero(sims >= threshold)
            i = a[i]
            # each pair once: own cells both, or a probe of one in the other's own cell
            ok = nid[i] != nid[j]
            ok &= (role[i] == 0) | (role[j] == 0)
            ok &= np.where(role[i] == role[j], nid[i] < nid[j], role[i] == 0)
            if split:
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            # counted where the pair meets first: in the earliest table, own cells before probes
            hi, hj = keys[i][:, :, :1], keys[j][:, :, :1]
            meets = (hi == hj)[:, :, 0], (keys[i][:, :, 1:] == hj).any(2), (keys[j][:, :, 1:] == hi).any(2)
            small = nid[i] < nid[j]
            order = np.stack([meets[0], np.where(small[:, None], meets[1], meets[2]), np.where(small[:, None], meets[2], meets[1])], axis=2)
            first = order.reshape(len(i), -1).argmax(1)
            kind = np.where(role[i] == role[j], 0, np.where((role[j] != 0) == small, 2, 1))
            new = first == table * 3 + kind
            np.add.at(links, i[new], weight[j[new]])
            np.add.at(links, j[new], weight[i[new]])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if forest.add(names[p], names[q]):
                    edges.append((names[p], names[q]))
        for r in np.flatnonzero(links):
            out[0].append(int(nid[r]))
            out[1].append(None)
            out[2].append(int(links[r]))
        for u, v in edges:
            for c, value in zip(out, (u, v, 0), strict=True):
                c.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, forest = None, [], Forest()
        out: list[list] = [[], [], []]

        for batch in batches:
            n = batch.num_rows
            cols = [batch.column(c).to_pylist() for c in ("k", "nid", "role", "side", "w", "t", "split")]
            xs, ks = batch.column("x"), batch.column("keys")
            for i in range(n):
                k = cols[0][i]
                if k != now:
                    if len(rows) > 1:
                        solve(rows, out, forest)
                    now, rows = k, []
                rows.append((cols[1][i], cols[2][i], cols[3][i], cols[4][i], xs[i].values.to_numpy(), ks[i].values.to_numpy(), cols[5][i], cols[6][i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v", "n"])
            for c in out:
                c.clear()
        if len(rows) > 1:
            solve(rows, out, forest)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v", "n"])

    return run


def embedding_dedup(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = 0.98,
    tables: int | None = None,
    probes: int | None = None,
    blocks: int | None = None,
    scale: float = 1.7,
    most_in_cell: int = MOST_IN_CELL,
) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Vectors with equal, non-null labels link if their cosine is ``threshold`` or more; vectors of
    different lengths don't. A vector that is null, empty, zero or holds null or non-finite components
    links with nothing: no links, its own component, kept. ``n_links`` counts the linked rows, equal
    vectors and repeated rows among them; ``component_id`` is the least identifier that links reach.
    Rows with equal identifiers are kept or not together. An empty table gives no rows. Other columns
    are not read.

    ``scale`` sets the cells' size, ``blocks`` how many projections make a key (by default as many as
    keep cells small for the largest label). ``tables`` and ``probes`` are by default 5 and 2 times ``blocks``, as
    keys of two or more projections are equal less often; of 20,000 pairs at cosine 0.98 in 64 dimensions
    all met with up to three projections and 0.9999 with four. Equal vectors are summed first. A cell with more than
    ``most_in_cell`` vectors is compared in blocks, so that its pairs are all seen and no task holds it.
    """
    spark = vectors.sparkSession
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), v.cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    nid = F.when(good, F.xxhash64("label", "embedding"))
    keyed = rows.select("id", "label", "embedding", nid.alias("nid"))
    nodes, nodes_at = written(
        keyed.where("nid IS NOT NULL")
        .groupBy("nid")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("w"), F.min("id").alias("least")),
        "vectors",
    )
    if blocks is None:
        most = nodes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
        blocks = 1
        while most > PER_BLOCK * 1000 ** (blocks - 1) and blocks < 4:
            blocks += 1
    tables = TABLES * blocks if tables is None else tables
    probes = PROBES * blocks if probes is None else probes
    hashed, hashed_at = written(
        nodes.select("nid", "label", "w", "embedding").mapInArrow(
            _hashed(tables, probes, blocks, scale), "nid long, label string, w long, x array<double>, keys array<long>"
        ),
        "cells",
    )
    met = hashed.select("nid", "label", "w", "x", "keys", F.posexplode("keys").alias("p", "cell")).select(
        "nid", "w", "x", "keys",
        F.floor(F.col("p") / (1 + probes)).cast("long").alias("t"),
        (F.col("p") % (1 + probes)).cast("long").alias("role"),
        F.xxhash64("label", F.size("x"), F.floor(F.col("p") / (1 + probes)), "cell").alias("k"),
    )
    crowd, crowd_at = written(
        met.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > most_in_cell).select("k", F.ceil(F.col("c") / (most_in_cell / 2)).cast("int").alias("s")),
        "crowded",
    )
    base = met.select("k", "nid", "role", F.lit(0).cast("long").alias("side"), "w", "x", "keys", "t", F.lit(False).alias("split"))
    if not crowd.isEmpty():
        mine = F.pmod(F.col("nid"), F.col("s")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
        big = met.join(crowd, "k").withColumn("b", mine).withColumn("o", other)
        big = big.select(
            F.xxhash64("k", F.least("b", "o"), F.greatest("b", "o")).alias("k"), "nid", "role", F.col("b").cast("long").alias("side"), "w", "x", "keys", "t",
            (F.col("b") != F.col("o")).alias("split"),
        )
        base = base.join(crowd.select("k"), "k", "left_anti").unionByName(big)
    found, found_at = written(
        base.repartition(n_partitions(spark), "k").sortWithinPartitions("k").mapInArrow(_verify(tables, probes, threshold), "u long, v long, n long"),
        "links",
    )
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    parts, scratch = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    labelled = (
        nodes.select("nid", "w", "least")
        .join(parts, F.col("nid") == F.col("node"), "left")
        .join(counts, F.col("nid") == F.col("u"), "left")
        .select("nid", "least", F.coalesce("component", "nid").alias("part"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    )
    heads = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    groups, _ = written(labelled.join(heads, "part").select("nid", "n_links", "component_id"), "groups")
    remove(spark, nodes_at, hashed_at, crowd_at, found_at, *scratch)
    found = keyed.where("nid IS NOT NULL").select("id", "nid").join(groups, "nid").select("id", "n_links", "component_id")
    # rows that link with nothing may be very many; they aren't dealt by their missing key
    alone = keyed.where("nid IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
