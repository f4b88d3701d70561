"""The near dedup of the pipeline on large groups: rows made, texts moved, and what is linked."""

import random

import numpy as np
import pytest

from keyloom.llm import components, near_dedup, simhash

from .test_near_dedup import plain_kept
from .test_operators import plain_components


def test_near_copies_make_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    length, count, size = 8, 61, 400
    own = rng.integers(0, 2, length * count + -length * count % 64, np.uint8)
    rows = []
    for _ in range(size):
        near = own.copy()
        near[rng.permutation(near.size)[:12]] ^= 1
        rows.append((bytearray(np.packbits(near).tobytes()),))
    made, written = {}, near_dedup.written

    def counted(df, name):
        out = written(df, name)
        made[name] = out[0].count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    found, _ = near_dedup._near_fingerprints(spark.createDataFrame(rows, "fp binary"), length, near_dedup.RADIUS, 64)
    names = {int.from_bytes(f[0][:8], "big", signed=True) for f in rows}
    assert {(r.node, r.component) for r in found.collect()} == {(n, min(names)) for n in names}
    assert made["met"] <= 4 * size


def test_links_between_what_a_tree_holds_and_what_it_does_not():
    rng = np.random.default_rng(7)
    for _ in range(20):
        own = [rng.integers(0, 2, near_dedup.BITS, np.uint8)]
        for _ in range(80):  # chains, so that groups are wider than the radius
            near = own[rng.integers(len(own))].copy() if rng.random() < 0.9 else rng.integers(0, 2, near_dedup.BITS, np.uint8)
            near[rng.permutation(near_dedup.BITS)[: int(rng.integers(20, 90))]] ^= 1
            own.append(near)
        prints = np.packbits(np.array(own), axis=1)
        part = plain_components(len(own), lambda i, j: (own[i] != own[j]).sum() <= near_dedup.RADIUS)
        links = near_dedup._near(prints, near_dedup.RADIUS)
        assert len(links) == len(own) - len(set(part))
        joined = plain_components(len(own), lambda i, j: (i, j) in links or (j, i) in links)
        assert len({*zip(part, joined, strict=True)}) == len(set(part)) == len(set(joined))


@pytest.mark.parametrize("leaders", [1, 32])
def test_large_groups_of_unlike_sets(spark, monkeypatch, leaders):
    monkeypatch.setattr(near_dedup, "LEADERS", leaders, raising=False)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for j in range(rng.randint(1, 9)):  # each from the one before it
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i * 10 + j, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.similar_documents(df, most=8, radius=near_dedup.BITS)  # all that meet are one group
    assert sorted((False, r.doc_id) for r in kept.collect()) == plain_kept(rows)


def test_no_pair_is_ruled_out_that_is_similar():
    rng = np.random.default_rng(9)
    for n in (1, 5, 60, 5000):
        s = rng.integers(0, 1 << 64, 2 * n, np.uint64)
        a, b = s[: n + n // 4], s[n // 5 :]
        x, y = near_dedup.bitmap(a), near_dedup.bitmap(b)
        most = (x & y).bit_count() + min(len(a) - x.bit_count(), len(b) - y.bit_count())
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_components_by_rounds_and_at_once(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    own = sorted({x for e in edges for x in e if e[0] != e[1]})
    linked = {*edges}
    part = plain_components(len(own), lambda i, j: (own[i], own[j]) in linked or (own[j], own[i]) in linked)
    least = {}
    for p, n in zip(part, own, strict=True):
        least[p] = min(least.get(p, n), n)
    for at_once in (0, 10, components.AT_ONCE):
        found, _ = components.connected_components(df, at_once=at_once)
        assert {r.node: r.component for r in found.collect()} == {n: least[p] for p, n in zip(part, own, strict=True)}


def test_rows_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "text 3")], "doc_id long, text string")
    best = docs.where("doc_id < 40").selectExpr("doc_id AS _i", "xxhash64(text) AS _h").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.rows_of(docs, best, "doc_id", "text")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 3  # rows, those chosen, and those chosen as distinct ones
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
