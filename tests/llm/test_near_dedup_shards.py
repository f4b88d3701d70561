"""The near dedup of the pipeline deals by blocks of SimHash fingerprints: who meets, and what is linked."""

import numpy as np
import pytest

from keyloom.llm import near_dedup

from .test_operators import plain_components


def test_fingerprints_with_fewer_different_bits_than_blocks_meet():
    rng = np.random.default_rng(1)
    for length in (8, 12, 17):
        count = 60
        own = rng.integers(0, 2, (300, length * count), np.uint8)
        near = own.copy()
        for row in near:
            row[rng.permutation(row.size)[: count - 1]] ^= 1
        a, b = near_dedup.shards(own, length), near_dedup.shards(near, length)
        assert a.shape == (300, count) and ((a == b).any(axis=1)).all()
        assert (near_dedup.shards(1 - own, length) == a).mean() < 0.001


def test_bits_of_similar_sets_differ_as_worked_out():
    differ = near_dedup.differing(0.8)
    assert differ[4] == differ[5] == max(differ) and not any(differ[:4])
    rng = np.random.default_rng(2)
    for both, a, b in ((4, 1, 0), (6, 1, 0), (12, 2, 1), (40, 5, 5), (400, 50, 50)):
        length, misses, far, apart = 9, 0, 0, []
        size = [min(both + n, len(differ) - 1) for n in (a, b)]
        met = min(near_dedup.blocks_needed(differ[n], length) for n in size) * length
        for _ in range(300):
            own = rng.integers(0, 1 << 64, both + a + b, np.uint64)
            x, y = (near_dedup.wide_fingerprint(s, met)[:met] for s in (own[: both + a], np.concatenate((own[:both], own[both + a :]))))
            apart.append((x != y).mean())
            misses += not (near_dedup.shards(x[None], length) == near_dedup.shards(y[None], length)).any()
            far += (x != y)[: near_dedup.BITS].sum() > near_dedup.RADIUS
        assert not misses and not far
        assert np.mean(apart) < max(differ[n] for n in size) + 0.004


@pytest.mark.parametrize("most", [1024, 3])
def test_near_fingerprints_are_linked_through_their_shards(spark, most):
    rng = np.random.default_rng(3)
    length, count = 8, 61
    width = length * count + -length * count % 64
    rows = []
    for _ in range(60):
        own = rng.integers(0, 2, width, np.uint8)
        for _ in range(int(rng.integers(1, 9))):
            near = own.copy()
            near[rng.permutation(width)[: int(rng.integers(0, 50))]] ^= 1
            rows.append(np.packbits(near).tobytes())
    df = spark.createDataFrame([(bytearray(f),) for f in rows], "fp binary")
    found, _ = near_dedup._near_fingerprints(df, length, near_dedup.RADIUS, most)
    got = {r.node: r.component for r in found.collect()}
    names = [int.from_bytes(f[:8], "big", signed=True) for f in rows]
    head = [int.from_bytes(f[: near_dedup.BITS // 8], "big") for f in rows]
    part = plain_components(len(rows), lambda i, j: (head[i] ^ head[j]).bit_count() <= near_dedup.RADIUS)
    least = {}
    for p, n in zip(part, names, strict=True):
        least[p] = min(least.get(p, n), n)
    assert [got.get(n, n) for n in names] == [least[p] for p in part]
