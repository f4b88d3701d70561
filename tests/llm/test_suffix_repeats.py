"""Every repeated byte goes: zero bytes, cut anchors, anchors that very many fragments share, long texts."""

import random
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import suffix_dedup

from .test_operators import brute_repeats, multiset


def held_to_brute_force(spark, texts, length, **options):
    rows = list(enumerate(texts))
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t.encode() for t in texts], length), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = multiset(suffix_dedup.suffix_dedup(df, length=length, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want


@pytest.mark.parametrize("shard", [600, 1200, 2000, 1 << 17])
def test_zero_bytes_at_ends(spark, shard):
    rng = random.Random(shard)
    shared = ["".join(rng.choice("\x00\x01ÿa") for _ in range(rng.randint(60, 150))) for _ in range(12)]
    shared += [s[:20] + "\x00" * 90 for s in shared[:6]] + ["\x00" * 140, "\x00" * 64 + "\x01" * 64]
    texts = []
    for _ in range(150):
        parts = ["".join(rng.choice("\x00\x01ÿ") for _ in range(rng.choice([0, 0, 3, 40]))) for _ in range(2)]
        texts.append(parts[0] + rng.choice(shared) + parts[1])
    held_to_brute_force(spark, texts, 100, gram=32, shard_bytes=shard)


def test_two_hundred_bytes_that_end_in_zeros(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        one = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(64, 180)))
        one += "\x00" * (200 - len(one))
        texts += [one, "x" * rng.randint(0, 30) + one + "".join(rng.choice("\x00\x01z") for _ in range(rng.randint(0, 30)))]
    rng.shuffle(texts)
    held_to_brute_force(spark, texts, 200, shard_bytes=1200)


@pytest.mark.parametrize("most", [2, 20])
def test_crowded_anchors(spark, most):
    """A passage that goes on differently each time, and one that begins so; some go on alike."""
    rng = random.Random(most)
    passage = "".join(rng.choice("abcdefghijkl ") for _ in range(180))
    texts = []
    for i in range(120):
        tail = "".join(rng.choice("mnop") for _ in range(rng.randint(10, 60)))
        head = "".join(rng.choice("qrst") for _ in range(rng.randint(10, 60)))
        texts += [head + passage + tail, passage[: rng.randint(90, 180)] + tail, head + passage[rng.randint(0, 80) :] if i % 3 else tail]
    texts += ["\x00" * 300 + str(i) for i in range(30)]
    held_to_brute_force(spark, texts, 100, gram=32, most_fragments=most, shard_bytes=900)


def test_a_text_of_several_chunks(spark):
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, (1 << 19) + 5000).astype(np.uint8)).decode()
    at = (1 << 19) - 150
    long = long[:at] + "0" * 700 + long[at + 700 :]
    held_to_brute_force(spark, [long, long[at - 300 : at + 900], long[1000:1300], "0" * 199, None or ""], 200)


def test_suffix_array_with_all_bytes():
    rng = np.random.default_rng(2)
    for _ in range(60):
        d = rng.choice(np.array([0, 1, 255], np.uint8), rng.integers(1, 200))
        d[rng.integers(0, len(d)) :] = 0
        order, rank = suffix_dedup.suffix_array(d, 30)
        b = bytes(d)
        parts = [b[i : i + 30] for i in order]
        assert parts == sorted(b[i : i + 30] for i in range(len(b)))
        assert all((rank[i] == rank[j]) == (x == y) for i, j, x, y in zip(order, order[1:], parts, parts[1:]))  # noqa: B905
