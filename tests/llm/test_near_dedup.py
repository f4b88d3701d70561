"""The near dedup of the pipeline against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import exact_dedup, near_dedup

from .test_operators import plain_components


def plain_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)}


def plain_kept(rows):
    """Rows of identifier and text; all pairs are compared."""
    sets = [plain_set(t) for _, t in rows]
    part = plain_components(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    best = {}
    for p, (i, _) in zip(part, rows, strict=True):
        best[p] = min(best.get(p, (True, 0)), (i is None, i or 0))
    return sorted(best.values())


@pytest.mark.parametrize("most", [1024, 4])
def test_similar_documents(spark, most):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (None, "no id here"), (906, "a b c d e"), (907, "a b c d e f")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        for j in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i * 10 + j, " ".join(t)))
    rows += [rows[-1], (3, rows[-1][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("own"))
    kept = near_dedup.similar_documents(df, most=most)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == plain_kept(rows)
    assert near_dedup.similar_documents(df.limit(0)).count() == 0


def test_threshold_is_met_exactly():
    a = np.arange(90, dtype=np.uint64)
    assert near_dedup.similar(a[:80], a[:64], 0.8) and not near_dedup.similar(a[:80], a[:63], 0.8)
    assert near_dedup.similar(a[:72], np.concatenate((a[:64], a[72:80])), 0.8) and not near_dedup.similar(a[:72], np.concatenate((a[:63], a[72:81])), 0.8)


def test_fingerprint_is_the_majority():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 64):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        plain = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))
        assert near_dedup.fingerprint(own) == plain


def test_radius_reaches_the_similarity():
    rng = np.random.default_rng(5)
    for both, a, b in ((4, 1, 0), (4, 0, 1), (8, 1, 1), (40, 5, 5), (160, 40, 0)):
        for _ in range(1500):
            own = rng.integers(0, 1 << 64, both + a + b, np.uint64)
            x, y = own[: both + a], np.concatenate((own[:both], own[both + a :]))
            assert (near_dedup.fingerprint(x) ^ near_dedup.fingerprint(y)).bit_count() <= near_dedup.RADIUS


def test_pipeline_stage_reaches_similarity(spark, sf_dir):
    docs = exact_dedup.kept_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf_dir)
    assert sorted((False, r.doc_id) for r in got.collect()) == plain_kept(rows)
