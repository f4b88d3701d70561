"""The random field against all readings of short runs, and its spans on disguised texts that it has not seen."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import pii


def readings(n, kinds, scores):
    """All ways to cut n tokens into outside tokens and segments that have a score."""
    if n == 0:
        yield ()
        return
    for size in range(1, min(n, scores.shape[1]) + 1):
        for kind in range(kinds + 1):
            if kind == 0 and size == 1:
                for r in readings(n - 1, kinds, scores):
                    yield (*r, (n - 1, n, 0))
            elif kind and scores[n - size, size - 1, kind - 1] > -np.inf:
                for r in readings(n - size, kinds, scores):
                    yield (*r, (n - size, n, kind))


def weight(reading, scores, follow):
    total, before = 0.0, 0
    for i, j, k in reading:
        total += follow[before, k] + (scores[i, j - i - 1, k - 1] if k else 0.0)
        before = k
    return total + follow[before, 0]


def test_sums_equal_all_readings():
    rng = np.random.default_rng(1)
    for n in (1, 3, 6):
        scores = np.where(rng.random((2, n, 4, 2)) < 0.6, rng.normal(0, 2, (2, n, 4, 2)), -np.inf)
        for i, size in itertools.product(range(n), range(1, 5)):
            if i + size > n:
                scores[:, i, size - 1] = -np.inf
        follow = rng.normal(0, 1, (3, 3))
        follow[0, 0] = 0.0
        sums = pii.Sums(scores, follow)
        sums.forward()
        sums.backward()
        steps = np.zeros((3, 3))
        for r in range(2):
            every = list(readings(n, 2, scores[r]))
            w = np.exp([weight(x, scores[r], follow) for x in every])
            assert np.isclose(sums.log_z[r], np.log(w.sum()))
            for i, size in itertools.product(range(n), range(1, 5)):
                if i + size <= n:
                    want = [sum(v for x, v in zip(every, w, strict=True) if (i, i + size, k) in x) / w.sum() for k in (1, 2)]
                    assert np.allclose(sums.marginals(np.array([r]), np.array([i]), np.array([size]))[0], want)
            for x, v in zip(every, w, strict=True):
                kinds = [0, *(k for _, _, k in x), 0]
                for a, b in itertools.pairwise(kinds):
                    steps[a, b] += v / w.sum()
            best = max(every, key=lambda x: weight(x, scores[r], follow))
            assert sums.best()[r] == [x for x in best if x[2]]
        assert np.allclose(sums.steps(), steps)


def test_sums_of_long_runs_stay_finite():
    rng = np.random.default_rng(2)
    sums = pii.Sums(rng.normal(0, 10, (2, 1500, 24, 4)), np.zeros((5, 5)))
    sums.forward()
    sums.backward()
    m = sums.marginals(np.zeros(1400, int), np.arange(1400), np.full(1400, 3))
    assert np.isfinite(sums.log_z).all() and (m >= 0).all() and (m <= 1 + 1e-9).all()
    assert np.allclose(np.log(sums.rest[:, 0] @ np.eye(5)[0]) + sums.down[:, 0], sums.log_z)


def test_candidates_are_what_tokens_say():
    text = "call +1 (988) 555-2485, mail a.b [at] c [dot] com; 10.0.0.1 4111 1111 1111 1111 x@y.z ü12345ü"
    found = pii.candidates(text)
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    assert list(zip(found.starts.tolist(), found.ends.tolist(), strict=True)) == tokens
    spans = {text[found.starts[i] : found.ends[i + n - 1]] for i, n in zip(found.first, found.size, strict=True)}
    assert {"+1 (988) 555-2485", "a.b [at] c [dot] com", "10.0.0.1", "4111 1111 1111 1111", "x@y.z", "12345"} <= spans
    again = pii.candidates("no digits" + pii._APART + text)  # features don't depend on what stands elsewhere
    key = lambda c, t: {(t[c.starts[i] : c.ends[i + n - 1]], c.ends[i + n - 1] - len(t)): b.tolist() for i, n, b in zip(c.first, c.size, c.bins, strict=True)}
    assert key(found, text) == key(again, "no digits" + pii._APART + text)


@pytest.fixture(scope="module")
def split(spark, sf_dir):
    docs = spark.read.parquet(str(sf_dir).replace("sf0.001", "sf0.01") + "/documents.parquet")
    texts = sorted(r.text for r in docs.where("text IS NOT NULL").select("text").distinct().collect())
    random.Random(1).shuffle(texts)
    return texts[::2], texts[1::2]


def test_disguised_spans_of_unseen_texts(split):
    stretches = sorted({t[a:b] for t in split[0] for a, b in pii.windows(t) if b - a < pii.MOST_LETTERS})
    model = pii.fit(stretches)
    right = wrong = missed = 0
    for i, t in enumerate(split[1]):
        copy, marked = pii._disguised(t, pii.base_spans(t), i)
        base = pii.base_spans(copy)
        want, got = set(marked) - set(base), set(pii.added_spans(model, copy, base))
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right >= 0.8 * (right + missed) and right >= 0.9 * (right + wrong) and right > 5


def test_dense_numbers_take_linear_time(split):
    model = pii.fit(["card 4111 1111 1111 1111 of 1999", "phone +1 (988) 555-2485"])
    rng = random.Random(3)
    text = " ".join(str(rng.randint(0, 9999)) for _ in range(50_000))[:200_000]
    began = time.time()
    pii.added_spans(model, text, pii.base_spans(text))
    assert time.time() - began < 8
    long = "plain words " * 60_000 + "call 1-988-555-2485 now " + "plain words " * 60_000  # several blocks
    got = pii.added_to(model, [long, "", "plain", long], [[], [], [], []])
    assert got[0] == got[3] and got[1] == got[2] == []


def test_a_sample_holds_one_of_all_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("call +1 (988) 555-2485 or mail ab.cd@mail.example.com now").alias("text"))
    model = pii.train(df, sample=3000)
    assert isinstance(model, pii.Field) and pii.pii(df.limit(3), model=model).where("n_phone = 1 AND n_email = 1").count() == 3
