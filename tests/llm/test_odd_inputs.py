"""Repeated and very long texts, ties, letters, and rows that link with nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import components, embedding_dedup, language_id, mixing, token_counts, toxicity

from .test_operators import BPE, labelled

LONG = "the thing from the house " * 40_000


def test_letters_by_category():
    assert not any(map(language_id.has_letter, ("", "½", "²", "Ⅷ", "12 _ !", "́", "①")))
    assert all(map(language_id.has_letter, ("a", "12½x", "ß", "日", "ʰ", "ª")))


def test_languages_of_long_repeated_and_tied_texts(spark):
    words = {"en": "the and thing with from".split(), "de": "der und nicht für schön".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(200) for k in [("en", "de")[i % 2]]]
    rows += [(1000, LONG, None), (1001, LONG, "en"), (1002, "x", None), (1003, "x", None), (1004, "½ ² Ⅷ", "en"), *rows[:2], rows[0]]
    rows += [(i, "same text", k) for i, k in ((2000, "en"), (2001, "de"), (2002, "en"), (2003, "de"))]  # labels tie
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == len(rows) and all(len(v) == 1 for v in by.values())
    assert by[1000] == by[1001] and {p for p, _ in by[1000]} == {"en"} and by[1002] == by[1003] and by[1004] == {("und", 0.0)}
    assert by[2000] == by[2001] == by[2002] == by[2003]


def test_a_bound_on_rows_of_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_ROWS", 40)
    rows = [(i, f"wort{i % 7} text{i % 11} nummer{i % 5}", f"l{i % 8}") for i in range(1600)]
    fitted = []
    monkeypatch.setattr(language_id, "fit", lambda x, y: fitted.append(len(y)) or language_id.Model([], {}))
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 0 < fitted[0] < 100


def test_toxicity_of_long_and_repeated_texts(spark):
    df, labels = labelled(spark, 300)
    odd = spark.createDataFrame([(5000, LONG), (5001, LONG), (5002, LONG + " idiot" * 2000), (5003, "idiot " * 50_000), (5004, "x" * 500_000)], "doc_id long, text string")
    both = df.select("doc_id", "text").unionByName(odd).unionByName(odd.limit(2))
    got = {}
    for r in toxicity.toxicity(both, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in got.values()) and got[5000] == got[5001] and got[5003] > {0.0} or max(got[5003]) > max(got[5000])


def test_all_terms_past_the_thresholds_are_kept(spark):
    rng = random.Random(5)
    bad = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(900)]
    rows = [(i, " ".join(["plain", "words", *(bad if i % 2 else [])]), i % 2) for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.train(df, df.select("doc_id", "toxic")).terms) >= len(set(bad))


def test_mixing_of_long_and_repeated_texts(spark, caplog):
    df, labels = labelled(spark, 300)
    rows = df.select("doc_id", "text").unionByName(spark.createDataFrame([(7000, LONG), (7000, LONG), (7001, "x" * 300_000), (7002, "")], "doc_id long, text string"))
    targets = {"quality1_toxic0": 0.6, "quality0_toxic0": 0.2, "quality1_toxic1": 0.1, "quality0_toxic1": 0.1}
    got = mixing.mixing_rates(rows, labels, targets, tokenizer_file=BPE).collect()
    counts = {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(rows, BPE).collect()}
    assert {(r.doc_id, r.n_tokens) for r in got} == counts
    n, rate, p = (np.array([r[c] for r in got]) for c in ("n_tokens", "rate", "posteriors"))
    off = np.abs((n * rate) @ p / n.sum() - [targets[k] for k in sorted(targets)]).max()
    assert len({r.target_error for r in got}) == 1 and np.isclose(off, got[0].target_error)
    assert ("off its target" in caplog.text) == (off > mixing.FAR)
    assert len({(r.rate, r.copies) for r in got if r.doc_id == 7000}) == 1 and (rate >= 0).all()


@pytest.mark.parametrize("width", [1, 2, 4, 9])
def test_rounded_posteriors_are_few(width):
    steps = mixing._steps(width)
    p = np.random.default_rng(1).dirichlet(np.full(width, 0.5), 200_000)
    assert len(np.unique(np.floor(p * steps), axis=0)) <= mixing.MOST_CELLS


def test_rows_without_a_vector_or_label(spark):
    rows = [(i, None if i % 2 else [1.0, 2.0], None if i % 3 else 1) for i in range(60)] + [(None, None, None), (3, None, 1)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    linked = [i for i in range(60) if i % 2 == 0 and i % 3 == 0]
    want = sorted([(str(i), len(linked) - 1 if i in linked else 0, str(0 if i in linked else i), i not in linked or i == 0) for i in range(60)] + [("None", 0, "None", False), ("3", 0, "3", True)])
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want


def test_components_of_a_star_and_paths(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(2000, 2400)] + [(2400, 1499), (5000, 5001)]
    random.Random(1).shuffle(edges)
    got, _ = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(9))
    found = {r.node: r.component for r in got.collect()}
    assert found == dict.fromkeys([*range(1500), *range(2000, 2401)], 0) | {5000: 5000, 5001: 5000}


def test_counts_of_a_given_cache_with_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a text {i % 5}") for i in range(50)], "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    token_counts.token_counts(df, BPE, cache_path=cache).count()
    spark.read.parquet(cache).write.mode("append").parquet(cache + "2")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "2")  # two runs stored the same
    got = token_counts.token_counts(df.withColumn("digest", F.lit(1)), BPE, cache_path=cache + "2")
    assert got.count() == 50 and got.where("n_tokens <= 0").count() == 0
