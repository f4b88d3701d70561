"""All stages of the pipeline on odd tables, each held against a plain version of itself."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import mixing, sentencepiece_nbest

from .test_near_dedup import plain_kept
from .test_segmentations_query import plain_n_best
from .test_segmentations_spaces import SPM, lattice, sp  # noqa: F401

#: Names that operators use inside.
CLASHING = "h string, i long, k string, row string, t string, n long, p double, u double, _i long, _h long, _own_h string, _k string, _row string, _lang string, _text string, _t string, _rank long, label string, node long"


def odd_rows():
    rng = random.Random(8)
    words = {"en": "the and thing with from house water".split(), "de": "der und nicht für schön Haus Wasser".split()}
    base = [(k, [rng.choice(words[k]) for _ in range(rng.randint(20, 60))]) for k in ("en", "de") * 12]
    texts = [(k, " ".join(w)) for k, w in base]
    for k, w in base[:8]:
        w = list(w)
        w[-1] = "other"
        texts.append((k, " ".join(w)))
    texts += [texts[0], texts[0], ("en", None), (None, ""), (None, " \n"), ("en", "½ ² Ⅷ 12"), (None, "x"), ("de", "   the  two\n\tthe"), ("en", "the thing " * 30_000), ("en", "anderthing" * 3000)]
    return [(i * 3, t, k) for i, (k, t) in enumerate(texts)] + [(None, texts[3][1], "en"), (None, None, None), (0, texts[5][1], "de")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    extra = [f.strip().split() for f in CLASHING.split(",")]
    rows = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string")
    rows = rows.select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(None if n.startswith("_") else 1).cast(kind).alias(n) for n, kind in extra])
    labels = spark.createDataFrame([(i * 3, i % 2, i % 5 == 0) for i in range(20)], "doc_id long, quality int, toxic boolean").select("doc_id", "quality", F.col("toxic").cast("int").alias("toxic"))
    rows.union(rows.where("doc_id = 9")).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels.union(labels.limit(1)).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_equal_plain_versions(spark, tables, lattice):  # noqa: F811
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    first = stage["language_id"](spark, docs, tables)
    assert first.columns == docs.columns
    kept = [r for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    assert sorted(map(key, first.collect())) == sorted(map(key, kept)) and first.where("lang IS NULL").count() == 0
    second = stage["exact_dedup"](spark, first, tables)
    most = {}
    for r in kept:
        most[r.text] = max((x for x in (most.get(r.text), r.doc_id) if x is not None), default=None)
    assert second.columns == docs.columns and Counter((r.doc_id, r.text) for r in second.collect()) == Counter((i, t) for t, i in most.items())
    third = stage["simhash"](spark, second, tables)
    assert third.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in third.collect()) == plain_kept([(i, t) for t, i in most.items()])
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rates = mixing.mixing_rates(third, labels, corpus_pipeline.TARGETS, tokenizer_file=corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rates.collect():
        want[r.doc_id] += r.copies
    fourth = stage["mixing"](spark, third, tables)
    assert fourth.columns == docs.columns and Counter(r.doc_id for r in fourth.collect()) == +want
    fifth = stage["sentencepiece"](spark, third, tables)
    pieces = {p: v for p, (_, v) in lattice.piece.items()}
    texts = {r.doc_id: r.text for r in third.collect()}
    got = fifth.collect()
    assert len(got) == len(texts)
    for r in got:
        if len(texts[r.doc_id]) < 20_000:
            assert [round(s * sentencepiece_nbest.UNIT) for s in r.nbest_scores] == plain_n_best(pieces, lattice.unknown, "▁" + texts[r.doc_id].replace(" ", "▁"), 3)
        assert r.round_trip


def test_run_on_odd_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
