"""All n segmentations of a text, not only the best one and scores."""

import hashlib
import random

import numpy as np

from keyloom.llm import sentencepiece_nbest

from .test_segmentations_spaces import SPM, TEXTS, every, lattice, sp  # noqa: F401


def test_ids_of_all_segmentations(sp, lattice):  # noqa: F811
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("the aon\nß") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["the the the"]
    for text in texts:
        want = every(sp, lattice, "▁" + text.replace(" ", "▁"))
        for n in (1, 2, 5):
            got = lattice.encode_n(text, n)
            assert [s for _, s in got] == sorted((s for s, _ in want), reverse=True)[:n], text
            assert all((s, tuple(ids)) in want for ids, s in got), text
            assert len({tuple(ids) for ids, _ in got}) == len(got), text
            assert all(lattice.decode(ids) == text.replace("▁", " ") for ids, _ in got), text


def test_query_gives_all_segmentations(spark, sp, lattice):  # noqa: F811
    texts = ["the aon the", "a  b", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_nbest.segmentations(df, SPM, n=3, with_ids=True).collect():
        want = lattice.encode_n(texts[r.doc_id] or "", 3)
        assert r.nbest_ids == [ids for ids, _ in want] and r.ids == r.nbest_ids[0] and len(r.nbest_ids) == len(r.nbest_scores)
        assert r.nbest_ids_sha256 == [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for ids, _ in want]
        assert r.ids_sha256 == r.nbest_ids_sha256[0]
    assert "nbest_ids" not in sentencepiece_nbest.segmentations(df, SPM).columns
