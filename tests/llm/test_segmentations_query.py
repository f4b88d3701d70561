"""The query op5 against a plain n-best over whole texts, and long texts without spaces."""

import heapq
import random
import time

from keyloom.llm import sentencepiece_nbest
from keyloom.llm.queries import op5_sentencepiece_nbest

from .test_segmentations_spaces import SPM, lattice, sp  # noqa: F401


def plain_n_best(pieces, unknown, s, n):
    """The n best scores of all segmentations, by keeping n for each prefix."""
    longest = max(map(len, pieces))
    best = [[0]]
    for j in range(1, len(s) + 1):
        found = []
        for i in range(max(0, j - longest), j):
            v = pieces.get(s[i:j], unknown if i == j - 1 else None)
            if v is not None:
                found += [b + v for b in best[i]]
        best.append(heapq.nlargest(n, found))
    return best[-1]


def test_query_equals_plain_n_best(spark, sf_dir, lattice):  # noqa: F811
    pieces = {p: v for p, (_, v) in lattice.piece.items()}
    got = {r.doc_id: r for r in op5_sentencepiece_nbest(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(docs) == len(got)
    known = {}
    for d in docs:
        text = d.text or ""
        if text not in known:
            known[text] = plain_n_best(pieces, lattice.unknown, "▁" + text.replace(" ", "▁"), 3) if text else [0]
        assert [round(s * sentencepiece_nbest.UNIT) for s in got[d.doc_id].nbest_scores] == known[text]
        assert got[d.doc_id].round_trip


def test_long_texts_without_spaces(lattice):  # noqa: F811
    rng = random.Random(4)
    pieces = {p: v for p, (_, v) in lattice.piece.items()}
    for letters in ("etaoinshr", "a", "ab", "0123456789-"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        found = lattice.encode_n(text, 4)
        assert [s for _, s in found] == plain_n_best(pieces, lattice.unknown, "▁" + text, 4)
        assert len({tuple(i) for i, _ in found}) == 4 and all(lattice.decode(i) == text for i, _ in found)
    times = []
    for n in (50_000, 200_000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        began = time.time()
        lattice.encode_n(text, 3)
        times.append(time.time() - began)
    assert times[1] < 12 * times[0] + 1
