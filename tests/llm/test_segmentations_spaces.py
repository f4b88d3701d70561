"""Segmentations of texts with runs of spaces against all segmentations over the whole vocabulary."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from keyloom.llm import sentencepiece_nbest

SPM = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=SPM)


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_nbest.Lattice(open(SPM, "rb").read())


def every(sp, lattice, marked):
    """All segmentations as score and ids, from the model's own list of pieces."""
    listed = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    out = []

    def go(i, score, ids):
        if i == len(marked):
            out.append((score, ids))
        for j in range(i + 1, len(marked) + 1):
            p = marked[i:j]
            if p in listed:
                go(j, score + lattice.piece[p][1], (*ids, listed[p]))
            elif j == i + 1:
                go(j, score + lattice.unknown, (*ids, *(lattice.byte_id[b] for b in p.encode())))

    go(0, 0, ())
    return out


TEXTS = ["a b c", "a  b   c", "   a", "a   ", "  ", " ", "a \n  b", "\n\n  \n", "▁▁a  b", "if x:\n    y"]


@pytest.mark.parametrize("text", TEXTS)
def test_runs_of_spaces(sp, lattice, text):
    want = every(sp, lattice, "▁" + text.replace(" ", "▁"))
    ids, scores = lattice.encode(text, 6)
    assert scores == sorted((s for s, _ in want), reverse=True)[:6]
    assert (scores[0], tuple(ids)) in want and lattice.decode(ids) == text.replace("▁", " ")


def test_pieces_of_several_marks_are_used(sp, lattice):
    assert {i for i in range(sp.vocab_size()) if set(sp.id_to_piece(i)) == {"▁"}} <= {i for i, _ in lattice.piece.values()}
    ids, _ = lattice.encode("a    c", 1)
    assert [sp.id_to_piece(i) for i in ids] == sp.encode("a    c", out_type=str) == ["▁a", "▁▁▁", "▁c"]


def test_long_runs_of_spaces(lattice):
    text = "a" + " " * 20_000 + "b" + "\n" + " " * 500 + "c"
    ids, scores = lattice.encode(text, 4)
    assert lattice.decode(ids) == text and len(scores) == 4 and scores == sorted(scores, reverse=True)


def test_units_are_cut_where_no_piece_crosses(lattice):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("  ab\n▁") for _ in range(rng.randint(1, 30)))
        units = lattice._split(text)
        assert "".join(units) == "▁" + text.replace(" ", "▁") and all(units)
        assert not any("▁" in u.lstrip("▁") or "\n" in u[1:] for u in units)
