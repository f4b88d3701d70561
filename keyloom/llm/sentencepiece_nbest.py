"""SentencePiece encoding and decoding with the N best segmentations.

Pieces that match a text form a lattice. A forward Viterbi pass gives each place the best score of
what precedes it; as that is exact, it serves a backward A* search as its heuristic, which then takes
the segmentations best first. Where no piece reaches across a place the lattice falls apart into
words with the spaces before them, each solved once.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, text_or_empty

SPACE = "▁"
#: Scores are kept as whole numbers of this part, so that sums are exact and ties are ties.
UNIT = 1_000_000
#: What an unknown letter scores below the least piece, as in SentencePiece (fixed value).
UNKNOWN = 10.0
_MOST_WORDS = 700_000
#: Letters of the words that a worker remembers.
_MOST_LETTERS = 24_000_000
_AT_ONCE = 2_000_000


class Lattice:
    """A vocabulary as a lattice of pieces.

    Piece scores are log probabilities. A BPE model has ranks in their place; they are read as a Zipf
    law, so a piece of rank ``r`` has a probability in proportion to ``1 / (r + 1)``. Control pieces are
    left out; pieces with scores of -1e8 or less, among them those of several space marks, get the least of
    the others. A letter without a piece is spelled in byte pieces and scores less than any piece.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        raw: dict[int, float] = {}
        last: list[int] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if sp.get_score(i) > -1e8:
                    raw[i] = sp.get_score(i)
                else:
                    last.append(i)
        raw |= dict.fromkeys(last, min(raw.values(), default=0.0))
        ranks = all(v <= 0 and float(v).is_integer() for v in raw.values())
        if ranks:
            mass = np.log(sum(1.0 / (1.0 - v) for v in raw.values()))
            raw = {i: -np.log(1.0 - v) - mass for i, v in raw.items()}
        self.unk_id = sp.unk_id()
        self.piece = {sp.id_to_piece(i): (i, round(v * UNIT)) for i, v in raw.items()}
        self.unknown = round((min(raw.values(), default=0.0) - UNKNOWN) * UNIT)
        self.tails: dict[str, int] = {}
        for p in self.piece:
            self.tails[p[-2:]] = max(self.tails.get(p[-2:], 0), len(p))
        # a unit is a run of spaces and the word after it, if no piece reaches from a word into spaces
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece)
        self.breaks = not any("\n" in p for p in self.piece)
        self.units = re.compile(rf"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        plain = sp.normalize("  a  ﬁ B\n")
        self.identity = plain.replace(SPACE, " ") in ("   a  ﬁ B\n", "  a  ﬁ B\n")
        self.sp = sp
        self.dummy = sp.encode("a", out_type=str)[:1] != ["a"]
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.letters = 0
        self.ids: list[bytes] = []
        self.best, self.gap = array("q"), array("q")
        self.ranked: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    # one word or text

    def edges(self, s: str, j: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """The pieces that end at a place: start, score and ids."""
        one = self.piece.get(s[j - 1])
        if one:
            yield j - 1, one[1], (one[0],)
        else:
            data = s[j - 1].encode("utf-8", "surrogatepass")
            yield j - 1, self.unknown, tuple(self.byte_id.get(b, self.unk_id) for b in data)
        for i in range(j - 2, max(-1, j - 1 - self.tails.get(s[j - 2 : j], 0)), -1):
            found = self.piece.get(s[i:j])
            if found:
                yield i, found[1], (found[0],)

    def viterbi(self, s: str) -> array:
        """The best score of each prefix."""
        best = array("q", bytes(8 * (len(s) + 1)))
        for j in range(1, len(s) + 1):
            best[j] = max(best[i] + v for i, v, _ in self.edges(s, j))
        return best

    def n_best(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations, best first, as score and ids.

        Among paths of equal promise the one nearest to its end goes first: a long run of spaces has
        more of them than could be tried side by side. Ties are in the order in which they end. What a
        path promises it also reaches, so of the open paths no more are kept than segmentations lack.
        """
        best = self.viterbi(s)
        out: list[tuple[int, tuple[int, ...]]] = []
        todo: list[tuple] = [(-best[len(s)], len(s), 0, 0, None)]
        turn = 0
        while todo and len(out) < n:
            _, at, _, score, path = todo.pop(0)
            if at == 0:
                found: list[int] = []
                while path:
                    ids, path = path
                    found += ids
                out.append((score, tuple(found)))
                continue
            lack = n - len(out)
            for i, v, ids in self.edges(s, at):
                # the forward score is exact, so what is taken first is best
                turn += 1
                promise = -(best[i] + v + score)
                if len(todo) < lack or promise <= todo[-1][0]:
                    bisect.insort(todo, (promise, i, turn, score + v, (ids, path)))
                    del todo[lack:]
        return out

    # whole texts

    def _learn(self, words: list[str]) -> None:
        """Solve new words: best score, how much less the second best scores (-1: there is none), best ids.

        The two best scores of a prefix serve all words that begin with it, so the words are taken in
        order and each starts where it leaves the one before.
        """
        piece, tails = self.piece.get, self.tails.get
        first, second, back = [0], [None], [(0, ())]
        before = ""
        for w in sorted(words):
            n, same = len(w), 0
            for x, y in zip(w, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del first[same + 1 :], second[same + 1 :], back[same + 1 :]
            for j in range(same + 1, n + 1):
                i = j - 1
                found = piece(w[i])
                if found:
                    v, ids = found[1], (found[0],)
                else:
                    v = self.unknown
                    ids = tuple(self.byte_id.get(x, self.unk_id) for x in w[i].encode("utf-8", "surrogatepass"))
                best, other, link = first[i] + v, None if second[i] is None else second[i] + v, (i, ids)
                for i in range(j - 2, max(-1, j - 1 - tails(w[j - 2 : j], 0)), -1):
                    found = piece(w[i:j])
                    if found:
                        v = first[i] + found[1]
                        if v >= best:
                            other, best, link = best, v, (i, (found[0],))
                        elif other is None or v > other:
                            other = v
                        if second[i] is not None and (other is None or second[i] + found[1] > other):
                            other = second[i] + found[1]
                first.append(best)
                second.append(other)
                back.append(link)
            path, j = [], n
            while j:
                j, ids = back[j]
                path += ids[::-1]
            path.reverse()
            self.number[w] = len(self.words)
            self.words.append(w)
            self.letters += len(w)
            self.best.append(first[n])
            self.gap.append(-1 if second[n] is None else first[n] - second[n])
            self.ids.append(array("i", path).tobytes())
            before = w

    def _split(self, text: str) -> list[str]:
        """The words that no piece reaches across, in the order of the text."""
        if not self.identity:
            text = self.sp.normalize(text).replace(SPACE, " ").removeprefix(" " if self.dummy else "")
        text = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return self.units.findall(text) if self.separable else [text]

    def encode_all(self, texts: list[str], n: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """For each text the ids, as 32-bit numbers, and the scores of the ``n`` best segmentations."""
        if len(self.words) > _MOST_WORDS or self.letters > _MOST_LETTERS:
            self._reset()
        split = [self._split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.number)
        if new:
            self._learn(list(new))
        best, gap = np.frombuffer(self.best, np.int64), np.frombuffer(self.gap, np.int64)
        number, ids = self.number.__getitem__, self.ids.__getitem__
        for words in split:
            if not words:
                yield [b""], [0]
                continue
            parts = list(map(number, words))
            at = np.array(parts)
            total = int(best[at].sum())
            chosen = self._choices(gap[at], at, n)
            plain = list(map(ids, parts))
            found = []
            for _, changes in chosen:
                mine = plain.copy() if changes else plain
                for place, k in changes:
                    mine[place] = array("i", self.ranked[parts[place]][k][1]).tobytes()
                found.append(b"".join(mine))
            yield found, [total - loss for loss, _ in chosen]

    def encode_n(self, text: str, n: int) -> list[tuple[list[int], int]]:
        """The ids and scores of the ``n`` best segmentations of a text, best first."""
        found, scores = list(self.encode_all([text], n))[0]
        return [(np.frombuffer(ids, "i4").tolist(), score) for ids, score in zip(found, scores, strict=True)]

    def encode(self, text: str, n: int) -> tuple[list[int], list[int]]:
        """The best segmentation's ids, and the scores of the ``n`` best."""
        found = self.encode_n(text, n)
        return found[0][0], [score for _, score in found]

    def _alternatives(self, p: int, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations of a word, the one in ``ids`` first."""
        if p not in self.ranked or len(self.ranked[p]) < n:
            own = tuple(np.frombuffer(self.ids[p], "i4").tolist())
            found = self.n_best(self.words[p], n)
            # where others tie with it, it may come later or not at all
            self.ranked[p] = [(self.best[p], own), *(f for f in found if f[1] != own)][:n]
        return self.ranked[p]

    def _choices(self, gaps: np.ndarray, at: np.ndarray, n: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
        """The best ``n`` ways to segment each word: what they lose, and which words take which alternative.

        Each after the best changes a word, and only the ``n - 1`` words that lose least can be
        among them; their own ``n`` best are found by A*.
        """
        open_words = np.flatnonzero(gaps >= 0)
        found: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
        if n < 2 or not len(open_words):
            return found
        if len(open_words) > n - 1:
            open_words = open_words[np.argpartition(gaps[open_words], n - 2)[: n - 1]]
        for place in open_words.tolist():
            p = int(at[place])
            losses = [self.best[p] - score for score, _ in self._alternatives(p, n)]
            found = heapq.nsmallest(n, ((a + b, (*c, (place, k)) if k else c) for a, c in found for k, b in enumerate(losses)))
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.dummy and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _encoded(lattice: Lattice, column: pa.Array, n: int) -> Iterator[tuple[str, list[bytes], list[int]]]:
    """Texts with their segmentations, a bounded amount of text at a time."""
    texts, size = [], 0
    for t in column:
        texts.append(t.as_py())
        size += len(texts[-1])
        if size > _AT_ONCE:
            yield from ((t, *e) for t, e in zip(texts, lattice.encode_all(texts, n), strict=True))
            texts, size = [], 0
    yield from ((t, *e) for t, e in zip(texts, lattice.encode_all(texts, n), strict=True))


def segmentations(docs: DataFrame, model_file: str, *, n: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_pieces, best_score, nbest_scores, ids_sha256, round_trip, nbest_ids_sha256``.

    ``nbest_scores`` has the scores of the ``n`` best segmentations of the whole text, best first (fewer
    where there are fewer), as log probabilities; ``ids_sha256`` digests the best one's ids as
    little-endian 32-bit numbers; ``round_trip`` tells if they decode to the text. ``nbest_ids_sha256`` has
    such digests of all ``n``, in the order of their scores. With ``with_ids`` the numbers themselves are
    added, ``ids`` of the best and ``nbest_ids`` of all ``n``. A null text is empty: no pieces, score 0. Texts with the space mark U+2581
    itself decode to spaces, as in the library. Repeated rows give repeated results, null identifiers
    stay null, an empty table gives no rows, and other columns are not read.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    with open(model_file, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(Held(content))
    keyed = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value.get(Lattice)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text, found, scores in _encoded(lattice, batch.column("t"), n):
                numbers = [np.frombuffer(ids, "i4") for ids in found]
                digests = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in numbers]
                listed = numbers[0].tolist()
                every = [x.tolist() for x in numbers] if with_ids else None
                row = (len(listed), scores[0] / UNIT, [s / UNIT for s in scores], digests[0], lattice.decode(listed) == text, digests, listed if with_ids else None, every)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            numbered = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.bool_(), pa.list_(pa.string()), numbered, pa.list_(numbered)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["i", "n_pieces", "best_score", "nbest_scores", "ids_sha256", "round_trip", "nbest_ids_sha256", "ids", "nbest_ids"])

    schema = keyed.select("i").schema.add("n_pieces", "long").add("best_score", "double").add("nbest_scores", T.ArrayType(T.DoubleType()))
    schema = schema.add("ids_sha256", "string").add("round_trip", "boolean").add("nbest_ids_sha256", T.ArrayType(T.StringType()))
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType())))
    out = keyed.mapInArrow(run, schema).withColumnRenamed("i", id_col)
    return out if with_ids else out.drop("ids", "nbest_ids")
