"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The random field gives each way to cut a text's tokens into outside
tokens and bounded entities of four kinds a probability, from features of whole candidate segments and of
the kinds that follow each other. Forward and backward sums over segments give the partition sum and each
segment's marginal; weights are fitted by the gradient of the conditional likelihood. The likeliest reading
chooses boundaries and types jointly, and its spans of a high marginal that the patterns miss are added.
It learns from base spans of a bounded sample, some of them disguised; base spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Matches what IP does, but tries each run of digits once only, so that long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9+][\x20().0-9+-]*+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

#: Tokens and letters of a candidate segment at most.
MOST_TOKENS = 24
MOST_SPAN = 320
#: Characters on each side of a trigger that the stretches of the sample have.
AROUND = 40
#: Documents, on average, that the random field is fitted on.
SAMPLE = 300
#: Stretches of one document, and characters of one stretch, that the random field is fitted on at most.
MOST_STRETCHES = 200
MOST_LETTERS = 4000
#: An added span's marginal probability, at least.
SURE = 0.5
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|\b[aA][tT]\b(?=\W+\w+\W+[dD][oO][tT]\b)|[\[(][aA][tT][\])]")
_WEIGHT_BITS = 18
#: Characters that are read at once, and how far two such blocks overlap.
_BLOCK, _OVERLAP = 1 << 19, 1 << 13
#: Tokens of a run that are summed over at once, and tokens of the runs that are held at once.
_PIECE, _HELD = 1024, 1 << 14


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL matches, in linear time: all starts of a run of letters before an ``@`` match or fail alike."""
    least, at = 0, text.find("@")
    while at >= 0:
        before = text[least:at]
        start = len(before.rstrip(_LOCAL)) + least
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        least = found.end() if found else at + 1
        at = text.find("@", least)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by kind and start, in code points; leftmost and non-overlapping within a kind.

    Each pattern's letters lie within a run of a larger class of letters, so only those runs are read.
    """
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    found["email"] = [("email", a, b) for a, b in _emails(text)]
    for run in _NUMBERS.finditer(text):
        a, b = run.span()
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found["ip"].append(("ip", m.start(), m.end()))
        if b - a >= 13:
            for m in CARD.finditer(text, a, b):
                d = _digits(m.group())
                if 13 <= len(d) <= 19 and luhn(d):
                    found["card"].append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text, a, b):
            if 9 <= len(_digits(m.group())) <= 15:
                found["phone"].append(("phone", m.start(), m.end()))
    return [s for k in KINDS for s in found[k]]


_U = np.uint64
_ODD, _MIX = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9)
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)])
_CLASS = np.where(_BLANK[:128], _SPACE, _OTHER).astype(np.int8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX
    return x ^ (x >> _U(29))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, _U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _sums(x: np.ndarray) -> np.ndarray:
    """What precedes each place adds up to."""
    out = np.zeros(len(x) + 1, x.dtype if x.dtype == _U else np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _word(s: str) -> int:
    powers = _power_tables(64)[0]
    return int(_mixed((np.array([ord(c) for c in s], _U) * powers[: len(s)]).sum(keepdims=True))[0])


@dataclass
class Candidates:
    """Tokens of texts, and the segments that could be entities: first token, number of tokens, feature bins."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    size: np.ndarray
    bins: np.ndarray


_FEATURES = 14


def candidates(joined: str) -> Candidates:
    """All segments of bounded tokens that have four digits and hardly a word, an ``@``,
    ``at`` in brackets, or ``at`` and ``dot``.

    Features are those of the whole span: digits, the shape of its tokens and gaps, the lengths of its
    digit groups, check sums, separators, what touches it, and the word before it. Three blanks in a row
    end a segment, so texts may be joined by them.
    """
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars)
    kind = np.full(n, _OTHER, np.int8)
    low = chars < 128
    kind[low] = _CLASS[chars[low]]
    high = np.flatnonzero(~low & (chars < len(_BLANK)))
    kind[high[_BLANK[chars[high]]]] = _SPACE
    none = np.zeros(0, np.int64)
    before = np.concatenate((np.zeros(1, np.int8), kind[:-1]))
    begins = (kind != _SPACE) & ((kind != before) | (kind == _OTHER))
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Candidates(none, none, none, none, np.zeros((0, _FEATURES), np.int32))
    ends = np.flatnonzero(np.append(begins[1:] | (kind[1:] == _SPACE), True) & (kind != _SPACE)) + 1
    m = len(starts)
    what = kind[starts]
    code = np.where(what == _OTHER, chars[starts], 0).astype(np.int64)
    gap = np.concatenate(([9], starts[1:] - ends[:-1]))
    broken = np.cumsum(gap > 2)
    # prefix sums over characters and tokens
    is_digit = kind == _DIGIT
    digits = _sums(is_digit)
    ats, dots = _sums(code == 64), _sums(code == 46)
    words, numbers = _sums(what == _LETTER), _sums(what == _DIGIT)
    gaps = _sums(np.where(gap > 2, 0, gap))
    powers, inverse = _power_tables(max(m + 1, int((ends - starts).max()) + 1))
    lower = chars.astype(_U)
    lower[(chars >= 65) & (chars <= 90)] += _U(32)
    owner = np.cumsum(begins) - 1
    inside = np.flatnonzero(kind == _LETTER)
    spelled = np.zeros(n, _U)
    spelled[inside] = lower[inside] * powers[inside - starts[owner[inside]]]
    spell = _sums(spelled)
    word = np.where(what == _LETTER, _mixed(spell[ends] - spell[starts]), code.astype(_U))
    at_words = _sums((word == _U(_word("at"))) & (what == _LETTER))
    dot_words = _sums((word == _U(_word("dot"))) & (what == _LETTER))
    # "(at)" and "[at]"
    around = np.isin(np.concatenate(([0], code[:-1])), [40, 91]) & np.isin(np.concatenate((code[1:], [0])), [41, 93])
    marked = _sums((word == _U(_word("at"))) & (what == _LETTER) & around)
    # where a segment may begin: what it needs is among the tokens ahead
    ahead = np.minimum(np.arange(m) + MOST_TOKENS, m)
    here = np.arange(m)
    needs = (digits[ends[ahead - 1]] - digits[starts] >= 4) | (ats[ahead] > ats[here]) | (marked[ahead] > marked[here]) | ((at_words[ahead] > at_words[here]) & (dot_words[ahead] > dot_words[here]))
    head = (what != _OTHER) | np.isin(code, [ord(c) for c in "+([_"])
    tail = (what != _OTHER) | np.isin(code, [ord(c) for c in ")]"])
    may = np.flatnonzero(needs & head)
    if not len(may):
        return Candidates(starts, ends, none, none, np.zeros((0, _FEATURES), np.int32))
    # polynomial sums, so that a segment's sequence of tokens has a hash in two lookups
    look = (np.where(what == _OTHER, code + 3, what) * 4 + np.minimum(gap, 2)).astype(_U)
    shape = _sums(_mixed(look) * powers[:m])
    opening = _mixed((np.where(what == _OTHER, code + 3, what) * 4 + 3).astype(_U))
    long = np.minimum(ends - starts, 17)
    groups = _sums(np.where(what == _DIGIT, _mixed(long.astype(_U)) * powers[numbers[:-1]], _U(0)))
    value = np.where(is_digit, chars.astype(np.int64) - 48, 0)
    double = np.where(value > 4, value * 2 - 9, value * 2)
    even = digits[:-1] % 2 == 0
    check = [_sums(np.where(is_digit, np.where(even, value, double), 0)), _sums(np.where(is_digit, np.where(even, double, value), 0))]
    # numbers over 255, from the last three digits of those that have no more
    size_of = ends - starts
    number = np.zeros(m, np.int64)
    for k in range(3):
        place = np.minimum(starts + k, n - 1)
        number = np.where((what == _DIGIT) & (k < size_of), number * 10 + value[place], number)
    large = _sums((what == _DIGIT) & ((size_of > 3) | (number > 255)))
    split = np.isin(code, [46, 58])

    def side(c: np.ndarray, open_marks: str) -> np.ndarray:
        alnum = (c >= 128) | (_CLASS[np.minimum(c, 127)] == _LETTER) | (_CLASS[np.minimum(c, 127)] == _DIGIT)
        free = (_CLASS[np.minimum(c, 127)] == _SPACE) & (c < 128) | np.isin(c, [ord(x) for x in open_marks])
        return np.where(free, 0, np.where(alnum, 1, 2))

    padded = np.concatenate(([32], chars, [32])).astype(np.int64)
    left, right = side(padded[starts], "([<\"'"), side(padded[ends + 1], ")]>\"'.,;:")
    one_back, two_back = np.maximum(here - 1, 0), np.maximum(here - 2, 0)
    told = np.where((here > 0) & (gap <= 2), word[one_back], _U(0))
    wide = (here > 1) & (gap <= 2) & (gap[one_back] <= 2) & (what[one_back] != _LETTER) & (what[two_back] == _LETTER)
    told = np.where(wide, word[two_back], told)
    firsts, sizes, found = [], [], []
    for length in range(1, MOST_TOKENS + 1):
        i = may[may + length <= m]
        j = i + length
        a, b = starts[i], ends[j - 1]
        d = digits[b] - digits[a]
        w = words[j] - words[i]
        at = ats[j] - ats[i]
        spoken = (marked[j] > marked[i]) | ((at_words[j] > at_words[i]) & (dot_words[j] > dot_words[i]))
        ok = (broken[j - 1] == broken[i]) & (b - a <= MOST_SPAN) & tail[j - 1] & (((d >= 4) & (w <= 2)) | (at > 0) | spoken)
        if not ok.any():
            continue
        i, j, a, b, d, w, at, spoken = (x[ok] for x in (i, j, a, b, d, w, at, spoken))
        sequence = opening[i] + (shape[j] - shape[i + 1]) * inverse[i]
        digit_groups = (groups[j] - groups[i]) * inverse[numbers[i]]
        blank = gaps[j] - gaps[i + 1]
        dot = dots[j] - dots[i]
        last = (digits[b] - 1) % 2
        luhn_sum = np.where(last == 0, check[0][b] - check[0][a], check[1][b] - check[1][a])
        card = (d >= 13) & (d <= 19)
        over = large[j] - large[i] > 0
        quad = np.full(len(i), length == 7)
        if length == 7:
            quad = (numbers[j] - numbers[i] == 4) & (what[i] == _DIGIT) & split[i + 1] & split[i + 3] & split[i + 5]
        address = ((at > 0) | (at_words[j] > at_words[i])) & ((dot > 0) | (dot_words[j] > dot_words[i]))
        edge = np.where(what[i] == _OTHER, code[i], 1) * 256 + np.where(what[j - 1] == _OTHER, code[j - 1], 1)
        values = [
            np.zeros(len(i), _U), np.minimum(d, 20), sequence, digit_groups, left[i] * 3 + right[j - 1], edge,
            np.minimum(dot, 5) * 8 + np.minimum(at, 2) * 2 + (d > 0), np.minimum(blank, 6),
            np.where(card, 1 + (luhn_sum % 10 == 0) + 2 * (w > 0), 0), np.where(quad, 1 + over, 0),
            np.where(address, 1 + (at > 0) + 2 * (blank > 0) + 4 * np.minimum(w // 2, 8), 0),
            told[i], np.minimum(w, 6) * 32 + length, told[i] ^ _mixed(np.minimum(d, 20).astype(_U)),
        ]
        keys = [_mixed(np.asarray(v).astype(_U) + _U(k * _ODD & 0xFFFFFFFFFFFFFFFF)) >> _U(64 - _WEIGHT_BITS) for k, v in enumerate(values, 1)]
        firsts.append(i)
        sizes.append(np.full(len(i), length))
        found.append(np.stack(keys, axis=1).astype(np.int32))
    if not firsts:
        return Candidates(starts, ends, none, none, np.zeros((0, _FEATURES), np.int32))
    return Candidates(starts, ends, np.concatenate(firsts), np.concatenate(sizes), np.concatenate(found))


def runs_of(first: np.ndarray, size: np.ndarray, tokens: int) -> list[tuple[int, int, int, int]]:
    """Tokens that segments cover, as runs: start, end, and the part of it whose spans count.

    A token that no segment covers is outside for certain, so runs are independent of each other. A run
    of over ``_PIECE`` tokens is read in pieces that overlap; a span counts where it begins.
    """
    cover = np.zeros(tokens + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False])).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        at = a
        while b - at > _PIECE:
            out.append((at, at + _PIECE, at if at == a else at + MOST_TOKENS, at + _PIECE - MOST_TOKENS))
            at += _PIECE - 2 * MOST_TOKENS
        out.append((at, b, at if at == a else at + MOST_TOKENS, b))
    return out


class Sums:
    """Forward and backward sums over the segments of runs of tokens, side by side.

    ``scores`` are by run, first token, number of tokens less one and kind; no segment is minus infinity.
    ``follow`` scores a kind after a kind, 0 being outside; outside after outside scores nothing, so
    tokens that fill up a shorter run change nothing.
    """

    def __init__(self, scores: np.ndarray, follow: np.ndarray) -> None:
        self.scores, self.follow = scores, follow
        self.exp = np.exp(np.clip(scores, -30.0, 30.0), where=scores > -np.inf, out=np.zeros_like(scores))
        self.step = np.exp(follow)
        self.runs, self.tokens, self.wide, self.kinds = scores.shape

    def _rescale(self, held: tuple[np.ndarray, ...], scale: np.ndarray, part: slice, by: np.ndarray) -> None:
        for x in held:
            x[:, part] /= by[:, None, None]
        scale[:, part] += np.log(by)[:, None]

    def forward(self) -> None:
        """``after``: sums of what ends at a place, by its kind; ``into``: the same and the step to the next kind."""
        r, n, wide, kinds = self.scores.shape
        pad = wide
        self.after = np.zeros((r, n + 1 + pad, kinds + 1))
        self.into = np.zeros((r, n + 1 + pad, kinds + 1))
        self.up = np.zeros((r, n + 1 + pad))
        self.after[:, pad, 0] = 1.0
        self.into[:, pad] = self.step[0]
        ending = np.zeros((r, n + 1, wide, kinds))  # by end; the longest first, as places are
        for length in range(1, min(wide, n) + 1):
            ending[:, length:, wide - length] = self.exp[:, : n - length + 1, length - 1]
        for j in range(1, n + 1):
            at = j + pad
            self.up[:, at] = self.up[:, at - 1]
            self.after[:, at, 0] = self.into[:, at - 1, 0]
            np.einsum("rlk,rlk->rk", self.into[:, at - wide : at, 1:], ending[:, j], out=self.after[:, at, 1:])
            self.into[:, at] = self.after[:, at] @ self.step
            if j % 8 == 0:
                self._rescale((self.after, self.into), self.up, slice(at - wide + 1, at + 1), self.after[:, at].max(axis=1))
        self.after, self.into, self.up = self.after[:, pad:], self.into[:, pad:], self.up[:, pad:]
        self.log_z = np.log(self.into[:, n, 0]) + self.up[:, n]

    def backward(self) -> None:
        """``rest``: sums of what may follow a place after each kind; ``onward``: sums of what begins there, by its kind."""
        r, n, wide, kinds = self.scores.shape
        self.rest = np.zeros((r, n + 1 + wide, kinds + 1))
        self.onward = np.zeros((r, n + 1 + wide, kinds + 1))
        self.down = np.zeros((r, n + 1 + wide))
        self.onward[:, n, 0] = 1.0
        self.rest[:, n] = self.step[:, 0]
        for j in range(n - 1, -1, -1):
            self.down[:, j] = self.down[:, j + 1]
            self.onward[:, j, 0] = self.rest[:, j + 1, 0]
            np.einsum("rlk,rlk->rk", self.rest[:, j + 1 : j + 1 + wide, 1:], self.exp[:, j], out=self.onward[:, j, 1:])
            self.rest[:, j] = self.onward[:, j] @ self.step.T
            if j % 8 == 0:
                self._rescale((self.rest, self.onward), self.down, slice(j, j + wide), self.rest[:, j].max(axis=1))

    def marginals(self, run: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The probability of each given segment, by kind."""
        log = self.up[run, first] + self.down[run, first + size] - self.log_z[run]
        own = self.into[run, first, 1:] * self.exp[run, first, size - 1] * self.rest[run, first + size, 1:]
        return np.exp(np.log(own, where=own > 0, out=np.full_like(own, -np.inf)) + log[:, None])

    def steps(self) -> np.ndarray:
        """How often each kind is expected to follow each."""
        n = self.tokens + 1
        scale = np.exp(self.up + self.down[:, :n] - self.log_z[:, None])
        return np.einsum("rja,rjb,rj->ab", self.after, self.onward[:, :n], scale) * self.step

    def best(self) -> list[list[tuple[int, int, int]]]:
        """The likeliest reading of each run: first token, end and kind of its entities."""
        r, n, wide, kinds = self.scores.shape
        into = np.full((r, n + 1 + wide, kinds + 1), -np.inf)
        into[:, wide] = self.follow[0]
        took = np.zeros((r, n + 1, kinds + 1), np.int8)
        came = np.zeros((r, n + 1, kinds + 1), np.int8)
        ending = np.full((r, n + 1, wide, kinds), -np.inf)
        for length in range(1, min(wide, n) + 1):
            ending[:, length:, wide - length] = self.scores[:, : n - length + 1, length - 1]
        own = np.empty((r, kinds + 1))
        for j in range(1, n + 1):
            at = j + wide
            own[:, 0] = into[:, at - 1, 0]
            through = into[:, at - wide : at, 1:] + ending[:, j]
            which = through.argmax(axis=1)
            own[:, 1:] = np.take_along_axis(through, which[:, None], 1)[:, 0]
            took[:, j, 0], took[:, j, 1:] = 1, wide - which
            onward = own[:, :, None] + self.follow[None]
            came[:, j] = onward.argmax(axis=1)
            into[:, at] = onward.max(axis=1)
        out = []
        for k in range(r):
            sizes, kinds_before = took[k].tolist(), came[k].tolist()
            j, kind, spans = n, kinds_before[n][0], []
            while j > 0:
                size = sizes[j][kind]
                if kind:
                    spans.append((j - size, j, kind))
                j -= size
                kind = kinds_before[j][kind] if j else 0
            out.append(spans[::-1])
        return out


def _batches(runs: list[tuple[int, int, int, int]], held: int = _HELD) -> Iterator[list[tuple[int, int, int, int]]]:
    """Runs of like length together, so that little is filled up."""
    batch: list[tuple[int, int, int, int]] = []
    for run in sorted(runs, key=lambda x: x[1] - x[0]):
        if batch and (len(batch) + 1) * (run[1] - run[0]) > held:
            yield batch
            batch = []
        batch.append(run)
    if batch:
        yield batch


class Field:
    """Weights of hashed features by kind, and of each kind after each."""

    def __init__(self, w: np.ndarray | None = None, follow: np.ndarray | None = None) -> None:
        self.w = np.zeros((1 << _WEIGHT_BITS, len(KINDS)), np.float32) if w is None else w
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if follow is None else follow

    def segment_scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(KINDS)))
        for column in bins.T:
            out += self.w[column]
        return out

    def read(self, found: Candidates) -> list[tuple[int, int, int, float]]:
        """Entities of the likeliest reading as start, end, kind and marginal, in characters."""
        if not len(found.first):
            return []
        by = np.lexsort((found.size, found.first))
        first, size, bins = found.first[by], found.size[by], found.bins[by]
        scores = self.segment_scores(bins)
        out = []
        for batch in _batches(runs_of(first, size, len(found.starts))):
            _, inner, where = _placed(batch, first, size)
            sums = _gridded(batch, where, scores[inner], self.follow)
            readings = sums.best()
            spans = [(k, i, j, kind) for k, r in enumerate(readings) for i, j, kind in r if batch[k][2] <= batch[k][0] + i < batch[k][3]]
            if not spans:
                continue
            sums.forward()
            sums.backward()
            k, i, j, kind = np.array(spans).T
            sure = sums.marginals(k, i, j - i)[np.arange(len(k)), kind - 1]
            begin = np.array([b[0] for b in batch])[k]
            out += zip(found.starts[begin + i].tolist(), found.ends[begin + j - 1].tolist(), kind.tolist(), sure.tolist(), strict=True)
        return sorted(out)


def _placed(batch: list[tuple[int, int, int, int]], first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The run of each segment in a batch of runs, the segment's place among all, and its place in a grid of scores."""
    run, inner = [], []
    for k, (a, b, _, _) in enumerate(batch):
        lo, hi = np.searchsorted(first, (a, b))
        mine = np.arange(lo, hi)
        mine = mine[first[mine] + size[mine] <= b]
        run.append(np.full(len(mine), k))
        inner.append(mine)
    run, inner = np.concatenate(run), np.concatenate(inner)
    begin = np.array([b[0] for b in batch])
    return run, inner, (run, first[inner] - begin[run], size[inner] - 1)


def _gridded(batch: list[tuple[int, int, int, int]], where: tuple, scores: np.ndarray, follow: np.ndarray) -> Sums:
    grid = np.full((len(batch), max(b - a for a, b, _, _ in batch), MOST_TOKENS, len(KINDS)), -np.inf)
    grid[where] = scores
    return Sums(grid, follow)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, merged, with ends between words."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        while a > 0 and not text[a - 1].isspace() and m.start() - a < 4 * AROUND:
            a -= 1
        while b < len(text) and not text[b].isspace() and b - m.end() < 4 * AROUND:
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _disguised(text: str, spans: list[tuple[str, int, int]], turn: int) -> tuple[str, list[tuple[str, int, int]]]:
    """A copy of the text with its entities written in ways that the patterns don't match."""
    out, at, moved = [], 0, []
    size = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        s = text[a:b]
        if kind == "email":
            ways = (s.replace("@", " at ").replace(".", " dot "), s.replace("@", " [at] ").replace(".", " [dot] "), s.replace("@", "(at)"))
        elif kind == "ip":
            ways = (s.replace(".", " . "), s.replace(".", ":"), s.replace(".", ". "))
        elif kind == "card":
            d = _digits(s)
            ways = (".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4)), "_".join(d[i : i + 4] for i in range(0, len(d), 4)))
        else:
            d = s.lstrip("+")
            ways = (d, re.sub(r"^[0-9]+ ", "", d), re.sub(r"[^0-9]+", "-", d))
        new = ways[turn % len(ways)]
        out += [text[at:a], new]
        size += a - at
        moved.append((kind, size, size + len(new)))
        size += len(new)
        at = b
    return "".join(out) + text[at:], moved


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rounds: int = 3) -> Field:
    """Fit by conditional likelihood on about ``sample`` documents that have base spans.

    They are drawn by a hash of the text among documents with a digit or ``@``; only the different
    stretches around triggers reach the driver, once for all copies. Of a document with over
    ``MOST_STRETCHES`` those with the least checksums are taken, and stretches of ``MOST_LETTERS`` or
    more are not learned from. Both bound the sample alone: spans are sought in all of every text.
    """
    text = text_or_empty(text_col)
    likely = docs.select(text.alias("t")).where(F.col("t").rlike("[0-9]{4}|@"))
    n = likely.count()
    if not n:
        return Field()
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for t in batch.column("t").to_pylist():
                short = {t[a:b] for a, b in windows(t) if b - a < MOST_LETTERS}
                parts += sorted(short, key=lambda p: (zlib.crc32(p.encode()), p))[:MOST_STRETCHES]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["t"])

    got = sorted(r[0] for r in likely.where(draw < min(1.0, sample / n)).mapInArrow(cut, "t string").distinct().collect())
    return fit(got, rounds)


_APART = "\n\n\n"


def fit(texts: list[str], rounds: int = 3, penalty: float = 0.05) -> Field:
    """The random field from stretches of text, their base spans and disguised copies of these.

    Each round is twenty steps along the gradient of the conditional log likelihood, scaled by feature.
    """
    parts, gold_spans, at = [], [], 0
    for k, t in enumerate(texts):
        spans = base_spans(t)
        for copy, marked in [(t, spans)] + ([_disguised(t, spans, k)] if spans else []):
            parts.append(copy)
            gold_spans += [(KINDS.index(kind), at + a, at + b) for kind, a, b in marked]
            at += len(copy) + len(_APART)
    found = candidates(_APART.join(parts))
    if not len(found.first):
        return Field()
    by = np.lexsort((found.size, found.first))
    first, size = found.first[by], found.size[by]
    used, compact = np.unique(found.bins[by], return_inverse=True)
    compact = compact.reshape(len(by), _FEATURES)
    key = first * (MOST_TOKENS + 1) + size
    observed = np.zeros((len(by), len(KINDS)))
    for kind, a, b in gold_spans:
        i, j = np.searchsorted(found.starts, a), np.searchsorted(found.ends, b)
        if i < len(found.starts) and j < len(found.ends) and found.starts[i] == a and found.ends[j] == b and 0 <= j - i < MOST_TOKENS:
            place = np.searchsorted(key, i * (MOST_TOKENS + 1) + j - i + 1)
            if place < len(key) and key[place] == i * (MOST_TOKENS + 1) + j - i + 1 and not observed[place].any():
                observed[place, kind] = 1.0
    batches = list(_batches(runs_of(first, size, len(found.starts))))
    placed = [_placed(batch, first, size) for batch in batches]
    chosen = np.flatnonzero(observed.any(axis=1))
    marks = {int(first[c]): (int(first[c] + size[c]), int(observed[c].argmax()) + 1) for c in chosen}
    seen_steps = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    for batch in batches:
        for a, b, _, _ in batch:
            place, kind = a, 0
            while place < b:
                end, new = marks.get(place, (place + 1, 0))
                if end > b:
                    end, new = place + 1, 0
                seen_steps[kind, new] += 1
                place, kind = end, new
            seen_steps[kind, 0] += 1
    w, follow = np.zeros((len(used), len(KINDS))), np.zeros_like(seen_steps)
    past, past_follow = np.full_like(w, 1e-8), np.full_like(follow, 1e-8)
    for _ in range(20 * rounds):
        scores = np.zeros((len(by), len(KINDS)))
        for column in compact.T:
            scores += w[column]
        expected, expected_steps = np.zeros_like(observed), np.zeros_like(follow)
        for batch, (run, inner, where) in zip(batches, placed, strict=True):
            sums = _gridded(batch, where, scores[inner], follow)
            sums.forward()
            sums.backward()
            expected[inner] = sums.marginals(run, where[1], size[inner])
            expected_steps += sums.steps()
        off = observed - expected
        grad = np.stack([np.bincount(compact.ravel(), np.repeat(off[:, k], _FEATURES), len(used)) for k in range(len(KINDS))], axis=1) - penalty * w
        step = seen_steps - expected_steps - penalty * follow
        step[0, 0] = 0.0
        past += grad**2
        past_follow += step**2
        w += 0.5 * grad / np.sqrt(past)
        follow += 0.2 * step / np.sqrt(past_follow)
    weights = np.zeros((1 << _WEIGHT_BITS, len(KINDS)), np.float32)
    weights[used] = w
    return Field(weights, follow)


def _blocks(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int, int, int]]]]:
    """Texts joined to blocks of bounded size, with each part's text, place in the block, place in the text and own range.

    A longer text is read in blocks that overlap; a span counts where it begins.
    """
    parts, places, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            end = min(at + _BLOCK, len(t))
            own = at + (_OVERLAP // 2 if at else 0), (end - _OVERLAP // 2 if end < len(t) else end)
            if size and size + end - at > _BLOCK:
                yield _APART.join(parts), places
                parts, places, size = [], [], 0
            parts.append(t[at:end])
            places.append((k, size, at, *own))
            size += end - at + len(_APART)
            if end == len(t):
                break
            at = end - _OVERLAP
    if parts:
        yield _APART.join(parts), places


def added_to(model: Field, texts: list[str], bases: list[list[tuple[str, int, int]]], sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """For each text the spans of the likeliest reading that are ``sure`` and touch no base span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken: dict[int, tuple[list[int], list[int]]] = {}
    for joined, places in _blocks(texts):
        begins = [p[1] for p in places]
        for a, b, kind, p in model.read(candidates(joined)):
            k, place, at, own, own_end = places[bisect.bisect_right(begins, a) - 1]
            s, e = a - place + at, b - place + at
            if p < sure or not own <= s < own_end:
                continue
            if k not in taken:
                taken[k] = _merged(bases[k])
            starts, ends = taken[k]
            before = bisect.bisect_left(starts, e) - 1
            if before < 0 or ends[before] <= s:
                out[k].append((KINDS[kind - 1], s, e))
    return out


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """The ranges that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if starts and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(model: Field, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the random field finds with a high marginal and that touch no base span."""
    return added_to(model, [text], [base])[0]


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """One row per input row: ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    ``n_*`` count the base spans of each kind and ``base_sha256`` digests them as
    ``kind:start:end`` by kind, then start, joined by commas (code points, end exclusive); ``spans`` has
    all spans, those that the random field adds among them, and ``n_added`` counts the added ones. A
    null text is empty, and a text without spans has empty ``spans``. Repeated rows give repeated
    results, null identifiers stay null, an empty table gives no rows, and other columns are not read.
    """
    if model is None:
        model = train(docs, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.follow))
    keyed = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            texts = [t.as_py() for t in batch.column("t")]
            bases = [base_spans(t) for t in texts]
            for base, more in zip(bases, added_to(field, texts, bases), strict=True):
                row = [sum(k == s[0] for s in base) for k in KINDS]
                row += [hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + more), len(more)]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["i", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = keyed.select("i").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")
    return keyed.mapInArrow(run, schema).withColumnRenamed("i", id_col)
