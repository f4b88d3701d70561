"""Toxicity by a learned lexicon, matched with spelling mistakes.

The lexicon's terms form a trie. Levenshtein automata of all terms run over the trie at once: the
pairs of trie node and distance row that a word's letters lead to are the states of one automaton,
made as they are met. A match counts by how its context window reads, as quotation or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, text_or_empty, written

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Marks of quotation and reporting words (fixed values).
QUOTES = "\"“”„«»‘‚‹›"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes reported stated sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
WINDOW = 5
#: Labelled rows of each class, on average, that lexicon and weights are fitted on.
SAMPLE_PER_CLASS = 4000
STEM_LENGTHS = (5, 6, 7, 8)
#: A term's log odds, in standard errors, at least.
CLEAR = 4.0
#: States that one automaton keeps before it starts anew.
_MOST_STATES = 50_000
#: The state that a word's first letters lead to is remembered: so many letters, and so many beginnings.
HEAD = 6
_MOST_HEADS = 200_000
#: Pieces without and with a match that a worker remembers, and letters of one at most.
_MOST_NONE, _MOST_HITS, _LONG = 150_000, 50_000, 40
#: Terms that a task sums in memory before it hands them on.
_MOST_SUMMED = 400_000


def errors_allowed(term: str) -> int:
    """Spelling mistakes forgiven in a term: none in short ones and in stems."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """Levenshtein automata of all terms on their trie, as one deterministic automaton made on demand."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]  # terms that end at a node, with the mistakes they allow
        self.stems: list[list[int]] = [[]]
        self.most: list[int] = [0]  # mistakes that any term below allows
        for k, term in enumerate(terms):
            at, allowed = 0, errors_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.stems.append([])
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], allowed)
            (self.stems[at].append(k) if term.endswith("*") else self.ends[at].append((k, allowed)))
        self._fresh()

    def _fresh(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[list[tuple[int, int]]] = []
        self.start = self._state(self._closed({0: 0}), ())
        self.dead = self._state({}, ())

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """Nodes reached also by leaving out letters of a term."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and at.get(child, 99) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def _state(self, at: dict[int, int], hit: tuple[int, ...]) -> int:
        key = (tuple(sorted(at.items())), hit)
        if key not in self.ids:
            self.ids[key] = len(self.rows)
            self.rows.append(key)
            self.steps.append({})
            best = dict.fromkeys(hit, 0)
            for node, e in key[0]:
                for k, allowed in self.ends[node]:
                    if e <= allowed and best.get(k, 99) > e:
                        best[k] = e
            self.found.append(list(best.items()))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        at, hit = self.rows[state]
        new: dict[int, int] = {}
        for node, e in at:
            child = self.children[node].get(c)
            if child is not None and new.get(child, 99) > e:
                new[child] = e
            if e + 1 <= self.most[node] and new.get(node, 99) > e + 1:  # a letter too many
                new[node] = e + 1
            for other in self.children[node].values():  # a wrong letter
                if other != child and e + 1 <= self.most[other] and new.get(other, 99) > e + 1:
                    new[other] = e + 1
        stems = {k for node, e in new.items() if e == 0 for k in self.stems[node]}
        return self._state(self._closed(new), tuple(sorted({*hit, *stems})) if stems else hit)

    def after(self, letters: str, state: int | None = None) -> int:
        """The state that letters lead to, from the start or another state; ``dead`` if no term goes on so."""
        state = self.start if state is None else state
        dead, steps = self.dead, self.steps
        for c in letters:
            after = steps[state].get(c)
            if after is None:
                after = steps[state][c] = self._step(state, c)
            if after == dead:
                return dead
            state = after
        return state

    def match(self, word: str) -> list[tuple[int, int]]:
        """Terms within their mistakes of the word, and the mistakes."""
        return self.found[self.after(word)]


@dataclass
class Model:
    terms: list[str]
    strength: np.ndarray  # of each term
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))

    def __post_init__(self) -> None:
        self._ready()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("terms", "strength", "weights", "centre", "spread")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self.automaton = Automaton(self.terms)
        self.heads: dict[str, int] = {}
        self.none: set[str] = set()
        self.hits: dict[str, list[tuple[str, float, int]]] = {}

    def _best(self, matches: list[tuple[int, int]]) -> tuple[float, int]:
        strength, e = max((self.strength[k] / (1 + e), -e) for k, e in matches)
        return float(strength), -e

    def _matched(self, word: str) -> tuple[float, int] | None:
        """The strength of the best term that matches the word, and the mistakes."""
        machine, head = self.automaton, word[:HEAD]
        state = self.heads.get(head)
        if state is None:
            if len(machine.rows) > _MOST_STATES:
                machine._fresh()
                self.heads.clear()
            state = self.heads[head] = machine.after(head)
        if state == machine.dead:
            return None
        matches = machine.found[machine.after(word[HEAD:], state)]
        return self._best(matches) if matches else None

    def _matches(self, pieces: set[str]) -> dict[str, list[tuple[str, float, int]]]:
        """For the pieces of a text that hold words which a term matches, these words with the term's strength and the mistakes.

        No word reaches across white space, so a piece has the same matches in every text and is remembered.
        """
        if len(self.heads) > _MOST_HEADS:
            self.heads.clear()
        if len(self.none) > _MOST_NONE:
            self.none.clear()
        if len(self.hits) > _MOST_HITS:
            self.hits.clear()
        none, hits, heads, dead = self.none, self.hits, self.heads, self.automaton.dead
        found = {}
        for p in pieces.difference(none):
            if heads.get(p[:HEAD]) == dead and p.isalnum():
                if len(p) <= _LONG:
                    none.add(p)
                continue
            known = hits.get(p)
            if known is None:
                known = [(w, *best) for w in ([p] if p.isalnum() else WORD.findall(p)) if (best := self._matched(w))]
                if len(p) <= _LONG:
                    if known:
                        hits[p] = known
                    else:
                        none.add(p)
            if known:
                found[p] = known
        return found

    def features(self, text: str) -> np.ndarray:
        """What the terms in a text add up to: exact, misspelled and quoted matches apart."""
        low = text.lower()
        pieces = low.split()
        return self.features_of(low, pieces, set(pieces))

    def features_of(self, low: str, pieces: list[str], distinct: set[str]) -> np.ndarray:
        """The same for a text in lower case that the caller has split at white space."""
        found = self._matches(distinct)
        exact = fuzzy = quoted = top = 0.0
        hits: list[tuple[str, float, int]] = []
        if found:
            hits = [hit for p in pieces if p in found for hit in found[p]]
            marks = [False] * len(hits)
            if any(q in low for q in QUOTES):
                words = WORD.findall(low)
                matched = {w for w, _, _ in hits}
                marks = quotation(low, words, [i for i, w in enumerate(words) if w in matched])
            for (_, strength, e), q in zip(hits, marks, strict=True):
                if q:
                    quoted += strength
                elif e:
                    fuzzy += strength
                else:
                    exact += strength
                    top = max(top, strength)
        n_pieces = len(pieces)
        size = np.sqrt(n_pieces + 20.0)
        return np.array([np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), top, 10 * exact / size, 10 * fuzzy / size, min(1.0, len(hits)), np.log1p(n_pieces)])

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        z = (self.features(text) - self.centre) / self.spread @ self.weights[:-1] + self.weights[-1]
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def quotation(text: str, words: list[str], hits: list[int]) -> list[bool]:
    """For each hit in the lower-cased text, whether its window of words stands in quotation marks or after a reporting word with one."""
    if not any(q in text for q in QUOTES):
        return [False] * len(hits)
    spans = [m.span() for m in WORD.finditer(text)]
    out = []
    for i in hits:
        a, b = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
        before, after = text[spans[a][0] : spans[i][0]], text[spans[i][1] : spans[b][1] + 2]
        opened, closed = any(q in before for q in QUOTES), any(q in after for q in QUOTES)
        out.append((opened and closed) or ((opened or closed) and any(w in REPORTING for w in words[a : b + 1])))
    return out


def held_out(id_column: Column) -> Column:
    """Rows that models never learn from: crc32 of the identifier as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class words and stems are, summed within the task."""
    sums: dict[str, list[int]] = {}

    def rows() -> pa.RecordBatch:
        found = [pa.array([v[k] for v in sums.values()], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), found[1], found[0]], names=["term", "a", "b"])

    for batch in batches:
        for y, t in zip(batch.column("y").to_pylist(), batch.column("t"), strict=True):
            words = {w for w in WORD.findall(t.as_py().lower()) if len(w) > 2}
            words |= {f"{w[:n]}*" for w in words for n in STEM_LENGTHS if len(w) > n}
            for w in words:
                have = sums.get(w)
                if have is None:
                    have = sums[w] = [0, 0]
                have[y] += 1
            if len(sums) > _MOST_SUMMED:
                yield rows()
                sums.clear()
    yield rows()


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 800) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression, classes alike, on standardised features."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - centre) / spread, np.ones((len(x), 1))])
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(z.shape[1])
    move, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ move, -30, 30)))
        new = move - 0.8 * (z.T @ ((p - y) * each) + 1e-3 * np.append(move[:-1], 0))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        move, w, t = new + (t - 1) / s * (new - w), new, s
    return w, centre, spread


def drawn_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> DataFrame | None:
    """About ``per_class`` labels of each class that aren't held out, ``i, y``, drawn by a hash of the identifier; None without both classes."""
    usable = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("long").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    sizes = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(F.lit(min(1.0, per_class / sizes[0])))
    return usable.where(draw < rate).groupBy("i").agg(F.max("y").alias("y"))


def lexicon(sample: DataFrame, clear_from: float = CLEAR) -> Model:
    """A model with terms alone from a stored sample ``y, t``, without any if a class is missing.

    Terms are words, and stems written ``stem*``, that are much more frequent in labelled texts than in
    others, by ``clear_from`` standard errors; all that pass are kept.
    """
    got = sample.groupBy("y").count().collect()
    n1, n0 = (next((r[1] for r in got if r[0] == k), 0) for k in (1, 0))
    if not n1 or not n0:
        return Model([], np.zeros(0))
    counts = sample.mapInArrow(_terms, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate1, rate0 = (F.col("a") + 0.5) / (n1 + 1.0), (F.col("b") + 0.5) / (n0 + 1.0)
    odds = F.log(rate1 / rate0)
    clear = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = (
        counts.where((F.col("a") >= 4) & (odds > 1.3))
        .select("term", odds.alias("o"), clear.alias("z"))
        .where(F.col("z") > clear_from)
        .orderBy(F.desc("z"), "term")
        .collect()  # bounded by the sample: each term is in four of its texts at least
    )
    return Model([r[0] for r in top], np.array([r[1] for r in top]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, clear_from: float = CLEAR) -> Model:
    """Learn the lexicon and the weights from a bounded sample of labelled rows that aren't held out.

    The table of drawn labels, bounded by ``per_class``, is broadcast to find their texts. The sample is
    stored, so documents are read once.
    """
    chosen = drawn_labels(labels, id_col=id_col, label_col=label_col, per_class=per_class)
    if chosen is None:
        return Model([], np.zeros(0))
    sample, sample_at = written(docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).join(F.broadcast(chosen), "i").select("y", "t"), "sample")
    model = lexicon(sample, clear_from)
    if sample.select("y").distinct().count() < 2:
        remove(docs.sparkSession, sample_at)
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.features(t.as_py()).tolist() for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sorted((r[0], tuple(r[1])) for r in sample.mapInArrow(run, "y long, x array<double>").collect())
    remove(docs.sparkSession, sample_at)
    model.weights, model.centre, model.spread = _fit(np.array([r[1] for r in rows]), np.array([float(r[0]) for r in rows]))
    return model


def toxicity(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, model: Model | None = None) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    A model is learned from ``labels`` unless given. ``score`` is from 0 to 1, ``predicted`` is 1 from
    ``threshold`` on. A null text is the empty text, which is scored too. Without labels of both classes
    all scores are 0. Repeated texts score alike; a null identifier is not held out; an empty table
    gives no rows; other columns are never read.
    """
    if model is None:
        model = train(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(scores, pa.float64())], names=["i", "score"])

    schema = keyed.select("i").schema.add("score", "double")
    return keyed.mapInArrow(run, schema).select(
        F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
