"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table predicts how likely each document is of each domain.
Projected gradient least squares then finds document rates, none negative, whose expected tokens by
domain match the targets. The rates follow from the history of the domains' errors, a few numbers a
round, so no state is kept by document. A rate depends on the posteriors alone, so the first rounds run on
a bounded table of tokens by rounded posteriors; the last ones sum over all documents, exactly.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import token_counts, toxicity
from .common import Held, give_back, remove, text_or_empty, written

#: Labelled rows of each domain, on average, that the classifier is fitted on.
SAMPLE_PER_DOMAIN = 700
#: How clear the lexicon's terms are, in standard errors; the classifier has other features too.
TERMS_CLEAR = 5.0
#: Rounds on the table of rounded posteriors at most, and over all documents.
ROUNDS = 100
EXACT_ROUNDS = 2
#: Rows of the table of rounded posteriors, at most.
MOST_CELLS = 50_000
#: Words whose token counts one Python worker remembers.
WORDS_KEPT = 200_000
#: Weight of staying near rate 1, which makes the rates unique.
RIDGE = 2e-3
#: The fit ends early when no domain's share is off by more than the ridge allows.
TOLERANCE = 1e-4
#: A share that is off by more than this is told in a warning.
FAR = 0.01


def domain_name(quality: Column, toxic: Column) -> Column:
    return F.concat(F.lit("quality"), quality.cast("string"), F.lit("_toxic"), toxic.cast("string"))


_CLASSES = np.array([5 if b > 127 else 0 if chr(b).isupper() else 1 if chr(b).islower() else 2 if chr(b).isdigit() else 3 if chr(b).isspace() else 4 for b in range(256)], np.uint8)


def _inputs(text: str, terms: toxicity.Model) -> tuple[np.ndarray, int]:
    """Figures of the whole text: kinds of letters, words and their repetition, and matches of a lexicon; also its words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    low = text.lower()
    words = low.split()
    n = max(len(words), 1)
    different = set(words)
    distinct = len(different)
    shares = np.bincount(_CLASSES[data], minlength=6) / max(len(data), 1)
    figures = [distinct / n, np.log1p(n), np.log1p(distinct), min(len(data) / n, 40.0), 1.0 / n, float(shares[0] > 0.4), float(shares[4] > 0.12), text.count("\n") / n]
    return np.concatenate((shares, figures, terms.features_of(low, words, different), [1.0])), len(words)


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    terms: toxicity.Model

    def posterior(self, text: str) -> tuple[np.ndarray, int]:
        """How likely the text is of each domain, and its words."""
        if len(self.domains) < 2:
            return np.ones(len(self.domains)), len(text.split())
        x, n = _inputs(text, self.terms)
        z = (x - self.centre) / self.spread @ self.weights
        p = np.exp(z - z.max())
        return p / p.sum(), n


def fit_classifier(x: np.ndarray, y: list[str], terms: toxicity.Model, rounds: int = 500, penalty: float = 1e-4) -> Classifier:
    """Softmax regression with rows counted as they are, so that posteriors keep the labels' shares."""
    domains = sorted(set(y))
    own = np.array([domains.index(v) for v in y], int)
    target = np.eye(max(len(domains), 1))[own] if len(y) else np.zeros((0, 1))
    centre, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    centre[-1:], spread[-1:] = 0.0, 1.0
    x = (x - centre) / spread
    w = np.zeros((x.shape[1], max(len(domains), 1)))
    move, t = w.copy(), 1.0
    for _ in range(rounds if len(domains) > 1 else 0):
        z = x @ move
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = move - 0.15 * (x.T @ (p - target) / len(x) + penalty * move)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        move, w, t = new + (t - 1) / s * (new - w), new, s
    return Classifier(domains, w, centre, spread, terms)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """Fit on a bounded sample of labelled rows; only their features reach the driver.

    At most about ``per_domain`` times the number of domains are drawn by a hash of the identifier, and
    the rows that the lexicon is learned from beside them; the table of drawn labels, bounded by both, is
    broadcast to find the texts in one pass over the documents.
    """
    spark = docs.sparkSession
    table = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col(id_col).alias("i"), domain_name(F.col("quality"), F.col("toxic")).alias("d"))
    table = table.where(F.col("i").isNotNull()).groupBy("i").agg(F.min("d").alias("d"))
    sizes = {r[0]: r[1] for r in table.groupBy("d").count().collect()}
    total = sum(sizes.values())
    draw = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    chosen = table.where(draw < min(1.0, per_domain * max(len(sizes), 1) / max(total, 1)))
    of_terms = toxicity.drawn_labels(labels, id_col=id_col)
    both = chosen.withColumn("y", F.lit(None).cast("long")) if of_terms is None else chosen.join(of_terms, "i", "full")
    texts = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"))
    sample, sample_at = written(texts.join(F.broadcast(both), "i").select("d", "y", "t"), "sample")
    terms = toxicity.lexicon(sample.where("y IS NOT NULL").select("y", "t"), TERMS_CLEAR)
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_inputs(t.as_py(), shared.value)[0].tobytes() for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(rows, pa.binary())], names=["d", "x"])

    rows = sample.where("d IS NOT NULL").select("d", "t").mapInArrow(run, "d string, x binary").collect()
    remove(spark, sample_at)
    got = sorted((r[0], bytes(r[1])) for r in rows)
    x = np.frombuffer(b"".join(r[1] for r in got), np.float64).reshape(len(got), len(_inputs("", terms)[0]))
    return fit_classifier(x, [r[0] for r in got], terms)


@dataclass
class Rates:
    """The rates of documents, as the history of the domains' errors that leads to them."""

    errors: list[np.ndarray] = field(default_factory=list)
    ridge: float = RIDGE
    #: How far the worst domain's share is from its target, over all documents; none if nothing was fitted.
    off: float | None = None

    def of(self, p: np.ndarray, trial: bool = False) -> np.ndarray:
        """Rates for rows of posteriors; ``trial`` gives the place where the next error is measured."""
        rate = np.ones(len(p))
        move = rate.copy()
        t = 1.0
        step = 1.0 / (1.0 + self.ridge)
        for e in self.errors:
            new = np.maximum(0.0, move - step * (p @ e + self.ridge * (move - 1.0)))
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            move, rate, t = new + (t - 1) / s * (new - rate), new, s
        return move if trial else rate


def _posteriors(shared, spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        tokens = token_counts.counter(spec, WORDS_KEPT) if spec else None
        for batch in batches:
            flat, words = [], []

            def texts() -> Iterator[str]:
                for t in batch.column("t"):
                    text = t.as_py()
                    p, n = c.posterior(text)
                    flat.append(p)
                    words.append(n)
                    yield text

            counts = tokens.counts(texts()) if tokens else list(texts()) and words
            lists = pa.array([p.tolist() for p in flat], pa.list_(pa.float64()))
            others = [c for c in batch.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(counts, pa.int64()), lists], names=[*others, "n", "p"])
        give_back()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _steps(width: int) -> int:
    """How finely posteriors of so many domains are rounded down, so that there are at most ``MOST_CELLS`` different ones.

    The rounded parts sum to the whole or to one of the ``width - 1`` numbers of steps below it.
    """
    steps = 1
    while steps < 256 and width * comb(steps + width, width - 1) <= MOST_CELLS:
        steps += 1
    return steps


def _cells(members: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean posteriors of the documents whose posteriors are alike after rounding; a bounded table."""
    steps = _steps(width)
    cell = F.transform("p", lambda x: F.floor(x * steps).cast("int"))
    sums = [F.sum(F.col("n") * F.col("p")[d]).alias(f"s{d}") for d in range(width)]
    got = members.where("n > 0").groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), *sums).drop("cell").collect()
    table = np.array([list(r) for r in got], float).reshape(len(got), width + 1)
    table = table[np.lexsort(table.T)]
    return table[:, 0], table[:, 1:] / table[:, :1]


def solve(members: DataFrame, targets: np.ndarray, *, rounds: int = ROUNDS, exact_rounds: int = EXACT_ROUNDS, ridge: float = RIDGE) -> Rates:
    """Fit rates to ``n`` tokens and posteriors ``p`` of each row, so that domains' shares meet ``targets``.

    Each round sums tokens by domain at the current rates: first over rounded posteriors, until the error
    settles, and then ``exact_rounds`` times over all rows. Tokens and rates are scaled by the total, and a
    row's gradient by its tokens, so one step size suits every table. ``off`` of the result is measured
    over all rows at the end; a warning says so where targets can't be met.
    """
    rates = Rates(ridge=ridge)
    width = len(targets)
    total = members.agg(F.sum("n")).first()[0] or 0
    if not total or not width:
        return rates

    def sums(now: Rates, trial: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    p = _matrix(batch.column("p"))
                    have += (now.of(p, trial=trial) * batch.column("n").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(have)], names=["d", "v"])

        return run

    def measured(trial: bool) -> np.ndarray:
        got = members.select("n", "p").mapInArrow(sums(rates, trial), "d int, v double").groupBy("d").agg(F.sum("v")).collect()
        have = np.zeros(width)
        for d, v in got:
            have[d] = v
        return have / total - targets

    n, p = _cells(members, width)
    for _ in range(rounds):
        rates.errors.append((rates.of(p, trial=True) * n) @ p / total - targets)
        if len(rates.errors) > 3 and max(np.abs(rates.errors[-1] - e).max() for e in rates.errors[-3:-1]) < TOLERANCE / 10:
            break
    for _ in range(exact_rounds):
        rates.errors.append(measured(trial=True))
    rates.off = float(np.abs(measured(trial=False)).max())
    if rates.off > FAR:
        logging.getLogger(__name__).warning("the worst domain's share is %.4f off its target", rates.off)
    return rates


@dataclass
class Mixture:
    classifier: Classifier
    rates: Rates


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float], kept: list[Column], *, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Mixture, DataFrame]:
    """Classifier and rates; also a stored table of all documents with the columns ``kept``, ``n`` and ``p``.

    Texts are scanned once for it, and the rounds of the fit read only its columns ``n`` and ``p``.

    ``targets`` weighs the domains; those it doesn't name get no weight, and names that no label has
    are left out. Weights are scaled to sum to one. ``n`` counts the tokens of ``tokenizer_file``, as the
    token counts of this package do, or without one what white space separates.
    """
    classifier = train(docs, labels, id_col=id_col, text_col=text_col)
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in classifier.domains])
    weights = weights / weights.sum() if weights.sum() else np.full(len(weights), 1.0 / max(len(weights), 1))
    keyed = docs.select(*kept, text_or_empty(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = keyed.drop("t").schema.add("n", "long").add("p", T.ArrayType(T.DoubleType()))
    spec = None
    if tokenizer_file:
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = docs.sparkSession.sparkContext.broadcast(Held(f.read()))
    members, _ = written(keyed.mapInArrow(_posteriors(shared, spec), schema), "members")
    return Mixture(classifier, solve(members, weights)), members


def _copies(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    whole = np.floor(rate)
    return (whole + (draw < rate - whole)).astype(np.int64)


def _draw(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on the row alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(42)), F.lit(1 << 30)) / float(1 << 30)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_tokens, domain, rate, copies, posteriors, target_error``.

    ``n_tokens`` counts the tokens of ``tokenizer_file``, or without one what white space separates;
    ``posteriors`` follow the sorted domain names, ``domain`` is the likeliest, ``rate`` is how often the
    document is used on average and ``copies`` a draw with that mean from a hash of the identifier.
    ``target_error`` is alike in all rows: how far the worst domain's share of expected tokens is from its
    target; it is null where nothing could be fitted. A null text is empty and has no tokens; it moves no
    total. Repeated rows have equal rates and draws. Without labels every rate is 1 and ``domain`` null.
    An empty table gives no rows; other columns are not read.
    """
    mixture, members = fit_mixture(docs, labels, targets, [F.col(id_col).alias("i")], tokenizer_file=tokenizer_file, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = _matrix(batch.column("p")) if m.classifier.domains else np.zeros((batch.num_rows, 0))
            rate = m.rates.of(p)
            names = pa.array([m.classifier.domains[k] for k in p.argmax(1)] if p.shape[1] else [None] * batch.num_rows, pa.string())
            copies = _copies(rate, batch.column("u").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("n"), names, pa.array(rate), pa.array(copies), batch.column("p")], names=["i", "n_tokens", "domain", "rate", "copies", "posteriors"])

    schema = members.select("i").schema.add("n_tokens", "long").add("domain", "string").add("rate", "double").add("copies", "long").add("posteriors", T.ArrayType(T.DoubleType()))
    drawn = members.select("i", "n", "p", _draw(F.col("i").cast("string")).alias("u"))
    off = F.lit(mixture.rates.off).cast("double").alias("target_error")
    return drawn.mapInArrow(run, schema).select(F.col("i").alias(id_col), "n_tokens", "domain", "rate", "copies", "posteriors", off)


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, all columns unchanged.

    Rows are stored beside their posteriors while rates are fitted; texts are neither scanned again nor
    shuffled.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _draw(F.col(id_col).cast("string")).alias("u")]
    mixture, members = fit_mixture(docs, labels, targets, kept, tokenizer_file=tokenizer_file, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                copies = _copies(m.rates.of(_matrix(batch.column("p"))), batch.column("u").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(copies)], names=["row", "copies"])

    schema = members.select("row").schema.add("copies", "long")
    drawn = members.select("row", "p", "u").mapInArrow(run, schema).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
