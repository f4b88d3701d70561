"""Language identification in two steps.

A linear model predicts the language family; within the family, one linear support vector machine for
each pair of languages votes. Both read the same hashed byte n-grams of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty

#: Families of languages by code (fixed values); a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
BINS = 1 << 12
#: Labelled rows per language, on average, that the models are fitted on.
SAMPLE_PER_LANGUAGE = 500
#: Rows that the models are fitted on, on average, however many languages there are.
MOST_ROWS = 10_000
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L); number signs such as one half are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), f"own:{language}")


def ngram_bins(text: str) -> Iterator[np.ndarray]:
    """Bins of the byte bigrams and trigrams of the lower-cased text, in chunks that cover all of it."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, max(len(data) - 2, 1), _CHUNK):
        part = data[at : at + _CHUNK + 2].astype(np.uint32)
        if len(part) < 3:
            continue
        pair = part[:-1] * np.uint32(2654435761) ^ part[1:] * np.uint32(40503)
        three = pair[:-1] * np.uint32(97) + part[2:] * np.uint32(2246822519)
        yield np.concatenate((pair[:-1] * np.uint32(0x9E3779B1) >> np.uint32(20), (three ^ three >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(20)))


def features(text: str) -> np.ndarray:
    """Shares of the bins, scaled so that long and short texts compare."""
    counts = np.zeros(BINS)
    for bins in ngram_bins(text):
        counts += np.bincount(bins, minlength=BINS)
    return np.sqrt(counts / max(counts.sum(), 1.0))


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    family_w: np.ndarray = field(default_factory=lambda: np.zeros((BINS + 1, 0)))
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.families:
            return "und", 0.0
        x = np.append(features(text), 1.0)
        z = x @ self.family_w
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        family = self.families[best]
        languages = self.languages[family]
        if len(languages) == 1:
            return languages[0], float(p[best])
        votes = np.zeros(len(languages))
        sure = np.ones(len(languages))
        for i, j, w in self.pairs[family]:
            margin = float(x @ w)
            q = 1.0 / (1.0 + np.exp(-np.clip(3.0 * margin, -30, 30)))
            votes[i] += q
            votes[j] += 1.0 - q
            sure[i], sure[j] = min(sure[i], q), min(sure[j], 1.0 - q)
        k = int(votes.argmax())
        return languages[k], float(min(1.0, max(0.0, p[best] * sure[k])))


def _descend(grad, w: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent."""
    y, t = w.copy(), 1.0
    for _ in range(rounds):
        new = y - step * grad(y)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - w)
        w, t = new, s
    return w


def fit(x: np.ndarray, y: list[str], rounds: int = 150, penalty: float = 1e-4) -> Model:
    """Families by softmax, pairs of languages by support vector machines with squared hinge loss."""
    languages = sorted(set(y))
    families = sorted({family_of(v) for v in languages})
    model = Model(families, {f: [v for v in languages if family_of(v) == f] for f in families})
    if not languages:
        return model
    x = np.hstack([np.asarray(x, np.float32), np.ones((len(x), 1), np.float32)])
    # rows have length sqrt(2); classes count alike
    own = np.array([families.index(family_of(v)) for v in y])
    target = np.eye(len(families))[own]
    share = 1.0 / (len(families) * np.bincount(own, minlength=len(families))[own])

    def softmax(w: np.ndarray) -> np.ndarray:
        z = x @ w.astype(np.float32)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return x.T @ ((p - target) * share[:, None]).astype(np.float32) + penalty * w

    model.family_w = _descend(softmax, np.zeros((BINS + 1, len(families))), 1.0, rounds)
    lang = np.array([languages.index(v) for v in y])
    for f in families:
        mine = model.languages[f]
        model.pairs[f] = []
        for i in range(len(mine)):
            for j in range(i + 1, len(mine)):
                a, b = lang == languages.index(mine[i]), lang == languages.index(mine[j])
                rows = x[a | b]
                sign = np.where(a[a | b], 1.0, -1.0)
                each = np.where(sign > 0, 0.5 / a.sum(), 0.5 / b.sum())

                def hinge(w: np.ndarray, rows=rows, sign=sign, each=each) -> np.ndarray:
                    short = np.maximum(0.0, 1.0 - sign * (rows @ w.astype(np.float32)))
                    return rows.T @ (-2.0 * short * sign * each).astype(np.float32) + penalty * w

                model.pairs[f].append((i, j, _descend(hinge, np.zeros(BINS + 1), 0.25, rounds)))
    return model


def held_out(id_column: Column) -> Column:
    """Rows that models never learn from: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    Of each language about ``per_language`` rows are taken, fewer if there are so many languages that
    ``MOST_ROWS`` would be passed, chosen by a hash of identifier and text's length; their features (not
    their texts) reach the driver, 16 kB a row.
    """
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    if not counts:
        return fit(np.zeros((0, BINS)), [])
    per_language = min(per_language, MOST_ROWS / len(counts))
    limit = F.lit(None)
    for language, n in counts.items():
        limit = F.when(F.col(label_col) == language, F.lit(min(1.0, per_language / n))).otherwise(limit)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < limit).select(F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).astype(np.float32).tobytes() if has_letter(t.as_py()) else None for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.binary())], names=["y", "x"])

    got = [r for r in sample.mapInArrow(run, "y string, x binary").collect() if r[1]]
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.float32).reshape(len(got), BINS) if got else np.zeros((0, BINS))
    languages = [r[0] for r in got]
    del got
    model = fit(x, languages)
    del x
    give_back()
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["_row", "_lang", "_score"],
            )

    return run


def predicted(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` as struct ``_row``, with ``_lang`` and ``_score`` of each whole text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), text_or_empty(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = packed.select("_row").schema.add("_lang", "string").add("_score", "double")
    return packed.mapInArrow(_predict(shared), schema)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score``.

    A model is fitted first unless given. ``lang_pred`` is a learned language, or ``und`` with score 0
    where the text is null or has no letter, or nothing could be learned. ``score`` is the product of
    the family's probability and the least sure vote for the language. Labels, identifiers and other
    columns never enter a prediction, so repeated texts get equal ones; a null identifier is not held
    out. An empty table gives no rows.
    """
    if model is None:
        model = train(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    found = predicted(docs, model, [id_col], text_col)
    ident = F.col(f"_row.`{id_col}`")
    return found.select(ident.alias(id_col), held_out(ident).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def known_language_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with ``label_col`` set to it; ``und`` rows go.

    Other columns are unchanged.
    """
    if model is None:
        model = train(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    found = predicted(docs, model, docs.columns, text_col).where("_lang <> 'und'")
    return found.select(*[(F.col("_lang") if c == label_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
