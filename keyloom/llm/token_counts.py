"""Token counts through a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file. Counts are joined
from a stored cache; only distinct texts that the cache lacks are encoded, and they are appended to it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, exists, fresh_path, text_or_empty, written

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Words whose counts one Python worker remembers.
WORDS_KEPT = 600_000
#: Words are looked up together for texts of so many letters, and one text more.
_TOGETHER = 1 << 20
#: Stands before a word that no space precedes; texts that hold it go to the library.
_FIRST = "\x00"


class _Counter:
    """Counts of whole texts, equal to the library's, from counts of words.

    Byte-level BPE splits a text into pieces before merging, and no piece has white space after other
    characters. So a text may be cut before each white space that follows another character, and the
    counts of the parts add up. Where white space meets white space the line goes to the library
    whole, and so does a text that holds a special token's string. The words of many texts are
    encoded as a dictionary, so that each different one is looked up once.
    """

    def __init__(self, spec: str, kept: int = WORDS_KEPT) -> None:
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = pa.array([], pa.large_string())
        self.known_counts = np.zeros(0, np.int64)
        self.newline = self._whole("\n")
        self.splits = self._cuts_are_safe()
        self.ranks = self._merge_ranks(spec) if self.splits else None

    def _whole(self, text: str) -> int:
        return len(self.lib.encode(text, add_special_tokens=False).ids)

    def _cuts_are_safe(self) -> bool:
        kind = str(self.lib.pre_tokenizer)
        return "ByteLevel" in kind and "use_regex=True" in kind and "add_prefix_space=False" in kind and self.lib.normalizer is None

    def _merge_ranks(self, spec: str):
        """The file's own merge table as byte ranks, which are merged several times faster; None if its ids aren't in merge order."""
        import tiktoken

        model = json.loads(spec)["model"]
        letters = {c: b for b, c in _byte_letters().items()}
        ranks, base = {}, len(letters)
        for token, i in model["vocab"].items():
            if all(c in letters for c in token) and i < base + len(model["merges"]):
                ranks[bytes(letters[c] for c in token)] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != base + i for i, (a, b) in enumerate(pairs)) or len(ranks) != base + len(pairs):
            return None
        self.lengths = np.zeros(len(ranks), np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        return tiktoken.Encoding("merges", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def _counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of words as the texts have them: after a space, or marked as the first of a line."""
        out = np.zeros(len(words), np.int64)
        first = pc.starts_with(words, _FIRST).to_numpy(zero_copy_only=False)
        for at, lead, between in ((np.flatnonzero(~first), " ", " "), (np.flatnonzero(first), "", "\n")):
            own = words.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
            if not lead:
                own = [w[1:] for w in own]
            if self.ranks is None:
                plain = np.zeros(len(own), bool)
            elif _LATIN.fullmatch(between + between.join(own)):
                out[at] = self._merged(own, between)
                continue
            else:
                plain = np.fromiter((_LATIN.fullmatch(w) is not None for w in own), bool, len(own))
            out[at[plain]] = self._merged([own[i] for i in np.flatnonzero(plain)], between)
            other = [lead + own[i] for i in np.flatnonzero(~plain)]
            out[at[~plain]] = [len(e.ids) for e in self.lib.encode_batch_fast(other, add_special_tokens=False)]
        return out

    def _merged(self, words: list[str], between: str) -> np.ndarray:
        """Tokens of words after a space or line end, from one line of all of them: a token is the word's where its bytes start."""
        if not words:
            return np.zeros(0, np.int64)
        line = between + between.join(words)
        ids = np.array(self.ranks.encode_ordinary(line), np.int64)
        starts = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        cuts = np.flatnonzero(np.frombuffer(line.encode(), np.uint8) == ord(between))  # no word holds one
        return np.diff(np.searchsorted(starts, cuts), append=len(ids)) - (self.newline if between == "\n" else 0)

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def counts(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text; no more texts are held at once than are looked up together."""
        out: list[int] = []
        held: list[tuple[int, str]] = []
        size = 0
        for text in texts:
            out.append(0)
            if not self.splits or _FIRST in text or (self.special and self.special.search(text)) or _SPACES.search(text) or text != text.strip():
                out[-1] = self._whole(text)
                continue
            held.append((len(out) - 1, text))
            size += len(text)
            if size > _TOGETHER:
                self._fill(out, held)
                held, size = [], 0
        if held:
            self._fill(out, held)
        return out

    def _fill(self, out: list[int], held: list[tuple[int, str]]) -> None:
        lines = pa.array([_FIRST + text.replace("\n", f" {_FIRST}") for _, text in held], pa.large_string())
        pieces = pc.split_pattern(lines, " ")
        codes = pieces.flatten().dictionary_encode()
        where = codes.indices.to_numpy()
        counts = self._look_up(codes.dictionary, where)
        sums = np.add.reduceat(counts[where], pieces.offsets.to_numpy()[:-1])
        for (i, text), n in zip(held, sums.tolist(), strict=True):
            out[i] = n + text.count("\n") * self.newline

    def _look_up(self, words: pa.Array, where: np.ndarray) -> np.ndarray:
        """Tokens of different words. Those that come only once among the texts aren't remembered."""
        place = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy()
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.known_counts[place]
        counts = np.append(self.known_counts, 0)[place]
        counts[new] = self._counts(words.take(pa.array(new)))
        again = new[np.bincount(where, minlength=len(words))[new] > 1]
        if len(self.known) + len(again) > self.kept:
            self.known, self.known_counts = self.known[:0], self.known_counts[:0]
        if len(again) <= self.kept:
            self.known = pa.concat_arrays([self.known, words.take(pa.array(again))])
            self.known_counts = np.append(self.known_counts, counts[again])
        return counts


def counter(spec, kept: int = WORDS_KEPT) -> _Counter:
    """This worker's counter for a broadcast tokenizer."""
    return spec.value.get(lambda content: _Counter(content, kept))


#: How the byte-level pre-tokenizer splits a text (fixed value).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that all versions of Unicode class alike; words with others go to the library.
_LATIN = re.compile("[\x01-\u024f]*")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: White space beside white space: there the cuts would not be the library's.
_SPACES = re.compile(r"\s\s")


def _encode(spec, version: str):
    schema = pa.schema([("tokenizer", pa.string()), ("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(spec)
        for batch in batches:
            counts = known.counts(t.as_py() for t in batch.column("_t"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column("_d"), pa.array(counts, pa.int64())],
                schema=schema,
            )

    return run


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored counts for one tokenizer version, one row per digest even if two runs stored it."""
    if not exists(spark, cache_path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit``.

    Counts are those of the library for the whole text without begin, end or added special tokens. A
    null text is the empty text with no tokens. Repeated rows give repeated results from one encoding;
    null identifiers are returned as they are. An empty table gives no rows. Other columns are not read.

    ``cache_path`` names the stored cache, made if missing and appended to; without one, a new cache
    serves this call. The tokenizer's file is sent to the executors (its size is the vocabulary's).
    The text is shuffled once, by digest, after the copies within each task are merged; the widely
    shared texts therefore cost one row per task. Counts are joined from a stored table, so adaptive
    execution can split the rows of a digest that very many share.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read()
    version = hashlib.sha256(content.encode()).hexdigest()
    own = cache_path is None
    cache_path = cache_path or fresh_path(spark, "token-cache")
    text = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("_n"), F.unhex(F.sha2(text, 256)).alias("_d"), text.alias("_t")
    )
    known = read_cache(spark, cache_path, version)
    misses = keyed.groupBy("_d").agg(F.first("_t").alias("_t")).join(known, F.col("_d") == F.col("digest"), "left_anti")
    spec = spark.sparkContext.broadcast(Held(content))
    misses.mapInArrow(_encode(spec, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # stored counts without a sum above them: Spark can split a digest that very many rows share
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).select("digest", "n_tokens") if own else written(read_cache(spark, cache_path, version), "counts")[0]
    return keyed.select("_id", "_n", "_d").join(counts, F.col("_d") == F.col("digest")).select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
