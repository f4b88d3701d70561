"""A store of segments: a folder with one Parquet folder per appended batch and a manifest.

A segment is written beside the store and moved in whole, then named in a new manifest, so a reader
sees all of a batch or none. The manifest's name carries its number and the highest one counts. Each
segment also carries a description of itself, from which a lost manifest can be made again.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import REVERSED, SEGMENT, lookup, matched_frames, predicate, with_reversed
from ..operators.ordered import FILE, ROW, file_number
from ..operators.rows import frame, text_line
from .scratch import file_system

FORMAT_VERSION = 1
#: A segment's description; names that begin with an underscore are skipped by table readers.
ABOUT = "_segment.json"
_LINES = T.StructType([T.StructField("line", T.StringType())])


class StoreError(ValueError):
    """The folder is no store, is damaged, or has another format version."""


@dataclass(frozen=True)
class Repaired:
    kept: int
    dropped: int
    changed: bool


class Store:
    """Rows under text keys, appended in segments."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self._root = file_system(spark, self.path)

    # manifest

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        if not self.fs.exists(self._root):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._root))

    def _manifests(self) -> list[str]:
        return [n for n in self._names() if n.startswith("manifest-")]

    def exists(self) -> bool:
        """Whether there is a manifest, sound or not."""
        return bool(self._manifests())

    def _json(self, name: str) -> dict:
        stream = self.fs.open(self._at(name))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except (ValueError, Py4JError) as e:  # a wrong checksum is raised by the file system
            raise StoreError(f"damaged {name} at {self.path}") from e
        finally:
            stream.close()
        if not isinstance(found, dict):
            raise StoreError(f"damaged {name} at {self.path}")
        if found.get("format_version") != FORMAT_VERSION:
            raise _OtherVersion(f"format version {found.get('format_version')} is not {FORMAT_VERSION}")
        return found

    def _manifest(self) -> dict:
        names = self._manifests()
        if not names:
            raise StoreError(f"no store at {self.path}")
        return self._json(names[-1]) | {"number": int(names[-1].split("-")[1])}

    def _write(self, name: str, content: dict) -> None:
        stream = self.fs.create(self._at(name), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def _commit(self, manifest: dict) -> None:
        manifest = dict(manifest)
        number = manifest.pop("number", 0) + 1
        part, final = f"_{uuid.uuid4().hex}", self._at(f"manifest-{number:010d}")
        self._write(part, manifest)
        if self.fs.exists(final) or not self.fs.rename(self._at(part), final):
            self.fs.delete(self._at(part), False)
            raise StoreError("another writer was faster; append again")

    # writing

    def _segment(self, rows: DataFrame, manifest: dict, segment: int, rejected: DataFrame | None = None, replaces: list[str] | None = None) -> dict:
        """Write rows sorted by the first key, with reversed keys, and their rejected lines, and move them in whole."""
        keys = manifest["keys"]
        missing = [k for k in keys if k not in rows.columns]
        if not keys or missing:
            raise ValueError(f"no key column {missing or ''}")
        taken = {SEGMENT, FILE, ROW} & set(rows.columns)
        if taken:
            raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")
        for k in keys:
            rows = with_reversed(rows.withColumn(k, F.coalesce(F.col(k), F.lit(""))), k)
        ident = uuid.uuid4().hex
        entry: dict = {"id": segment, "name": f"segment-{ident}", "rejected": []}
        if rejected is not None:
            entry["rejected"] = [f"rejected-{ident}"]
            rejected.select(F.col(rejected.columns[0]).cast("string").alias("line")).write.parquet(f"{self.path}/rejected-{ident}")
        part = f"_{entry['name']}"
        rows.repartitionByRange(keys[0]).sortWithinPartitions(*keys).write.parquet(f"{self.path}/{part}")
        about = {k: manifest[k] for k in ("format_version", "keys", "schema")}
        self._write(f"{part}/{ABOUT}", about | {"entry": entry, "number": manifest.get("number", 0) + 1, "replaces": replaces or [], "batches": manifest.get("batches", {})})
        if not self.fs.rename(self._at(part), self._at(entry["name"])):
            raise StoreError(f"can't move a segment into {self.path}")
        return entry

    def _committed(self, manifest: dict, entry: dict) -> None:
        try:
            self._commit(manifest)
        except StoreError:
            for name in (entry["name"], *entry["rejected"]):
                self.fs.delete(self._at(name), True)
            raise

    def build(self, rows: DataFrame, keys: list[str], rejected: DataFrame | None = None, *, batch: tuple[str, int] | None = None, replace: bool = False) -> Store:
        """A new store of one segment, in place of a sound store at this path.

        A folder with a manifest that can't be read, or with other content, is left alone unless
        ``replace`` is true.
        """
        names, number, old = self._names(), 0, []
        if self.exists():
            number = int(self._manifests()[-1].split("-")[1])
            old = [n for n in names if n.startswith("segment-")]
            if not replace:
                self._manifest()
        elif [n for n in names if not n.startswith((".", "_"))] and not replace:
            raise StoreError(f"{self.path} holds other files")
        manifest = {"format_version": FORMAT_VERSION, "keys": keys, "schema": json.loads(rows.schema.json()), "batches": dict([batch] if batch else []), "number": number}
        entry = self._segment(rows, manifest, 1, rejected, old)
        self._committed(manifest | {"segments": [entry]}, entry)
        return self

    def append(self, rows: DataFrame, rejected: DataFrame | None = None, *, batch: tuple[str, int] | None = None) -> Store:
        """One more segment; the store must exist, and nothing changes unless all of it is written.

        ``batch`` names a stream and the number of its batch; a batch that is in the store, or an earlier
        one of the same stream, is not appended again.
        """
        manifest = self._manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return self
        want = [f["name"] for f in manifest["schema"]["fields"]]
        if sorted(rows.columns) != sorted(want):
            raise ValueError(f"columns {rows.columns} are not the store's {want}")
        if batch:
            manifest["batches"][batch[0]] = batch[1]
        next_id = max([0, *(s["id"] for s in manifest["segments"])]) + 1
        entry = self._segment(rows.select(*want), manifest, next_id, rejected)
        manifest["segments"].append(entry)
        self._committed(manifest, entry)
        return self

    def compact(self, *, drop_rejected: bool = False) -> Store:
        """All segments as one, each row once."""
        manifest = self._manifest()
        rows = self.rows(with_segment=False).dropDuplicates()
        next_id = max([0, *(s["id"] for s in manifest["segments"])]) + 1
        lines = None if drop_rejected or not any(s["rejected"] for s in manifest["segments"]) else self.rejected()
        entry = self._segment(rows, manifest, next_id, lines, [s["name"] for s in manifest["segments"]])
        manifest["segments"] = [entry]
        self._committed(manifest, entry)
        return self

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> list[str]:
        """Delete what the manifest doesn't name and is older than that; readers of older states lose them."""
        m = self._manifest()
        live = {f"manifest-{m['number']:010d}"} | {n for s in m["segments"] for n in (s["name"], *s["rejected"])}
        least = (time.time() - older_than_seconds) * 1000
        gone = []
        for f in self.fs.listStatus(self._root):
            name = f.getPath().getName()
            if name not in live and name.startswith(("manifest-", "segment-", "rejected-", "_")) and f.getModificationTime() <= least:
                self.fs.delete(f.getPath(), True)
                gone.append(name)
        return sorted(gone)

    # reading

    def _read(self, name: str, schema: dict, keys: list[str], *, placed: bool = False) -> DataFrame:
        full = T.StructType.fromJson(schema)
        for k in keys:
            full = full.add(k + REVERSED, "string")
        found = self.spark.read.schema(full).parquet(f"{self.path}/{name}")
        return found.select("*", file_number().alias(FILE), F.col("_metadata.row_index").alias(ROW)) if placed else found

    def indexed(self, *, placed: bool = False) -> DataFrame:
        """All rows with ``segment_id`` and the stored reversed keys, which lookups use.

        With ``placed`` each row's file and its place there are added, so that segment, file and place
        give the store's order.
        """
        m = self._manifest()
        parts = [self._read(s["name"], m["schema"], m["keys"], placed=placed).withColumn(SEGMENT, F.lit(s["id"])) for s in m["segments"]]
        if not parts:
            raise StoreError("no segments")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def columns(self) -> list[str]:
        return [f["name"] for f in self._manifest()["schema"]["fields"]]

    def rows(self, *, with_segment: bool = True) -> DataFrame:
        """All rows of all segments, repeated ones too."""
        return self.indexed().select(*self.columns(), *([SEGMENT] if with_segment else []))

    def rejected(self, *, with_segment: bool = False) -> DataFrame:
        """Lines that did not parse, as they were; they are never searched."""
        out = self.spark.createDataFrame([], _LINES).withColumn(SEGMENT, F.lit(0))
        for s in self._manifest()["segments"]:
            if s["rejected"]:
                out = out.unionByName(self.spark.read.schema(_LINES).parquet(*[f"{self.path}/{n}" for n in s["rejected"]]).withColumn(SEGMENT, F.lit(s["id"])))
        return out if with_segment else out.select("line")

    def lookup(self, key: str, mode: str, value: str | bytes, *, distinct: bool = True, ordered: bool = False) -> DataFrame:
        """Rows whose key matches, each once over all segments unless ``distinct`` is false.

        With ``ordered`` they come in the order of segments and of rows within them; of equal rows the
        first one counts.
        """
        cols = [F.col(f"`{c}`") for c in self.columns()]
        if not ordered:
            found = self.indexed()
            return lookup(found, key, mode, value) if distinct else found.where(predicate(found, key, mode, value)).select(*cols)
        found = self.indexed(placed=True)
        place = F.struct(SEGMENT, FILE, ROW)
        hits = found.where(predicate(found, key, mode, value)).select(*cols, place.alias("_place"))
        if distinct:
            hits = hits.groupBy(*cols).agg(F.min("_place").alias("_place"))
        return hits.orderBy("_place").select(*cols)

    def frames(self, key: str, mode: str, value: str | bytes, columns: list[str] | None = None) -> DataFrame:
        """The rows that match as binary frames of ``columns``, each combination once."""
        return matched_frames(self.indexed(), key, mode, value, columns or self.columns())

    def dump(self, columns: list[str] | None = None, separator: str = "\t", *, ordered: bool = False) -> DataFrame:
        """``line``: every row of a segment as text and then its rejected lines as they were, nothing dropped.

        With ``ordered`` the lines come in the order of segments and of rows within them.
        """
        each = self.indexed(placed=True).select(
            text_line(columns or self.columns(), separator).alias("line"), SEGMENT, F.lit(0).alias("_kind"), F.struct(FILE, ROW).alias("_place")
        )
        none = F.struct(F.lit(None).cast("long").alias(FILE), F.lit(None).cast("long").alias(ROW))
        bad = self.rejected(with_segment=True).select("line", SEGMENT, F.lit(1).alias("_kind"), none.alias("_place"))
        both = each.unionByName(bad)
        return (both.orderBy(SEGMENT, "_kind", "_place") if ordered else both).select("line")

    def dump_frames(self, columns: list[str] | None = None) -> DataFrame:
        """``frame``: every row as a binary frame. Rejected lines have none; a warning says how many are left out."""
        left_out = self.rejected().count()
        if left_out:
            logging.getLogger(__name__).warning("%d rejected lines have no frame", left_out)
        return self.indexed().select(frame(columns or self.columns()).alias("frame"))

    # care

    def _sound(self, name: str, schema: dict, keys: list[str]) -> bool:
        try:
            if not self.fs.exists(self._at(f"{name}/_SUCCESS")):
                return False
            self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}").schema  # noqa: B018  reads each footer
            self._read(name, schema, keys).agg(F.count("*")).first()
        except (PySparkException, Py4JError):
            return False
        return True

    def validate(self) -> None:
        """Raise if a segment is missing or its files can't be opened."""
        m = self._manifest()
        for s in m["segments"]:
            if not self._sound(s["name"], m["schema"], m["keys"]):
                raise StoreError(f"segment {s['id']} is damaged")

    def repair(self) -> Repaired:
        """Keep the segments that can be read; a sound store is left as it is.

        If the newest manifest is damaged or missing, the state is made again: the newest manifest that
        can be read, and the sound segments written after it that no later one replaced. Refuses a folder
        without segments that describe themselves, one of another version, and to drop everything. If
        another writer changes the store meanwhile, that stays and an error is raised.
        """
        try:
            m, rebuilt = self._manifest(), False
        except _OtherVersion:
            raise
        except StoreError:
            m, rebuilt = self._from_segments(), True
        good = [s for s in m["segments"] if self._sound(s["name"], m["schema"], m["keys"])]
        dropped = len(m["segments"]) - len(good)
        if not dropped and not rebuilt:
            return Repaired(len(good), 0, False)
        if not good:
            raise StoreError("no segment can be read")
        m["segments"] = good
        self._commit(m)
        return Repaired(len(good), dropped, True)

    def _from_segments(self) -> dict:
        """The state by the newest manifest that can be read and by what segments say of themselves."""
        names = self._names()
        base: dict = {"segments": [], "number": 0, "batches": {}}
        top = 0
        for n in self._manifests():
            top = max(top, int(n.split("-")[1]))
            try:
                base = self._json(n) | {"number": int(n.split("-")[1])}
            except _OtherVersion:
                raise
            except StoreError:
                continue
        later = []
        for n in names:
            if n.startswith("segment-"):
                try:
                    about = self._json(f"{n}/{ABOUT}")
                except _OtherVersion:
                    raise
                except (StoreError, Py4JError):
                    continue
                if about["number"] > base["number"]:
                    later.append(about)
        later.sort(key=lambda a: (a["number"], a["entry"]["name"]))
        if not later and "schema" not in base:
            raise StoreError(f"no store at {self.path}")
        for about in later:
            if about["replaces"] and not self._sound(about["entry"]["name"], about["schema"], about["keys"]):
                continue  # what it replaced is still there
            base |= {k: about[k] for k in ("format_version", "keys", "schema", "batches")}
            base["segments"] = [s for s in base["segments"] if s["name"] not in about["replaces"]] + [about["entry"]]
            top = max(top, about["number"])
        return base | {"number": max(top, base["number"])}

    def segment_stats(self) -> DataFrame:
        """``segment_id, records, distinct_<key>`` of each segment."""
        keys = self._manifest()["keys"]
        return self.indexed().groupBy(SEGMENT).agg(F.count("*").alias("records"), *[F.countDistinct(k).alias(f"distinct_{k}") for k in keys])

    def info(self) -> dict:
        """Totals and segments. ``distinct`` sums the segments' counts, so a key in two of them counts twice."""
        m = self._manifest()
        stats = {r[SEGMENT]: r.asDict() for r in self.segment_stats().collect()}  # a row for each segment
        segments = []
        for s in m["segments"]:
            size = self.fs.getContentSummary(self._at(s["name"])).getLength()
            row = stats.get(s["id"], {})
            segments.append({"id": s["id"], "size_bytes": size, "records": row.get("records", 0), "distinct": {k: row.get(f"distinct_{k}", 0) for k in m["keys"]}})
        return {
            "path": self.path,
            "size_bytes": sum(s["size_bytes"] for s in segments),
            "format_version": FORMAT_VERSION,
            "segment_count": len(segments),
            "records": sum(s["records"] for s in segments),
            "distinct": {k: sum(s["distinct"][k] for s in segments) for k in m["keys"]},
            "rejected": self.rejected().count(),
            "segments": segments,
        }

    def bench(self, key: str, n: int) -> dict:
        """Seconds of ``n`` exact lookups of stored keys: ``lookups, found, mean_seconds``.

        The keys are those with the least hashes, so that they are spread over the store.
        """
        if n < 1:
            raise ValueError("at least one lookup is needed")
        some = [r[0] for r in self.indexed().select(key).distinct().orderBy(F.xxhash64(key), key).limit(n).collect()]
        began, found = time.time(), 0
        for i in range(n if some else 0):
            found += self.lookup(key, "exact", some[i % len(some)], distinct=False).count()
        done = n if some else 0
        return {"lookups": done, "found": found, "mean_seconds": (time.time() - began) / max(done, 1)}


class _OtherVersion(StoreError):
    """The store was written by another version."""
