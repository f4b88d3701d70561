import shutil
from pathlib import Path

import pytest

from keyloom.operators.lookup import counters, lookup
from keyloom.plans.store import Store, StoreError
from keyloom.sources.tables import read_lines, read_records
from keyloom.streaming.ingest import append_stream

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_append_dedup_compact(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a.com", 1), (None, 2)), ["k"])
    s.append(rows(spark, ("a.com", 1), ("b.com", 3)))
    assert s.rows().count() == 4
    c = counters(s.rows(with_segment=False)).first()
    assert (c.found, c.dupes, c.saved) == (4, 1, 3)
    s.compact()
    assert sorted(tuple(r) for r in s.rows(with_segment=False).collect()) == [("", 2), ("a.com", 1), ("b.com", 3)]
    assert s.info()["segment_count"] == 1
    assert [r.v for r in lookup(s.indexed(), "k", "suffix", ".com").orderBy("v").collect()] == [1, 3]
    assert lookup(s.indexed(), "k", "suffix", "").count() == 0 and lookup(s.indexed(), "k", "prefix", "").count() == 3


def test_suffix_reaches_the_scan_as_prefix(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a.com", 1)), ["k"])
    plan = lookup(s.indexed(), "k", "suffix", ".com")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(k_reversed,moc.)" in plan


def test_missing_bad_and_foreign_stores(spark, tmp_path):
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/none").append(rows(spark, ("a", 1)))
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a", 1)), ["k"])
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([(1,)], "x long"))
    with pytest.raises(ValueError):
        lookup(s.indexed(), "nope", "exact", "a")
    with pytest.raises(ValueError):
        lookup(s.indexed(), "k", "fuzzy", "a")
    for p in Path(tmp_path, "s").glob("manifest-*"):
        p.write_text(p.read_text().replace('"format_version": 1', '"format_version": 9'))
        Path(tmp_path, "s", f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(StoreError):
        s.repair()


def test_repair(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a", 1)), ["k"])
    s.append(rows(spark, ("b", 2)))
    assert s.repair() == s.repair() and not s.repair().changed
    s.validate()
    last = s._manifest()["segments"][-1]["name"]
    part = next(Path(tmp_path, "s", last).glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:20])
    Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(StoreError):
        s.validate()
    done = s.repair()
    assert (done.kept, done.dropped, done.changed) == (1, 1, True)
    assert [tuple(r) for r in s.rows(with_segment=False).collect()] == [("a", 1)]
    shutil.rmtree(Path(tmp_path, "s", s._manifest()["segments"][0]["name"]))
    with pytest.raises(StoreError):
        s.repair()


def test_many_rows_under_one_key_and_empty_store(spark, tmp_path):
    many = spark.range(10_005).selectExpr("'same' AS k", "id AS v")
    s = Store(spark, f"file://{tmp_path}/s").build(many, ["k"])
    assert lookup(s.indexed(), "k", "exact", "same").count() == 10_005
    e = Store(spark, f"file://{tmp_path}/e").build(many.limit(0), ["k"])
    e.validate()
    assert e.info()["records"] == 0 and lookup(e.indexed(), "k", "prefix", "").count() == 0


def test_rejected_lines_are_kept(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "in.csv").write_text("a,1\nb,x\nc,3\n")
    good, bad = read_records(spark, f"file://{tmp_path}/in.csv", schema=StructType.fromDDL(SCHEMA))
    s = Store(spark, f"file://{tmp_path}/s").build(good, ["k"], bad)
    assert s.rows().count() == 2 and [r.line for r in s.rejected().collect()] == ["b,x"]
    assert s.compact().rejected().count() == 1 and s.compact(drop_rejected=True).rejected().count() == 0
    (tmp_path / "t.txt").write_bytes(b"x\r\ny\n")
    assert sorted(r.value for r in read_lines(spark, f"file://{tmp_path}/t.txt").collect()) == ["x", "y"]


def test_stream_appends(spark, tmp_path):
    rows(spark, ("a", 1), ("b", 2)).write.parquet(f"{tmp_path}/land")
    store = Store(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/land")
    append_stream(stream, store, ["k"], f"{tmp_path}/ck").awaitTermination()
    rows(spark, ("c", 3)).write.mode("append").parquet(f"{tmp_path}/land")
    append_stream(stream, store, ["k"], f"{tmp_path}/ck").awaitTermination()
    assert store.rows().count() == 3 and store.info()["segment_count"] == 2


def test_lookup_over_segments_in_order(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("c", 1), ("a", 2)), ["k"]).append(rows(spark, ("a", 2), ("b", 0)))
    assert [tuple(r) for r in lookup(s.indexed(), "k", "exact", "a").collect()] == [("a", 2)]
    assert [tuple(r) for r in s.lookup("k", "prefix", "", ordered=True).collect()] == [("a", 2), ("c", 1), ("b", 0)]
    assert [tuple(r) for r in s.lookup("k", "prefix", "", ordered=True, distinct=False).collect()] == [("a", 2), ("c", 1), ("a", 2), ("b", 0)]
    assert s.lookup("k", "exact", "a", distinct=False).count() == 2
    assert [bytes(r[0]).hex() for r in s.frames("k", "exact", "a", ["k"]).collect()] == ["0100000061"]


def test_byte_needles(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("aü", 1), ("b", 2)), ["k"])
    found = lambda mode, value: sorted(r.v for r in lookup(s.indexed(), "k", mode, value).collect())
    assert found("suffix", "ü".encode()) == found("suffix", b"\xbc") == found("contains", b"\xc3") == found("prefix", b"a\xc3") == [1]
    assert found("suffix", b"") == found("prefix", b"\xff") == found("exact", b"\xff") == [] and found("exact", b"b") == [2]
    plan = lookup(s.indexed(), "k", "suffix", b".com")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(k_reversed,moc.)" in plan
    raw = spark.createDataFrame([(bytearray(b"\xffu"),), (bytearray(b"x"),)], "k binary")
    assert lookup(raw, "k", "prefix", b"\xff").count() == lookup(raw, "k", "suffix", b"u").count() == lookup(raw, "k", "exact", b"x").count() == 1


def test_dump_has_rows_and_then_rejected_lines(spark, tmp_path, caplog):
    bad = spark.createDataFrame([("? ?",)], "line string")
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("b", 1), ("a", None)), ["k"], bad).append(rows(spark, ("a", 3)))
    assert [r.line for r in s.dump(ordered=True).collect()] == ["a\t", "b\t1", "? ?", "a\t3"]
    assert s.dump_frames(["k"]).count() == 3 and "1 rejected" in caplog.text
    lines = [r.line for r in s.compact().dump(ordered=True).collect()]  # the order within a key isn't set
    assert sorted(lines[:2]) == ["a\t", "a\t3"] and lines[2:] == ["b\t1", "? ?"]


def damage(path, name, content=b"{"):
    Path(path, name).write_bytes(content)
    Path(path, f".{name}.crc").unlink(missing_ok=True)


def test_repair_makes_a_lost_manifest_again(spark, tmp_path):
    at = tmp_path / "s"
    s = Store(spark, f"file://{at}").build(rows(spark, ("a", 1)), ["k"]).append(rows(spark, ("b", 2)))
    want = sorted(tuple(r) for r in s.rows().collect())
    damage(at, "manifest-0000000002")
    with pytest.raises(StoreError):
        s.rows()
    assert s.repair().changed and sorted(tuple(r) for r in s.rows().collect()) == want
    s.append(rows(spark, ("c", 3))).compact()
    want = sorted(tuple(r) for r in s.rows().collect())
    for p in (*at.glob("manifest-*"), *at.glob(".manifest-*")):
        p.unlink()
    done = s.repair()
    assert (done.kept, done.dropped, done.changed) == (1, 0, True) and sorted(tuple(r) for r in s.rows().collect()) == want
    assert not s.repair().changed
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "notes.txt").write_text("mine")
    foreign = Store(spark, f"file://{tmp_path}/foreign")
    for refused in (foreign.repair, lambda: foreign.build(rows(spark, ("a", 1)), ["k"])):
        with pytest.raises(StoreError):
            refused()
    assert [p.name for p in (tmp_path / "foreign").iterdir()] == ["notes.txt"]


def test_a_faster_writer_stays(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a", 1)), ["k"])
    old = s._manifest()
    s.append(rows(spark, ("b", 2)))
    with pytest.raises(StoreError):
        s._commit(old)
    assert s.rows().count() == 2


def test_build_asks_before_it_replaces_what_it_cannot_read(spark, tmp_path):
    at = tmp_path / "s"
    s = Store(spark, f"file://{at}").build(rows(spark, ("a", 1)), ["k"])
    damage(at, "manifest-0000000001")
    with pytest.raises(StoreError):
        s.build(rows(spark, ("b", 2)), ["k"])
    s.build(rows(spark, ("b", 2)), ["k"], replace=True)
    assert [tuple(r) for r in s.rows(with_segment=False).collect()] == [("b", 2)]
    with pytest.raises(ValueError):
        s.build(spark.createDataFrame([("a", 1)], "k string, segment_id int"), ["k"])
    with pytest.raises(ValueError):
        s.build(spark.createDataFrame([("a", "b")], "k string, k_reversed string"), ["k"])


def test_a_stream_never_replaces_a_store(spark, tmp_path):
    at = tmp_path / "s"
    s = Store(spark, f"file://{at}").build(rows(spark, *[("a", i) for i in range(20)]), ["k"])
    text = next(at.glob("manifest-*")).read_text()
    rows(spark, ("b", 1)).write.parquet(f"{tmp_path}/land")
    for content in (text.replace('"format_version": 1', '"format_version": 9').encode(), b"{"):
        damage(at, "manifest-0000000001", content)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/land")
        with pytest.raises(Exception, match="format version|damaged"):
            append_stream(stream, s, ["k"], f"{tmp_path}/ck{len(content)}").awaitTermination()
    damage(at, "manifest-0000000001", text.encode())
    assert s.rows().count() == 20


def test_a_batch_that_comes_again_is_not_appended(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a", 1)), ["k"], batch=("x", 0))
    s.append(rows(spark, ("a", 1)), batch=("x", 0)).append(rows(spark, ("b", 2)), batch=("x", 1)).append(rows(spark, ("b", 2)), batch=("x", 1))
    assert s.rows().count() == 2
    s.compact().append(rows(spark, ("b", 2)), batch=("x", 1)).append(rows(spark, ("b", 2)), batch=("y", 0))
    assert s.rows().count() == 3


def test_vacuum_and_bench(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").build(rows(spark, ("a", 1), ("b", 2)), ["k"]).append(rows(spark, ("b", 3))).compact()
    assert s.vacuum() == [] and len(s.vacuum(older_than_seconds=0)) == 4
    assert s.rows().count() == 3 and [p.name[:9] for p in sorted(Path(tmp_path, "s").iterdir()) if p.name[0] != "."] == ["manifest-", "segment-" + next(Path(tmp_path, "s").glob("segment-*")).name[8]]
    s.validate()
    done = s.bench("k", 3)
    assert done["lookups"] == 3 and done["found"] >= 3 and done["mean_seconds"] > 0
    with pytest.raises(ValueError):
        s.bench("k", 0)
