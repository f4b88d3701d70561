"""The library's queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..operators import dictionary as D
from ..operators import lookup as L
from ..operators import rows as R
from ..sources.tables import read_lines, read_records, read_table
from ..streaming.ingest import append_stream
from .scratch import scratch_path
from .store import Store

Query = Callable[[SparkSession, str], DataFrame]

_SECOND = ", ".join(f"'{x}'" for x in K.SECOND_LEVEL)
#: The registrable domain of ``url`` in SQL, as a chain of subqueries over ``src(page_id, url)``.
DOMAINS_SQL = f"""
a AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM src),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(s, '^.*?://', '', 's'), '^.*@', '', 's'), '[/?#;].*$', '', 's') AS s FROM a),
c AS (SELECT page_id, url, regexp_extract(s, '^\\[([^\\]]*:[^\\]]*)\\]', 1) AS address,
             regexp_replace(regexp_replace(s, ':.*$', '', 's'), '^\\.+|\\.+$', '', 'g') AS host FROM b),
d AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM c),
domains AS (SELECT page_id, url, CASE
  WHEN address <> '' THEN address
  WHEN len(l) = 0 THEN ''
  WHEN len(list_filter(l, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN host
  WHEN len(l) >= 3 AND regexp_full_match(l[-1], '[a-z][a-z]') AND l[-2] IN ({_SECOND}) THEN array_to_string(l[-3:], '.')
  ELSE array_to_string(l[-2:], '.') END AS domain FROM d)
"""
_PAGES = f"WITH src AS (SELECT page_id, url FROM pages), {DOMAINS_SQL}"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", "url", K.normalize_domain(F.col("url")).alias("domain"))


def _looked_up(table: str, key: str, mode: str, value: str, *columns: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return L.lookup(read_table(spark, d, table).select(*columns), key, mode, value)

    return run


def _stored_suffix(table: str, key: str, value: str, *columns: str) -> Query:
    """A suffix lookup through a stored reversed key."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        store = Store(spark, scratch_path(spark, f"suffix-{table}")).build(read_table(spark, d, table).select(*columns), [key])
        return L.lookup(store.indexed(), key, "suffix", value).select(*columns)

    return run


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents in three segments that overlap."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source")
    parts = [docs.where(F.pmod("doc_id", F.lit(3)) != i).withColumn("segment_id", F.lit(i)) for i in range(3)]
    return R.union_all(*parts)


_SEGMENTS_SQL = "WITH segs AS (" + " UNION ALL ".join(
    f"SELECT doc_id, lang, source, {i} AS segment_id FROM documents WHERE doc_id % 3 <> {i}" for i in range(3)
) + ")"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", "event_type", "user_id")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return D.dictionary(read_table(spark, d, "part"), "p_name")


def _order_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _filled(spark: SparkSession, d: str) -> Store:
    """A store of customers built from one half and filled by two appends that overlap."""
    rows = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    store = Store(spark, scratch_path(spark, "customers")).build(rows.where("c_custkey % 2 = 0"), ["c_mktsegment", "c_name"])
    return store.append(rows.where("c_custkey % 2 = 1")).append(rows.where("c_custkey % 5 = 0"))


def _info_totals(spark: SparkSession, d: str) -> DataFrame:
    i = _filled(spark, d).info()
    return spark.createDataFrame(
        [(i["segment_count"], i["records"], i["distinct"]["c_mktsegment"], i["distinct"]["c_name"])],
        "segment_count long, records long, distinct_segments long, distinct_names long",
    )


def _text_keys(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "pages").select("page_id", "url")
    before = D.ranked(D.dictionary(e, "url"), "url")
    return D.front_code(before, "url").select("key_id", F.col("shared").cast("long").alias("shared"), "rest")


def _half_empty(spark: SparkSession, d: str) -> DataFrame:
    """Events of which every seventh has no key."""
    return _events(spark, d).withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))


def _decoded_nulls(spark: SparkSession, d: str) -> DataFrame:
    e = _half_empty(spark, d)
    keys = D.ranked(D.dictionary(e, "event_type"), "event_type")
    return D.decode_keys(D.encode_keys(e, "event_type", keys), keys, "event_type")


def _lines_back(spark: SparkSession, d: str) -> DataFrame:
    """Lines with and without a carriage return, written as text and read again."""
    path = scratch_path(spark, "lines")
    names = read_table(spark, d, "nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit("\r")).otherwise(F.lit(""))))
    names.write.mode("overwrite").text(path)
    return read_lines(spark, path).select(F.col("value").alias("n_name"))


def _records_back(spark: SparkSession, d: str) -> DataFrame:
    """Records written as text, some of which don't parse, and the lines of those."""
    path = scratch_path(spark, "records")
    number = F.when(F.col("n_nationkey") % 5 == 3, F.lit("many")).otherwise(F.col("n_nationkey").cast("string"))
    read_table(spark, d, "nation").select(F.concat_ws(",", number, "n_name")).write.mode("overwrite").text(path)
    good, bad = read_records(spark, path, schema=T.StructType.fromDDL("number long, name string"))
    return good.select("number", F.col("name").alias("text")).unionByName(bad.select(F.lit(None).cast("long").alias("number"), F.col("line").alias("text")))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    store = _filled(spark, d)
    store.validate()
    return spark.range(1).select(F.lit(True).alias("sound"))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    """The newest segment without its mark of success and the newest manifest cut short, repaired."""
    store = _filled(spark, d)
    last = store._manifest()
    store.fs.delete(store._at(f"{last['segments'][-1]['name']}/_SUCCESS"), False)
    name = f"manifest-{last['number']:010d}"
    store.fs.delete(store._at(name), False)
    store.fs.create(store._at(name)).close()
    store.repair()
    return store.rows()


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as files and appended to a store by a stream, which is then run again."""
    path = scratch_path(spark, "landing")
    rows = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    store, checkpoint = Store(spark, f"{path}/store"), f"{path}/checkpoint"
    for i in range(2):
        rows.where(F.col("c_custkey") % 2 == i).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        append_stream(stream, store, ["c_mktsegment"], checkpoint).awaitTermination()
    return store.rows(with_segment=False)


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    lines = read_table(spark, d, "region").select(F.concat(F.lit("?"), "r_name"))
    return Store(spark, scratch_path(spark, "dump")).build(rows, ["n_name"], lines).append(rows.where("n_nationkey < 9"), lines).dump(separator="|")


_CUSTOMERS = "FROM customer"
_FILLED_SQL = """WITH filled AS (
  SELECT c_custkey, c_name, c_mktsegment, 1 AS segment_id FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, 2 FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, 3 FROM customer WHERE c_custkey % 5 = 0)"""
_FRAME = "concat(" + ", ".join(f"lpad(hex(strlen({{c}}) // {256**i} % 256), 2, '0')" for i in range(4)) + ", hex(encode({c})))"
_PARTS = f"WITH parts AS (SELECT event_type, event_id, (row_number() OVER (ORDER BY event_type, event_id) - 1) // {D.LIST_ROWS} AS part FROM events)"
_COUNTERS = "SELECT sum(n)::BIGINT AS found, (sum(n) - count(*))::BIGINT AS dupes, count(*) AS saved FROM"

#: Each query with its SQL.
ALL: dict[str, tuple[Query, str]] = {
    "domain_normalize": (pages, f"{_PAGES} SELECT page_id, url, domain FROM domains"),
    "exact_domain": (
        lambda s, d: L.lookup(pages(s, d), "domain", "exact", "example.com"),
        f"{_PAGES} SELECT page_id, url, domain FROM domains WHERE domain = 'example.com'",
    ),
    "prefix_url": (
        _looked_up("pages", "url", "prefix", "https://blog.", "page_id", "url"),
        "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')",
    ),
    "contains_url": (
        _looked_up("pages", "url", "contains", "page=", "page_id", "url"),
        "SELECT page_id, url FROM pages WHERE contains(url, 'page=')",
    ),
    "contains_any_url": (_looked_up("pages", "url", "contains", "", "page_id", "url"), "SELECT page_id, url FROM pages"),
    "prefix_part_name": (
        _looked_up("part", "p_name", "prefix", "small", "p_partkey", "p_name"),
        "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')",
    ),
    "exact_event_type": (
        _looked_up("events", "event_type", "exact", "purchase", "event_id", "event_type", "value"),
        "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'",
    ),
    "exact_misses_case": (
        _looked_up("events", "event_type", "exact", "Purchase", "event_id", "event_type"),
        "SELECT event_id, event_type FROM events WHERE event_type = 'Purchase'",
    ),
    "suffix_url": (
        _stored_suffix("pages", "url", ".html", "page_id", "url"),
        "SELECT page_id, url FROM pages WHERE ends_with(url, '.html')",
    ),
    "suffix_customer_name": (
        _stored_suffix("customer", "c_name", "77", "c_custkey", "c_name"),
        "SELECT c_custkey, c_name FROM customer WHERE ends_with(c_name, '77')",
    ),
    "suffix_empty": (
        _stored_suffix("customer", "c_name", "", "c_custkey", "c_name"),
        "SELECT c_custkey, c_name FROM customer WHERE false",
    ),
    "dictionary_domains": (lambda s, d: D.dictionary(pages(s, d), "domain"), f"{_PAGES} SELECT DISTINCT domain FROM domains"),
    "dictionary_ranked": (
        lambda s, d: D.ranked(_names(s, d), "p_name"),
        "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS key_id FROM (SELECT DISTINCT p_name FROM part)",
    ),
    "reverse_sorted_names": (
        lambda s, d: D.ranked(_names(s, d), "p_name", by=F.reverse("p_name")),
        "SELECT p_name, row_number() OVER (ORDER BY reverse(p_name)) - 1 AS key_id FROM (SELECT DISTINCT p_name FROM part)",
    ),
    "unique_counts": (
        lambda s, d: read_table(s, d, "part").agg(F.count("*").alias("records"), F.countDistinct("p_name").alias("names"), F.countDistinct("p_brand").alias("brands")),
        "SELECT count(*) AS records, count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands FROM part",
    ),
    "dedup_documents": (
        lambda s, d: R.distinct_rows(read_table(s, d, "documents"), ["text", "lang"]),
        "SELECT DISTINCT text, lang FROM documents",
    ),
    "dedup_counters": (
        lambda s, d: L.counters(read_table(s, d, "documents"), ["text"]),
        f"{_COUNTERS} (SELECT count(*) AS n FROM documents GROUP BY text)",
    ),
    "sort_count": (
        lambda s, d: R.sort_count(read_table(s, d, "events").select("event_type", "user_id")),
        "SELECT sum(n)::BIGINT AS total, count(*) AS unique_rows, round((sum(n) - count(*)) * 100.0 / sum(n), 2)::DOUBLE AS dupes_percent FROM (SELECT count(*) AS n FROM events GROUP BY event_type, user_id)",
    ),
    "union_all_segments": (_segments, f"{_SEGMENTS_SQL} SELECT * FROM segs"),
    "union_distinct_segments": (
        lambda s, d: R.distinct_rows(_segments(s, d).drop("segment_id")),
        f"{_SEGMENTS_SQL} SELECT DISTINCT doc_id, lang, source FROM segs",
    ),
    "postings_event_type": (
        lambda s, d: D.postings(_events(s, d), "event_type", "event_id"),
        f"{_PARTS} SELECT event_type, part, list(event_id ORDER BY event_id) AS rows FROM parts GROUP BY event_type, part",
    ),
    "posting_list_deltas": (
        lambda s, d: D.posting_list_deltas(D.postings(_events(s, d), "event_type", "event_id")).select("event_type", "part", "deltas"),
        f"{_PARTS} SELECT event_type, part, list(delta ORDER BY event_id) AS deltas FROM (SELECT event_type, part, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY event_type, part ORDER BY event_id), 0) AS delta FROM parts) GROUP BY event_type, part",
    ),
    "postings_cut": (
        lambda s, d: D.postings(_events(s, d), "event_type", "event_id", list_rows=100).select("event_type", "part", F.size("rows").cast("long").alias("n")),
        "SELECT event_type, part, count(*) AS n FROM (SELECT event_type, (row_number() OVER (ORDER BY event_type, event_id) - 1) // 100 AS part FROM events) GROUP BY event_type, part",
    ),
    "postings_delta": (
        lambda s, d: D.posting_deltas(_order_rows(s, d), "o_orderstatus", "o_orderkey"),
        "SELECT o_orderstatus, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 0) AS delta FROM orders",
    ),
    "key_offsets": (
        lambda s, d: D.key_offsets(_events(s, d), "event_type", "event_id"),
        "SELECT event_type, min(event_id) AS first_row, max(event_id) + 1 AS end_row FROM events GROUP BY event_type",
    ),
    "group_starts": (
        lambda s, d: D.group_starts(_events(s, d), "event_type", "user_id", "event_id"),
        "SELECT user_id, event_id, event_type, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS starts FROM events",
    ),
    "front_code_lengths": (
        _text_keys,
        """WITH k AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS key_id FROM (SELECT DISTINCT url FROM pages)),
        p AS (SELECT *, lag(url) OVER (PARTITION BY key_id // 64 ORDER BY key_id) AS prev FROM k),
        n AS (SELECT key_id, url, coalesce(list_max(list_filter(range(0, least(length(url), length(prev)) + 1), lambda i: url[:i] = prev[:i])), 0) AS shared FROM p)
        SELECT key_id, shared, substr(url, shared::INT + 1) AS rest FROM n""",
    ),
    "dictionary_decode_join": (
        lambda s, d: D.decode_keys(D.encode_keys(_events(s, d), "event_type", k := D.ranked(D.dictionary(_events(s, d), "event_type"), "event_type")), k, "event_type"),
        "SELECT event_id, user_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS key_id FROM events",
    ),
    "postings_gather": (
        lambda s, d: D.gather(D.postings(_events(s, d), "event_type", "event_id").where("event_type = 'error'"), _events(s, d), "event_id"),
        "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error'",
    ),
    "append_roundtrip": (lambda s, d: _filled(s, d).rows(), f"{_FILLED_SQL} SELECT * FROM filled"),
    "compact_roundtrip": (
        lambda s, d: _filled(s, d).compact().rows(with_segment=False),
        f"SELECT c_custkey, c_name, c_mktsegment {_CUSTOMERS}",
    ),
    "segment_stats": (
        lambda s, d: _filled(s, d).segment_stats(),
        f"{_FILLED_SQL} SELECT segment_id, count(*) AS records, count(DISTINCT c_mktsegment) AS distinct_c_mktsegment, count(DISTINCT c_name) AS distinct_c_name FROM filled GROUP BY segment_id",
    ),
    "store_info_totals": (
        _info_totals,
        f"{_FILLED_SQL} SELECT count(*) AS segment_count, sum(r)::BIGINT AS records, sum(a)::BIGINT AS distinct_segments, sum(b)::BIGINT AS distinct_names FROM (SELECT count(*) AS r, count(DISTINCT c_mktsegment) AS a, count(DISTINCT c_name) AS b FROM filled GROUP BY segment_id)",
    ),
    "segment_match_count": (
        lambda s, d: L.matched_keys(L.lookup(_filled(s, d).indexed(), "c_mktsegment", "prefix", "A", distinct=False), "c_mktsegment"),
        f"{_FILLED_SQL} SELECT count(*) AS matched FROM (SELECT DISTINCT segment_id, c_mktsegment FROM filled WHERE starts_with(c_mktsegment, 'A'))",
    ),
    "lookup_counters": (
        lambda s, d: L.counters(L.lookup(_filled(s, d).rows(with_segment=False), "c_mktsegment", "exact", "BUILDING", distinct=False)),
        f"{_FILLED_SQL} SELECT coalesce(sum(n), 0)::BIGINT AS found, (coalesce(sum(n), 0) - count(*))::BIGINT AS dupes, count(*) AS saved FROM (SELECT count(*) AS n FROM filled WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, c_name, c_mktsegment)",
    ),
    "text_lines": (
        lambda s, d: read_table(s, d, "nation").select(R.text_line(["n_nationkey", "n_name", "n_regionkey"], "|").alias("line")),
        "SELECT concat(n_nationkey, '|', n_name, '|', n_regionkey) AS line FROM nation",
    ),
    "frames_encode": (
        lambda s, d: read_table(s, d, "pages").select("page_id", F.hex(R.frame(["url"])).alias("frame")),
        f"SELECT page_id, {_FRAME.format(c='url')} AS frame FROM pages",
    ),
    "reverse_bytes": (
        lambda s, d: read_table(s, d, "nation").select("n_nationkey", F.hex(K.reverse_bytes(F.col("n_name"))).alias("reversed")),
        "SELECT n_nationkey, hex(encode(reverse(n_name))) AS reversed FROM nation",
    ),
    "readable_size": (
        lambda s, d: read_table(s, d, "documents").select("doc_id", K.readable_size(F.col("n_chars")).alias("size")),
        """SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.2f KB', n_chars / 1024.0)
        WHEN n_chars < 1073741824 THEN printf('%.2f MB', n_chars / 1048576.0) ELSE printf('%.2f GB', n_chars / 1073741824.0) END AS size FROM documents""",
    ),
    "readable_size_large": (
        lambda s, d: read_table(s, d, "documents").select("doc_id", K.readable_size(F.col("doc_id") * F.col("n_chars") * 40503).alias("size")),
        """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0)
        WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS size FROM (SELECT doc_id, doc_id * n_chars * 40503 AS n FROM documents)""",
    ),
    "encode_null_keys": (
        _decoded_nulls,
        "SELECT event_id, user_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS key_id FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '' END AS event_type FROM events)",
    ),
    "lookup_across_segments": (
        lambda s, d: L.lookup(_filled(s, d).indexed(), "c_mktsegment", "exact", "BUILDING"),
        f"{_FILLED_SQL} SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM filled WHERE c_mktsegment = 'BUILDING'",
    ),
    "lookup_in_order": (
        lambda s, d: _filled(s, d).lookup("c_mktsegment", "prefix", "A", ordered=True),
        f"{_FILLED_SQL} SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM filled WHERE starts_with(c_mktsegment, 'A')",
    ),
    "byte_needle_suffix": (
        lambda s, d: L.lookup(_filled(s, d).indexed(), "c_name", "suffix", b"77"),
        f"{_FILLED_SQL} SELECT DISTINCT c_custkey, c_name, c_mktsegment FROM filled WHERE ends_with(c_name, '77')",
    ),
    "matched_frames": (
        lambda s, d: _filled(s, d).frames("c_name", "contains", "11", ["c_mktsegment"]).select(F.hex("frame").alias("frame")),
        f"{_FILLED_SQL} SELECT DISTINCT {_FRAME.format(c='c_mktsegment')} AS frame FROM filled WHERE contains(c_name, '11')",
    ),
    "read_lines_back": (_lines_back, "SELECT n_name FROM nation"),
    "read_records_back": (
        _records_back,
        "SELECT CASE WHEN n_nationkey % 5 <> 3 THEN n_nationkey::BIGINT END AS number, CASE WHEN n_nationkey % 5 = 3 THEN 'many,' || n_name ELSE n_name END AS text FROM nation",
    ),
    "validate_store": (_validated, "SELECT true AS sound"),
    "repair_roundtrip": (_repaired, f"{_FILLED_SQL} SELECT * FROM filled WHERE segment_id < 3"),
    "stream_append": (_streamed, f"SELECT c_custkey, c_name, c_mktsegment {_CUSTOMERS}"),
    "dump_lines": (
        _dumped,
        "SELECT concat(n_nationkey, '|', n_name) AS line FROM nation UNION ALL SELECT concat(n_nationkey, '|', n_name) FROM nation WHERE n_nationkey < 9 UNION ALL SELECT '?' || r_name FROM region UNION ALL SELECT '?' || r_name FROM region",
    ),
}
