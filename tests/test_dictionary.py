"""Operators that depend on a total order, with keys that hold most rows and ranges that cut them."""

import random

from keyloom.operators import dictionary as D


def table(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "", None]), i * 3, i % 4) for i in range(900)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, r long, w int").repartition(5)


def test_a_frequent_key_is_spread(spark):
    rows, df = table(spark)
    lists = D.postings(df, "k", "r", list_rows=50).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    want = {}
    for i, (k, r, _) in enumerate(order):
        want.setdefault((k, i // 50), []).append(r)
    assert {(x.k, x.part): x.rows for x in lists} == want and max(len(x.rows) for x in lists) <= 50
    back = D.gather(D.postings(df, "k", "r", list_rows=50).where("k = 'hot'"), df.select("r", "w"), "r")
    assert back.count() == sum(k == "hot" for k, _, _ in rows)


def test_deltas_and_starts_cross_ranges(spark):
    rows, df = table(spark)
    last, want = {}, set()
    for k, r, _ in sorted(rows, key=lambda x: x[1]):
        want.add((k, r, r - last.get(k, 0)))
        last[k] = r
    assert {tuple(x) for x in D.posting_deltas(df, "k", "r").collect()} == want
    last, want = {}, set()
    for k, r, w in sorted(rows, key=lambda x: x[1]):
        want.add((w, r, k, w not in last or last[w] != k))
        last[w] = k
    assert {tuple(x) for x in D.group_starts(df, "k", "w", "r").collect()} == want


def test_null_keys_are_kept(spark):
    rows, df = table(spark)
    keys = D.ranked(D.dictionary(df, "k"), "k")
    assert sorted((r.k, r.key_id) for r in keys.collect()) == [("", 0), ("a", 1), ("hot", 2)]
    back = D.decode_keys(D.encode_keys(df, "k", keys), keys, "k")
    assert sorted((r.k, r.r) for r in back.collect()) == sorted((k or "", r) for k, r, _ in rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, r long, w int")
    assert D.postings(df, "k", "r").count() == D.posting_deltas(df, "k", "r").count() == D.group_starts(df, "k", "w", "r").count() == 0
