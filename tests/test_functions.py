from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keys as K

#: One or more cases for each rule, in the order of the rules.
DOMAINS = [
    ("KIOSK.Fjord.NO", "fjord.no"), ("ÄRGER.kiosk.de", "kiosk.de"),
    ("gopher://old://shelf.io", "old"), ("//plain.io", ""), ("ftp://files.shelf.io", "shelf.io"),
    ("mail:pw@x@y.post.dk", "post.dk"), ("http://shop.li/list/@tea", "tea"), ("u@[::1]:99", "::1"),
    ("a.shelf.io?to=b.post.dk", "shelf.io"), ("post.dk#top.li", "post.dk"), ("post.dk;v=1/2", "post.dk"), ("q.post.dk/a?b#c", "post.dk"),
    ("[fe80::7:8]/x", "fe80::7:8"), ("[plain]", "[plain]"), ("[]", "[]"),
    ("kiosk.de:0", "kiosk.de"), (":80", ""), ("tcp://a.kiosk.de:1:2", "kiosk.de"),
    ("..kiosk.de..", "kiosk.de"), ("....", ""), (None, ""), ("   ", "   "),
    ("one...two....three", "two.three"), ("lonely", "lonely"),
    ("192.0.2.44", "192.0.2.44"), ("7..8", "7..8"), ("192.0.2.x4", "2.x4"), ("2024", "2024"),
    ("tea.shop.med.pl", "shop.med.pl"), ("w.tea.ltd.uk", "tea.ltd.uk"), ("ltd.uk", "ltd.uk"), ("w.tea.ltd.com", "ltd.com"),
    ("w.tea.shop.pl", "shop.pl"), ("w.tea.co.u1", "co.u1"), ("w.tea..gouv.fr", "tea.gouv.fr"),
]


def test_domains(spark):
    df = spark.createDataFrame(DOMAINS, "url string, want string")
    got = df.select("url", "want", K.normalize_domain(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == [(r.url, r.want) for r in got]


@pytest.mark.parametrize("label,known", [("com", True), ("med", True), ("example", False), ("c0m", False)])
def test_second_level(spark, label, known):
    assert spark.range(1).select(K.is_second_level(F.lit(label))).first()[0] is known


def test_ascii_lower_keeps_other_letters(spark):
    assert spark.range(1).select(K.ascii_lower(F.lit("ÄB-Ωz"))).first()[0] == "Äb-Ωz"


def test_reverse_bytes(spark):
    got = spark.createDataFrame([("Aü",), ("",), (None,)], "a string").select(K.reverse_bytes(F.col("a"))).collect()
    assert [r[0] and bytes(r[0]) for r in got] == [bytes.fromhex("BCC341"), bytearray(), None]


def test_common_lengths(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", "a"), (None, "a"), ("aa", "aa")], "a string, b string")
    got = df.select(K.common_prefix_length(F.col("a"), F.col("b")), K.common_suffix_length(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2, 1), (0, 0), (0, 0), (2, 2)]


def test_sizes_lengths_schemes(spark):
    sizes = [0, 1023, 1024, 1152, 1408, 5 << 20, (1 << 20) - 1, (5 << 20) + (1 << 17), 3 << 30, (3 << 30) + (3 << 27), (1 << 62) + 1, 1234567, None]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(K.readable_size(F.col("n"))).collect()

    def exact(n):
        if n is None or n < 1024:
            return n if n is None else f"{n} B"
        k, unit = next((k, u) for k, u in ((3, "GB"), (2, "MB"), (1, "KB")) if n >= 1024**k)
        return f"{(Decimal(n) / 1024**k).quantize(Decimal('0.01'), ROUND_HALF_EVEN)} {unit}"

    assert [r[0] for r in got] == [exact(n) for n in sizes] and got[3][0] == "1.12 KB"
    row = spark.range(1).select(K.little_endian_length(F.encode(F.repeat(F.lit("x"), 50108), "UTF-8")), K.has_scheme(F.lit("ab+c://x")), K.has_scheme(F.lit("1a://x"))).first()
    assert (bytes(row[0]).hex(), row[1], row[2]) == ("bcc30000", True, False)
