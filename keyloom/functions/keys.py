"""Text-key functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that count as a second-level registry under a two-letter top level (fixed values).
SECOND_LEVEL = (
    "com", "co", "org", "net", "gov", "edu", "ac", "mil", "gob", "gouv", "sch", "gen", "nom", "asso",
    "ne", "or", "go", "tm", "fm", "ag", "comm", "ltd", "plc", "ed", "ad", "presse", "med",
)


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone; other letters stay."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def is_second_level(label: Column) -> Column:
    return label.isin(*SECOND_LEVEL)


def normalize_domain(url: Column) -> Column:
    """The registrable domain of a URL or host name.

    In order: A-Z to lower case; drop up to the first ``://``, then up to the last ``@``; cut at the
    first of ``/ ? # ;``; an address in brackets with a colon is returned bare; cut at the first colon;
    trim dots. Names of digits alone stay. Otherwise the last two labels stay, or three under a
    two-letter top level with a second-level registry; repeated dots collapse. Null counts as empty.
    """
    s = ascii_lower(F.coalesce(url, F.lit("")))
    s = F.regexp_replace(s, r"(?s)^.*?://", "")
    s = F.regexp_replace(s, r"(?s)^.*@", "")
    s = F.regexp_replace(s, r"(?s)[/?#;].*$", "")
    address = F.regexp_extract(s, r"(?s)^\[([^\]]*:[^\]]*)\]", 1)
    host = F.regexp_replace(F.regexp_replace(s, r"(?s):.*$", ""), r"^\.+|\.+$", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    top, second = F.get(labels, n - 1), F.get(labels, n - 2)
    keep = F.when(top.rlike("^[a-z]{2}$") & (n >= 3) & is_second_level(second), 3).otherwise(2)
    kept = F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep)
    digits = F.forall(labels, lambda x: x.rlike("^[0-9]+$"))
    return (
        F.when(address != "", address)
        .when(n == 0, F.lit(""))
        .when(digits, host)
        .otherwise(F.array_join(kept, "."))
    )


def reverse_bytes(c: Column) -> Column:
    """The bytes of a string or binary in reverse, as binary; any bytes are fine."""
    one = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.encode(F.reverse(one), "ISO-8859-1")


def has_scheme(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Letters that two strings share from the start; 0 if one is null."""
    least = F.least(F.length(a), F.length(b))
    places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    same = F.aggregate(
        places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n)
    )
    return F.coalesce(same, F.lit(0))


def common_suffix_length(a: Column, b: Column) -> Column:
    return common_prefix_length(F.reverse(a), F.reverse(b))


def readable_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals, the exact value's nearest; ties go to the even digit."""
    n = n.cast("long")

    def text(bits: int, unit: str) -> Column:
        rest = n.bitwiseAND(F.lit((1 << bits) - 1)) * 100
        part, left = F.shiftright(rest, bits), rest.bitwiseAND(F.lit((1 << bits) - 1))
        half = 1 << (bits - 1)
        part = part + F.when((left > half) | ((left == half) & (part % 2 == 1)), 1).otherwise(0)
        whole = F.shiftright(n, bits) + F.when(part == 100, 1).otherwise(0)
        return F.concat(whole.cast("string"), F.lit("."), F.lpad((part % 100).cast("string"), 2, "0"), F.lit(unit))

    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, text(10, " KB"))
        .when(n < 1 << 30, text(20, " MB"))
        .otherwise(text(30, " GB"))
    )


def little_endian_length(c: Column) -> Column:
    """The length of a binary as four bytes, least first."""
    return F.encode(F.reverse(F.decode(F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), "ISO-8859-1")), "ISO-8859-1")
