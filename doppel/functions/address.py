"""Addresses and tokens as columns. Canonical: 40 lower-case hexadecimal digits without 0x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_address(c) -> Column:
    """Null unless the text, trimmed and lower-cased, is 40 digits after at most one 0x."""
    found = F.regexp_extract(F.lower(F.trim(_col(c))), "^(?:0x)?([0-9a-f]{40})$", 1)
    return F.when(found != "", found)


def normalize_token(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(c))), "^0x", "")


def prefix_key(c, depth: int) -> Column:
    return F.left(_col(c), F.lit(max(0, depth)))


def suffix_key(c, depth: int) -> Column:
    return F.right(_col(c), F.lit(max(0, depth)))


def prefix_match(a, b, most: int = 40) -> Column:
    """Length of the common beginning, `most` at most: comparisons that the JVM compiles, no lambda."""
    return sum((F.left(_col(a), F.lit(d)) == F.left(_col(b), F.lit(d))).cast("int") for d in range(1, most + 1))


def suffix_match(a, b, most: int = 40) -> Column:
    return sum((F.right(_col(a), F.lit(d)) == F.right(_col(b), F.lit(d))).cast("int") for d in range(1, most + 1))


def pack(c) -> Column:
    """An address as 20 bytes, half of what its digits take in a shuffle; any other text as its own bytes after 21 zeros. Equal exactly if the texts are."""
    c = _col(c)
    return F.when(c.rlike("^[0-9a-f]{40}$"), F.unhex(c)).otherwise(F.concat(F.lit(bytes(21)), c.cast("binary")))


def unpack(c) -> Column:
    c = _col(c)
    return F.when(F.octet_length(c) == 20, F.lower(F.hex(c))).otherwise(F.substring(c, 22, 1 << 30).cast("string"))


def pad_topic(c) -> Column:
    return F.lpad(normalize_address(c), 64, "0")


def shard(c, n: int) -> Column:
    """The last 8 digits, modulo n."""
    return F.conv(F.right(_col(c), F.lit(8)), 16, 10).cast("long") % n


def display_code(c) -> Column:
    """The 6 first and 6 last digits as numbers."""
    return F.array(*(F.conv(F.substring(_col(c), p, 1), 16, 10).cast("int") for p in (1, 2, 3, 4, 5, 6, 35, 36, 37, 38, 39, 40)))


def one_hot(code) -> Column:
    """12 digits as 192 zeros and ones."""
    return F.flatten(F.transform(_col(code), lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (k == d).cast("int"))))


def code_distance(a, b) -> Column:
    """Places at which two codes differ."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def split_by_victim(c) -> Column:
    """train, val or test by the first 64 bits of the address's SHA-256, unsigned, modulo 100: 70, 15 and 15."""
    digest = F.sha2(F.regexp_replace(_col(c), "^0x", ""), 256)
    high, low = (F.conv(F.substring(digest, p, 8), 16, 10).cast("long") for p in (1, 9))
    rest = ((high % 100) * 96 + low % 100) % 100
    return F.when(rest < 70, "train").when(rest < 85, "val").otherwise("test")
