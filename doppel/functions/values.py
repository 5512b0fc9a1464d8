"""Casts, times, call data and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The chain's first second, and seconds of a block in the replay clock.
GENESIS, BLOCK_SECONDS = 1438214400, 12
#: Method selectors of token transfers.
TRANSFER, TRANSFER_FROM = "a9059cbb", "23b872dd"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def block_to_time(c) -> Column:
    return F.timestamp_seconds(F.lit(GENESIS) + F.lit(BLOCK_SECONDS) * _col(c))


def time_to_block(c) -> Column:
    return F.greatest(F.lit(0), F.round((F.unix_micros(_col(c)) / 1e6 - GENESIS) / BLOCK_SECONDS)).cast("long")


def to_bool(c) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))).isin("t", "true", "1", "y", "yes"), F.lit(False))


def to_double(c) -> Column:
    """Blank, bad and nan are 0; infinities pass."""
    x = F.trim(_col(c))
    number = F.when(F.lower(x).isin("inf", "+inf", "infinity"), float("inf")).when(F.lower(x).isin("-inf", "-infinity"), float("-inf")).otherwise(x.try_cast("double"))
    return F.nanvl(F.coalesce(number, F.lit(0.0)), F.lit(0.0))


def to_long(c) -> Column:
    x = F.trim(_col(c))
    return F.coalesce(x.try_cast("long"), x.try_cast("double").try_cast("long"), F.lit(0))


def scale(raw, decimals) -> Column:
    return F.when(_col(decimals) > 0, _col(raw) / F.pow(F.lit(10.0), _col(decimals))).otherwise(_col(raw))


def safe_div(a, b) -> Column:
    return F.when(_col(b) == 0, F.lit(0.0)).otherwise(_col(a) / _col(b))


def logit(p, eps: float = 1e-12) -> Column:
    x = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _col(p)))
    return F.ln(x / (1 - x))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def hex_to_double(c, words: int = 8) -> Column:
    """Up to 64 hexadecimal digits as a double, by limbs of 32 bits; blank or bad is 0."""
    body = F.regexp_replace(F.lower(F.trim(_col(c))), "^0x", "")
    padded = F.lpad(body, 8 * words, "0")
    total = F.lit(0.0)
    for w in range(words):
        total = total * 4294967296.0 + F.conv(F.substring(padded, 8 * w + 1, 8), 16, 10).cast("double")
    return F.when(body.rlike("^[0-9a-f]{1,64}$"), total).otherwise(F.lit(0.0))


def hex_quantity(c) -> Column:
    """0x and no leading zeros."""
    body = F.ltrim(F.regexp_replace(F.lower(F.trim(_col(c))), "^0x", ""), F.lit("0"))
    return F.concat(F.lit("0x"), F.when(body == "", "0").otherwise(body))


def with_0x(c) -> Column:
    x = F.lower(F.trim(_col(c)))
    return F.when(x.startswith("0x"), x).otherwise(F.concat(F.lit("0x"), x))


def transfer_call(data) -> Column:
    """struct(from_addr, to_addr, amount_hex) of a transfer or transferFrom call, else null. A plain transfer has no from_addr."""
    x = F.regexp_replace(F.lower(F.trim(_col(data))), "^0x", "")
    word = lambda k: F.substring(x, 9 + 64 * k, 64)
    address = lambda k: F.right(word(k), F.lit(40))
    plain = F.struct(F.lit(None).cast("string").alias("from_addr"), address(0).alias("to_addr"), word(1).alias("amount_hex"))
    behalf = F.struct(address(0).alias("from_addr"), address(1).alias("to_addr"), word(2).alias("amount_hex"))
    return F.when(F.startswith(x, F.lit(TRANSFER)) & (F.length(x) >= 136), plain).when(F.startswith(x, F.lit(TRANSFER_FROM)) & (F.length(x) >= 200), behalf)


def abi_uint(c) -> Column:
    return hex_to_double(F.right(F.lpad(F.regexp_replace(F.lower(_col(c)), "^0x", ""), 64, "0"), F.lit(64)))


def abi_string(c) -> Column:
    """A text of ABI data: one static word, or offset, length and bytes. Zero bytes at the end go; null if it is no UTF-8."""
    x = F.regexp_replace(F.lower(_col(c)), "^0x", "")
    size = F.conv(F.substring(x, 65 + 48, 16), 16, 10).cast("int")
    dynamic = F.substr(x, F.lit(129), 2 * size)
    static = F.regexp_replace(x, "(00)+$", "")
    raw = F.when(F.length(x) <= 64, static).otherwise(dynamic)
    return F.rtrim(F.try_validate_utf8(F.try_to_binary(raw, F.lit("hex")).cast("string")), F.lit("\0"))


def is_poisoning() -> Column:
    return F.col("tiny_transfer") | F.col("zero_value_transfer") | F.col("counterfeit_token_transfer")


def label_class() -> Column:
    """The first that holds, in this order."""
    names = (("zero_value_transfer", "zero_value"), ("tiny_transfer", "tiny"), ("counterfeit_token_transfer", "counterfeit_token"), ("intended_transfer", "intended"))
    out = None
    for flag, name in names:
        out = F.when(F.col(flag), name) if out is None else out.when(F.col(flag), name)
    return out.when(F.col("payoff_transfer") | F.col("payoff_transfer_unconfirmed"), "payoff").otherwise("other")


def is_negative() -> Column:
    return F.col("intended_transfer") & ~is_poisoning() & ~F.col("payoff_transfer") & ~F.col("payoff_transfer_unconfirmed")
