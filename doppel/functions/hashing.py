"""Hashes that Spark lacks, as Arrow functions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def stable_u64(texts: pd.Series) -> pd.Series:
    """The first 64 bits of BLAKE2b, big-endian, in decimal."""
    return texts.map(lambda t: None if t is None else str(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")))
