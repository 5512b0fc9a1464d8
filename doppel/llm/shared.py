"""What the operators of this subpackage share: tables, cut points, Arrow batches and byte hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.session import shared_folder, ship

#: Rows of one Arrow batch; texts of a batch are worked on in slices of SLICE_BYTES.
BATCH_ROWS = 1024
SLICE_BYTES = 1 << 18
BATCH_BYTES = 16 << 20

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Sends the package, and keeps the batches handed to Python small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/doppel-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: written to the shared folder as Parquet and reread, so that a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def fresh(name: str, taken) -> str:
    """A column name like `name` that isn't taken."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- Arrow batches


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and the offsets of its rows (one more than rows). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer text is a range of its own, never cut."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of `values`, of the given lengths."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def trimmed(run):
    """A function over Arrow batches whose worker gives freed memory back when it is done: workers are used again and again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes of any substring from prefix sums modulo 2**64; `seed` picks base and byte codes."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 57, 1 << 60)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << max(16, int(n - 1).bit_length())
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        """Prefix sums, one more than bytes."""
        self.powers(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of raw[start:end], not yet mixed."""
        self.powers(len(sums))
        return (sums[end] - sums[start]) * self.down[start]


_WORD_BYTE = np.zeros(256, bool)
for _c in range(256):
    _WORD_BYTE[_c] = _c >= 128 or chr(_c).isalnum()
WORDS = Rolling(11)


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of ASCII letters, digits and non-ASCII bytes) of the given lower-case texts.

    Returns prefix sums for WORDS, starts, ends and, for each text and one more, its first word."""
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[:-1] = _WORD_BYTE[raw]
    step = np.diff(inside, prepend=np.int8(0))
    step[0] = inside[0]
    edge = offs[1:-1]  # a text's end closes the word there
    edge = edge[(edge > 0) & (edge < len(raw))]
    edge = np.unique(edge[(inside[edge] == 1) & (inside[edge - 1] == 1)]) if len(edge) else edge
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(edge):
        starts, ends = np.sort(np.concatenate([starts, edge])), np.sort(np.concatenate([ends, edge]))
    return WORDS.prefix(raw), starts, ends, np.searchsorted(starts, offs)
