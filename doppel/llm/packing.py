"""Packing along a space-filling curve.

Words hashed to signs project every document to DIMS dimensions (scaled by the square root of its words); the cells of a
grid of 2**LEVEL steps in each are ordered by a Hilbert curve. Documents are dealt to ranges of the curve, sorted there,
tokenised and laid out end to end; a sequence is a stretch of `size` ids. What a range leaves over is cut into stretches of
a power of two, so that nothing is padded. There are as many ranges as the session has shuffle partitions, and more where
they would hold over RANGE_BYTES of text. Their bounds come from some SAMPLE documents at random, or PER_RANGE for each range
if that is more; they place documents only, and a key that fills several ranges is spread over all of them.

Defined results: a null text is empty; an empty text is its end id alone; repeated rows are packed each; documents with null
ids are packed too; other columns, of any name, are ignored; an empty table gives no rows. A text is tokenised whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import shared, tokens

SIZE, END = 1024, 0
DIMS, LEVEL = 4, 8
SAMPLE, PER_RANGE = 20_000, 32
RANGE_BYTES = 64 << 20


def hilbert(cells: np.ndarray, level: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of coordinates below 2**level (transposed form, then bits interleaved)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (level - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    bit = 1 << (level - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(level - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert keys of texts; a text without words is at the middle of the grid."""
    lower = pc.utf8_lower(texts)
    _, offs = shared.text_buffer(lower)
    out = []
    for i, j in shared.slices(offs):
        raw, own = shared.text_buffer(lower.slice(i, j - i))
        sums, a, b, first = shared.words(raw, own)
        h = shared.mix(shared.WORDS.between(sums, a, b))
        count = np.diff(first)
        some = np.flatnonzero(count)
        v = np.zeros((j - i, DIMS))
        for d in range(DIMS):
            sign = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) - 32767.5
            if len(some):
                v[some, d] = np.add.reduceat(sign, first[some]) / np.sqrt(count[some]) / 18918
        # an even spread over the grid
        out.append(hilbert(np.clip(((np.tanh(0.8 * v) + 1) / 2 * (1 << LEVEL)).astype(np.int64), 0, (1 << LEVEL) - 1), LEVEL))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def lanes(spark: SparkSession, count: int) -> list[int]:
    """For each partition of a hash partitioning by an int, a value that goes there."""
    rows = spark.range(32 * count).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(count)).alias("p")).agg(F.min("v").alias("v")).collect()
    of = {r["p"]: r["v"] for r in rows}
    return [of.get(p, p) for p in range(count)]


def even_bounds(keys: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """Keys that part the sample evenly, rows and bytes weighing alike."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    weight = np.cumsum(1 + size[order] / max(1.0, size.mean()))
    at = np.searchsorted(weight, weight[-1] * np.arange(1, count) / count)
    return keys[order][np.minimum(at, len(keys) - 1)]


def along_curve(docs: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """Rows (_id, _text, extra) dealt to ranges of the curve and sorted there."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), shared.whole_text(text_col).alias("_text"), *extra)
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text").cast("long"))).first()
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    share = min(1.0, max(SAMPLE, PER_RANGE * count) / max(1, total))
    at = len(rows.columns)

    def key_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(b.column(0))), pa.array(np.diff(shared.text_buffer(b.column(0))[1]))], names=["key", "bytes"])

    sample = rows.select("_text").sample(share, 4).mapInArrow(shared.trimmed(key_only), "key long, bytes long").toArrow()
    bounds = even_bounds(sample["key"].to_numpy(), sample["bytes"].to_numpy(), count)
    shipped = spark.sparkContext.broadcast((bounds, np.array(lanes(spark, count), np.int32)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, lane = shipped.value
        for b in batches:
            key, spread = curve_keys(b.column(1)), b.column(at).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
            part = lane[low + np.abs(spread) % (high - low + 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at + 1)), pa.array(key), pa.array(part)], names=[*b.schema.names, "_key", "_part"])

    spread = rows.withColumn("_spread", F.pmod(F.xxhash64("_id", F.length("_text"), F.lit(1)), F.lit(1 << 40)))
    schema = spread.withColumns({"_key": F.lit(0).cast("long"), "_part": F.lit(0).cast("int")}).schema
    return spread.mapInArrow(shared.trimmed(deal), schema).repartition(count, "_part").sortWithinPartitions("_part", "_key", "_spread").drop("_spread", "_part")


def split_tail(tail: list[list[int]], left: int) -> list[tuple[list[int], int, int, int, int]]:
    """Pieces of an unfilled sequence of `left` ids, cut again into sequences of powers of two: (piece, start in it, length, sequence, offset)."""
    sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    out, seq, at = [], 0, 0
    for p in tail:
        start = 0
        while start < p[2]:
            take = min(p[2] - start, sizes[seq] - at)
            out.append((p, start, take, seq, at))
            start += take
            at += take
            if at == sizes[seq]:
                seq, at = seq + 1, 0
    return out


def pack(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `keep_ids` the ids."""
    path = tokenizer or tokens.default_path()
    fast = tokens.agreed(path)
    kind = docs.select(F.col(id_col).alias("i")).schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, fast)
        base = TaskContext.get().partitionId() << 40
        seq, at, tail = 0, 0, []

        def rows_of(rows: list, ids_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [ids_type, *[pa.int64()] * 6, pa.binary()]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            keep = range(8) if keep_ids else range(7)
            return pa.RecordBatch.from_arrays([pa.array(cols[k], kinds[k]) for k in keep], names=[names[k] for k in keep])

        ids_type = None
        for b in batches:
            ids_type = b.column(0).type
            done = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    take = min(n - start, size - at)
                    part = ids[start : start + take]
                    tail.append((doc, start, take, part, n, at))
                    start, at = start + take, at + take
                    if at == size:
                        done += [(d, s, k, zlib.crc32(x), total, base + seq, o, x.tobytes() if keep_ids else None) for d, s, k, x, total, o in tail]
                        seq, at, tail = seq + 1, 0, []
            yield rows_of(done, ids_type)
        if tail:
            done = []
            for p, s, k, q, o in split_tail(tail, at):
                part = p[3][s : s + k]
                done.append((p[0], p[1] + s, k, zlib.crc32(part), p[4], base + seq + q, o, part.tobytes() if keep_ids else None))
            yield rows_of(done, ids_type)

    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if keep_ids else "")
    return along_curve(docs, id_col, text_col, []).select("_id", "_text").mapInArrow(shared.trimmed(run), schema)
