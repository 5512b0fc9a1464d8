"""Token-id output: best-fit-decreasing packing, written as binary matrices.

Documents are tokenised once; those beyond `size` ids are split losslessly into full pieces and a rest. Pieces of a block of
about BLOCK_TOKENS ids are packed longest first, each into the open sequence with the least room that still holds it; a
segment tree over room (how many open sequences have it) finds that room in logarithmic time. Blocks end with their task,
so nothing is shuffled and memory is bounded; a lost task writes the same again.

A row is a sequence: ids (little-endian, 16 bits if the vocabulary allows, padded with `pad` to `size`), cumulative segment
lengths (0, ..., number of ids), position resets (each id's place in its segment), and the segments' documents and starts.

Defined results: a null text is empty; every document ends with `end`, so an empty one is that id alone; repeated rows and
rows with null ids are packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm import shared, tokens

SIZE, END, PAD = 1024, 50256, 0
BLOCK_TOKENS = 1 << 20


class Room:
    """A segment tree over 0 .. size: how many open sequences have so much room."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.tree[k] += n
            k >>= 1

    def least(self, need: int) -> int:
        """The least room of `need` or more that an open sequence has; -1 if none has."""
        k = need + self.leaves
        if self.tree[k]:
            return need
        while k > 1:  # up until a right-hand neighbour has any, then down to its least
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.leaves:
                    k *= 2
                    if not self.tree[k]:
                        k += 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the pieces in each sequence. Longest first, equal lengths in their order; of equal rooms the latest opened."""
    room, open_, out = Room(size), [[] for _ in range(size + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        r = room.least(n)
        if r < 0:
            out.append([])
            s, r = len(out) - 1, size
        else:
            s = open_[r].pop()
            room.add(r, -1)
        out[s].append(i)
        if r - n:
            open_[r - n].append(s)
            room.add(r - n, 1)
    return out


def pack(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, pad: int = PAD, wide: bool = False) -> DataFrame:
    """Sequences (see the module): sequence_id, n_tokens, ids, positions, cu_seqlens, doc_ids, starts."""
    path = tokenizer or tokens.default_path()
    fast = tokens.agreed(path)
    rows = docs.select(F.col(id_col).alias("_id"), shared.whole_text(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    number = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, fast)
        seq = TaskContext.get().partitionId() << 40
        parts: list[tuple] = []
        held = 0
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal seq, parts, held
            bins = best_fit([len(p[2]) for p in parts], size)
            ids, place = np.full((len(bins), size), pad, number), np.zeros((len(bins), size), np.dtype("<u2") if size <= 65536 else np.dtype("<u4"))
            cum, owner, start, used = [], [], [], []
            for k, members in enumerate(bins):
                at, c = 0, [0]
                for i in members:
                    n = len(parts[i][2])
                    ids[k, at : at + n] = parts[i][2]
                    place[k, at : at + n] = np.arange(n)
                    at += n
                    c.append(at)
                cum.append(c)
                owner.append([parts[i][0] for i in members])
                start.append([parts[i][1] for i in members])
                used.append(at)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(seq, seq + len(bins))), pa.array(used, pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in place], pa.binary()),
                 pa.array(cum, pa.list_(pa.int32())), pa.array(owner, pa.list_(id_type)), pa.array(start, pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts"],
            )
            seq, parts, held = seq + len(bins), [], 0
            return out

        for b in batches:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end))
                if not wide and ids.max() > 65535:
                    raise ValueError("this vocabulary needs wide=True")
                ids = ids.astype(number)
                for s in range(0, len(ids), size):
                    parts.append((doc, s, ids[s : s + size]))
                    held += min(size, len(ids) - s)
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if parts:
            yield flush()

    return rows.mapInArrow(shared.trimmed(run), f"sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, starts array<long>")


def write(docs: DataFrame, path: str, **options) -> DataFrame:
    """Packs `docs`, writes the sequences as Parquet at `path`, and reads them back."""
    packed = pack(docs, **options)
    packed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)
