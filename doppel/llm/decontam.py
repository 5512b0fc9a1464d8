"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

A document holds an item if some region of it is within `rate` * length edits of the item, both lower-cased with every run
of bytes that are no ASCII letter, digit or non-ASCII byte made one space. By the q-gram lemma a region within k edits of
an item of m bytes shares m - q + 1 - k * q of its q-grams, all on diagonals at most 2 k apart. Shared q-grams are counted
in overlapping bands of diagonals, 3 (k + 1) wide and k + 1 apart, so that one band holds them all; bands that meet the
bound are aligned, within the band. q is Q, and SHORT_Q for the items whose bound would be below 1 with Q (10 to 31 bytes,
at the usual rate), so that every item has its whole edit budget. Items of fewer than Q bytes, too short for grams, have no
edits to spare at that rate: they are looked up exactly, as whole words. So nothing is missed.

Items are taken in blocks of about BLOCK_BYTES, each broadcast for one pass over the documents: bounded, whatever the size
of the benchmark. Texts are searched in stretches of STRETCH bytes that overlap by the longest item, and at most HITS shared
grams (or those of one overlap) are held at a time. Nothing is shuffled.

Defined results: items that are null, empty or without a word match nothing; null and empty texts hold nothing; of equal
items each is reported; repeated rows get equal results; other columns are passed by, a column of the name of `found_col`
being replaced; an empty table gives no rows, an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm import shared

Q, SHORT_Q, RATE = 8, 5, 0.1
BLOCK_BYTES = 1 << 20
STRETCH, HITS = 1 << 20, 1 << 21
_FLAGS = 1 << 22


def normalised(lower: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, runs of other bytes made one space; none at a text's beginning."""
    raw, offs = shared.text_buffer(lower)
    word = shared._WORD_BYTE[raw]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[offs[:-1][offs[:-1] < len(raw)]] = False
    keep = word | before
    out = np.where(word, raw, np.uint8(32))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[offs]


@dataclass
class Grams:
    """The q-grams of items, sorted by code."""

    q: int
    code: np.ndarray
    item: np.ndarray
    place: np.ndarray
    flags: np.ndarray


@dataclass
class Items:
    ids: list
    texts: list[bytes]
    edits: np.ndarray
    size: np.ndarray
    grams: list[Grams]
    words: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: codes, sorted, and items of those looked up as whole words


def codes(raw: np.ndarray, q: int = Q) -> np.ndarray:
    """The q <= 8 bytes from each place on, as one number; bytes beyond the end are 0."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    whole = np.lib.stride_tricks.as_strided(padded, (len(raw), 8), (1, 1)).copy().view(np.uint64).reshape(-1)
    return whole if q == 8 else whole & np.uint64((1 << 8 * q) - 1)


def _flag(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).view(np.int64)


def index(rows: list[tuple], rate: float) -> Items:
    raw, offs = normalised(pc.utf8_lower(pa.array([t for _, t in rows], pa.string())))
    own = [bytes(raw[offs[r] : offs[r + 1]]).strip(b" ") for r in range(len(rows))]
    kept = [r for r, t in enumerate(own) if t]
    texts = [own[r] for r in kept]
    size = np.array([len(t) for t in texts], np.int64)
    edits = np.where(size < Q, 0, size * rate).astype(np.int64)
    q_of = np.where(size < Q, 0, np.where(size - Q + 1 - edits * Q >= 1, Q, SHORT_Q))
    edits = np.where(q_of == SHORT_Q, np.minimum(edits, size // SHORT_Q - 1), edits)  # all of them, at the usual rate
    grams = []
    for q in (Q, SHORT_Q):
        some = np.flatnonzero(q_of == q).tolist()
        if some:
            code = [codes(np.frombuffer(texts[i], np.uint8), q)[: size[i] - q + 1] for i in some]
            item, place = np.repeat(some, [len(c) for c in code]), np.concatenate([np.arange(len(c)) for c in code])
            code = np.concatenate(code)
            order = np.argsort(code, kind="stable")
            flags = np.zeros(_FLAGS, bool)
            flags[_flag(code)] = True
            grams.append(Grams(q, code[order], item[order], place[order], flags))
    words = {}
    for n in np.unique(size[q_of == 0]).tolist():
        some = np.flatnonzero((q_of == 0) & (size == n))
        code = np.array([codes(np.frombuffer(texts[i], np.uint8), n)[0] for i in some], np.uint64)
        order = np.argsort(code, kind="stable")
        words[n] = code[order], some[order]
    return Items([rows[r][0] for r in kept], texts, edits, size, grams, words)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edits between the item and a region of the text, along diagonals (place in text - place in item) low .. high; most + 1 if more."""
    width = high - low + 1
    diag = np.arange(low, high + 1)
    cost = np.where((diag >= 0) & (diag <= len(text)), 0, most + 1)
    steps = np.arange(width)
    padded = np.concatenate([np.zeros(max(0, -low), np.uint8), text, np.zeros(max(0, high + len(item) - len(text)), np.uint8)])
    shift = max(0, -low) + low
    for i in range(len(item)):
        at = diag + i
        inside = (at >= 0) & (at < len(text))
        same = np.where(inside, cost + (padded[shift + i : shift + i + width] != item[i]), most + 1)
        skip = np.append(cost[1:], most + 1) + 1  # the item's byte is missing in the text
        new = np.minimum(same, np.where((at + 1 >= 0) & (at + 1 <= len(text)), skip, most + 1))
        cost = np.minimum(np.minimum.accumulate(new - steps) + steps, most + 1)  # bytes that only the text has
        if cost.min() > most:
            return most + 1
    return int(cost.min())


def find(items: Items, lower: pa.Array) -> list[list[int]]:
    """For each text the items (by number) that it holds."""
    found: list[set[int]] = [set() for _ in range(len(lower))]
    if items.ids:
        raw, offs = normalised(lower)
        overlap = int((items.size + items.edits).max()) + Q
        for start in range(0, len(raw), STRETCH):
            stretch = raw[start : start + STRETCH + overlap]
            _whole_words(items, stretch, start, raw, offs, found)
            for g in items.grams:
                _regions(items, g, stretch, start, overlap, raw, offs, found)
    return [sorted(f) for f in found]


def _whole_words(items: Items, stretch: np.ndarray, start: int, raw: np.ndarray, offs: np.ndarray, found: list[set[int]]) -> None:
    if not items.words or not len(stretch):
        return
    code = codes(stretch)
    before = np.empty(len(stretch), np.uint8)
    before[1:], before[0] = stretch[:-1], raw[start - 1] if start else 32
    edge = offs[np.searchsorted(offs, start) : np.searchsorted(offs, start + len(stretch))] - start
    before[edge] = 32
    first = np.flatnonzero((before == 32) & (stretch != 32))
    for n, (known, item) in items.words.items():
        own = code[first] & np.uint64((1 << 8 * n) - 1)
        lo, hi = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            at = start + int(first[k])
            row = int(np.searchsorted(offs, at, "right")) - 1
            if at + n == offs[row + 1] or (at + n < offs[row + 1] and raw[at + n] == 32):
                found[row].update(item[lo[k] : hi[k]].tolist())


def _regions(items: Items, g: Grams, stretch: np.ndarray, start: int, overlap: int, raw: np.ndarray, offs: np.ndarray, found: list[set[int]]) -> None:
    """Items of one q whose region lies in the stretch; parts of it that share HITS grams overlap as the stretches do."""
    code = codes(stretch, g.q)
    at = np.flatnonzero(g.flags[_flag(code)])
    lo, hi = np.searchsorted(g.code, code[at], "left"), np.searchsorted(g.code, code[at], "right")
    some = hi > lo
    at, lo, count = at[some], lo[some], (hi - lo)[some]
    row = np.searchsorted(offs, at + start, "right") - 1
    whole = at + start + g.q <= offs[row + 1]  # not across the end of a text
    at, lo, count, row = at[whole] + start, lo[whole], count[whole], row[whole]
    i, total = 0, np.concatenate([[0], np.cumsum(count)])
    while i < len(at):
        stop = max(int(np.searchsorted(total, total[i] + HITS, "right")) - 1, i + 1)
        j = int(np.searchsorted(at, at[stop - 1] + overlap, "right"))  # what a region that begins before `stop` may reach
        _bands(items, g, at[i:j], lo[i:j], count[i:j], row[i:j], raw, offs, found)
        i = stop


def _bands(items: Items, g: Grams, at: np.ndarray, lo: np.ndarray, count: np.ndarray, row: np.ndarray, raw: np.ndarray, offs: np.ndarray, found: list[set[int]]) -> None:
    hit = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
    item = g.item[hit]
    step = items.edits[item] + 1
    diag = np.repeat(at - offs[row], count) - g.place[hit]
    least = int(row[0])
    owner = np.repeat(row - least, count) * len(items.ids) + item
    bound = items.size - g.q + 1 - items.edits * g.q
    band = diag // step
    for back in range(3):
        key = owner * (1 << 32) + (band - back + (1 << 31))
        keys, n = np.unique(key, return_counts=True)
        who = (keys >> 32) % len(items.ids)
        enough = n >= bound[who]
        for key_, i in zip(keys[enough].tolist(), who[enough].tolist(), strict=True):
            r, b = least + (key_ >> 32) // len(items.ids), (key_ & ((1 << 32) - 1)) - (1 << 31)
            if i in found[r]:
                continue
            k = int(items.edits[i])
            first, last = b * (k + 1), (b + 3) * (k + 1) - 1
            left = max(0, first)
            text = raw[offs[r] + left : min(offs[r + 1], offs[r] + last + len(items.texts[i]))]
            if items.texts[i] in text.tobytes() or aligned(np.frombuffer(items.texts[i], np.uint8), text, first - left, last - left, k) <= k:
                found[r].add(i)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float) -> Iterator[Items]:
    """Indexes over the items, about BLOCK_BYTES of them at a time."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        got = rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield index([(r["i"], r["t"]) for r in got], rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, found_col: str = "items", only_clean: bool = False) -> DataFrame:
    """`docs` with the ids of the items that each holds; with `only_clean` the documents that hold none, as they were."""
    spark = docs.sparkSession
    kind = benchmark.select(F.col(item_id).alias("i")).schema["i"].dataType.simpleString()
    if not only_clean and found_col.lower() == text_col.lower():
        raise ValueError("the result can't take the text's name")
    out = docs if only_clean else docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != found_col.lower()), F.array().cast(f"array<{kind}>").alias(found_col))
    names = list(out.columns)
    for items in blocks(benchmark, item_id, item_text, rate):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lower = pc.utf8_lower(b.column(len(names)))
                _, offs = shared.text_buffer(lower)
                found = [f for i, j in shared.slices(offs) for f in find(shipped.value, lower.slice(i, j - i))]
                cols = [b.column(k) for k in range(len(names))]
                if only_clean:
                    yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array([not f for f in found], pa.bool_()))
                    continue
                if any(found):
                    ids = shipped.value.ids
                    cols[-1] = pa.array([(old or []) + [ids[i] for i in f] for old, f in zip(cols[-1].to_pylist(), found, strict=True)], cols[-1].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

        out = out.select("*", shared.whole_text(text_col).alias(shared.fresh("whole", names))).mapInArrow(shared.trimmed(run), out.schema)
    return out
