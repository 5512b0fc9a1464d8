"""Suffix-array dedup by prefix-free parsing: bytes covered by a long string that also starts elsewhere are removed.

Rolling hashes of GRAM bytes cut the texts into phrases: the trigger of a window of `length` bytes is its gram of least hash
(leftmost of equals), so that every window holds one and equal windows hold it at the same place. Windows of one trigger
stand together; the text that they span is a phrase of the dictionary, and the parse of a text is its phrases in order.
Suffixes need an order only up to depth `length`: two are neighbours there exactly if their names at that depth are equal
(a name being the rank-free fingerprint that prefix doubling gives a suffix), so classes are grouped instead of sorted.

1. Dictionary: phrases with how often they occur. All windows of a phrase that occurs again are repeated.
2. Phrases that occur once but share their trigger with another may be repeated in part: of each such phrase the text is
   taken up once, and the names of CELL windows' common core, then those of the windows left, are counted.
3. Repeated windows go back to their texts, and what they cover is removed.

Phrases, windows and texts are told by 128 bits: a name and the trigger's, or two hashes of the text. What a task broadcasts
are bitmaps of BITS bits, which only spare shuffles: a wrong hit costs a row, not a result. Highly repetitive texts have few
different phrases, and every count is combined map-side. Texts are parsed in stretches of STRETCH windows, however long.

Defined results: matches never cross documents; null and empty texts, and texts shorter than `length`, lose nothing; equal
texts and repeated rows of at least `length` bytes lose all; other columns, of any name, are passed by; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm import shared

LENGTH, GRAM, CELL = 200, 48, 16
BITS = 25
#: Window starts that are parsed at a time; fewer than _PLACE can tell.
STRETCH = 1 << 22
_ROLL = shared.Rolling(66)
_PLACE = np.uint64((1 << 27) - 1)


def names(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt=0) -> np.ndarray:
    return shared.mix(_ROLL.between(sums, start, end) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def parse(raw: np.ndarray, offs: np.ndarray, length: int):
    """Phrases: (row, lo, hi, trigger), places within `raw`, and the prefix sums. lo and hi are the first and last window start."""
    sums = _ROLL.prefix(raw)
    size = np.diff(offs)
    none = np.zeros(0, np.int64)
    if len(raw) < length or not (size >= length).any():
        return none, none, none, none, sums
    n = len(raw) - GRAM + 1
    at = np.arange(n)
    key = (shared.mix(_ROLL.between(sums, at, at + GRAM)) & ~_PLACE) | at.astype(np.uint64)
    wide, width = length - GRAM + 1, 1
    while width * 2 <= wide:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < wide:
        key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])
    trigger = (key & _PLACE).astype(np.int64)  # of each window start
    row = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    first = np.repeat(np.cumsum(np.maximum(size - length + 1, 0)) - np.maximum(size - length + 1, 0), np.maximum(size - length + 1, 0))
    start = offs[:-1][row] + np.arange(len(row)) - first
    trigger = trigger[start]
    new = np.flatnonzero((np.diff(trigger, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    return row[new], start[new], start[np.append(new[1:], len(row)) - 1], trigger[new], sums


def phrase_names(sums, lo, hi, trigger, length):
    return names(sums, lo, hi + length, trigger - lo), names(sums, trigger, trigger + GRAM)


def phrases(raw: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, trigger, name, core) of the texts, places from a text's own start. A long text is parsed in stretches of
    its own, at whose ends phrases are cut; what two cuts make of one phrase still shares its trigger."""
    out = []
    for i, j in shared.slices(offs, STRETCH):
        end = offs[j] - offs[i]
        for at in range(0, max(end if j == i + 1 else 1, 1), STRETCH):
            own = np.minimum(offs[i : j + 1] - offs[i], at + STRETCH + length - 1) - at if j == i + 1 else offs[i : j + 1] - offs[i]
            own[0] = 0
            row, lo, hi, trigger, sums = parse(raw[offs[i] + at : offs[i] + at + own[-1]], own, length)
            if len(row):
                base = own[row] - at
                name, core = phrase_names(sums, lo, hi, trigger, length)
                out.append((row + i, lo - base, hi - base, trigger - base, name.view(np.int64), core.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---------------------------------------------------------------- bitmaps


def bitmap(rows: DataFrame, col: str) -> np.ndarray:
    """A bit for each value of a long column, at its lowest BITS bits: a fixed size, whatever the rows."""
    low = F.col(col).bitwiseAND((1 << BITS) - 1)
    got = rows.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast({col} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & ((1 << BITS) - 1)
    return (bits[low >> 6] >> (low & 63)) & 1 == 1


def _within(rows: DataFrame, bits: np.ndarray, col: str, keep: bool = True) -> DataFrame:
    """Rows whose value has its bit set (or hasn't)."""
    shipped, at = rows.sparkSession.sparkContext.broadcast(bits), rows.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(shipped.value, b.column(at).to_numpy(zero_copy_only=False)) == keep))

    return rows.mapInArrow(shared.trimmed(run), rows.schema)


# ---------------------------------------------------------------- the operator


def repeated(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(node, twin, lo, hi): of each text with a repeated window, first and last starts of runs of such windows (places in bytes)."""
    spark = docs.sparkSession
    texts = docs.select(*(c.alias(n) for n, c in text_key(text_col).items()), shared.whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = shared.text_buffer(b.column(2))
            for i, j in shared.slices(offs):
                row, lo, hi, _, name, core = phrases(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
                if not len(row):
                    continue
                some, counts = np.unique(row, return_counts=True)
                at = pa.array(some + i)
                lists = [shared.list_column(x, counts, k) for x, k in ((lo.astype(np.int32), pa.int32()), (hi.astype(np.int32), pa.int32()), (name, pa.int64()), (core, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *lists], names=["node", "twin", "lo", "hi", "name", "core"])

    parsed = shared.cut(texts.mapInArrow(shared.trimmed(run), "node long, twin long, lo array<int>, hi array<int>, name array<long>, core array<long>"), "parse")
    occurrences = parsed.select("node", F.explode(F.arrays_zip("name", "core")).alias("p")).select("node", "p.*")
    dictionary = shared.cut(occurrences.groupBy("name", "core").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")), "dictionary")
    again = dictionary.filter("n > 1").select("name", "core")
    bits = spark.sparkContext.broadcast(bitmap(again, "name"))

    def unnest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(k) for k in range(2, 6)]
            count = np.diff(lists[0].offsets.to_numpy())
            lo, hi, name, core = (x.flatten().to_numpy() for x in lists)
            hit = np.flatnonzero(marked(bits.value, name))
            node, twin = (np.repeat(b.column(k).to_numpy(), count)[hit] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, twin, lo[hit], hi[hit], name[hit], core[hit])], names=["node", "twin", "lo", "hi", "name", "core"])

    runs = parsed.mapInArrow(shared.trimmed(unnest), "node long, twin long, lo int, hi int, name long, core long").join(again, ["name", "core"]).select("node", "twin", "lo", "hi")
    # phrases that occur once and share their trigger with another phrase
    shares = shared.cut(dictionary.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("core"), "shares")
    wanted = _within(dictionary, bitmap(shares, "core"), "core").join(shares, "core", "left_semi")
    wanted = shared.cut(wanted.groupBy("node").agg(F.collect_list(F.struct("name", "n")).alias("want")), "wanted")
    asked = _within(texts, bitmap(wanted, "node"), "node").join(wanted, "node").select("node", "twin", "text", F.transform("want", lambda x: x["name"]).alias("name"), F.transform("want", lambda x: x["n"]).alias("n"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = shared.text_buffer(b.column(2))
            out = {k: [] for k in ("node", "twin", "name", "core", "lo", "hi", "at", "n")}
            spans = []
            nodes, twins, want_names, want_n = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3), b.column(4)
            for r in range(b.num_rows):
                text = raw[offs[r] : offs[r + 1]]
                _, lo, hi, trigger, name, core = phrases(text, np.array([0, len(text)]), length)
                w = want_names[r].values.to_numpy()
                order = np.argsort(w)
                at = np.searchsorted(w[order], name)
                at[at == len(w)] = 0
                hit = np.flatnonzero(w[order][at] == name)
                _, one = np.unique(name[hit], return_index=True)  # a phrase that the text holds twice is taken once
                hit = hit[one]
                for k, x in (("node", np.full(len(hit), nodes[r])), ("twin", np.full(len(hit), twins[r])), ("name", name[hit]), ("core", core[hit]), ("lo", lo[hit]), ("hi", hi[hit]), ("at", trigger[hit] - lo[hit]), ("n", want_n[r].values.to_numpy()[order][at[hit]])):
                    out[k].append(x)
                spans += [text[a : c + length].tobytes() for a, c in zip(lo[hit], hi[hit], strict=True)]
            got = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
            for i in range(0, len(spans), 8192):
                yield pa.RecordBatch.from_arrays([*(pa.array(got[k][i : i + 8192].astype(np.int64)) for k in out), pa.array(spans[i : i + 8192], pa.binary())], names=[*out, "span"])

    # equal texts give equal rows: one of them stays
    spans = asked.mapInArrow(shared.trimmed(take), "node long, twin long, name long, core long, lo long, hi long, at long, n long, span binary").dropDuplicates(["node", "twin", "name", "core"])
    spans = shared.cut(spans, "spans")

    def cells(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {k: b.column(b.schema.get_field_index(k)) for k in b.schema.names}
            raw, offs = shared.text_buffer(col["span"])
            if not len(raw):
                continue
            sums = _ROLL.prefix(raw)
            size, at = np.diff(offs), col["at"].to_numpy()
            windows = size - length + 1  # starts 0 .. windows - 1; behind the trigger by at - start
            far, near = at // CELL, (at - windows + 1) // CELL  # cells, counted back from the trigger
            count = far - near + 1
            row = np.repeat(np.arange(len(size)), count)
            cell = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            last = at[row] - CELL * cell  # the last start of the cell, CELL - 1 after its first
            if not deep:
                begin = offs[:-1][row] + last
                code = names(sums, begin, begin - CELL + 1 + length, cell + 1000)
                yield pa.RecordBatch.from_arrays([_as_long(code), *(col[c].take(pa.array(row)) for c in ("core", "n", "node", "name")), pa.array(cell.astype(np.int32))], names=["code", "core", "n", "node", "name", "cell"])
            else:
                lists = col["cells"]
                owner = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
                some = np.isin(row * 4096 + cell + 1024, owner * 4096 + lists.flatten().to_numpy() + 1024)
                row, last = row[some], last[some]
                start = (last[:, None] - np.arange(CELL)[None, :]).reshape(-1)
                row = np.repeat(row, CELL)
                ok = (start >= 0) & (start < windows[row])
                row, start = row[ok], start[ok]
                begin = offs[:-1][row] + start
                code = names(sums, begin, begin + length, at[row] - start)
                place = (col["lo"].to_numpy()[row] + start).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_as_long(code), *(col[c].take(pa.array(row)) for c in ("core", "n", "node", "twin")), pa.array(place)], names=["code", "core", "n", "node", "twin", "place"])

    def shared_codes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("code", "core").agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("`all` > 1 and least = 1").select("code", "core")

    key = ["code", "core"]
    coarse = spans.select("node", "name", "core", "at", "n", "span").mapInArrow(shared.trimmed(lambda b: cells(b, False)), "code long, core long, n long, node long, name long, cell int")
    coarse = shared.cut(coarse, "cells")
    chosen = coarse.join(shared.cut(shared_codes(coarse), "codes"), key, "left_semi").groupBy("node", "name", "core").agg(F.collect_set("cell").alias("cells"))
    fine = spans.join(chosen, ["node", "name", "core"]).select("node", "twin", "core", "lo", "at", "n", "span", "cells").mapInArrow(shared.trimmed(lambda b: cells(b, True)), "code long, core long, n long, node long, twin long, place int")
    fine = shared.cut(fine, "windows")
    points = fine.filter("n = 1").join(shared.cut(shared_codes(fine), "codes"), key, "left_semi").select("node", "twin", F.col("place").alias("lo"), F.col("place").alias("hi"))
    marks = runs.unionByName(points).groupBy("node", "twin").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    return shared.cut(marks.select("node", "twin", F.transform("marks", lambda x: x["lo"]).alias("lo"), F.transform("marks", lambda x: x["hi"]).alias("hi")), "marks")


def text_key(text_col: str) -> dict:
    """What tells a text: two hashes of 64 bits."""
    return {"node": F.xxhash64(shared.whole_text(text_col)), "twin": F.xxhash64(shared.whole_text(text_col), F.lit(1))}


def covered(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows starting at lo .. hi cover."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + length)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.append(first[1:], len(end)) - 1]


def remove(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """`docs` without the repeated bytes. With `digest`, instead of the text: n_bytes, n_removed, n_spans and the kept bytes' sha256
    (columns of these names are replaced).

    A character of which bytes go is left out whole. Texts that lose nothing aren't shuffled."""
    marks = repeated(docs, text_col=text_col, length=length)
    bits = bitmap(marks, "node")
    told = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} if digest else {}
    names_ = [c for c in docs.columns if c != text_col and c.lower() not in told]
    kept_ = [F.col(f"`{c}`") for c in names_]
    text, node, twin, m1, m2, lo_, hi_ = (shared.fresh(n, [*names_, *told]) for n in ("text", "node", "twin", "of_node", "of_twin", "lo", "hi"))
    key = text_key(text_col)
    rows = docs.select(*kept_, shared.whole_text(text_col).alias(text), key["node"].alias(node), key["twin"].alias(twin))
    schema = docs.select(*kept_, *(F.lit(None).cast(t).alias(c) for c, t in told.items())).schema if digest else docs.schema
    m = marks.select(F.col("node").alias(m1), F.col("twin").alias(m2), F.col("lo").alias(lo_), F.col("hi").alias(hi_))
    touched = _within(rows, bits, node).join(m, (F.col(f"`{node}`") == F.col(f"`{m1}`")) & (F.col(f"`{twin}`") == F.col(f"`{m2}`")), "left").select(*kept_, *(F.col(f"`{c}`") for c in (text, lo_, hi_)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(names_)
            raw, offs = shared.text_buffer(b.column(k))
            out = []
            for r in range(b.num_rows):
                whole, lo = raw[offs[r] : offs[r + 1]], b.column(k + 1)[r]
                if lo.is_valid:
                    starts, ends = covered(lo.values.to_numpy(), b.column(k + 2)[r].values.to_numpy(), length)
                    edges = zip(np.concatenate([[0], ends]).tolist(), np.concatenate([starts, [len(whole)]]).tolist(), strict=True)
                    left, n_spans = b"".join(whole[i:j].tobytes() for i, j in edges), len(starts)
                else:
                    left, n_spans = whole.tobytes(), 0
                out.append((len(whole), len(whole) - len(left), n_spans, hashlib.sha256(left).hexdigest()) if digest else left.decode("utf-8", "ignore"))
            if digest:
                cols = list(zip(*out, strict=True)) or [()] * 4
                more = {c: pa.array(x, pa.string() if t == "string" else pa.int64()) for (c, t), x in zip(told.items(), cols, strict=True)}
            else:
                more = {text_col: pa.array(out, pa.string())}
            have = {c: b.column(i) for i, c in enumerate(names_)} | more
            yield pa.RecordBatch.from_arrays([have[f.name] for f in schema], names=[f.name for f in schema])

    untouched = _within(rows, bits, node, keep=False)
    if digest:
        whole = F.col(f"`{text}`")
        plain = (F.octet_length(whole).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(whole.cast("binary"), 256))
        untouched = untouched.select(*kept_, *(c.alias(n) for n, c in zip(told, plain, strict=True)))
    else:
        untouched = untouched.select(*(F.col(f"`{text}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
    return touched.mapInArrow(shared.trimmed(run), schema).unionByName(untouched)
