"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are SHINGLE consecutive words (a text of fewer words is one shingle). A shingle's weight is (1 + ln tf) * idf. The
document frequencies of all documents are counted in IDF_BUCKETS hashed buckets (a table of fixed size); idf runs from 1 to
1 + IDF_SPAN, evened to a tenth of that: shingles rarer than a bucket's usual load weigh alike, those of boilerplate less.
The span is small so that the weighted similarity stays close to the plain one.

Equal texts are one node throughout, told by 128 bits. Each node gets HASHES samples (the least of a consistent weighted
hash over its shingles), BANDS of ROWS. A bucket of a band isn't expanded into pairs:

1. Stars. The members are verified against the bucket's most central node, in tasks of at most about BLOCK members.
2. Blocks. Where that leaves several components in a bucket, every pair of members of different components is verified, in
   tasks of two blocks, whatever the bucket's size; a pair that meets in several bands is compared in the first of them.

So every pair of a bucket that is similar ends in one class. Links are pairs of similarity >= threshold by the exact
weights; classes are their connected components.

Defined results: every row gets a class id, the least document id of the class (null if all ids are null). Null and empty
texts, and texts without a word, are classes of their own rows (class id = own id). Repeated rows and rows with equal texts
share a class. Other columns, of any name, are ignored; an empty table gives no rows. A text is worked on whole, in memory
of some 40 times its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm import shared
from doppel.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 6
HASHES = BANDS * ROWS
IDF_BUCKETS, IDF_SPAN, IDF_STEPS = 1 << 16, 0.1, 10
SLOTS = 1 << 13
#: Members and bytes of text of a block: a task compares two blocks, or a block with one text.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Columns of the dense matrices that a task multiplies at a time.
COLUMNS = 4096

_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(lower: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text (44-bit hashes, ascending), how often each occurs, and the first of each text."""
    raw, offs = shared.text_buffer(lower)
    n = len(offs) - 1
    sums, a, b, first = shared.words(raw, offs)
    w = shared.mix(shared.WORDS.between(sums, a, b))
    count = np.diff(first)
    acc = w * np.uint64(1)
    p = _P
    for j in range(1, SHINGLE):
        acc[: len(w) - j] += w[j:] * p if j < len(w) else np.uint64(0)
        p = np.uint64(int(p) * int(_P) & shared._MASK)
    row = np.repeat(np.arange(n), count)
    place = np.arange(len(w)) - np.repeat(first[:-1], count)
    keep = place <= np.maximum(count[row] - SHINGLE, 0)
    for r in np.flatnonzero((count > 0) & (count < SHINGLE)):  # one shingle of all words
        h = np.full(1, count[r], np.uint64)
        for x in w[first[r] : first[r + 1]]:
            h = shared.mix((h + x) * _P)
        acc[first[r]] = h[0]
    key = (row[keep].astype(np.uint64) << np.uint64(44)) | (shared.mix(acc[keep]) >> np.uint64(20))
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    uniq = key[new]
    return uniq & np.uint64((1 << 44) - 1), tf, np.searchsorted(uniq, np.arange(n + 1).astype(np.uint64) << np.uint64(44))


def scattered(h: np.ndarray) -> np.ndarray:
    return shared.mix(h * _P + np.uint64(3))


def idf_table(docs: DataFrame, text_col: str) -> np.ndarray:
    """idf of each bucket, from all documents (one count for each document and different shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(IDF_BUCKETS, np.int64), 0
        for b in batches:
            lower = pc.utf8_lower(b.column(0))
            _, offs = shared.text_buffer(lower)
            rows += len(lower)
            for i, j in shared.slices(offs):
                df += np.bincount((scattered(shingles(lower.slice(i, j - i))[0]) >> np.uint64(48)).astype(np.int64), minlength=IDF_BUCKETS)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], rows))], names=["bucket", "n"])

    counts = docs.select(shared.whole_text(text_col).alias("_t")).mapInArrow(shared.trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, rows = np.zeros(IDF_BUCKETS), 0
    for r in counts:
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    usual = max(1.0, df.sum() / IDF_BUCKETS)
    rel = np.log1p(rows / np.maximum(df, usual)) / np.log1p(max(rows, 1) / usual)
    return (1 + IDF_SPAN * np.round(rel * IDF_STEPS) / IDF_STEPS).astype(np.float32)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf[(scattered(h) >> np.uint64(48)).astype(np.int64)]


class Sampler:
    """Improved consistent weighted sampling; a shingle's variables (two gammas, one uniform) are drawn by hashing it into SLOTS."""

    def __init__(self, base: float) -> None:
        rng = np.random.default_rng(33)
        shape = (HASHES, SLOTS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape, dtype=np.float32)
        self.odd = rng.integers(0, 1 << 62, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.float32(np.log(base))
        self.usual = self._value(self.base, slice(None), None)[0]

    def _value(self, log_w, k, slot):
        """Ordered bits of the hash in the upper half, and the level t that it was reached at."""
        r, c, b = (x[k] if slot is None else x[k][slot] for x in (self.r, self.log_c, self.beta))
        t = np.floor(log_w / r + b)
        bits = (c - r * (t - b) - r).astype(np.float32).view(np.int32)
        bits = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32)
        return bits.astype(np.uint64) << np.uint64(32), t

    def samples(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, HASHES) for the texts that have shingles, whose first shingles are given."""
        mixed = scattered(h)
        log_w = np.log(w).astype(np.float32)
        other = np.flatnonzero(np.abs(log_w - self.base) > 1e-6)
        low, out = mixed & np.uint64(0xFFFFFFFF), np.empty((len(first), HASHES), np.uint64)
        shift = np.uint64(64 - SLOTS.bit_length() + 1)
        for k in range(HASHES):
            slot = ((mixed * self.odd[k]) >> shift).view(np.int64)
            v = self.usual[k].take(slot)
            v |= low
            if len(other):
                bits, t = self._value(log_w[other], k, slot[other])
                v[other] = bits | ((mixed[other] + t.astype(np.int64).view(np.uint64) * _P) & np.uint64(0xFFFFFFFF))
            out[:, k] = np.minimum.reduceat(v, first)
        return out


_samplers: dict[float, Sampler] = {}


def sampler(base: float) -> Sampler:
    if base not in _samplers:
        _samplers[base] = Sampler(base)
    return _samplers[base]


def digest(text_col: str):
    """What tells a text: 128 bits."""
    return F.unhex(F.md5(shared.whole_text(text_col)))


def sketches(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """(id, node, size, bands): node is the digest of the text, null where it has no word; size is in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        s = sampler(float(1 + IDF_SPAN))
        for b in batches:
            lower = pc.utf8_lower(b.column(2))
            _, offs = shared.text_buffer(lower)
            ok, bands = [], []
            for i, j in shared.slices(offs):
                h, tf, first = shingles(lower.slice(i, j - i))
                some = np.flatnonzero(np.diff(first) > 0)
                ok.append(np.isin(np.arange(j - i), some))
                if len(some):
                    bands.append(_bands(s.samples(h, weights(h, tf, table), first[some])))
            ok = np.concatenate(ok) if ok else np.zeros(0, bool)
            bands = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
            node = pc.if_else(pa.array(ok), b.column(1), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), node, pa.array(np.diff(offs)), shared.list_column(bands.reshape(-1), ok * BANDS, pa.int64())], names=["id", "node", "size", "bands"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), digest(text_col).alias("node"), shared.whole_text(text_col).alias("_t")).mapInArrow(shared.trimmed(run), f"id {kind}, node binary, size long, bands array<long>")


def _bands(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(samples), k + 1, np.uint64)
        for j in range(ROWS):
            h = shared.mix(h * _P + samples[:, k * ROWS + j])
        out[:, k] = h
    return out.view(np.int64)


class Features:
    """The shingles of several texts, end to end, with their weights."""

    def __init__(self, column: pa.Array, table: np.ndarray) -> None:
        lower = pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        _, offs = shared.text_buffer(lower)
        got = [shingles(lower.slice(i, j - i)) for i, j in shared.slices(offs)]
        self.h, self.tf = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint64) for k in (0, 1))
        self.w = weights(self.h, self.tf, table)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(g[2]) for g in got]))]) if got else np.zeros(1, np.int64)
        self.total = np.add.reduceat(self.w, self.first[:-1]) if len(self.h) else np.zeros(len(self.first) - 1)

    def of(self, r: int) -> tuple[np.ndarray, np.ndarray, float]:
        own = slice(self.first[r], self.first[r + 1])
        return self.h[own], self.w[own], self.total[r]

    def against(self, one: tuple[np.ndarray, np.ndarray, float], i: int, j: int) -> np.ndarray:
        """Exact similarities of the texts i .. j - 1 to one text; every text has a shingle."""
        h, w, total = one
        own = slice(self.first[i], self.first[j])
        at = np.minimum(np.searchsorted(h, self.h[own]), len(h) - 1)
        common = np.where(h[at] == self.h[own], np.minimum(w[at], self.w[own]), 0)
        inter = np.add.reduceat(common, self.first[i:j] - self.first[i])
        return inter / (total + self.total[i:j] - inter)

    def estimate(self, left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Similarities of each of `left` to each of `right`, in single precision: the common weight as a product of matrices.

        The lesser of two weights of a shingle is the sum over the steps between the counts that occur, up to the lesser count;
        so every pair of shingle and count is a column, and a text has those up to its own count."""
        order = np.lexsort((self.tf, self.h))
        h, tf = self.h[order], self.tf[order]
        new_h = np.diff(h, prepend=h[:1] + np.uint64(1)) != 0
        new = new_h | (np.diff(tf, prepend=0) != 0)
        column = np.cumsum(new) - 1
        start = column[np.maximum.accumulate(np.where(new_h, np.arange(len(h)), 0))]
        at, reps = np.flatnonzero(new), column - start + 1
        value = 1 + np.log(tf[at])
        step = np.diff(value, prepend=0)
        step[new_h[at]] = value[new_h[at]]
        step = np.sqrt(step * table[(scattered(h[at]) >> np.uint64(48)).astype(np.int64)]).astype(np.float32)
        row = np.repeat(np.arange(len(self.total)), np.diff(self.first))[order]
        row, col = np.repeat(row, reps), np.repeat(start, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        if (reps > 1).any():
            again = np.argsort(col, kind="stable")
            row, col = row[again], col[again]
        place = np.full((2, len(self.total)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        # columns that both sides have
        sides = [np.bincount(col[place[k][row] >= 0], minlength=len(at)) > 0 for k in (0, 1)]
        both = sides[0] & sides[1]
        keep = both[col]
        row, col = row[keep], (np.cumsum(both) - 1)[col[keep]]
        step = step[both]
        inter = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, len(step), COLUMNS):
            some = slice(*np.searchsorted(col, [c, c + COLUMNS]))
            parts = []
            for k, n in ((0, len(left)), (1, len(right))):
                dense = np.zeros((n, min(COLUMNS, len(step) - c)), np.float32)
                mine = place[k][row[some]]
                ok = mine >= 0
                dense[mine[ok], col[some][ok] - c] = step[col[some][ok]]
                parts.append(dense)
            inter += parts[0] @ parts[1].T
        return inter / (self.total[left][:, None] + self.total[right][None, :] - inter)


def starred(rows: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) of texts to their stars; rows (star, part, is_star, node, text) of one star and part, the star first, stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star = one = None
        for b in batches:
            is_star = b.column(2).to_numpy(zero_copy_only=False)
            _, offs = shared.text_buffer(b.column(4))
            a, of = [], []
            for lo, hi in shared.slices(offs):
                f = Features(b.column(4).slice(lo, hi - lo), idf.value)
                i = lo
                while i < hi:
                    if is_star[i]:
                        star, one, i = b.column(3)[i].as_py(), f.of(i - lo), i + 1
                        continue
                    j = i + 1
                    while j < hi and not is_star[j]:
                        j += 1
                    near = np.flatnonzero(f.against(one, i - lo, j - lo) >= threshold) + i
                    a += near.tolist()
                    of += [star] * len(near)
                    i = j
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(a, pa.int64())), pa.array(of, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(shared.trimmed(run), "a binary, b binary")


def compared(group: pa.Table, table: np.ndarray, threshold: float) -> pa.Table:
    """Pairs of components (a, b) that a link joins between the `left` and the `right` members of a task. Pairs of one component
    (of `root`, or by the links found on the way) join nothing, and those that meet in an earlier band are compared there."""
    part, roots = np.unique(np.array(group["root"].to_pylist(), object), return_inverse=True)[::-1]
    left, right = (np.flatnonzero(group[c].to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(part), -1)
    band = group["band"][0].as_py()
    apart = part[left][:, None] != part[right][None, :]
    for k in range(band):
        apart &= bands[left, k][:, None] != bands[right, k][None, :]
    xs, ys = apart.any(axis=1), apart.any(axis=0)
    a, b = [], []
    if xs.any():
        left, right, apart = left[xs], right[ys], apart[np.ix_(xs, ys)]
        f = Features(group["text"], table)
        likely = np.argwhere(apart & (f.estimate(left, right, table) >= threshold - 1e-3))
        part = part.copy()
        for x, y in likely.tolist():
            x, y = left[x], right[y]
            if part[x] != part[y] and f.against(f.of(x), y, y + 1)[0] >= threshold:
                a.append(roots[part[x]])
                b.append(roots[part[y]])
                part[part == part[y]] = part[x]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def dealt(node: str, parts: str, key: str):
    """The block, of `parts`, that a member of a bucket is in."""
    return F.pmod(F.xxhash64(node, key), F.col(parts))


def by_bucket(members: DataFrame, buckets: DataFrame, *cols: str) -> DataFrame:
    """Members (key, parts, node, ...) with the columns of their buckets; a bucket of many parts is spread over as many keys."""
    spread = buckets.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), *cols)
    return members.withColumn("salt", dealt("node", "parts", "key")).join(spread, ["key", "salt"]).drop("salt")


def blocks(n, size):
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1))


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, root) of every node that a link joins to another, (node, id) of every node, and (id, node) of every document."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs, text_col))
    rows = shared.cut(sketches(docs, idf, id_col, text_col), "sketches")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = shared.cut(nodes, "nodes")
    # members of the buckets that hold several nodes; a node's own are put together to find its rank
    member = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    sizes = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    sizes = sizes.select("key", "n", blocks(F.col("n"), F.col("bytes")).alias("parts"))
    own = member.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("rank"), F.first("size").alias("size"), F.collect_list(F.struct("key", "band", "n", "parts")).alias("own"))
    ranked = shared.cut(own, "ranked")
    texts = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("node"), shared.whole_text(text_col).alias("text"))
    t, i = texts.alias("t"), nodes.join(ranked.select("node"), "node").select("node", "id", "bands").alias("i")
    texts = t.join(i, F.col("t.id").eqNullSafe(F.col("i.id")) & (F.col("t.node") == F.col("i.node"))).select("t.node", "t.text", "i.bands")
    texts = shared.cut(texts.dropDuplicates(["node"]), "texts")
    member = ranked.select("node", "rank", "size", F.explode("own").alias("o")).select("node", "rank", "size", "o.*")
    star = member.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("star"), F.max("parts").alias("parts")).select("key", "parts", F.col("star.node").alias("star"))
    led = shared.cut(by_bucket(member, star, "star"), "led")
    # stars
    pairs = shared.cut(led.filter("node <> star").groupBy("node", "star").agg(F.max("parts").alias("parts")).withColumn("part", dealt("node", "parts", "star")), "pairs")
    task = ("star", "parts", "part")
    points = pairs.join(texts, "node").select(*task, F.lit(False).alias("is_star"), "node", "text")
    centres = pairs.select(*task).distinct().join(texts.withColumnRenamed("node", "star"), "star").select(*task, F.lit(True).alias("is_star"), F.col("star").alias("node"), "text")
    rows_ = points.unionByName(centres).repartition(*task).sortWithinPartitions(*task, F.desc("is_star")).select("star", "part", "is_star", "node", "text")
    roots = shared.cut(components(starred(rows_, idf, threshold), "a", "b"), "roots")
    # blocks: the members outside the star's component (the rest) against all others
    state = shared.cut(led.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "state")
    kinds = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max(F.col("node") == F.col("star")).alias("main"), F.max("parts").alias("parts"))
    rest = lambda c: F.sum(F.when(~F.col("main"), F.col(c)).otherwise(0))
    main = lambda c: F.sum(F.when(F.col("main"), F.col(c)).otherwise(0))
    open_ = kinds.groupBy("key").agg(
        F.max("parts").alias("parts"), F.max(F.when(F.col("main"), F.col("root"))).alias("main_root"), rest("n").alias("rests"), blocks(rest("n"), rest("bytes")).alias("n_rest"), blocks(main("n"), main("bytes")).alias("n_main")
    )
    open_ = shared.cut(open_.filter("rests > 0"), "open")
    work = by_bucket(state, open_, "main_root", "n_rest", "n_main").withColumn("rest", F.col("root") != F.col("main_root"))
    place = F.xxhash64("key", "node")
    work = work.withColumn("block", F.when(F.col("rest"), F.pmod(place, "n_rest")).otherwise(F.col("n_rest") + F.pmod(place, "n_main")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("rest"), F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest")) - 1)
    work = work.select("key", "band", "node", "root", "block", F.explode(others).alias("other")).join(texts, "node")
    work = work.select("key", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "root", "text", "bands", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))
    more = work.groupBy("key", "lo", "hi").applyInArrow(lambda group: compared(group, idf.value, threshold), "a binary, b binary")
    more = shared.cut(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    if not more.isEmpty():
        # links between components: their roots are joined again
        higher = components(more, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("top"))
        alone = higher.select(F.col("root").alias("node"), "top").join(roots, "node", "left_anti").select("node", F.col("top").alias("root"))
        roots = roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone)
        roots = shared.cut(roots, "roots")
    return roots, nodes.select("node", "id"), rows.select("id", "node")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, node) of every document."""
    roots, nodes, rows = joined(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    member = roots.join(nodes, "node")
    named = member.join(member.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("node", "class_id")
    got = rows.join(nodes.withColumnRenamed("id", "least"), "node", "left").join(named, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.coalesce("class_id", "least"))
    return got.select(F.col("id").alias(id_col), class_id.alias("class_id"), "node")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class: that of the class id. Documents without a word all stay."""
    named = shared.cut(classes(docs, id_col=id_col, text_col=text_col, threshold=threshold).toDF("id", "class_id", "node"), "named").filter("node is not null")
    mine = shared.fresh("node", docs.columns)
    d = docs.withColumn(mine, digest(text_col)).alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.col(f"d.{mine}") == F.col("g.node"))
    own = F.col("id").eqNullSafe(F.col("class_id"))
    kept = d.join(named.filter(~own).select("id", "node").distinct().alias("g"), same, "left_anti")
    # rows that repeat both id and text: only where there are any
    twice = shared.cut(named.filter(own).groupBy("id", "node").count().filter("count > 1").drop("count"), "twice")
    if not twice.isEmpty():
        g = twice.alias("g")
        kept = kept.join(g, same, "left_anti").unionByName(kept.join(g, same, "left_semi").dropDuplicates([id_col, mine]))
    return kept.drop(mine)
