"""Quality: a byte-level convolutional network in numpy.

Filters of WIDTH bytes over learned embeddings of bytes run over overlapping chunks that cover the whole text; each is
max-pooled within its chunk, and the chunks' pooled values, by maximum and by mean, are combined into one probability.

Defined results: null and empty texts get one and the same score, all pooled values being 0; repeated rows get equal
scores; other columns, of any name, are passed by, one of the score's name being replaced; an empty table gives no rows.
Without labels of both classes the score is constant. Long texts are scored whole, 128 chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import shared
from doppel.llm.toxicity import best_threshold, labelled_sample

WIDTH, DIM, FILTERS = 6, 8, 24
#: Chunks of so many window positions; the next starts STRIDE positions later.
CHUNK, STRIDE = 256, 192
#: At most so many labelled rows of each class are learnt from.
SAMPLE_PER_CLASS = 1000
#: The score that stands for the threshold: what is above counts as good.
CUT = 0.7


@dataclass
class Model:
    embed: np.ndarray  # (256, DIM)
    filters: np.ndarray  # (WIDTH, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS)
    shift: float = 0.0
    constant: float | None = None

    def tables(self) -> list[np.ndarray]:
        """What each byte adds to each filter, by place in the window: the convolution is WIDTH look-ups."""
        return [(self.embed @ self.filters[j]).astype(np.float32) for j in range(WIDTH)]


def chunk_starts(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of positions of each chunk, and the number of chunks of each text. A text shorter than a window has one position, the bytes beyond its end being 0."""
    size = np.diff(offs)
    places = np.where(size > 0, np.maximum(size - WIDTH + 1, 1), 0)
    counts = np.where(places > 0, 1 + -(-np.maximum(places - CHUNK, 0) // STRIDE), 0)
    row = np.repeat(np.arange(len(size)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offs[:-1][row] + k * STRIDE, np.minimum(places[row] - k * STRIDE, CHUNK), counts


def pool(tables: list[np.ndarray], bias: np.ndarray, win: np.ndarray, places: np.ndarray, keep: bool = False):
    """Rectified maximum of each filter over each chunk; with `keep` also its place."""
    y = tables[0][win[:, :CHUNK]]
    for j in range(1, WIDTH):
        y += tables[j][win[:, j : j + CHUNK]]
    if len(places) and places.min() < CHUNK:
        y[np.arange(CHUNK)[None, :] >= places[:, None]] = -np.inf
    top = y.max(axis=1)
    pooled = np.maximum(top + bias, 0)
    return (pooled, y.argmax(axis=1)) if keep else pooled


def combine(pooled: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Maximum and mean over the chunks of each text."""
    out = np.zeros((len(counts), 2 * FILTERS), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        out[some, :FILTERS] = np.maximum.reduceat(pooled, at, axis=0)
        out[some, FILTERS:] = np.add.reduceat(pooled, at, axis=0) / counts[some][:, None]
    return out


def logits(m: Model, tables: list[np.ndarray], raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    starts, places, counts = chunk_starts(offs)
    pooled = np.zeros((len(starts), FILTERS), np.float32)
    reach = np.repeat(offs[1:], counts)
    for i in range(0, len(starts), 128):
        s = slice(i, i + 128)
        at = np.arange(CHUNK + WIDTH - 1)[None, :] + starts[s][:, None]
        win = raw[np.minimum(at, len(raw) - 1)]
        if (at[:, -1] >= reach[s]).any():
            win[at >= reach[s][:, None]] = 0
        pooled[s] = pool(tables, m.bias, win, places[s])
    return combine(pooled, counts) @ m.out + m.shift


def train(texts: list[str], labels: np.ndarray, seed: int = 1, epochs: int = 10, steps: int = 300, batch: int = 24, rate: float = 0.01) -> Model:
    """Adam on the logistic loss with evenly weighted classes, `epochs` rounds or as many as take `steps` steps; a quarter of the rows sets the threshold only."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32))
    if len(labels) == 0 or labels.min() == labels.max():
        m.constant = float(labels.mean()) if len(labels) else CUT
        return m
    blobs = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    aside = np.arange(len(labels)) % 4 == 3
    learn = np.flatnonzero(~aside) if labels[~aside].min() != labels[~aside].max() else np.arange(len(labels))
    weight = np.where(labels == 1, 0.5 / max(1, labels[learn].sum()), 0.5 / max(1, (1 - labels[learn]).sum())) * len(learn)
    params = {"embed": m.embed, "filters": m.filters, "bias": m.bias, "out": m.out, "shift": np.zeros(1, np.float32)}
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    step = 0
    parts = max(1, len(learn) // batch)
    for _ in range(max(epochs, -(-steps // parts))):
        for rows in np.array_split(rng.permutation(learn), parts):
            step += 1
            raw, offs = np.concatenate([blobs[r] for r in rows]), np.concatenate([[0], np.cumsum([len(blobs[r]) for r in rows])])
            starts, places, counts = chunk_starts(offs)
            if not len(starts):
                continue
            tables, reach, got = m.tables(), np.repeat(offs[1:], counts), []
            for i in range(0, len(starts), 128):
                s = slice(i, i + 128)
                at = np.arange(CHUNK + WIDTH - 1)[None, :] + starts[s][:, None]
                win = raw[np.minimum(at, len(raw) - 1)]
                win[at >= reach[s][:, None]] = 0
                got.append(pool(tables, m.bias, win, places[s], keep=True))
            pooled, where = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            feats = combine(pooled, counts)
            p = 1 / (1 + np.exp(-np.clip(feats @ m.out + params["shift"][0], -30, 30)))
            g = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            doc = np.repeat(np.arange(len(rows)), counts)
            # to the chunk of the maximum, and evenly to all by the mean
            up = (g[:, None] * m.out[None, FILTERS:])[doc] / counts[doc][:, None]
            best = pooled == feats[doc, :FILTERS]
            up += best * (g[:, None] * m.out[None, :FILTERS])[doc] / np.maximum(1, np.add.reduceat(best, (np.cumsum(counts) - counts)[counts > 0], axis=0)[np.cumsum(counts > 0)[doc] - 1])
            up *= pooled > 0
            grad = {k: np.zeros_like(v) for k, v in params.items()}
            grad["out"], grad["shift"], grad["bias"] = feats.T @ g + 1e-4 * m.out, g.sum(keepdims=True), up.sum(0)
            for c in range(FILTERS):
                live = np.flatnonzero(up[:, c])
                at, gg = starts[live] + where[live, c], up[live, c]
                for j in range(WIDTH):
                    byte = np.where(at + j < reach[live], raw[np.minimum(at + j, len(raw) - 1)], 0)
                    per = np.bincount(byte, gg, 256).astype(np.float32)
                    grad["filters"][j, :, c] += per @ m.embed
                    grad["embed"] += per[:, None] * m.filters[j, :, c][None, :]
            lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in params.items():
                mom[k][0] = 0.9 * mom[k][0] + 0.1 * grad[k]
                mom[k][1] = 0.999 * mom[k][1] + 0.001 * grad[k] ** 2
                v -= (lr * mom[k][0] / (np.sqrt(mom[k][1]) + 1e-8)).astype(np.float32)
    m.shift = float(params["shift"][0])
    rows = np.flatnonzero(aside) if aside.any() and labels[aside].min() != labels[aside].max() else np.arange(len(labels))
    tables = m.tables()
    z = np.array([float(logits(m, tables, blobs[r], np.array([0, len(blobs[r])]))[0]) for r in rows])
    m.shift += float(np.log(CUT / (1 - CUT))) - best_threshold(z, labels[rows], heavy=1)
    return m


def score_texts(m: Model, column: pa.Array) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(column), m.constant)
    raw, offs = shared.text_buffer(column)
    tables, out = m.tables(), []
    for i, j in shared.slices(offs):
        out.append(logits(m, tables, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
    z = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled rows given; keep held-out rows out of `labels`."""
    return train(*labelled_sample(docs, labels, label, id_col, text_col, per_class))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1: higher, likelier good. Narrow: no shuffle; the model (some KB) goes along as a broadcast."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    kept = [F.col(f"`{c}`") for c in names]
    schema = docs.select(*kept).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(shipped.value, b.column(len(names)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(s, pa.float64())], names=[*names, score_col])

    return docs.select(*kept, shared.whole_text(text_col).alias(shared.fresh("whole", names))).mapInArrow(shared.trimmed(run), schema)
