"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Each word is the sum of hashed embeddings (of the word, and of its beginnings of PREFIXES bytes); filters of several widths
run over the whole text, are max-pooled and joined by one logistic unit. An embedding starts from how much oftener the
labelled texts of one class hold its word; words of fewer than LEAST texts have none. FOLDS networks are trained, each
without its part of the rows; a score is their mean. Thresholds are calibrated by language, on scores by the network that
hasn't seen the row; the language is told from the text's own function words. A score is shifted so that 0.5 is its
language's threshold.

Defined results: a null text counts as empty; an empty text (or one without words) gets the score of the empty text,
the pooled filters being 0; repeated rows get equal scores; other columns, of any name, are passed by, one of the score's
name being replaced. An empty table gives no rows. Without labels of both classes every score is the constant prior. Long
texts are scored whole, in memory of some 60 bytes a byte of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import shared

BUCKETS, DIM = 1 << 16, 16
#: Beginnings of a word, in bytes, that have embeddings of their own.
PREFIXES = (4, 6)
WIDTHS, FILTERS = (1, 2, 3), 12
#: At most so many labelled rows of each class are learnt from, those of the least hash of the text.
SAMPLE_PER_CLASS = 2000
#: Networks, each trained without its part of the rows; that part calibrates the thresholds.
FOLDS = 3
#: Words and beginnings that fewer labelled texts hold have no embedding.
LEAST = 3
#: What an embedding loses in training, of its size.
DECAY = 1e-3
#: Bytes of labelled texts that the driver holds at most; beyond that, fewer rows of each class.
SAMPLE_BYTES = 64 << 20

#: Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for was with on are be this by",
    "de": "der die und das von zu mit den nicht ist ein eine auf dem im für",
    "fr": "le la les et un une dans pour qui sur pas par au est du elle",
    "es": "el los las y en con por una se del su para lo al como más",
}
LANGUAGES = tuple(FUNCTION_WORDS)


@dataclass
class Net:
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0


@dataclass
class Model:
    nets: list[Net]
    thresholds: dict[str, float] = field(default_factory=dict)  # of the logit, by language; "" for any other
    constant: float | None = None


def word_ids(lower: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginnings, the first word of each text, and each text's language (-1: none told)."""
    raw, offs = shared.text_buffer(lower)
    sums, a, b, first = shared.words(raw, offs)
    full = shared.mix(shared.WORDS.between(sums, a, b))
    heads = [shared.mix(shared.WORDS.between(sums, a, np.minimum(b, a + k)) + np.uint64(k)) for k in PREFIXES]
    known, lang = _function_words()
    at = np.searchsorted(known, full)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == full)
    n = len(offs) - 1
    votes = np.zeros((n, len(LANGUAGES)), np.int64)
    np.add.at(votes, (np.searchsorted(first, hit, "right") - 1, lang[at[hit]]), 1)
    told = np.where(votes.max(1, initial=0) > 0, votes.argmax(1) if n else 0, -1)
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.stack([(h >> top).astype(np.int32) for h in (full, *heads)]), first, told


_known: tuple[np.ndarray, np.ndarray] | None = None


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    global _known
    if _known is None:
        pairs = [(w, i) for i, name in enumerate(LANGUAGES) for w in FUNCTION_WORDS[name].split()]
        raw, offs = shared.text_buffer(pa.array([w for w, _ in pairs]))
        h = shared.mix(shared.WORDS.between(shared.WORDS.prefix(raw), offs[:-1], offs[1:]))
        order = np.argsort(h)
        _known = h[order], np.array([i for _, i in pairs])[order]
    return _known


def forward(m: Net, ids: np.ndarray, first: np.ndarray, keep: bool = False):
    """Pooled filters of each text; with `keep` also the word vectors and where each maximum is."""
    n = len(first) - 1
    x = m.embed[ids[0]]
    for row in ids[1:]:
        x += m.embed[row]
    pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    where = np.zeros((n, FILTERS * len(WIDTHS)), np.int64)
    full_rows = np.flatnonzero(np.diff(first) > 0)
    if len(full_rows):
        # words beyond a text's end count as zero vectors: windows are taken within the text only
        left = first[1:][np.searchsorted(first, np.arange(len(x)), "right") - 1] - np.arange(len(x))
        for k, width in enumerate(WIDTHS):
            y = x @ m.filters[k][:DIM]
            for j in range(1, width):
                part = x[j:] @ m.filters[k][j * DIM : (j + 1) * DIM]
                part[left[: len(part)] <= j] = 0
                y[: len(part)] += part
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[full_rows, cols] = np.maximum.reduceat(y, first[full_rows], axis=0)
            if keep:
                for r in full_rows:
                    where[r, cols] = first[r] + y[first[r] : first[r + 1]].argmax(0)
    pooled[full_rows] = np.maximum(pooled[full_rows] + m.bias, 0)
    return (pooled, x, where, left if len(full_rows) else None) if keep else pooled


def logits(m: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.mean([forward(n, ids, first) @ n.out + n.shift for n in m.nets], axis=0)


def start(docs: list, labels: np.ndarray, rng: np.random.Generator) -> tuple[Net, np.ndarray]:
    """A network whose embeddings begin with the log odds of their words, by standard errors; and which have one."""
    held = np.zeros((2, BUCKETS))
    for d, y in zip(docs, labels, strict=True):
        held[y, np.unique(d[0])] += 1
    known = held.sum(0) >= LEAST
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])[:, None]
    odds = np.log((held + 2 * share) / (share * len(labels) + 2))
    error = np.sqrt((1 / (held + 2 * share)).sum(0))
    embed = rng.normal(0, 0.03, (BUCKETS, DIM)) * known[:, None]
    embed[:, 0] = np.clip((odds[1] - odds[0]) / error, -3, 3) / 3 * known
    n = FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.4 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Net(embed.astype(np.float32), filters, np.zeros(n, np.float32), rng.normal(0, 0.2, n).astype(np.float32)), known


def train_net(docs: list, labels: np.ndarray, seed: int, epochs: int, steps: int, batch: int, rate: float) -> Net:
    """Adam on the logistic loss, classes weighted evenly: `epochs` rounds, or as many as take `steps` steps."""
    rng = np.random.default_rng(seed)
    m, known = start(docs, labels, rng)
    learn = np.arange(len(labels))
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(learn)
    state = {"t": 0}
    moments: dict[str, list[np.ndarray]] = {}

    def adam(name: str, p: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        mom = moments.setdefault(name, [np.zeros_like(p), np.zeros_like(p)])
        mom[0][rows] = 0.9 * mom[0][rows] + 0.1 * g
        mom[1][rows] = 0.999 * mom[1][rows] + 0.001 * g * g
        lr = rate * np.sqrt(1 - 0.999 ** state["t"]) / (1 - 0.9 ** state["t"])
        p[rows] -= lr * mom[0][rows] / (np.sqrt(mom[1][rows]) + 1e-8)

    shift = np.zeros(1, np.float32)
    parts_ = max(1, len(learn) // batch)
    for _ in range(max(epochs, -(-steps // parts_))):
        for rows in np.array_split(rng.permutation(learn), parts_):
            state["t"] += 1
            buckets = np.concatenate([docs[r][0] for r in rows], axis=1)
            first = np.concatenate([[0], np.cumsum([docs[r][0].shape[1] for r in rows])])
            pooled, x, where, left = forward(m, buckets, first, keep=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + shift[0], -30, 30)))
            g = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            up = g[:, None] * m.out[None, :] * (pooled > 0)
            grad_out, grad_x = pooled.T @ g + 1e-4 * m.out, {}
            touched, parts = [], []
            for k, width in enumerate(WIDTHS):
                gf = np.zeros_like(m.filters[k])
                for c in range(FILTERS):
                    col = k * FILTERS + c
                    live = np.flatnonzero(up[:, col])
                    at = where[live, col]
                    for j in range(width):
                        ok = left[at] > j if len(at) else np.zeros(0, bool)
                        pos, gg = at[ok] + j, up[live[ok], col]
                        gf[j * DIM : (j + 1) * DIM, c] += x[pos].T @ gg
                        touched.append(pos)
                        parts.append(gg[:, None] * m.filters[k][j * DIM : (j + 1) * DIM, c][None, :])
                grad_x[k] = gf
            pos, gx = np.concatenate(touched), np.concatenate(parts)
            uniq, inv = np.unique(buckets[:, pos].reshape(-1), return_inverse=True)
            ge = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(ge, inv, np.tile(gx, (len(buckets), 1)))
            for k in range(len(WIDTHS)):
                adam(f"f{k}", m.filters[k], grad_x[k] + 1e-4 * m.filters[k])
            adam("bias", m.bias, up.sum(0))
            adam("out", m.out, grad_out.astype(np.float32))
            adam("shift", shift, g.sum(keepdims=True).astype(np.float32))
            ok = known[uniq]
            if ok.any():
                adam("embed", m.embed, ge[ok] + DECAY * m.embed[uniq[ok]], uniq[ok])
    m.shift = float(shift[0])
    return m


def train(texts: list[str], labels: np.ndarray, seed: int = 9, epochs: int = 4, steps: int = 70, batch: int = 48, rate: float = 0.01) -> Model:
    """FOLDS networks, and thresholds by language from the scores of the rows that each hasn't seen."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model([], constant=float(labels.mean()) if len(labels) else 0.5)
    docs = [word_ids(pa.array([t]).cast(pa.string()) if not t else pc.utf8_lower(pa.array([t]))) for t in texts]
    fold = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        fold[labels == y] = np.arange((labels == y).sum()) % FOLDS
    m, z = Model([]), np.zeros(len(labels))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        if labels[inside].min() == labels[inside].max():
            inside = np.arange(len(labels))
        m.nets.append(train_net([docs[r] for r in inside], labels[inside], seed + k, epochs, steps, batch, rate))
        alone = Model(m.nets[-1:])
        for r in np.flatnonzero(fold == k):
            z[r] = logits(alone, *docs[r][:2])[0]
    told = np.array([d[2][0] for d in docs])
    m.thresholds[""] = best_threshold(z, labels)
    for i, name in enumerate(LANGUAGES):
        own = told == i
        enough = (labels[own] == 1).sum() >= 10 and (labels[own] == 0).sum() >= 10
        m.thresholds[name] = best_threshold(z[own], labels[own]) if enough else m.thresholds[""]
    return m


def best_threshold(z: np.ndarray, y: np.ndarray, heavy: int = 0) -> float:
    """The middle of the widest stretch of logits at which most rows are told rightly; the class `heavy` weighs double."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    w0, w1 = ((2 if heavy == k else 1) / max(1, (y == k).sum()) for k in (0, 1))
    right = np.concatenate([[0.0], np.cumsum(y == 0) * w0]) - np.concatenate([[0.0], np.cumsum(y == 1) * w1])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    widest = max(best, key=lambda i: edges[i + 1] - edges[i])
    return float((edges[widest] + edges[widest + 1]) / 2)


def score_texts(m: Model, column: pa.Array) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(column), m.constant)
    cut = np.array([m.thresholds[name] for name in LANGUAGES] + [m.thresholds[""]])
    lower = pc.utf8_lower(column.fill_null(""))
    _, offs = shared.text_buffer(lower)
    out = []
    for i, j in shared.slices(offs):
        ids, first, told = word_ids(lower.slice(i, j - i))
        out.append(logits(m, ids, first) - cut[told])
    z = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, per_class: int) -> tuple[list[str], np.ndarray]:
    """At most `per_class` labelled texts of each class, those of the least hash of the id, and SAMPLE_BYTES: so the driver may hold them.

    They are drawn from the labels alone and met with the documents by a broadcast of their ids: no document is shuffled.
    Labels that aren't 0 or 1 are passed by, as are drawn ones without a document; of contrary labels of one id the lesser counts."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label)).cast("int").alias("_label")).withColumn("_order", F.xxhash64("_id"))
    drawn = {r["_id"]: (r["_order"], r["_label"]) for y in (0, 1) for r in marked.filter(F.col("_label") == y).orderBy("_order", "_id").limit(per_class).collect()}
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), shared.whole_text(text_col).alias("_text"))

    def met(ids: list) -> DataFrame:
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], rows.select("_id").schema)), "_id")

    room, chosen = [SAMPLE_BYTES // 2] * 2, []
    sizes = met(list(drawn)).groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n")).collect() if drawn else []
    for r in sorted(sizes, key=lambda r: (drawn[r["_id"]][0], r["_id"])):
        y = drawn[r["_id"]][1]
        room[y] -= r["n"]
        if room[y] >= 0:
            chosen.append(r["_id"])
    if not chosen:
        return [], np.zeros(0, np.int64)
    texts = {r["_id"]: r["_text"] for r in met(chosen).groupBy("_id").agg(F.min("_text").alias("_text")).collect()}
    return [texts[i] for i in chosen], np.array([drawn[i][1] for i in chosen], np.int64)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled rows given; keep held-out rows out of `labels`."""
    return train(*labelled_sample(docs, labels, label, id_col, text_col, per_class))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1: higher, likelier toxic. Narrow: no shuffle; the model (12 MB) goes along as a broadcast."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    kept = [F.col(f"`{c}`") for c in names]
    schema = docs.select(*kept).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(shipped.value, b.column(len(names)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(s, pa.float64())], names=[*names, score_col])

    return docs.select(*kept, shared.whole_text(text_col).alias(shared.fresh("whole", names))).mapInArrow(shared.trimmed(run), schema)
