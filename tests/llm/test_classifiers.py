import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doppel.llm import quality, shared, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, _whole int"


def sample(n=240, seed=5):
    rng = np.random.default_rng(seed)
    plain = [f"w{i}" for i in range(60)]
    bad = ["vile", "rotten", "nasty"]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 30))
        if i % 3 == 0:
            words[int(rng.integers(30))] = str(rng.choice(bad))
            words[int(rng.integers(30))] = str(rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_toxicity_learns_and_is_stable():
    texts, labels = sample()
    model = toxicity.train(texts[:180], labels[:180])
    got = toxicity.score_texts(model, pa.array(texts[180:]))
    assert ((got >= 0.5) == labels[180:]).mean() > 0.95
    one_by_one = np.concatenate([toxicity.score_texts(model, pa.array([t])) for t in texts[180:]])
    assert np.allclose(got, one_by_one, atol=1e-5)


def test_toxicity_covers_the_whole_text():
    texts, labels = sample()
    model = toxicity.train(texts, labels)
    long = " ".join(["w1"] * 200_000)
    a, b = toxicity.score_texts(model, pa.array([long, long + " vile rotten"]))
    assert a < 0.5 <= b


def test_language_thresholds_come_from_the_text():
    told = toxicity.word_ids(pa.array(["the and of to is", "der die und das", "", "xyz"]))[2]
    assert [toxicity.LANGUAGES[i] if i >= 0 else None for i in told] == ["en", "de", None, None]


def test_quality_learns_and_chunks_cover_the_text():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(w + ("###" if k % 3 == 0 else "") for w in rng.choice(words, 80)) for k in range(200)]
    labels = np.array([int(k % 3 != 0) for k in range(200)])
    model = quality.train(texts[:150], labels[:150])
    got = quality.score_texts(model, pa.array(texts[150:]))
    assert ((got >= 0.7) == labels[150:]).mean() > 0.95
    for size in (1, 5, 6, 7, 261, 262, 1000):
        starts, places, counts = quality.chunk_starts(np.array([0, size]))
        seen = np.zeros(max(size - quality.WIDTH + 1, 1), bool)
        for s, p in zip(starts, places, strict=True):
            seen[s : s + p] = True
        assert seen.all() and counts.sum() == len(starts)


def test_toxicity_equals_a_plain_forward_pass():
    texts, labels = sample(90)
    model = toxicity.train(texts, labels)
    probes = [*texts[:5], "", "w1", "w1 vile", "the vile and rotten of the w3", "ü é w1 ß"]

    def plain(net, ids):
        x = [sum(net.embed[b].astype(float) for b in word) for word in ids.T]
        out = net.shift
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max((sum(float(x[i + j] @ net.filters[k][j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(width) if i + j < len(x)) for i in range(len(x))), default=None)
                col = k * toxicity.FILTERS + f
                out += net.out[col] * (0 if best is None else max(0, best + net.bias[col]))
        return out

    for text in probes:
        ids, _, told = toxicity.word_ids(pa.array([text]))
        z = np.mean([plain(n, ids) for n in model.nets])
        name = toxicity.LANGUAGES[told[0]] if told[0] >= 0 else ""
        want = 1 / (1 + np.exp(-np.clip(z - model.thresholds[name], -35, 35)))
        assert toxicity.score_texts(model, pa.array([text]))[0] == pytest.approx(want, abs=1e-4)


def test_quality_equals_a_plain_forward_pass():
    rng = np.random.default_rng(12)
    m = quality.Model(rng.normal(size=(256, quality.DIM)), rng.normal(size=(quality.WIDTH, quality.DIM, quality.FILTERS)), rng.normal(size=quality.FILTERS), rng.normal(size=2 * quality.FILTERS), 0.3)
    for size in (0, 1, 4, 6, 30, 261, 262, 700):
        text = "".join(rng.choice(list("abc é!"), size))
        raw = list(text.encode())
        n = max(len(raw) - quality.WIDTH + 1, 1) if raw else 0
        pooled, start = [], 0
        while start < n and (start == 0 or start + quality.CHUNK - quality.STRIDE < n):
            best = np.full(quality.FILTERS, -np.inf)
            for i in range(start, min(start + quality.CHUNK, n)):
                y = np.zeros(quality.FILTERS)
                for j in range(quality.WIDTH):
                    y += m.embed[raw[i + j] if i + j < len(raw) else 0] @ m.filters[j]
                best = np.maximum(best, y)
            pooled.append(np.maximum(best + m.bias, 0))
            start += quality.STRIDE
        both = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)]) if pooled else np.zeros(2 * quality.FILTERS)
        want = 1 / (1 + np.exp(-np.clip(both @ m.out + m.shift, -35, 35)))
        assert quality.score_texts(m, pa.array([text]))[0] == pytest.approx(want, abs=1e-4)


def test_sampled_bytes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100)
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), 10).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert len(toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", 1000)[0]) == 10


@pytest.mark.parametrize("mod,label", [(toxicity, "toxic"), (quality, "quality")])
def test_nulls_empties_ties_and_clashing_names(spark, mod, label):
    texts, labels = sample(60)
    rows = [(i, t, "en", 0.1, 1) for i, t in enumerate(texts)] + [(100, None, None, None, None), (101, "", "de", 1.0, 2), (None, "w1", "en", 1.0, 2), (3, texts[3], "xx", 1.0, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(100, None), (None, 1), (555, 1), (3, 7)], f"doc_id long, {label} int")
    model = mod.fit(spark, docs, marks)
    got = mod.score(docs, model).collect()
    assert len(got) == len(rows) and {*got[0].asDict()} == {"doc_id", "text", "lang", "score", "_whole"}
    assert all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert of[100] == of[101]
    assert len({round(r.score, 12) for r in got if r.doc_id == 3}) == 1
    assert mod.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("mod", [toxicity, quality])
def test_without_labels_of_both_classes(spark, mod):
    docs = spark.createDataFrame([(1, "a b", "en", 0.0, 1)], SCHEMA)
    label = "toxic" if mod is toxicity else "quality"
    model = mod.fit(spark, docs, spark.createDataFrame([], f"doc_id long, {label} int"))
    assert len(mod.score(docs, model).collect()) == 1


def test_sample_is_bounded(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts, y = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", "text", 10)
    assert len(texts) == 20 and y.sum() == 10


def test_rolling_hashes_tell_substrings():
    raw = np.frombuffer(b"abcabcabd", np.uint8)
    r = shared.Rolling(1)
    sums = r.prefix(raw)
    h = r.between(sums, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_words_keep_texts_apart():
    raw, offs = shared.text_buffer(pa.array(["ab", "cd ef", "", None, "g"]))
    _, a, b, first = shared.words(raw, offs)
    assert [bytes(raw[i:j]).decode() for i, j in zip(a, b, strict=True)] == ["ab", "cd", "ef", "g"]
    assert first.tolist() == [0, 1, 3, 3, 3, 4]
