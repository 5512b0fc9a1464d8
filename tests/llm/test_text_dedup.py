import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doppel.llm import components, decontam, neardup, suffixes


def brute_removal(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, other = word(260), word(200)
    return [
        word(500) + passage + word(300), word(100) + passage[:230] + word(50), passage[30:] + word(20), "x" * 1200, "x" * 210, "ab" * 400, word(150) + other, other + word(199), word(199), "",
        None, "ü" * 150 + passage, passage + "ü" * 150, word(5000) + "x" * 199 + "y", word(3000), passage[:199],
    ]


def test_suffixes_equal_brute_force(spark):
    texts = cases()
    texts += [texts[0], texts[14], texts[14][:1500] + "!" + texts[14][1500:]]
    docs = spark.createDataFrame([(i, t, "n", 7, "a", "b", "c") for i, t in enumerate(texts)], "doc_id long, text string, node string, lo int, _text string, _lo string, twin string")
    got = {r.doc_id: r for r in suffixes.remove(docs, digest=True).collect()}
    want = brute_removal([(t or "").encode() for t in texts], 200)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    left = {r.doc_id: r.text for r in suffixes.remove(docs).collect()}
    assert left[8] == texts[8] and left[0] == "" and set(docs.columns) == set(suffixes.remove(docs).columns)


def test_suffixes_in_stretches(spark, monkeypatch):
    """Texts beyond a stretch, cut at places that depend on where a passage stands."""
    for stretch in (300, 1000):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        texts = [t for t in cases() if t]
        blobs = [t.encode() for t in texts]
        names = {}
        for k, b in enumerate(blobs):
            row, lo, hi, trigger, name, core = suffixes.phrases(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 200)
            assert [p for x, y in zip(lo, hi, strict=True) for p in range(x, y + 1)] == list(range(max(0, len(b) - 199)))
            for i in range(len(row)):
                assert names.setdefault((name[i], core[i]), b[lo[i] : hi[i] + 200]) == b[lo[i] : hi[i] + 200]
                assert lo[i] <= trigger[i] and hi[i] <= trigger[i] and trigger[i] + suffixes.GRAM <= lo[i] + 200


def test_covered_merges_runs():
    starts, ends = suffixes.covered(np.array([500, 0, 10, 210]), np.array([500, 3, 10, 215]), 200)
    assert starts.tolist() == [0, 500] and ends.tolist() == [415, 700]


def test_suffixes_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove(docs, digest=True).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=420), min_size=1, max_size=4))
def test_parse_covers_every_window_once(texts):
    blobs = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    row, lo, hi, trigger, _ = suffixes.parse(np.frombuffer(b"".join(blobs), np.uint8), offs, 200)
    seen = [p for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)]
    assert seen == [offs[k] + p for k, b in enumerate(blobs) for p in range(len(b) - 199)]
    assert ((trigger >= hi) & (trigger + suffixes.GRAM <= lo + 200)).all()
    assert all(offs[r] <= a and b + 200 <= offs[r + 1] for r, a, b in zip(row, lo, hi, strict=True))


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(n))


def weighted(a, b, idf):
    def features(t):
        h, tf, _ = neardup.shingles(pa.array([t.lower()]))
        return dict(zip(h.tolist(), neardup.weights(h, tf, idf).tolist(), strict=True))

    x, y = features(a), features(b)
    inter = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return inter / (sum(x.values()) + sum(y.values()) - inter) if x and y else 0.0


def near_corpus():
    rng = np.random.default_rng(4)
    base = [sentence(rng, 200) for _ in range(12)]
    texts = list(base)
    for k, t in enumerate(base[:8]):
        words = t.split()
        for edits in (1, 2, 3, 12):
            w = list(words)
            for at in rng.choice(len(w), edits, replace=False):
                w[at] = f"edit{k}{edits}{at}"
            texts.append(" ".join(w))
    return [*texts, base[0], base[0].upper(), None, "", "!!!", "???", "one two", "One two.", "one three", "word " * 30_000]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_corpus()
    docs = spark.createDataFrame([(i * 3, t, "c", "n") for i, t in enumerate(texts)], "doc_id long, text string, class_id string, node string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert len(got) == len(texts)
    idf = neardup.idf_table(docs, "text")
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if a and b and weighted(a, b, idf) >= 0.8:
                root[find(i)] = find(j)
    want = [find(i) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i * 3] == got[j * 3]) == (want[i] == want[j]), (i, j)
    assert all(c == min(k for k, v in got.items() if v == c) for c in got.values())


def test_deduplicated_keeps_one_of_each_class(spark):
    texts = near_corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (0, texts[0], 1), (None, texts[1], 1)], "doc_id long, text string, n_chars int")
    kept = neardup.deduplicated(docs).collect()
    classes = {r.doc_id: r.class_id for r in neardup.classes(docs).collect() if r.doc_id is not None}
    worded = [r.doc_id for r in kept if r.text and any(c.isalnum() for c in r.text)]
    assert sorted(worded) == sorted({c for i, c in classes.items() if texts[i] and any(x.isalnum() for x in texts[i])})
    assert sum(not r.text for r in kept) == 2
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def family(n, seed):
    """A form letter in n versions of some 0.77 alike; each two share four changes more, which makes them 0.82 alike."""
    rng = np.random.default_rng(seed)
    words, texts = sentence(rng, 1200).split(), []
    for k in range(0, n, 2):
        own = rng.choice(240, 28, replace=False) * 5
        for half in (own[:16], np.concatenate([own[:4], own[16:]])):
            w = list(words)
            for at in half:
                w[at] = f"new{k}x{at}" if at in own[:4] else f"own{len(texts)}x{at}"
            texts.append(" ".join(w))
    return texts


def linked_in_buckets(spark, docs, texts):
    """Pairs of row numbers that share a bucket and are similar, by brute force."""
    table = neardup.idf_table(docs, "text")
    bands = {r.id: r.bands for r in neardup.sketches(docs, spark.sparkContext.broadcast(table), "doc_id", "text").collect()}
    bands = np.array([bands[i] for i in range(len(texts))])
    h, tf, first = neardup.shingles(pa.array(texts))
    w, (known, place) = neardup.weights(h, tf, table), np.unique(h, return_inverse=True)
    total, out = np.add.reduceat(w, first[:-1]), []
    for i in range(1, len(texts)):
        mine = np.zeros(len(known))
        mine[place[first[i] : first[i + 1]]] = w[first[i] : first[i + 1]]
        inter = np.add.reduceat(np.minimum(mine[place[: first[i]]], w[: first[i]]), first[:i])
        alike = (inter / (total[i] + total[:i] - inter) >= 0.8) & (bands[:i] == bands[i]).any(axis=1)
        out += [(i, int(j)) for j in np.flatnonzero(alike)]
    return out, max(np.unique(bands, return_counts=True)[1])


def assert_classes_join(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, largest = linked_in_buckets(spark, docs, texts)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    root = list(range(len(texts)))
    for i, j in want:
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        root[max(i, j)] = min(i, j)
    for i in range(len(texts)):
        root[i] = root[root[i]]
    lost = [(i, j) for i, j in want if got[i] != got[j]]
    assert not lost, f"{len(lost)} of {len(want)} pairs in buckets of up to {largest}"
    assert [got[i] for i in range(len(texts))] == root
    return largest


def test_true_partners_among_many_alike_are_found(spark):
    assert 64 < assert_classes_join(spark, family(400, 21)) <= 256


def test_buckets_beyond_a_block_are_compared_whole(spark):
    assert assert_classes_join(spark, family(700, 22)) > neardup.BLOCK


def task(texts, roots=None, bands=None, band=0, left=None, right=None):
    n = len(texts)
    roots = [bytes([i // 256, i % 256]) for i in range(n)] if roots is None else roots
    side = lambda x: [True] * n if x is None else x
    return pa.table({"band": [band] * n, "root": pa.array(roots, pa.binary()), "left": side(left), "right": side(right), "bands": pa.array(bands or [[0, i] for i in range(n)], pa.list_(pa.int64())), "text": texts})


def test_similar_texts_of_unlike_samples_are_linked():
    texts = family(400, 23)
    idf = np.full(neardup.IDF_BUCKETS, 1 + neardup.IDF_SPAN, np.float32)
    h, tf, first = neardup.shingles(pa.array(texts))
    got = neardup.Sampler(1 + neardup.IDF_SPAN).samples(h, neardup.weights(h, tf, idf), first[:-1])
    unlike = [i for i in range(0, 400, 2) if (got[i] == got[i + 1]).mean() < 0.73]
    assert unlike
    for i in unlike:
        assert neardup.compared(task(texts[i : i + 2]), idf, 0.8).num_rows == 1 and weighted(texts[i], texts[i + 1], idf) >= 0.8


def test_estimates_equal_plain_weights():
    rng = np.random.default_rng(3)
    words = ["a", "b", "c"]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) for _ in range(30)] + [sentence(rng, 50)]
    idf = (1 + rng.random(neardup.IDF_BUCKETS) * neardup.IDF_SPAN).astype(np.float32)
    f = neardup.Features(pa.array(texts), idf)
    left, right = np.arange(0, 20), np.arange(10, 31)
    got = f.estimate(left, right, idf)
    want = np.array([[weighted(texts[i], texts[j], idf) for j in right] for i in left])
    assert np.abs(got - want).max() < 1e-5
    assert np.abs(f.against(f.of(3), 10, 31) - want[3]).max() < 1e-12


def test_a_pair_is_compared_in_its_first_band_only():
    rng = np.random.default_rng(5)
    text = sentence(rng, 60)
    texts, idf = [text, text + " more"], np.ones(neardup.IDF_BUCKETS, np.float32)
    assert neardup.compared(task(texts, bands=[[7, 1], [8, 1]], band=1), idf, 0.8).num_rows == 1
    assert neardup.compared(task(texts, bands=[[7, 1], [7, 1]], band=1), idf, 0.8).num_rows == 0
    assert neardup.compared(task(texts, roots=[b"x", b"x"]), idf, 0.8).num_rows == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(8)
    words = sentence(rng, 400).split()
    other = list(words)
    for at in range(0, 400, 40):
        other[at] = f"x{at}"
    a, b = " ".join(words), " ".join(other)
    idf = np.full(neardup.IDF_BUCKETS, 1 + neardup.IDF_SPAN, np.float32)
    h, tf, first = neardup.shingles(pa.array([a, b]))
    got = neardup.Sampler(1 + neardup.IDF_SPAN).samples(h, neardup.weights(h, tf, idf), first[:-1])
    assert abs((got[0] == got[1]).mean() - weighted(a, b, idf)) < 0.15


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7), (5, 4)] + [(200, k) for k in range(201, 240)], "a long, b long")
    got = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(21)) and got[100] == got[101] == got[102] == 100 and all(got[k] == 200 for k in range(200, 240))
    assert components.components(links.limit(0), "a", "b").count() == 0


def edit_region(item: bytes, text: bytes) -> int:
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        for j, d in enumerate(text):
            new[j + 1] = min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min())


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [sentence(rng, n) for n in (6, 9, 14)] + ["tiny", None, "", "!?"]
    items.append(items[1])

    def spoiled(t, k):
        t = list(t)
        for _ in range(k):
            at, what = int(rng.integers(len(t))), int(rng.integers(3))
            t[at : at + (what != 0)] = [] if what == 1 else ["z"]
        return "".join(t)

    texts = [sentence(rng, 20) + " " + spoiled(t, k) + " " + sentence(rng, 5) for t in items[:3] for k in range(0, 9)] + [items[0].upper().replace(" ", " *** "), items[2][:40], sentence(rng, 60), "", None, items[1]]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: sorted(r["items"]) for r in decontam.contaminated(docs, bench).collect()}
    clean = lambda t: bytes(decontam.normalised(pa.array([(t or "").lower()]))[0])
    for i, t in enumerate(texts):
        want = []
        for k, b in enumerate(items):
            b = clean(b).strip()
            if b and (edit_region(b, clean(t)) <= int(len(b) * 0.1) if len(b) >= decontam.Q else b" " + b + b" " in b" " + clean(t) + b" "):
                want.append(k)
        assert got[i] == want, (i, got[i], want)
    kept = decontam.contaminated(docs, bench, only_clean=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if not v) and kept.columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_short_items_have_their_whole_budget(spark):
    rng = np.random.default_rng(16)
    letters = list("abcdefgh ")
    word = lambda n: "x" + "".join(rng.choice(letters, max(0, n - 2))) + "y" * (n > 1)
    clean = lambda t: bytes(decontam.normalised(pa.array([(t or "").lower()]))[0])
    items = [word(n) for n in range(1, 41)] + ["42 ok", "ü", "Ab", "ab"]
    texts = ["the answer is 42 ok", "the answer is 42 okay", "142 ok", "42 ok, then", "ab-c", "grüß ü", "cab", "", None, "42\nOK"]
    for t in items[:40]:
        spoilt = list(t)
        for at in rng.choice(len(t), len(t) // 10, replace=False):
            spoilt[at] = "z"
        texts += [f"{word(30)} {''.join(spoilt)} {word(9)}", f"{word(12)}{t[:-1]}q{word(3)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted(r["items"]) for r in decontam.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = [k for k, b in enumerate(clean(x).strip() for x in items) if b and (edit_region(b, clean(t)) <= len(b) // 10 if len(b) >= 8 else b" " + b + b" " in b" " + clean(t) + b" ")]
        assert got[i] == want, (i, t, [items[k] for k in set(got[i]) ^ set(want)])


def test_decontamination_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(17)
    items = [sentence(rng, 12) for _ in range(4)] + ["42 ok"]
    text = " ".join([sentence(rng, 60), items[0], sentence(rng, 90), items[2][:40] + "zz" + items[2][42:], sentence(rng, 30), "42 ok"])
    items += [f"common beginning of the items {k} {sentence(rng, 4)}" for k in range(30)]
    text += " common beginning of the items" * 9 + " " + items[30]
    found = decontam.index(list(enumerate(items)), 0.1)
    want = decontam.find(found, pa.array([text, None, items[1]]))
    assert {0, 2, 4} <= set(want[0]) and 30 in want[0] and want[1:] == [[], [1]]
    for stretch, hits in ((300, 1 << 21), (1 << 20, 500)):
        monkeypatch.setattr(decontam, "STRETCH", stretch)
        monkeypatch.setattr(decontam, "HITS", hits)
        assert decontam.find(found, pa.array([text, None, items[1]])) == want


def test_decontamination_columns(spark):
    docs = spark.createDataFrame([(1, "abc the long benchmark item here", "x", "y", "z")], "doc_id long, text string, items string, _whole string, whole string")
    got = decontam.contaminated(docs, spark.createDataFrame([("q", "the long benchmark item")], "item_id string, text string")).first()
    assert got["items"] == ["q"] and (got["_whole"], got["whole"]) == ("y", "z")
    assert decontam.contaminated(docs, spark.createDataFrame([("q", "an item that isn't there")], "item_id string, text string"), only_clean=True).first() == docs.first()
    with pytest.raises(ValueError):
        decontam.contaminated(docs, docs, item_id="doc_id", found_col="text")


def test_decontamination_takes_large_benchmarks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(6)
    items = [sentence(rng, 12) for _ in range(9)]
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(items)] + [(99, sentence(rng, 40))], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {i: [i] for i in range(9)} | {99: []}


@pytest.mark.parametrize("text", ["a" * 400_000, "ab " * 100_000])
def test_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffixes.remove(docs, digest=True).collect()} == {1: len(text), 2: 0, 3: len(text)}
    assert len({r.class_id for r in neardup.classes(docs).collect()}) == 2
