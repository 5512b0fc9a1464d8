import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doppel.llm import binpack, packing, shared, tokens, warc


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def texts():
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "état", "größe", "foo.", "\n\n", "  ", "123", "<|endoftext|>", "你好"]
    return [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 900, 60)] + ["", None, "x" * 5000, "a b " * 20_000]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizers_library(slow, text):
    assert tokens.encoder(tokens.default_path())(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_curve_packing_round_trip(spark, slow):
    rows = [(i, t, "k", 5) for i, t in enumerate(texts())] + [(None, "null id", "k", 5), (0, texts()[0], "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3)
    got = packing.pack(docs, keep_ids=True).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for i, t, *_ in rows[1:-2]:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[i], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == ids
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist() and parts[0].doc_tokens == len(ids)
    assert sum(r.length for r in by[0]) == 2 * by[0][0].doc_tokens and len(by[None]) >= 1
    for v in seq.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == np.cumsum([0] + [r.length for r in v])[:-1].tolist()
        n = sum(r.length for r in v)
        assert n <= 1024 and n & (n - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert_is_a_curve():
    level, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << level)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(cells, level)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_like_documents_are_near_on_the_curve():
    rng = np.random.default_rng(0)
    a, b = ([f"{p}{i}" for i in range(40)] for p in "ab")
    one = [" ".join(rng.choice(a, 300)) for _ in range(20)]
    two = [" ".join(rng.choice(b, 300)) for _ in range(20)]
    key = packing.curve_keys(pa.array(one + two))
    side = np.array([0] * 20 + [1] * 20)[np.argsort(key)]
    assert (np.diff(side) != 0).sum() <= 12


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing_equals_a_linear_search(lengths):
    got = binpack.best_fit(lengths, 64)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in got)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(64 - n)
    assert len(got) == len(rooms) and sorted(64 - sum(lengths[i] for i in b) for b in got) == sorted(rooms)


def test_matrices_round_trip(spark, slow):
    rows = [(i, t, "k") for i, t in enumerate(texts())] + [(None, "null id", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = binpack.write(docs, shared.fresh_path(spark, "test")).collect()
    parts = collections.defaultdict(dict)
    for r in got:
        ids, place = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(place) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 0).all()
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert (place[a:b] == np.arange(b - a)).all()
            parts[d][s] = ids[a:b]
    for i, t, _ in rows:
        assert np.concatenate([parts[i][s] for s in sorted(parts[i])]).tolist() == slow.encode(t or "", add_special_tokens=False).ids + [50256]
    assert sum(r.n_tokens for r in got) / len(got) > 900
    assert binpack.pack(docs.limit(0)).count() == 0


def test_arc_header_versions():
    block = "HTTP/1.1 200 OK\r\n\r\n<p>\n\nx</p>"
    for version in (1, 2):
        data = (warc.arc_volume(version, "f.arc") + "\n" + warc.arc_header(version, "http://a/b", "20200101000000", "text/html", len(block)) + "\n" + block + "\n").encode() * 2
        assert list(warc.arc_records(data)) == [(version, "http://a/b", "20200101000000", "text/html", block.encode())] * 2
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-20]))
    with pytest.raises(ValueError):
        list(warc.arc_records(warc.arc_volume(1, "f").encode() + b"\nhttp://a b c d e f 3\nabc\n"))


def test_archives_round_trip(spark):
    big = "<html>" + "y" * 300 + "\r\n\r\nWARC/1.1\r\n</html>"
    rows = [(5, "http://a/ b", big), (2, None, big), (9, "u", big), (1, "u", "short"), (3, "u", "short"), (4, "", ""), (6, "u", None), (7, "u", "ü" * 60), (8, "u", "ü" * 60), (8, "u", "ü" * 60), (None, "u", big), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "q" * 20_000_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and i != first[h or ""]
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%20b"} and {r.url for r in got if r.page_id == 4} == {"about:blank"}
    assert warc.archive(pages.limit(0)).count() == 0
