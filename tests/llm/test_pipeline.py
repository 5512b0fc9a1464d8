"""The pipeline against a plain version of it, and the registered queries on a small folder of tables."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from doppel.llm import decontam, queries, tokens, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    texts, toxic = [], {}
    for i in range(160):
        t = say(40)
        if i % 4 == 0:
            t = t.replace(" ", " vile ", 1) + " rotten nasty"
        toxic[i] = int(i % 4 == 0)
        texts.append(t)
    base = [say(150) for _ in range(4)]
    near = [" ".join(w if k not in (5, 90) else f"new{k}" for k, w in enumerate(b.split())) for b in base]
    passage = say(60)
    items = [say(14) for _ in range(3)]
    texts += [*base, *near, base[0], f"{say(30)} {passage} {say(20)}", f"{passage} {say(50)}", f"{say(20)} {items[0]} {say(9)}", items[1].upper(), say(4000), "", None, base[0] + " vile rotten nasty vile"]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 - y, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_pipeline(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit(spark, docs, labels)
    rows = {i: t for i, t in rows.items() if toxicity.score_texts(model, pa.array([t]))[0] < 0.5}
    def shingled(t):
        words = re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", t.lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    feats = {i: shingled(t) for i, t in rows.items()}  # plain similarity: no pair of these tables is close to the threshold
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = feats[i], feats[j]
            if x & y:
                alike = len(x & y) / len(x | y)
                assert not 0.7 < alike < 0.85
                if alike >= 0.8:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    rows = {i: t for i, t in rows.items() if find(i) == i}
    seen: dict[bytes, int] = {}
    for t in rows.values():
        b = t.encode()
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    for i, t in rows.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        rows[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    clean = lambda t: bytes(decontam.normalised(pa.array([t.lower()]))[0]).strip()
    items = [clean(r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    return {i: t for i, t in rows.items() if not any(b in clean(t) for b in items)}


def test_pipeline_equals_the_plain_version(spark, folder):
    want = plain_pipeline(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(want)
    encode = tokens.encoder(tokens.default_path())
    for i, t in want.items():
        ids = np.append(encode(t), np.uint32(0)).astype("<u4")
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    assert len(want) < 150 and 173 in want and 174 in want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "neardup", "suffixes", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id between 155 and 162 or text is null or text = ''")
    one = docs.filter("doc_id = 162")
    odd = docs.unionByName(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(one.withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit("!!!"), "n_chars": F.lit(3).cast("long")}))
    for c in ("_text", "_lo", "_node", "node", "twin", "_whole", "whole", "items", "star", "id", "root", "class_id", "_key", "_part"):
        odd = odd.withColumn(c, F.lit(c))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns
        rows = got.collect()
        assert all(r["_text"] == "_text" and r["items"] == "items" and r["_whole"] == "_whole" and r["_node"] == "_node" for r in rows)
        kept[name] = sorted((-1 if r.doc_id is None else r.doc_id for r in rows))
    assert kept["suffixes"] == sorted(-1 if r.doc_id is None else r.doc_id for r in odd.collect())
    assert kept["neardup"].count(162) == 1 and -1 not in kept["neardup"] and 900 in kept["neardup"] and kept["decontamination"].count(162) == 2
    assert corpus_pipeline.pack(spark, odd, folder).filter("start = 0").count() == odd.count()


@pytest.mark.parametrize("name,columns", [
    ("op1_quality", ["doc_id", "held_out", "score", "predicted"]), ("op3_neardup", ["doc_id", "class_id"]), ("op4_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    ("op6_suffixes", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]), ("op9_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op10_decontam", ["doc_id", "contaminated", "n_items", "item_ids"]),
])
def test_queries_cover_every_document(spark, folder, name, columns):
    got = queries.QUERIES[name](spark, folder)
    assert got.columns == columns
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{folder}/documents.parquet").count()
