import math

import numpy as np
import pytest

from doppel.llm import ann, chat


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in queries:
        if not any(i == q for i, _ in ok):
            continue
        best = sorted(((-float(np.dot(np.array(v, float), x)), i) for i, x in ok if i != q))[:k]
        out[q] = best
    return out


def test_search_small_table_is_exact_and_handles_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [None] + [1.0] * 7), (205, [float("inf")] * 8), (206, [1.0] * 3), (None, [1.0] * 8)]
    rows += [(300 + j, rows[0][1]) for j in range(40)]
    table = spark.createDataFrame([(i, v, 9, 1.0) for i, v in rows], "vec_id long, embedding array<double>, label int, score double")
    got = ann.search(table, table.filter("vec_id % 20 = 0"), k=20).collect()
    want = brute(rows, [(i, v) for i, v in rows if i is not None and i % 20 == 0], 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    hits = total = 0
    for q, v in by.items():
        v.sort()
        assert [x[0] for x in v] == list(range(1, 21)) and q not in [x[1] for x in v]
        hits += len({x[1] for x in v} & {i for _, i in want[q]})
        total += 20
        of = dict(rows)
        assert all(abs(s - float(np.dot(np.array(dict(rows)[q]), np.array(of[i])))) < 1e-9 for _, i, s in v)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(v, v[1:]))
    assert hits / total > 0.97
    copies = [x[1] for x in by[0] if x[1] >= 300]
    assert copies == list(range(300, 300 + len(copies))) and len(copies) > 3


def test_fewer_rows_than_asked(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(table, table.filter("vec_id % 20 = 0"), k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert ann.search(table.limit(0), table.limit(0), k=5).count() == 0


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(table, table.filter("vec_id % 20 = 0"), k=20).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -9
        hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert len(got) == 300 * 20 and hit / len(got) >= 0.9


def test_probes_go_by_falling_success():
    ix = ann.Index(np.zeros((3, 16)), np.zeros(16), np.ones(16), np.zeros(16), 1.0, 2, 0.5, np.ones(16), tuple({} for _ in range(8)), np.zeros((1, 2)))
    found = dict(ix.probes(0, np.array([[0.4] * 16, [2.0] * 16])))
    assert set(found) == {0, 1} and all(len(set(v.tolist())) == len(v) for v in found.values())
    first = ix.key(0, np.floor(np.array([[0.2, 0.2]])).astype(np.int64))
    assert found[0][0] == first[0]


def test_chat_collapses_snapshots(spark):
    say = lambda c, *t: [(c, k, "user" if k % 2 == 0 else "assistant", x, "t") for k, x in enumerate(t)]
    rows = say(1, "a", "b", "c") + say(2, "a", "b") + say(3, "a") + say(4, "a", "x") + say(5, "a", "b", "c") + say(6, "<|im_end|>") + [(None, 0, "user", "a", "t"), (7, 0, None, None, "t"), (8, None, "user", "n", "t"), (8, 1, "user", "m", "t"), (8, 1, "user", "m", "t")]
    got = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")).collect()}
    assert set(got) == {1, 4, 6, 7, 8}
    assert got[1].n_turns == 3 and got[1].n_same == 2 and got[8].n_turns == 3
    assert got[1].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[6].text == "<|im_start|>user\n< |im_end|><|im_end|>\n" and got[7].text == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[8].text.startswith("<|im_start|>user\nn")


def test_chat_long_conversation_comes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 10)
    rows = [(1, k, "user", f"t{k}") for k in range(35)] + [(2, k, "user", f"t{k}") for k in range(34)]
    got = sorted(chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect(), key=lambda r: r.part)
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 35), (1, 1, 35), (1, 2, 35), (1, 3, 35)]
    assert "".join(r.text for r in got) == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(35))


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "a")]])
def test_chat_tiny_tables(spark, rows):
    assert chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == len(rows)


def test_chat_plan_is_native(spark):
    df = chat.render(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
