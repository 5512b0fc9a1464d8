"""Small cases of the detector, each a few rows."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from doppel import schemas
from doppel.config import DetectorConfig
from doppel.functions import address, scoring
from doppel.operators import detect, display_ann, evaluate

V, T1, T2 = "1" * 40, "2" * 40, "3" * 40
NOW = dt.datetime(2026, 5, 13, 10)
R4, L4 = "aaaa" + "0" * 32 + "bbbb", "aaaa" + "9" * 32 + "bbbb"
R6, L6 = "aaaaaa" + "0" * 28 + "bbbbbb", "aaaaaa" + "9" * 28 + "bbbbbb"


def cps(spark, *rows):
    full = [(V, r, t, "USDT", "Tether", 6, NOW + seen, freq, False) for r, t, seen, freq in rows]
    return spark.createDataFrame(full, schemas.COUNTERPARTY)


def events(spark, *rows):
    full = [(i, f"h{i}", "0x" + V, to, token, float(v), 0.0, NOW, NOW + dt.timedelta(seconds=12), 0, None, True, "x", V) for i, (to, token, v) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.EVENT)


def meta(spark, *tokens):
    return spark.createDataFrame([(t, 6, "USDT", "Tether", False) for t in tokens], schemas.TOKEN_METADATA)


def found(spark, config, known, pending, method="trie_union", tokens=()):
    got = detect.alerts(events(spark, *pending), cps(spark, *known), meta(spark, *tokens), config, method).collect()
    return {(r.event_id, r.recipient) for r in got}


def additive(w, **k):
    return DetectorConfig(score_mode="additive", weights=w, lambda_sec=3600, **k)


AGO = dt.timedelta(minutes=-5)


def test_score_first_without_theta(spark):
    c = additive((0.2, 0.3, 0.2, 0.2, 0.1), kp=4, ks=4, theta_p=4, theta_s=4, tau=0.55)
    assert found(spark, c, [(R4, T1, dt.timedelta(minutes=-10), 1)], [(L4, T2, 0)]) == {(0, R4)}


@pytest.mark.parametrize("seen,hit", [(dt.timedelta(hours=1), False), (dt.timedelta(days=-31), False), (dt.timedelta(hours=-24), True)])
def test_window(spark, seen, hit):
    c = additive((0.4, 0.2, 0.1, 0.2, 0.1), kp=4, ks=4, tau=0.25).replace(lambda_sec=86400.0)
    for method in ("trie_union", "linear_scan", "key_index"):
        assert bool(found(spark, c, [(R4, T1, seen, 1)], [(L4, T2, 0)], method)) == hit


def test_counterfeit_token(spark):
    c = additive((0.2, 0.1, 0.45, 0.15, 0.1), kp=4, ks=4, tau=0.9)
    assert found(spark, c, [(R4, T1, AGO, 1)], [(L4, T2, 1)], tokens=(T1, T2)) == {(0, R4)}
    assert not found(spark, c, [(R4, T1, AGO, 1)], [(L4, T2, 1)])


def test_union_hits_where_intersection_misses(spark):
    c = additive((0.25, 0.25, 0.2, 0.2, 0.1), tau=0.5)
    pending = [("ffffff" + "0" * 28 + "bbbbbb", T2, 0)]
    assert found(spark, c, [(R6, T1, AGO, 1)], pending) and not found(spark, c, [(R6, T1, AGO, 1)], pending, "trie_intersection")


def test_cumulative_finds_what_the_deepest_node_hides(spark):
    c = additive((0.2, 0.3, 0.2, 0.2, 0.1), tau=0.65)
    shallow, deep = "abc111" + "0" * 28 + "aaaaaa", "abc999" + "0" * 28 + "bbbbbb"
    known = [(shallow, T1, AGO, 1), (deep, T1, dt.timedelta(hours=1), 1)]
    pending = [("abc999" + "9" * 28 + "cccccc", T2, 0)]
    assert found(spark, c, known, pending) == {(0, shallow)} and not found(spark, c, known, pending, "trie_legacy")


def test_exact_recipient_is_no_lookalike(spark):
    c = additive((0.3, 0.2, 0.2, 0.15, 0.15), tau=0.25)
    for method in ("trie_union", "linear_scan", "key_index", "lsh_display", "lsh_graph"):
        assert not found(spark, c, [(R6, T1, AGO, 1)], [(R6, T1, 1)], method)


@pytest.mark.parametrize("method", ["key_index", "lsh_display", "lsh_graph"])
def test_baselines_find_the_lookalike(spark, method):
    c = additive((0.3, 0.2, 0.2, 0.15, 0.15), max_candidates_per_side=8, tau=0.5)
    known = [(R6, T1, AGO, 3), ("123456" + "0" * 28 + "fedcba", T1, dt.timedelta(minutes=-10), 1)]
    assert (0, R6) in found(spark, c, known, [(L6, T2, 0)], method)


def _bulk(spark, n=300, seed=7):
    """One victim with many counterparties, two of them twice, some shown alike, and look-alikes of them."""
    import random

    rng = random.Random(seed)
    addr = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    some = [addr() for _ in range(n)]
    some += [a[:6] + addr()[:28] + a[-6:] for a in some[:20]] + some[:2]
    looks = [a[:4] + addr()[:32] + a[-4:] for a in some[:12]] + [addr() for _ in range(4)]
    return some, cps(spark, *((a, T1, AGO, 1) for a in some)), events(spark, *((a, T2, 0) for a in looks))


def _searched(rows):
    return {(r.lookalike, r.recipient) for r in rows.select("lookalike", "recipient").distinct().collect()}


@pytest.mark.parametrize("limit", [3, 100])
def test_votes_as_a_plan_are_the_plain_votes(spark, limit):
    some, known, pending = _bulk(spark)
    c = DetectorConfig(max_candidates_per_side=limit)
    ids = sorted(set(some))
    code = display_ann.codes(ids)
    places, want = display_ann.project(code, display_ann.weights()), set()
    for look in {r.lookalike for r in detect.pair_victims(pending).join(known.select("victim"), "victim", "left_semi").select("lookalike").collect()}:
        q = display_ann.codes([look])
        want |= {(look, ids[k]) for k in display_ann.by_votes(q[0], display_ann.project(q, display_ann.weights())[0], code, places, 2 * limit)}
    assert _searched(detect.candidates(pending, known, meta(spark), c, "lsh")) == want


def test_hashed_retrieval_shuffles_no_met_pairs(spark):
    """What all pairs of look-alikes and counterparties give is summed where they meet."""
    _, known, pending = _bulk(spark)
    plan = detect.alerts(pending, known, meta(spark), DetectorConfig(), "lsh_display")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "votes array" not in plan


@pytest.mark.parametrize("queries", [4, 4096])
def test_graph_search_as_a_plan_is_the_plain_search(spark, monkeypatch, queries):
    """Also where a victim's queries are dealt to blocks; visited points go to the rows, not to shuffles of their own."""
    monkeypatch.setattr(display_ann, "QUERIES", queries)
    some, known, pending = _bulk(spark, 60)
    ids = sorted(set(some))
    code, w = display_ann.codes(ids), display_ann.weights()
    places, want = display_ann.project(code, w), set()
    links = display_ann.build_graph(code, places)
    for look in {r.lookalike for r in detect.pair_victims(pending).join(known.select("victim"), "victim", "left_semi").select("lookalike").collect()}:
        q = display_ann.codes([look])
        want |= {(look, ids[k]) for k in display_ann.by_graph(q[0], display_ann.project(q, w)[0], code, places, links, 100)}
    got = detect.candidates(pending, known, meta(spark), DetectorConfig(max_candidates_per_side=50), "graph")
    assert _searched(got) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("InPandas") == 0


@pytest.mark.parametrize("method", ["legacy", "rule"])
def test_deepest_nodes_meet_histories_once(spark, method):
    """The recipients of both sides' deepest nodes; no history is sent under several keys."""
    import os.path

    some, known, pending = _bulk(spark, 60)
    shared = lambda a, b: len(os.path.commonprefix([a[:6], b[:6]]))
    got, want = detect.candidates(pending, known, meta(spark), DetectorConfig(), method), set()
    for look in {r.lookalike for r in detect.pair_victims(pending).join(known.select("victim"), "victim", "left_semi").select("lookalike").collect()}:
        ap, as_ = ({r: shared(look[::d], r[::d]) for r in some} for d in (1, -1))
        sides = [{r for r in some if at[r] == max(at.values()) > 0} for at in (ap, as_)]
        want |= {(look, r) for r in (sides[0] & sides[1] if method == "rule" else sides[0] | sides[1])}
    assert _searched(got) == want
    # the only rows that are multiplied are events, one for each end
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(p" not in plan and "side" not in plan


def test_packed_addresses(spark):
    some = ["ab" * 20, "AB" * 20, "", "0x12", "x" * 20, "é" * 10]
    rows = spark.createDataFrame([(a,) for a in [*some, None]], "a string").withColumn("p", address.pack("a")).withColumn("b", address.unpack("p")).collect()
    assert all(r.a == r.b for r in rows) and len({bytes(r.p) for r in rows if r.p is not None}) == len(some) and len(rows[0].p) == 20


def test_confirmed_rule(spark):
    c = DetectorConfig(theta_p=6, theta_s=6)
    assert found(spark, c, [(R6, T1, AGO, 1)], [(L6, T2, 0), (L6, T1, 100)], "confirmed_rule") == {(0, R6)}


def test_pruning_keeps_the_highest_rank(spark):
    c = DetectorConfig(max_candidates_per_side=1, tau=0.0)
    other = "aaaaaa" + "1" * 28 + "bbbbbb"
    known = [(R6, T1, AGO, 1), (other, T2, dt.timedelta(days=-3), 1)]
    got = detect.candidates(events(spark, (L6, T2, 0)), cps(spark, *known), meta(spark), c).select("recipient").distinct().collect()
    assert [r.recipient for r in got] == [other]


def test_invalid_addresses_and_nulls(spark):
    rows = [("0x12", T2, 0), (L6, None, 0)]
    c = DetectorConfig(tau=0.1)
    assert found(spark, c, [(R6, T1, AGO, 1)], rows) == {(1, R6)}
    assert detect.alerts(events(spark, (L6, T2, 0)).limit(0), cps(spark, (R6, T1, AGO, 1)), meta(spark), c).count() == 0


#: Least matched digits of 12 at which the default score reaches 0.901, by type score and token score.
GOLDEN = {(1.0, 1.0): 2, (1.0, 0.7): 3, (1.0, 0.4): 3, (1.0, 0.2): 4, (0.8, 1.0): 3, (0.8, 0.7): 3, (0.8, 0.4): 4, (0.8, 0.2): 6, (0.25, 1.0): 4, (0.25, 0.7): 6, (0.25, 0.4): 11, (0.25, 0.2): None}


def test_golden_scores(spark):
    c = DetectorConfig()
    rows = [(n / 12, t, k, n) for (t, k), n in itertools.product(GOLDEN, range(13))]
    got = spark.createDataFrame(rows, "s_addr double, s_type double, s_token double, n int").withColumns({"s_time": F.lit(0.0), "s_value": F.lit(0.0)}).withColumn("total", scoring.total(c)).collect()
    for (t, k), least in GOLDEN.items():
        hit = sorted(r.n for r in got if (r.s_type, r.s_token) == (t, k) and r.total >= c.tau)
        assert (hit[0] if hit else None) == least


def test_display_code(spark):
    a = "abcdef" + "0" * 28 + "123456"
    row = spark.createDataFrame([(a,)], "a string").select(address.display_code("a").alias("c"), address.one_hot(address.display_code("a")).alias("v")).first()
    assert row.c[:3] == [10, 11, 12] and row.c[-1] == 6 and len(row.v) == 192 and sum(row.v) == 12
    assert (display_ann.codes([a])[0] == row.c).all()


def test_invariants_between_methods(spark):
    import random

    rng = random.Random(4)
    addr = lambda: "".join(rng.choice("0123") for _ in range(40))
    known = [(addr(), rng.choice([T1, T2]), dt.timedelta(days=-rng.randint(0, 40)), 1) for _ in range(60)]
    pending = [(addr(), rng.choice([T1, T2, ""]), rng.choice([0, 5, 100])) for _ in range(40)]
    c = DetectorConfig(tau=0.3)
    sets = {m: found(spark, c, known, pending, m) for m in ("trie_union", "trie_intersection", "linear_scan", "key_index")}
    assert sets["trie_intersection"] <= sets["trie_union"] <= sets["linear_scan"] and sets["key_index"] == sets["trie_union"]
    e, k, m = events(spark, *pending), cps(spark, *known), meta(spark)
    run = evaluate.method_metrics(e, k, m, c).first()
    swept = evaluate.tau_sweep(e, k, m, c, [0.3, 0.9]).filter("tau = 0.3").first()
    assert (run.tp, run.fp, run.fn, run.tn) == (swept.tp, swept.fp, swept.fn, swept.tn)
    assert sum(r.tp for r in evaluate.daily_metrics(e, k, m, c).collect()) == run.tp


def test_methods_without_a_score(spark):
    with pytest.raises(ValueError):
        detect.max_score(events(spark, (L6, T2, 0)), cps(spark, (R6, T1, AGO, 1)), meta(spark), DetectorConfig(), "linear_scan")
