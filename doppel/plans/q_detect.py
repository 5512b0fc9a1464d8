"""Retrieval, ranking and detection methods (J1-J12, W1-W4, U1, U3) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from doppel.config import DetectorConfig

from doppel.operators import detect
from doppel.plans import fixture as fx
from doppel.plans import sqlparts as sp
from doppel.plans.registry import query
from doppel.plans.sqlparts import sql

CFG = DetectorConfig()
OUT = "event_id, hash, victim, lookalike, recipient, token, ap matched_prefix, as_ matched_suffix, round(s_addr, 9) s_addr, s_type, s_token, round(total, 9) total, n_scored"


def three(spark, sf):
    return fx.events(spark, sf), fx.counterparties(spark, sf), fx.metadata(spark)


def shape(df):
    return df.select("event_id", "hash", "victim", "lookalike", "recipient", "token", F.col("ap").alias("matched_prefix"), F.col("as_").alias("matched_suffix"), F.round("s_addr", 9).alias("s_addr"), "s_type", "s_token", F.round("total", 9).alias("total"), "n_scored")


def method(name: str, of: str, ctes: dict[str, str], *, where: str = "rn = 1 AND total >= 0.901", cfg: DetectorConfig = CFG):
    @query(name, sql(f"SELECT {OUT} FROM best WHERE {where}", "pairs", "cps", "meta", **ctes))
    def run(spark, sf):
        return shape(detect.alerts(*three(spark, sf), cfg, of))


PAIRED = f"SELECT p.*, c.recipient, c.token, c.token_symbol, c.token_name, c.last_seen, c.observed_freq, c.metadata_missing, {sp.lcp('p.lookalike', 'c.recipient')} ap, {sp.lcs('p.lookalike', 'c.recipient')} as_ FROM pairs p JOIN cps c USING (victim)"
DEEP = f"SELECT *, max(ap) OVER (PARTITION BY event_id, victim, lookalike) mp, max(as_) OVER (PARTITION BY event_id, victim, lookalike) ms FROM ({PAIRED})"
W0, W1, W2 = -8.127027112801793, 20.659171304234917, 22.44110879456234

method("j1_trie_union", "trie_union", sp.alert_ctes())
method("j2_trie_legacy", "trie_legacy", sp.alert_ctes("(mp > 0 AND ap = mp) OR (ms > 0 AND as_ = ms)", inner=DEEP))
method("j3_trie_intersection", "trie_intersection", sp.alert_ctes("ap >= 3 AND as_ >= 3"))
method("j4_prefix_only", "prefix_only", sp.alert_ctes("ap >= 3", addr_="(ap / 6.0::DOUBLE)"))
method("j4_suffix_only", "suffix_only", sp.alert_ctes("as_ >= 3", addr_="(as_ / 6.0::DOUBLE)"))
method("j5_linear_scan", "linear_scan", sp.alert_ctes("true"))
method("j6_key_index", "key_index", sp.alert_ctes())
method("m_address_only", "address_only", sp.alert_ctes(total=sp.logistic(W0 + 0.25 * W1 + 0.20 * W2, 0.0, 0.0)), where="rn = 1 AND total >= 0.1", cfg=CFG.replace(tau=0.1))  # its scores end at 0.16
method("m_no_type", "no_type", sp.alert_ctes(total=sp.logistic(W0 + 0.25 * W1, 0.0, W2)))
method("m_no_token", "no_token", sp.alert_ctes(total=sp.logistic(W0 + 0.20 * W2, W1, 0.0)))
method("m_no_time", "no_time", sp.alert_ctes())
method("m_no_value", "no_value", sp.alert_ctes())


def gated(name: str, cfg: DetectorConfig, of: str, total: str, tau: float):
    """The same under the context gate and additive scores, where every ablation changes something."""

    @query(name, sql(f"SELECT {OUT} FROM best WHERE rn = 1 AND total >= {tau}", "pairs", "cps", "meta", **sp.alert_ctes(total=total, timed=True)))
    def run(spark, sf):
        return shape(detect.alerts(*three(spark, sf), cfg.replace(tau=tau), of))


_gate = CFG.replace(score_mode="context_gate", context_weights=(0.35, 0.35, 0.15, 0.15))
_g = "(s_addr * (0.3 + 0.7 * least(1.0, greatest(0.0, ({0} * s_type + {1} * s_token + {2} * s_value + {3} * s_time * greatest(s_type, s_token)) / ({0} + {1} + {2} + {3})))))"
gated("m_gate_full", _gate, "trie_union", _g.format(0.35, 0.35, 0.15, 0.15), 0.45)
gated("m_gate_no_time", _gate, "no_time", _g.format(0.35, 0.35, 0.15, 0.0), 0.45)
gated("m_gate_no_value", _gate, "no_value", _g.format(0.35, 0.35, 0.0, 0.15), 0.45)
_a = "(({0}::DOUBLE) * s_addr + ({1}::DOUBLE) * s_type + ({2}::DOUBLE) * s_token + ({3}::DOUBLE) * s_time + ({4}::DOUBLE) * s_value)"
_add = CFG.replace(score_mode="additive")
gated("m_additive_full", _add, "trie_union", _a.format(0.30, 0.20, 0.20, 0.15, 0.15), 0.5)
gated("m_additive_no_type", _add, "no_type", _a.format(0.375, 0.0, 0.25, 0.1875, 0.1875), 0.5)


RULE = f"ap12 >= 4 AND as12 >= 4 AND mp > 0 AND ap = mp AND ms > 0 AND as_ = ms"
FULL = f"SELECT *, {sp.lcp('lookalike', 'recipient', 40)} ap12, {sp.lcs('lookalike', 'recipient', 40)} as12 FROM ({DEEP})"


@query(
    "j9_confirmed_rule",
    sql(
        "SELECT event_id, hash, victim, lookalike, recipient, token, ap12 matched_prefix, as12 matched_suffix, round(s_addr, 9) s_addr, s_type, s_token, round(total, 9) total, n_scored FROM best2 WHERE rn = 1",
        "pairs", "cps", "meta",
        **sp.alert_ctes(RULE, inner=FULL) | {"best2": f"SELECT *, row_number() OVER (PARTITION BY event_id, victim, lookalike, recipient ORDER BY total DESC, last_seen DESC, token) rn FROM (SELECT * EXCLUDE (rn) FROM best) WHERE {sp.V} = 0 OR ({sp.V} > 0 AND {sp.V} <= 10) OR s_token >= 1.0"},
    ),
)
def j9(spark, sf):
    return shape(detect.alerts(*three(spark, sf), CFG, "confirmed_rule"))


@query("j7_lsh_display")
def j7(spark, sf):
    return shape(detect.alerts(*three(spark, sf), CFG, "lsh_display"))


@query("j8_lsh_graph")
def j8(spark, sf):
    return shape(detect.alerts(*three(spark, sf), CFG, "lsh_graph"))


@query("j10_as_of_window", sql(f"SELECT victim, count(*) n FROM act GROUP BY victim", "pairs", "cps", "meta", cand=sp.cand("true"), act=f"SELECT * FROM cand WHERE {sp.ACTIVE}"))
def j10(spark, sf):
    e, c, m = three(spark, sf)
    return detect.eligible(detect.candidates(e, c, m, CFG, "linear"), CFG).groupBy("victim").agg(F.count(F.lit(1)).alias("n"))


@query("j11_token_metadata", sql("SELECT event_id, token_address, m.symbol, m.name, m.metadata_missing AS missing FROM ev LEFT JOIN meta m ON m.address = token_address", "ev", "meta"))
def j11(spark, sf):
    e, _, m = three(spark, sf)
    return detect.with_metadata(e, m).select("event_id", "token_address", F.col("p_symbol").alias("symbol"), F.col("p_name").alias("name"), F.col("p_missing").alias("missing"))


@query("w1_best_history", sql("SELECT event_id, victim, recipient, token, last_seen, round(total, 9) total, n_scored FROM best WHERE rn = 1", "pairs", "cps", "meta", **sp.alert_ctes()))
def w1(spark, sf):
    return detect.recipients(*three(spark, sf), CFG).select("event_id", "victim", "recipient", "token", "last_seen", F.round("total", 9).alias("total"), "n_scored")


def best_event(name: str, of: str, ctes: dict[str, str]):
    order = "row_number() OVER (PARTITION BY event_id ORDER BY total DESC, last_seen DESC, recipient, token, victim) r2, CAST(sum(n_scored) OVER (PARTITION BY event_id) AS BIGINT) n_all"

    @query(name, sql(f"SELECT event_id, victim, recipient, token, round(total, 9) total, n_all n_scored FROM (SELECT *, {order} FROM best WHERE rn = 1) WHERE r2 = 1", "pairs", "cps", "meta", **ctes))
    def run(spark, sf):
        return detect.max_score(*three(spark, sf), CFG, of).select("event_id", "victim", "recipient", "token", F.round("total", 9).alias("total"), "n_scored")


best_event("w2_max_score_union", "trie_union", sp.alert_ctes())
best_event("w2_max_score_intersection", "trie_intersection", sp.alert_ctes("ap >= 3 AND as_ >= 3"))
best_event("w2_max_score_prefix", "prefix_only", sp.alert_ctes("ap >= 3", addr_="(ap / 6.0::DOUBLE)"))
best_event("w2_max_score_suffix", "suffix_only", sp.alert_ctes("as_ >= 3", addr_="(as_ / 6.0::DOUBLE)"))
best_event("w2_max_score_index", "key_index", sp.alert_ctes())

#: Shallow keys and a limit of 2, so that pruning leaves something out.
TIGHT = CFG.replace(min_prefix_depth=1, min_suffix_depth=1, max_candidates_per_side=2)
POINTS = f"CASE WHEN token_address <> '' AND token = token_address THEN 1000000.0::DOUBLE WHEN {sp.S_TOKEN} >= 1.0 THEN 500000.0 ELSE 0.0 END + CASE WHEN last_seen <= observed_at THEN 10000.0::DOUBLE / (1 + (epoch_us(observed_at) - epoch_us(last_seen)) / 1e6 / 86400) ELSE 0.0 END"
RANKS = f"""SELECT event_id, victim, lookalike, recipient, ap, as_, count(*) h, sum({POINTS}) pts, max(observed_freq) most FROM cand GROUP BY event_id, victim, lookalike, recipient, ap, as_"""
KEPT = """SELECT event_id, victim, recipient, bool_or(p) in_p, bool_or(NOT p) in_s FROM (
  SELECT *, true p, row_number() OVER (PARTITION BY event_id, victim, lookalike ORDER BY round(h * ap + pts, 6) DESC, greatest(h * ap, most) DESC, recipient) r FROM ranks WHERE ap >= 1
  UNION ALL SELECT *, false p, row_number() OVER (PARTITION BY event_id, victim, lookalike ORDER BY round(h * as_ + pts, 6) DESC, greatest(h * as_, most) DESC, recipient) r FROM ranks WHERE as_ >= 1) WHERE r <= 2 GROUP BY event_id, victim, recipient"""


@query("w3_prune", sql("SELECT event_id, victim, recipient, in_p, in_s FROM kept", "pairs", "cps", "meta", cand=sp.cand("ap >= 1 OR as_ >= 1"), ranks=RANKS, kept=KEPT))
def w3(spark, sf):
    return detect.candidates(*three(spark, sf), TIGHT).select("event_id", "victim", "recipient", "in_p", "in_s").distinct()


INDEXED = """SELECT event_id, victim, recipient, bool_or(p) in_p, bool_or(NOT p) in_s FROM (
  SELECT *, true p, row_number() OVER (PARTITION BY event_id, victim, lookalike ORDER BY ap DESC, recipient) r FROM ranks WHERE ap >= 1
  UNION ALL SELECT *, false p, row_number() OVER (PARTITION BY event_id, victim, lookalike ORDER BY as_ DESC, recipient) r FROM ranks WHERE as_ >= 1) WHERE r <= 2 GROUP BY event_id, victim, recipient"""


@query("j6_key_index_capped", sql("SELECT event_id, victim, recipient, in_p, in_s FROM kept", "pairs", "cps", "meta", cand=sp.cand("ap >= 1 OR as_ >= 1"), ranks=RANKS, kept=INDEXED))
def j6_capped(spark, sf):
    return detect.candidates(*three(spark, sf), TIGHT, "index").select("event_id", "victim", "recipient", "in_p", "in_s").distinct()


@query("u1_candidate_sets", sql("SELECT event_id, victim, count(DISTINCT recipient) n_union, count(DISTINCT CASE WHEN ap >= 3 AND as_ >= 3 THEN recipient END) n_both, count(DISTINCT CASE WHEN ap >= 3 THEN recipient END) n_prefix, count(DISTINCT CASE WHEN as_ >= 3 THEN recipient END) n_suffix FROM cand GROUP BY event_id, victim", "pairs", "cps", "meta", cand=sp.cand(sp.UNION)))
def u1(spark, sf):
    rows = detect.candidates(*three(spark, sf), CFG)
    n = lambda c: F.countDistinct(F.when(c, F.col("recipient")))
    return rows.groupBy("event_id", "victim").agg(F.countDistinct("recipient").alias("n_union"), n(F.col("in_p") & F.col("in_s")).alias("n_both"), n(F.col("in_p")).alias("n_prefix"), n(F.col("in_s")).alias("n_suffix"))


@query("u3_distinct_ends", sql("SELECT count(DISTINCT a) n FROM (SELECT from_addr a FROM ev UNION ALL SELECT to_addr FROM ev)", "ev"))
def u3(spark, sf):
    e = fx.events(spark, sf)
    return e.select(F.col("from_addr").alias("a")).unionByName(e.select(F.col("to_addr").alias("a"))).agg(F.countDistinct("a").alias("n"))


@query("perf_candidates_scored", sql("SELECT p.event_id, p.victim, CAST(coalesce(sum(n), 0) AS BIGINT) candidates FROM pairs p LEFT JOIN (SELECT event_id, victim, lookalike, count(*) n FROM act GROUP BY ALL) a USING (event_id, victim, lookalike) WHERE p.victim IN (SELECT victim FROM cps) GROUP BY p.event_id, p.victim", "pairs", "cps", "meta", cand=sp.cand(sp.UNION), act=f"SELECT * FROM cand WHERE {sp.ACTIVE}"))
def perf(spark, sf):
    e, c, m = three(spark, sf)
    return detect.performance(e, c, detect.recipients(e, c, m, CFG))
