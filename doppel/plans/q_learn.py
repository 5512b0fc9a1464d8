"""Features, score families, thresholds and calibration (ML, F42-F45, A20, A22, W8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.operators import features, learn
from doppel.plans import sqlparts as sp
from doppel.plans.q_detect import three
from doppel.plans.registry import query
from doppel.plans.sqlparts import sql

CFG = DetectorConfig(score_mode="context_gate")

FEATS = sp.alert_ctes(total=sp.GATE, timed=True) | {
    "top": "SELECT *, CAST(sum(n_scored) OVER (PARTITION BY event_id) AS BIGINT) n_all, row_number() OVER (PARTITION BY event_id ORDER BY total DESC, last_seen DESC, recipient, token, victim) r2 FROM best WHERE rn = 1",
    "feats": """SELECT e.event_id, e.hash, strftime(e.block_time, '%Y-%m-%d') AS day, e.is_poisoning::INT AS label, coalesce(t.s_addr, 0.0) s_addr, coalesce(t.s_type, 0.0) s_type, coalesce(t.s_token, 0.0) s_token, coalesce(t.s_time, 0.0) s_time, coalesce(t.s_value, 0.0) s_value,
      coalesce(t.ap, 0) matched_prefix, coalesce(t.as_, 0) matched_suffix, coalesce(t.n_all, 0) candidates_scored, (t.recipient IS NOT NULL)::INT found_candidate, coalesce(t.victim, e.victim_hint) victim, coalesce(t.recipient, '') matched_recipient FROM ev e LEFT JOIN (SELECT * FROM top WHERE r2 = 1) t USING (event_id)""",
}
NEED = ("ev", "pairs", "cps", "meta")


def feature_rows(spark, sf):
    return features.feature_rows(*three(spark, sf), CFG)


@query("ml1_feature_rows", sql("SELECT CAST(event_id AS VARCHAR) event_id, hash tx_hash, day, victim, matched_recipient, label, round(s_addr, 9) s_addr, s_type, s_token, round(s_time, 9) s_time, round(s_value, 9) s_value, matched_prefix, matched_suffix, candidates_scored, found_candidate FROM feats", *NEED, **FEATS))
def ml1(spark, sf):
    rows = feature_rows(spark, sf)
    return rows.select("event_id", "tx_hash", "day", "victim", "matched_recipient", "label", F.round("s_addr", 9).alias("s_addr"), "s_type", "s_token", F.round("s_time", 9).alias("s_time"), F.round("s_value", 9).alias("s_value"), "matched_prefix", "matched_suffix", "candidates_scored", "found_candidate")


@query("f45_interactions", sql("SELECT CAST(event_id AS VARCHAR) event_id, round(s_addr * s_type, 9) s_addr_x_type, round(s_addr * s_token, 9) s_addr_x_token, round(s_addr * s_time, 9) s_addr_x_time, round(s_addr * s_value, 9) s_addr_x_value, (matched_prefix >= 3 OR matched_suffix >= 3)::INT address_gate_weak, (matched_prefix >= 4 OR matched_suffix >= 4)::INT address_gate_strong FROM feats", *NEED, **FEATS))
def f45(spark, sf):
    names = list(features.interactions())
    return feature_rows(spark, sf).select("event_id", *(F.round(c, 9).alias(c) if c.startswith("s_") else F.col(c) for c in names))


DERIVED = """SELECT *, least(p, s) both_addr, greatest(p, s) either_addr, CASE WHEN greatest(p, s) > 0 THEN least(p, s) / greatest(p, s) ELSE 0.0 END balance_addr, abs(p - s) prefix_suffix_gap, greatest(0.0, least(1.0, ln(1 + candidates_scored) / ln(129.0))) candidate_pressure,
  least(s_type, s_token) context_min, abs(s_type - s_token) context_gap FROM (SELECT *, least(matched_prefix, 6) / 6.0::DOUBLE p, least(matched_suffix, 6) / 6.0::DOUBLE s FROM feats)"""


@query("f42_derived_features", sql("SELECT CAST(event_id AS VARCHAR) event_id, round(p, 9) prefix_addr, round(s, 9) suffix_addr, round(both_addr, 9) both_addr, round(either_addr, 9) either_addr, round(balance_addr, 9) balance_addr, round(prefix_suffix_gap, 9) prefix_suffix_gap, round(candidate_pressure, 9) candidate_pressure, round(context_min, 9) context_min, round(context_gap, 9) context_gap, round(s_type * s_token, 9) type_x_token FROM derived", *NEED, **FEATS, derived=DERIVED))
def f42(spark, sf):
    plain = {n: c for n, c in features.derived().items() if "_x_" not in n or n == "type_x_token"}
    return feature_rows(spark, sf).select("event_id", *(F.round(c, 9).alias(n) for n, c in plain.items()))


#: The components of each variant, written out.
VARIANT_SQL = {
    "full_addr_type_token": "s_addr, s_addr * s_type, s_addr * s_token",
    "full_addr_type_token_time": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_time",
    "full_addr_type_token_value": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_value",
    "full_addr_type_token_time_value": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_time, s_addr * s_value",
    "full_context_product": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_type * s_token, s_addr * context_min, s_addr * context_gap",
    "full_context_product_value": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_type * s_token, s_addr * context_min, s_addr * context_gap, s_addr * s_value",
    "full_token_quadratic_value": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_token * s_token, s_addr * s_type * s_token, s_addr * s_value",
    "full_hard_negative": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_time, s_addr * s_value, balance_addr, both_addr, prefix_suffix_gap, candidate_pressure, s_addr * candidate_pressure, balance_addr * s_type, balance_addr * s_token",
    "full_hard_negative_no_candidate": "s_addr, s_addr * s_type, s_addr * s_token, s_addr * s_time, s_addr * s_value, balance_addr, both_addr, prefix_suffix_gap, balance_addr * s_type, balance_addr * s_token",
    "full_display_addr_type_token": "s_addr, p, s, both_addr, balance_addr, s_addr * s_type, s_addr * s_token, p * s_type, s * s_type, both_addr * s_type, p * s_token, s * s_token, both_addr * s_token",
    "display_address_only": "s_addr, p, s, both_addr, balance_addr",
    "display_no_type": "s_addr, p, s, both_addr, balance_addr, s_addr * s_token, p * s_token, s * s_token, both_addr * s_token",
    "display_no_token": "s_addr, p, s, both_addr, balance_addr, s_addr * s_type, p * s_type, s * s_type, both_addr * s_type",
    "address_only": "s_addr",
    "no_type": "s_addr, s_addr * s_token",
    "no_token": "s_addr, s_addr * s_type",
    "prefix_only": "p, p * s_type, p * s_token",
    "suffix_only": "s, s * s_type, s * s_token",
    "type_token_without_address": "s_type, s_token",
}
VECTORS = ", ".join(f"{{'variant': '{n}', 'x': [{', '.join(f'CAST({e} AS DOUBLE)' for e in cols.split(', '))}]}}" for n, cols in VARIANT_SQL.items())
MOST = 13


@query("f42_variant_vectors", sql(f"SELECT CAST(event_id AS VARCHAR) event_id, c.variant AS variant, {', '.join(f'round(c.x[{k + 1}], 9) AS x{k}' for k in range(MOST))} FROM (SELECT event_id, unnest([{VECTORS}]) c FROM derived)", *NEED, **FEATS, derived=DERIVED))
def f42v(spark, sf):
    """The vectors of all variants."""
    return features.variant_vectors(feature_rows(spark, sf), "event_id").select("event_id", "variant", *(F.round(F.get("vector", k), 9).alias(f"x{k}") for k in range(MOST)))


#: The context scores, written out: name, kind, address, base, weights of type, token, time and value.
SPEC_SQL = """(VALUES
  ('ctx_gate_sum_symbolic_30', 'gate', 'sum', 0.30::DOUBLE, 0.65::DOUBLE, 0.35::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE),
  ('ctx_gate_sum_symbolic_30_no_type', 'gate', 'sum', 0.30, 0.0, 0.35, 0.0, 0.0),
  ('ctx_gate_sum_symbolic_30_no_token', 'gate', 'sum', 0.30, 0.65, 0.0, 0.0, 0.0),
  ('ctx_boost_ttv_weak', 'boost', 'sum', 0.0, 0.05, 0.05, 0.0, 0.025),
  ('ctx_boost_ttv_mid', 'boost', 'sum', 0.0, 0.10, 0.10, 0.0, 0.05),
  ('ctx_boost_ttv_strong', 'boost', 'sum', 0.0, 0.20, 0.20, 0.0, 0.10),
  ('ctx_boost_tttv_weak', 'boost', 'sum', 0.0, 0.05, 0.05, 0.025, 0.025),
  ('ctx_boost_type_only', 'boost', 'sum', 0.0, 0.15, 0.0, 0.0, 0.0),
  ('ctx_boost_token_only', 'boost', 'sum', 0.0, 0.0, 0.15, 0.0, 0.0),
  ('ctx_mult_ttv_weak', 'multiplicative', 'sum', 0.0, 0.10, 0.10, 0.0, 0.05),
  ('ctx_mult_ttv_mid', 'multiplicative', 'sum', 0.0, 0.20, 0.20, 0.0, 0.10),
  ('ctx_mult_tttv_weak', 'multiplicative', 'sum', 0.0, 0.10, 0.10, 0.05, 0.05),
  ('ctx_gate_ttv_90', 'gate', 'sum', 0.90, 0.4, 0.4, 0.0, 0.2),
  ('ctx_gate_ttv_85', 'gate', 'sum', 0.85, 0.4, 0.4, 0.0, 0.2),
  ('ctx_gate_ttv_80', 'gate', 'sum', 0.80, 0.4, 0.4, 0.0, 0.2),
  ('ctx_gate_ttv_75', 'gate', 'sum', 0.75, 0.4, 0.4, 0.0, 0.2),
  ('ctx_gate_type_token_85', 'gate', 'sum', 0.85, 0.5, 0.5, 0.0, 0.0),
  ('ctx_gate_token_85', 'gate', 'sum', 0.85, 0.0, 1.0, 0.0, 0.0),
  ('ctx_gate_balanced_tuned_30', 'gate', 'balanced', 0.30, 0.20, 0.55, 0.0, 0.0),
  ('ctx_gate_balanced_tuned_30_with_value', 'gate', 'balanced', 0.30, 0.20, 0.55, 0.0, 0.05),
  ('ctx_gate_balanced_tuned_30_with_time', 'gate', 'balanced', 0.30, 0.20, 0.55, 0.20, 0.05),
  ('ctx_gate_balanced_tuned_30_no_type', 'gate', 'balanced', 0.30, 0.0, 0.55, 0.20, 0.05),
  ('ctx_gate_balanced_tuned_30_no_token', 'gate', 'balanced', 0.30, 0.20, 0.0, 0.20, 0.05),
  ('ctx_gate_balanced_tuned_30_no_time', 'gate', 'balanced', 0.30, 0.20, 0.55, 0.0, 0.05),
  ('ctx_gate_balanced_tuned_30_no_value', 'gate', 'balanced', 0.30, 0.20, 0.55, 0.20, 0.0),
  ('ctx_gate_temporal_80', 'gate', 'sum', 0.80, 0.35, 0.35, 0.15, 0.15),
  ('ctx_gate_temporal_no_type', 'gate', 'sum', 0.80, 0.0, 0.35, 0.15, 0.15),
  ('ctx_gate_temporal_no_token', 'gate', 'sum', 0.80, 0.35, 0.0, 0.15, 0.15),
  ('ctx_gate_temporal_no_time', 'gate', 'sum', 0.80, 0.35, 0.35, 0.0, 0.15),
  ('ctx_gate_temporal_no_value', 'gate', 'sum', 0.80, 0.35, 0.35, 0.15, 0.0)) z(name, kind, adr, base, wt, wk, wtime, wv)"""
BALANCED = "s_addr * (0.5 + 0.5 * balance_addr)"
FAMILIES = f"""SELECT event_id, label, name, greatest(0.0, least(1.0, CASE kind WHEN 'gate' THEN a * (base + (1 - base) * ((wt * s_type + wk * s_token + wtime * s_time * greatest(s_type, s_token) + wv * s_value) / (wt + wk + wtime + wv))) ELSE a * (1 + wt * s_type + wk * s_token + wtime * s_time + wv * s_value) END)) score
  FROM (SELECT *, CASE WHEN adr = 'balanced' THEN {BALANCED} ELSE s_addr END a FROM derived, {SPEC_SQL})
  UNION ALL SELECT event_id, label, 'address_only', s_addr FROM derived UNION ALL SELECT event_id, label, 'address_only_balanced', {BALANCED} FROM derived
  UNION ALL SELECT event_id, label, 'manual_full_score', 0.30 * s_addr + 0.20 * s_type + 0.20 * s_token + 0.15 * s_time + 0.15 * s_value FROM derived
  UNION ALL SELECT event_id, label, 'manual_no_time', (0.30 * s_addr + 0.20 * s_type + 0.20 * s_token + 0.15 * s_value) / 0.85::DOUBLE FROM derived"""


@query("f43_score_families", sql("SELECT CAST(event_id AS VARCHAR) event_id, name, round(score, 9) score FROM families", *NEED, **FEATS, derived=DERIVED, families=FAMILIES))
def f43(spark, sf):
    """All named scores of every event."""
    return features.long_scores(feature_rows(spark, sf), features.named_scores(), "event_id").withColumn("score", F.round("score", 9))


#: The parts of the formula grid, written out.
FORMULAS = """SELECT CAST(((ai * 8 + bi) * 4 + ti) * 17 + wi AS INTEGER) AS place, printf('gate_%s_a%.2f_g%.1f_b%.2f_t%s_w%.2f-%.2f-%.2f-%.2f', addr_mode, alpha, gamma, beta, time_mode, w_type, w_token, w_value, w_time) AS name, addr_mode, alpha, gamma, beta, time_mode, w_type, w_token, w_value, w_time FROM
  (VALUES (0, 'sum', 1.0::DOUBLE, 1.0::DOUBLE), (1, 'balanced', 0.75, 1.0), (2, 'balanced', 0.5, 1.0), (3, 'balanced', 0.5, 2.0), (4, 'harmonic', 1.0, 1.0), (5, 'min', 1.0, 1.0)) a(ai, addr_mode, alpha, gamma),
  (VALUES (0, 0.30::DOUBLE), (1, 0.40), (2, 0.50), (3, 0.60), (4, 0.70), (5, 0.80), (6, 0.90), (7, 0.95)) b(bi, beta), (VALUES (0, 'max_type_token'), (1, 'avg_type_token'), (2, 'token'), (3, 'raw')) t(ti, time_mode),
  (VALUES (0, 0.35::DOUBLE, 0.35::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE), (1, 0.30, 0.30, 0.10, 0.30), (2, 0.25, 0.25, 0.10, 0.40), (3, 0.20, 0.20, 0.10, 0.50), (4, 0.15, 0.15, 0.10, 0.60), (5, 0.30, 0.45, 0.10, 0.15), (6, 0.45, 0.30, 0.10, 0.15), (7, 0.20, 0.55, 0.05, 0.20), (8, 0.55, 0.20, 0.05, 0.20),
    (9, 0.25, 0.35, 0.05, 0.35), (10, 0.35, 0.25, 0.05, 0.35), (11, 0.25, 0.25, 0.25, 0.25), (12, 0.50, 0.50, 0.0, 0.0), (13, 0.35, 0.65, 0.0, 0.0), (14, 0.65, 0.35, 0.0, 0.0), (15, 0.30, 0.50, 0.0, 0.20), (16, 0.50, 0.30, 0.0, 0.20)) w(wi, w_type, w_token, w_value, w_time)"""
ADDRESS = "CASE addr_mode WHEN 'balanced' THEN s_addr * (alpha + (1 - alpha) * pow(balance_addr, gamma)) WHEN 'harmonic' THEN CASE WHEN both_addr + either_addr > 0 THEN 2 * both_addr * either_addr / (both_addr + either_addr) ELSE 0.0 END WHEN 'min' THEN both_addr ELSE s_addr END"
TIMED = "s_time * CASE time_mode WHEN 'max_type_token' THEN greatest(s_type, s_token) WHEN 'avg_type_token' THEN (s_type + s_token) / 2 WHEN 'token' THEN s_token ELSE 1.0 END"


def formula_sql(rows: str, formulas: str) -> str:
    return f"SELECT f.place, f.name, label, greatest(0.0, least(1.0, {ADDRESS} * (beta + (1 - beta) * greatest(0.0, least(1.0, (w_type * s_type + w_token * s_token + w_value * s_value + w_time * {TIMED}) / (w_type + w_token + w_value + w_time)))))) score FROM {rows}, {formulas} f"


def validation_rows(spark, sf):
    return features.with_splits(feature_rows(spark, sf)).filter("split_victim = 'val'")


VAL_VICTIMS = "SELECT * FROM derived WHERE CAST(CAST('0x' || left(sha256(victim), 16) AS UBIGINT) % 100 AS INT) BETWEEN 70 AND 84"


@query("f44_formula_scores", sql("SELECT name, label, count(*) n, round(avg(score), 9) mean_score FROM fscore GROUP BY name, label", *NEED, **FEATS, derived=DERIVED, dval=VAL_VICTIMS, formulas=FORMULAS, fscore=formula_sql("dval", "formulas")))
def f44(spark, sf):
    """The mean score of each of the 3264 formulas over the victims' validation split, by label."""
    return features.formula_means(validation_rows(spark, sf), features.formula_grid()).withColumn("mean_score", F.round("mean_score", 9))


HIST = "SELECT name, label, least(100, greatest(0, CAST(floor(score * 100 + 1e-9) AS INTEGER))) bin FROM named"
NAMED = "SELECT label, name, round(score, 6) score FROM families"


def named(spark, sf):
    return features.long_scores(feature_rows(spark, sf), features.named_scores(), "label").withColumn("score", F.round("score", 6))


@query("a22_score_histogram", sql("SELECT name, bin, count(*) FILTER (label = 1) pos, count(*) FILTER (label = 0) neg FROM hist GROUP BY ALL", *NEED, **FEATS, derived=DERIVED, families=FAMILIES, named=NAMED, hist=HIST))
def a22(spark, sf):
    return features.histogram(named(spark, sf), 101, "name")


CUM = "SELECT name, bin, CAST(sum(pos) OVER w AS BIGINT) tp, CAST(sum(neg) OVER w AS BIGINT) fp, CAST(sum(pos) OVER (PARTITION BY name) AS BIGINT) np, CAST(sum(neg) OVER (PARTITION BY name) AS BIGINT) nn FROM (SELECT name, bin, count(*) FILTER (label = 1) pos, count(*) FILTER (label = 0) neg FROM hist GROUP BY ALL) WINDOW w AS (PARTITION BY name ORDER BY bin DESC)"
CURVE = "SELECT name, bin / 100.0::DOUBLE tau, coalesce(lag(bin) OVER (PARTITION BY name ORDER BY bin) + 1, 0) / 100.0::DOUBLE tau_from, tp, fp, np - tp fn, nn - fp tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END r FROM cum"


@query("w8_reverse_cumulative", sql("SELECT name, round(tau, 9) tau, tp, fp, fn, tn FROM curve", *NEED, **FEATS, derived=DERIVED, families=FAMILIES, named=NAMED, hist=HIST, cum=CUM, curve=CURVE))
def w8(spark, sf):
    return features.threshold_curve(features.histogram(named(spark, sf), 101, "name"), 101, "name").select("name", F.round("tau", 9).alias("tau"), "tp", "fp", "fn", "tn")


@query("ml7_named_scores_at_best", sql("SELECT name, round(tau_from, 9) tau, tp, fp, fn, tn FROM curve QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END DESC, p DESC, r DESC, tau) = 1", *NEED, **FEATS, derived=DERIVED, families=FAMILIES, named=NAMED, hist=HIST, cum=CUM, curve=CURVE))
def ml7(spark, sf):
    curve = features.threshold_curve(features.histogram(named(spark, sf), 101, "name"), 101, "name")
    return features.best_of_curve(curve, "name").select("name", F.round("tau", 9).alias("tau"), "tp", "fp", "fn", "tn")


@query("ml5_frozen_threshold", sql("SELECT name, count(*) FILTER (score >= 0.4 AND label = 1) tp, count(*) FILTER (score >= 0.4 AND label = 0) fp, count(*) FILTER (score < 0.4 AND label = 1) fn, count(*) FILTER (score < 0.4 AND label = 0) tn FROM named GROUP BY name", *NEED, **FEATS, derived=DERIVED, families=FAMILIES, named=NAMED))
def ml5(spark, sf):
    from doppel.operators.evaluate import confusion

    return named(spark, sf).groupBy("name").agg(*(F.count_if(c).alias(n) for n, c in confusion(F.col("score") >= 0.4, F.col("label") == 1).items()))


SPLIT = "SELECT *, CASE WHEN m < 70 THEN 'train' WHEN m < 85 THEN 'val' ELSE 'test' END split FROM (SELECT *, CAST(CAST('0x' || left(sha256(victim), 16) AS UBIGINT) % 100 AS INT) m FROM feats)"


@query("a20_split_coverage", sql("SELECT split, count(*) n, count(*) FILTER (label = 1) pos, count(*) FILTER (label = 0) neg, count(*) FILTER (found_candidate = 1) found, count(*) FILTER (label = 1 AND found_candidate = 1) pos_found FROM split GROUP BY split", *NEED, **FEATS, split=SPLIT))
def a20(spark, sf):
    rows = features.with_splits(feature_rows(spark, sf))
    pos, found = F.col("label") == 1, F.col("found_candidate") == 1
    return rows.groupBy(F.col("split_victim").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"), F.count_if(found).alias("found"), F.count_if(pos & found).alias("pos_found"))


@query("src17_feature_scan", sql("SELECT label, count(*) n, round(avg(s_addr), 9) s_addr FROM feats GROUP BY label", *NEED, **FEATS))
def src17(spark, sf):
    """Feature shards as files, read by column."""
    from doppel.plans.q_tables import fresh

    path = fresh(spark, "features")
    feature_rows(spark, sf).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).select("label", "s_addr").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_addr"), 9).alias("s_addr"))


@query("ml3_logistic_calibration")
def ml3(spark, sf):
    """Learnt on train, threshold from val, reported on test."""
    rows = features.with_splits(feature_rows(spark, sf)).cache()
    fitted, report = learn.calibrate(rows)
    return report.withColumns({"threshold": F.lit(fitted.threshold), "intercept": F.lit(fitted.intercept)})


@query("ml4_random_forest")
def ml4(spark, sf):
    rows = features.with_splits(feature_rows(spark, sf)).cache()
    name = "full_addr_type_token"
    model = learn.fit_forest(rows.filter("split_victim = 'train'"), name, trees=20, depth=8)
    return learn.confusion_at(learn.forest_score(rows.filter("split_victim = 'test'"), model, name), 0.5)


def best_sql(scores: str, keys: str) -> str:
    """The best of 1001 thresholds for each of `keys`, from rows (keys, label, score)."""
    return f"""SELECT {keys}, coalesce(below + 1, 0) / 1000.0::DOUBLE tau, tp, fp, np - tp fn, nn - fp tn, p AS "precision", r AS recall, f1 FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY f1 DESC, p DESC, r DESC, bin) rn FROM (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END r FROM (
        SELECT {keys}, bin, CAST(sum(pos) OVER w AS BIGINT) tp, CAST(sum(neg) OVER w AS BIGINT) fp, CAST(sum(pos) OVER (PARTITION BY {keys}) AS BIGINT) np, CAST(sum(neg) OVER (PARTITION BY {keys}) AS BIGINT) nn, lead(bin) OVER w below FROM (
          SELECT {keys}, least(1000, greatest(0, CAST(floor(round(score, 9) * 1000 + 1e-7) AS INTEGER))) bin, count(*) FILTER (label = 1) pos, count(*) FILTER (label = 0) neg FROM {scores} GROUP BY ALL)
        WINDOW w AS (PARTITION BY {keys} ORDER BY bin DESC))))) WHERE rn = 1"""


def _search_ctes(split: str) -> dict[str, str]:
    """Rows of a split, and the best thresholds of baselines and of the address scores alone."""
    base = "0.30 * s_addr + 0.20 * s_type + 0.20 * s_token + 0.15 * s_time + 0.15 * s_value"
    return {
        f"{split}_rows": f"SELECT * FROM derived, cuts WHERE CASE WHEN day <= train_end THEN 'train' WHEN day <= val_end THEN 'val' ELSE 'test' END = '{split}'",
        f"{split}_plain": f"SELECT 'address_only_sum' AS name, label, s_addr AS score FROM {split}_rows UNION ALL SELECT 'prefix_only', label, p FROM {split}_rows UNION ALL SELECT 'suffix_only', label, s FROM {split}_rows UNION ALL SELECT 'manual_additive', label, greatest(0.0, least(1.0, {base})) FROM {split}_rows",
        f"{split}_base": best_sql(f"{split}_plain", "name"),
        f"{split}_addr": f"SELECT a.addr_mode, a.alpha, a.gamma, label, {ADDRESS} AS score FROM {split}_rows, (SELECT DISTINCT addr_mode, alpha, gamma FROM formulas) a",
        f"{split}_same": best_sql(f"{split}_addr", "addr_mode, alpha, gamma"),
    }


SEARCH = {
    "derived": DERIVED, "formulas": FORMULAS,
    "cum_days": "SELECT day, sum(n) OVER (ORDER BY day) c, sum(n) OVER () total FROM (SELECT day, count(*) n FROM feats GROUP BY day)",
    "cuts": "SELECT min(day) FILTER (c >= total * 0.70) train_end, min(day) FILTER (c >= total * 0.85) val_end FROM cum_days",
    **_search_ctes("val"),
    "val_scores": formula_sql("val_rows", "formulas"),
    "val_full": best_sql("val_scores", "place, name"),
    "found": """SELECT v.*, s.f1 same_address_f1, v.f1 - b.c margin_vs_baseline, v.f1 - s.f1 margin_vs_same_address, v.f1 - greatest(b.c, s.f1) margin_vs_fair_ceiling, addr_mode, alpha, gamma
      FROM val_full v JOIN formulas f USING (place, name) JOIN val_same s USING (addr_mode, alpha, gamma), (SELECT max(f1) c FROM val_base) b""",
}
MEASURES = 'round(tau, 9) tau, tp, fp, fn, tn, round("precision", 9) AS "precision", round(recall, 9) recall, round(f1, 9) f1'


def _apart_ctes(split: str, full: str, chosen: str) -> dict[str, str]:
    """The formulas of `chosen`, in parts and against baselines."""
    less = ", ".join(f"CASE WHEN x = '{c}' THEN 0.0 ELSE w_{c} END w_{c}" for c in ("type", "token", "value", "time"))
    cols = 'tau, tp, fp, fn, tn, "precision", recall, f1'
    return {
        f"{split}_less": f"SELECT place * 4 + xi AS place, 'no_' || x AS name, addr_mode, alpha, gamma, beta, time_mode, {less} FROM formulas JOIN {chosen} USING (place), (VALUES (0, 'type'), (1, 'token'), (2, 'value'), (3, 'time')) q(xi, x)",
        f"{split}_less_scores": formula_sql(f"{split}_rows", f"{split}_less"),
        f"{split}_parts": f"""SELECT place, 'full' AS ablation, {cols} FROM {full} JOIN {chosen} USING (place)
          UNION ALL SELECT place, 'address_only_same', {cols} FROM {split}_same JOIN formulas USING (addr_mode, alpha, gamma) JOIN {chosen} USING (place)
          UNION ALL SELECT place // 4, name, {cols} FROM ({best_sql(f'{split}_less_scores', 'place, name')}) UNION ALL SELECT place, name, {cols} FROM {split}_base, {chosen}""",
        f"{split}_apart": f"SELECT *, max(f1) FILTER (ablation = 'full') OVER (PARTITION BY place) - max(f1) FILTER (ablation <> 'full') OVER (PARTITION BY place) full_margin_vs_best_ablation FROM {split}_parts",
    }


CHOSEN = "SELECT place, row_number() OVER (ORDER BY margin_vs_fair_ceiling DESC, margin_vs_same_address DESC, f1 DESC, place) pos FROM found QUALIFY pos <= 200"
REPORTED = "SELECT place FROM (SELECT a.place, row_number() OVER (ORDER BY full_margin_vs_best_ablation DESC, f1 DESC, pos) n FROM val_apart a JOIN chosen USING (place) WHERE ablation = 'full') WHERE n <= 10"
APART = {"chosen": CHOSEN, **_apart_ctes("val", "val_full", "chosen")}
TESTED = {"reported": REPORTED, **_search_ctes("test"), "test_scores": formula_sql("test_rows", "(SELECT * FROM formulas JOIN reported USING (place))"), "test_full": best_sql("test_scores", "place, name"), **_apart_ctes("test", "test_full", "reported")}
PARTS = f"SELECT CAST(a.place AS INTEGER) place, f.name, ablation, {MEASURES}, round(full_margin_vs_best_ablation, 9) full_margin_vs_best_ablation FROM SPLIT_apart a JOIN formulas f ON f.place = a.place"


def rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def searched(spark, sf):
    """The search reads its rows several times: what it needs of them is written once."""
    from doppel.plans.q_tables import fresh

    path = fresh(spark, "formula-rows")
    rows = feature_rows(spark, sf).select("day", "label", "matched_prefix", "matched_suffix", "candidates_scored", *features.scoring.TERMS)
    rows.write.option("compression", "zstd").parquet(path)
    return features.FormulaSearch(features.with_split_days(spark.read.schema(rows.schema).parquet(path)))


@query("ml8_formula_search", sql(f"SELECT place, name, {MEASURES}, round(same_address_f1, 9) same_address_f1, round(margin_vs_baseline, 9) margin_vs_baseline, round(margin_vs_same_address, 9) margin_vs_same_address, round(margin_vs_fair_ceiling, 9) margin_vs_fair_ceiling FROM found", *NEED, **FEATS, **SEARCH))
def ml8(spark, sf):
    """Each of the 3264 formulas at its best threshold on the validation days, and its margins."""
    return rounded(searched(spark, sf).table())


@query("ml8_formula_ablations", sql(PARTS.replace("SPLIT", "val"), *NEED, **FEATS, **SEARCH, **APART))
def ml8_ablations(spark, sf):
    """The 200 best formulas in parts and against baselines."""
    return rounded(searched(spark, sf).ablations())


@query("ml8_formula_test", sql(PARTS.replace("SPLIT", "test"), *NEED, **FEATS, **SEARCH, **APART, **TESTED))
def ml8_test(spark, sf):
    """The ten best by their margin over their own parts, on the test days."""
    return rounded(searched(spark, sf).test())


@query("ml11_published_coefficients", sql(f"SELECT count(*) n, round(avg({sp.logistic()}), 9) mean_score FROM feats", *NEED, **FEATS))
def ml11(spark, sf):
    fitted = learn.Fitted(features.VARIANTS["full_addr_type_token"], -3.1619704800591686, (-8.127027112801793, 20.659171304234917, 22.44110879456234))
    return learn.logistic_score(feature_rows(spark, sf), fitted, "full_addr_type_token").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))
