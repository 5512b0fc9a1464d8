"""Evaluation (A5-A14, A22-A25, W7, W8, F37, J14, J16, J17, SNK3, SNK7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.operators import detect, evaluate, stats
from doppel.plans import fixture as fx
from doppel.plans import sqlparts as sp
from doppel.plans.q_detect import three
from doppel.plans.registry import query
from doppel.plans.sqlparts import sql
from doppel.sources import files

CFG = DetectorConfig()
TAUS = [0.0, 0.1, 0.25, 0.4, 0.5, 0.7, 0.8, 0.9, 0.901, 0.95, 0.98, 0.99, 1.0]

DAYS = {
    "days": "SELECT event_id, hash, strftime(block_time, '%Y-%m-%d') AS day, coalesce(visible, true) seen, is_poisoning label FROM ev",
    "al": "SELECT event_id, count(*) n_alerts FROM best WHERE rn = 1 AND total >= 0.901 GROUP BY event_id",
    "pf": "SELECT p.event_id, count(*) n_perf, sum(coalesce(a.n, 0)) n_candidates FROM (SELECT event_id, victim, lookalike FROM spairs WHERE victim IN (SELECT victim FROM cps)) p LEFT JOIN (SELECT event_id, victim, lookalike, count(*) n FROM act GROUP BY ALL) a USING (event_id, victim, lookalike) GROUP BY p.event_id",
    "o": "SELECT d.*, coalesce(n_alerts, 0) n_alerts, coalesce(n_candidates, 0) n_candidates, coalesce(n_perf, 0) n_perf FROM days d LEFT JOIN al USING (event_id) LEFT JOIN pf USING (event_id)",
    "tx": "SELECT hash, bool_or(label) label, bool_or(n_alerts > 0) pred, arg_min(day, event_id) AS day FROM o GROUP BY hash",
}
EVAL = sp.alert_ctes(pairs="spairs") | DAYS
CONF = "count(*) FILTER (pred AND label) tp, count(*) FILTER (pred AND NOT label) fp, count(*) FILTER (NOT pred AND label) fn, count(*) FILTER (NOT pred AND NOT label) tn"
MEAS = "count(*) FILTER (label AND seen) positive_visible, count(*) FILTER (label AND seen AND n_alerts > 0) positive_detected, count(*) FILTER (label AND seen AND n_alerts = 0 AND n_candidates = 0) missed_no_candidate, count(*) FILTER (label AND seen AND n_alerts = 0 AND n_candidates > 0) missed_below_tau, count(*) total_events, sum(CASE WHEN NOT label THEN n_alerts ELSE 0 END) false_alerts, sum(n_candidates) candidates, sum(n_perf) perf"
QUAL = "round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) f1"
PR = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END r"
TAIL = "round(false_alerts / ({den}), 12) false_alerts_per_account_day, 0.0::DOUBLE mean_latency_ms, total_events, v.protected_victims, round(candidates / greatest(1, perf), 9) average_candidates, positive_visible, positive_detected, missed_no_candidate, missed_below_tau"


def rounded(df):
    return df.select(*(F.round(c, 12 if c.startswith("false") else 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("a5_transactions", sql("SELECT hash, label, pred, day FROM tx", "ev", "spairs", "cps", "meta", **EVAL))
def a5(spark, sf):
    return evaluate.transactions(evaluate.evaluate(*three(spark, sf), CFG))


@query("a6_method_metrics", sql(f"SELECT 'trie_union' AS method, tp, fp, fn, tn, {QUAL}, {TAIL.format(den='greatest(1, accounts) * greatest(1, nd)')}, 179.6875::DOUBLE memory_kb_per_1k FROM (SELECT *, {PR} FROM (SELECT {CONF} FROM tx)), (SELECT {MEAS}, count(DISTINCT day) nd FROM o), (SELECT count(DISTINCT a) accounts FROM (SELECT from_addr a FROM ev UNION ALL SELECT to_addr FROM ev)), (SELECT count(DISTINCT victim) protected_victims FROM cps) v", "ev", "spairs", "cps", "meta", **EVAL))
def a6(spark, sf):
    return rounded(evaluate.method_metrics(*three(spark, sf), CFG))


DAILY = f"SELECT 'trie_union' AS method, day, coalesce(tp, 0) tp, coalesce(fp, 0) fp, coalesce(fn, 0) fn, coalesce(tn, 0) tn, {QUAL}, {TAIL.format(den='v.protected_victims')} FROM (SELECT day, {MEAS} FROM o GROUP BY day) e LEFT JOIN (SELECT day, {CONF} FROM tx GROUP BY day) t USING (day), LATERAL (SELECT CASE WHEN coalesce(tp + fp, 0) = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN coalesce(tp + fn, 0) = 0 THEN 0.0 ELSE tp / (tp + fn) END r), (SELECT greatest(1, count(DISTINCT victim)) protected_victims FROM cps) v"


@query("a7_daily_metrics", sql(DAILY, "ev", "spairs", "cps", "meta", **EVAL))
def a7(spark, sf):
    return rounded(evaluate.daily_metrics(*three(spark, sf), CFG))


@query("a8_daily_alerts", sql("SELECT strftime(observed_at, '%Y-%m-%d') AS day, count(*) FILTER (is_poisoning AND n > 0) tp, count(*) FILTER (NOT is_poisoning AND n > 0) fp, count(*) FILTER (is_poisoning AND n = 0) fn FROM (SELECT e.*, coalesce(n_alerts, 0) n FROM ev e LEFT JOIN al USING (event_id)) GROUP BY 1", "ev", "spairs", "cps", "meta", **EVAL))
def a8(spark, sf):
    e, c, m = three(spark, sf)
    n = detect.alerts(detect.visible(e), c, m, CFG).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    rows = e.join(n, "event_id", "left").withColumn("hit", F.coalesce("n", F.lit(0)) > 0)
    return rows.groupBy(F.date_format("observed_at", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("is_poisoning") & F.col("hit")).alias("tp"), F.count_if(~F.col("is_poisoning") & F.col("hit")).alias("fp"), F.count_if(F.col("is_poisoning") & ~F.col("hit")).alias("fn"))


BESTS = {"bs": "SELECT event_id, max(total) top FROM best WHERE rn = 1 GROUP BY event_id", "es": "SELECT e.event_id, e.hash, coalesce(e.is_poisoning, false) label, coalesce(top, -1) top FROM ev e LEFT JOIN bs USING (event_id)"}
GRID = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in TAUS) + "]) tau)"
CURVE = f"SELECT 'METHOD' AS method, tau, tp, fp, fn, tn, {QUAL} FROM (SELECT *, {PR} FROM (SELECT tau, count(*) FILTER (top >= tau AND label) tp, count(*) FILTER (top >= tau AND NOT label) fp, count(*) FILTER (top < tau AND label) fn, count(*) FILTER (top < tau AND NOT label) tn FROM es CROSS JOIN {GRID} GROUP BY tau))"


def sweep(name: str, of: str, ctes: dict[str, str]):
    @query(name, sql(CURVE.replace("METHOD", of), "ev", "spairs", "cps", "meta", **ctes, **BESTS))
    def run(spark, sf):
        return rounded(evaluate.tau_sweep(*three(spark, sf), CFG, TAUS, of))


S = lambda where=sp.UNION, **k: sp.alert_ctes(where, pairs="spairs", **k)
sweep("a9_tau_sweep", "trie_union", S())
sweep("a9_tau_sweep_intersection", "trie_intersection", S("ap >= 3 AND as_ >= 3"))
sweep("a9_tau_sweep_no_token", "no_token", S(total=sp.logistic(-8.127027112801793 + 0.20 * 22.44110879456234, 20.659171304234917, 0.0)))


@query("w7_best_threshold", sql(f"SELECT * FROM ({CURVE.replace('METHOD', 'trie_union')}) ORDER BY f1 DESC, precision DESC, tau LIMIT 1", "ev", "spairs", "cps", "meta", **S(), **BESTS))
def w7(spark, sf):
    return evaluate.best_threshold(rounded(evaluate.tau_sweep(*three(spark, sf), CFG, TAUS)))


@query("w7_nearest_threshold", sql(f"SELECT *, round(f1 - max(f1) OVER (), 9) delta_f1 FROM ({CURVE.replace('METHOD', 'trie_union')}) QUALIFY row_number() OVER (ORDER BY round(abs(tau - 0.85), 9), tau) = 1", "ev", "spairs", "cps", "meta", **S(), **BESTS))
def w7n(spark, sf):
    rows = rounded(evaluate.tau_sweep(*three(spark, sf), CFG, TAUS))
    top = rows.agg(F.max("f1").alias("best"))
    return rows.orderBy(F.round(F.abs(F.col("tau") - 0.85), 9), "tau").limit(1).crossJoin(top).withColumn("delta_f1", F.round(F.col("f1") - F.col("best"), 9)).drop("best")


# ---------------------------------------------------------------- roll-ups over a table of daily metrics per loss and threshold


def metric_rows(spark, sf):
    """Confusion by day, loss and threshold from a cheap rule over orders: a table to roll up."""
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("day"), (k % 3).alias("m"), (k % 4 * 0.25).alias("loss_rate"), (k % 5 * 0.1 + 0.5).alias("tau"), (k % 7 < 3).alias("label"), (k % 11 < 5).alias("pred"), F.col("o_totalprice").alias("x"))
    return rows.groupBy(F.concat(F.lit("m"), F.col("m").cast("string")).alias("method"), F.round("loss_rate", 2).alias("loss_rate"), F.round("tau", 2).alias("tau"), "day").agg(
        *(F.count_if(c).alias(n) for n, c in evaluate.confusion(F.col("pred"), F.col("label")).items()), F.count(F.lit(1)).alias("total_events"), F.avg("x").alias("lookup_mean_ms"), F.max("x").alias("lookup_p95_ms")
    )


MET = f"SELECT method, loss_rate, tau, day, {CONF}, count(*) total_events, avg(x) lookup_mean_ms, max(x) lookup_p95_ms FROM (SELECT 'm' || CAST(o_orderkey % 3 AS VARCHAR) AS method, round(o_orderkey % 4 * 0.25::DOUBLE, 2) loss_rate, round(o_orderkey % 5 * 0.1::DOUBLE + 0.5, 2) tau, strftime(o_orderdate, '%Y-%m') AS day, o_orderkey % 7 < 3 label, o_orderkey % 11 < 5 pred, o_totalprice x FROM orders) GROUP BY ALL"
MQ = f"SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END r FROM met"


@query("w7_production_threshold", sql("SELECT tau, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 9) mean_f1, round(avg(fp / total_events), 9) mean_false_rate FROM mq WHERE loss_rate = 0 AND method = 'm0' GROUP BY tau ORDER BY round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 12) DESC, round(avg(fp / total_events), 12), tau LIMIT 1", met=MET, mq=MQ))
def w7p(spark, sf):
    rows = metric_rows(spark, sf).filter("loss_rate = 0 and method = 'm0'").withColumns(evaluate.quality()).withColumn("false_rate", F.col("fp") / F.col("total_events"))
    return rounded(evaluate.production_threshold(rows))


@query("a10_loss_means", sql("SELECT method, loss_rate, tau, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 9) f1 FROM mq GROUP BY ALL", met=MET, mq=MQ))
def a10(spark, sf):
    rows = metric_rows(spark, sf).withColumns(evaluate.quality())
    return rounded(rows.groupBy("method", "loss_rate", "tau").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))))


RATES = f"{QUAL}, round(CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END, 9) specificity, round(CASE WHEN tn + fp = 0 THEN 0.0 ELSE fp / (tn + fp) END, 9) fpr, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE fn / (tp + fn) END, 9) fnr, round((tp + tn) / (tp + fp + fn + tn), 9) accuracy"
SUMS = "CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn, CAST(sum(tn) AS BIGINT) tn"


def confusion_rollup(name: str, *keys: str):
    k = ", ".join(keys)

    @query(name, sql(f"SELECT {k}, tp, fp, fn, tn, {RATES} FROM (SELECT *, {PR} FROM (SELECT {k}, {SUMS} FROM met GROUP BY {k}))", met=MET))
    def run(spark, sf):
        return rounded(evaluate.rollup(metric_rows(spark, sf), *keys))


confusion_rollup("a11_confusion_by_method", "method")
confusion_rollup("a11_confusion_by_method_tau_loss", "method", "tau", "loss_rate")


@query("a11_confusion_grouping_sets", sql(f"SELECT method, tau, tp, fp, fn, tn, {RATES} FROM (SELECT *, {PR} FROM (SELECT method, tau, {SUMS} FROM met GROUP BY GROUPING SETS ((method), (method, tau))))", met=MET))
def a11(spark, sf):
    rows = metric_rows(spark, sf)
    got = rows.groupingSets([[F.col("method")], [F.col("method"), F.col("tau")]], "method", "tau").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))
    return rounded(got.withColumns(evaluate.rates()))


WM = "round(sum(lookup_mean_ms * total_events) / sum(total_events), 6) lookup_mean_ms, round(sum(lookup_p95_ms * total_events) / sum(total_events), 6) lookup_p95_ms"


def weighted(name: str, keys: list[str]):
    k = ", ".join(keys)

    @query(name, sql(f"SELECT {k}, tp, fp, fn, tn, total_events, lookup_mean_ms, lookup_p95_ms, {QUAL} FROM (SELECT *, {PR} FROM (SELECT {k}, {SUMS}, CAST(sum(total_events) AS BIGINT) total_events, {WM.replace('sum(total_events)', 'sum(met.total_events)')} FROM met GROUP BY {k}))", met=MET))
    def run(spark, sf):
        got = evaluate.full_rollup(metric_rows(spark, sf), keys, ["lookup_mean_ms", "lookup_p95_ms"])
        return got.select(*(F.round(c, 6 if c.startswith("lookup") else 9).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes))


weighted("a12_full_rollup", ["method", "loss_rate"])
weighted("a13_tau_sweep_merge", ["method", "tau", "loss_rate"])


@query("a14_exact_percentiles", "SELECT user_id, round(quantile_cont(value, 0.5), 9) p50, round(quantile_cont(value, 0.95), 9) p95, round(quantile_cont(value, 0.99), 9) p99 FROM events GROUP BY user_id")
def a14(spark, sf):
    return fx.table(spark, sf, "events").groupBy("user_id").agg(*(F.round(F.percentile("value", p / 100), 9).alias(f"p{p}") for p in (50, 95, 99)))


@query("a15_mean_and_std", "SELECT user_id, round(avg(value), 9) v_mean, round(coalesce(stddev_samp(value), 0), 9) v_std FROM events GROUP BY user_id")
def a15(spark, sf):
    got = fx.table(spark, sf, "events").groupBy("user_id").agg(*stats.mean_std("value", "v"))
    return rounded(got)


@query("a16_performance_summary", sql("SELECT event_id, CAST(sum(n) AS BIGINT) candidates, count(*) victims FROM (SELECT p.event_id, p.victim, coalesce(a.n, 0) n FROM pairs p LEFT JOIN (SELECT event_id, victim, lookalike, count(*) n FROM act GROUP BY ALL) a USING (event_id, victim, lookalike) WHERE p.victim IN (SELECT victim FROM cps)) GROUP BY event_id", "pairs", "cps", "meta", cand=sp.cand(sp.UNION), act=f"SELECT * FROM cand WHERE {sp.ACTIVE}"))
def a16(spark, sf):
    e, c, m = three(spark, sf)
    return detect.performance(e, c, detect.recipients(e, c, m, CFG)).groupBy("event_id").agg(F.sum("candidates").alias("candidates"), F.count(F.lit(1)).alias("victims"))


@query("a25_memory_estimate", sql("SELECT CASE WHEN count(*) > 0 THEN 184 * 1000 / 1024.0::DOUBLE ELSE 0.0 END kb_per_1k FROM cps", "cps"))
def a25(spark, sf):
    return fx.counterparties(spark, sf).agg(evaluate.memory_estimate(F.count(F.lit(1))).alias("kb_per_1k"))


# ---------------------------------------------------------------- days, profiles, paired rows

BOUNDS = "SELECT strftime(block_time, '%Y-%m-%d') AS day, min(block_number) start_block, max(block_number) end_block FROM ev GROUP BY 1"


def boundaries(events):
    return events.groupBy(F.date_format("block_time", "yyyy-MM-dd").alias("day")).agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"))


@query("src20_day_boundaries", sql(BOUNDS, "ev"))
def src20(spark, sf):
    return boundaries(fx.events(spark, sf))


@query("f37_event_day", sql("SELECT e.event_id, CASE WHEN e.block_number <= b.end_block THEN b.day ELSE strftime(block_time, '%Y-%m-%d') END AS day FROM ev e ASOF LEFT JOIN (SELECT * FROM bounds WHERE day >= '1994') b ON e.block_number >= b.start_block", "ev", bounds=BOUNDS))
def f37(spark, sf):
    e = fx.events(spark, sf)
    return evaluate.event_day(e, boundaries(e).filter("day >= '1994'")).select("event_id", "day")


@query("j14_day_boundary_join", sql("SELECT b.day, count(*) n FROM ev e ASOF JOIN bounds b ON e.block_number >= b.start_block GROUP BY b.day", "ev", bounds=BOUNDS))
def j14(spark, sf):
    e = fx.events(spark, sf)
    return evaluate.event_day(e, boundaries(e)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("snk7_replay_profiles", sql("SELECT run_id, loss_rate, delay AS delay_profile_sec, count(*) n, count(*) FILTER (loss_rate <= 0 OR " + "(CAST(CAST('0x' || left(sha256('42|' || CAST(run_id AS VARCHAR) || '|' || printf('%.6f', loss_rate) || '|' || hash), 8) AS BIGINT) AS DOUBLE) / 4294967296.0)" + " >= loss_rate) n_visible, min(epoch_us(block_time) - delay * 1000000) first_us FROM ev CROSS JOIN (SELECT unnest([1, 2])::INT run_id) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) loss_rate) CROSS JOIN (SELECT unnest([5, 15, 30])::INT delay) GROUP BY ALL", "ev"))
def snk7(spark, sf):
    rows = evaluate.replay_profiles(fx.events(spark, sf), [5, 15, 30], [0.0, 0.1, 0.5], 2)
    return rows.groupBy("run_id", "loss_rate", "delay_profile_sec").agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("n_visible"), F.min(F.unix_micros("observed_at")).alias("first_us"))


@query("snk3_fixed_metrics", sql("SELECT method, tau, tp, printf('%.6f', round(avg_ms, 6)) avg_ms FROM (SELECT method, tau, CAST(sum(tp) AS BIGINT) tp, max(lookup_p95_ms) avg_ms FROM met GROUP BY ALL)", met=MET).replace("SELECT method, tau, tp,", "SELECT method, printf('%.6f', tau) tau, tp,"))
def snk3(spark, sf):
    return files.fixed(metric_rows(spark, sf).groupBy("method", "tau").agg(F.sum("tp").alias("tp"), F.round(F.max("lookup_p95_ms"), 6).alias("avg_ms")))


@query("j16_alerts_to_replay", sql("SELECT strftime(e.observed_at, '%Y-%m-%d') AS day, count(*) n, round(avg(greatest(0, epoch_us(b.observed_at) - epoch_us(e.observed_at)) / 1000.0), 6) latency_ms FROM best b JOIN ev e USING (event_id) WHERE rn = 1 AND b.total >= 0.901 GROUP BY 1", "pairs", "cps", "meta", **sp.alert_ctes()))
def j16(spark, sf):
    e, c, m = three(spark, sf)
    a = detect.alerts(e, c, m, CFG).select("event_id", F.col("observed_at").alias("alert_at"))
    late = F.greatest(F.lit(0), F.unix_micros("alert_at") - F.unix_micros("observed_at")) / 1000.0
    return a.join(e, "event_id").groupBy(F.date_format("observed_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(late), 6).alias("latency_ms"))


@query("j17_paired_baseline", sql("SELECT a.day, a.tau, a.loss_rate, a.method, round(a.lookup_mean_ms, 6) own, round(b.lookup_mean_ms, 6) baseline, round(a.lookup_mean_ms - b.lookup_mean_ms, 6) diff FROM met a JOIN met b USING (day, tau, loss_rate) WHERE b.method = 'm0' AND a.method <> 'm0'", met=MET))
def j17(spark, sf):
    rows = metric_rows(spark, sf)
    base = rows.filter("method = 'm0'").select("day", "tau", "loss_rate", F.col("lookup_mean_ms").alias("baseline"))
    got = rows.filter("method <> 'm0'").join(base, ["day", "tau", "loss_rate"])
    return got.select("day", "tau", "loss_rate", "method", F.round("lookup_mean_ms", 6).alias("own"), F.round("baseline", 6).alias("baseline"), F.round(F.col("lookup_mean_ms") - F.col("baseline"), 6).alias("diff"))


@query("p11_slices", sql("SELECT method, day, tp, fp FROM met WHERE loss_rate = 0 AND tau = 0.9", met=MET))
def p11(spark, sf):
    return metric_rows(spark, sf).filter("loss_rate = 0 and tau = 0.9").select("method", "day", "tp", "fp")


@query("w12_average_ranks", sql("SELECT method, day, tau, loss_rate, total_events, rank() OVER (PARTITION BY method ORDER BY total_events) + (count(*) OVER (PARTITION BY method, total_events) - 1) / 2.0::DOUBLE avg_rank FROM met", met=MET))
def w12(spark, sf):
    return stats.average_ranks(metric_rows(spark, sf).select("method", "day", "tau", "loss_rate", "total_events"), "total_events", "method")


@query("w13_holm", sql("SELECT method, day, p, round(least(1.0, max(p * (m - r + 1)) OVER (PARTITION BY method ORDER BY p, day ROWS UNBOUNDED PRECEDING)), 9) p_holm FROM (SELECT *, count(*) OVER (PARTITION BY method) m, row_number() OVER (PARTITION BY method ORDER BY p, day) r FROM (SELECT method, day, round(sum(fp) / (sum(fp) + sum(tp) + 1) / 100.0, 9) p FROM met GROUP BY ALL))", met=MET))
def w13(spark, sf):
    rows = metric_rows(spark, sf).groupBy("method", "day").agg(F.round(F.sum("fp") / (F.sum("fp") + F.sum("tp") + 1) / 100.0, 9).alias("p"))
    return stats.holm(rows, "p", "method", tie="day").withColumn("p_holm", F.round("p_holm", 9))


@query("w15_ordered_metrics", sql("SELECT method, tau, loss_rate, day, tp, row_number() OVER (ORDER BY method, tau, loss_rate, day)::INT n FROM met", met=MET))
def w15(spark, sf):
    from pyspark.sql import Window

    return metric_rows(spark, sf).select("method", "tau", "loss_rate", "day", "tp", F.row_number().over(Window.orderBy("method", "tau", "loss_rate", "day")).alias("n"))


@query("a23_run_summary", sql("SELECT method, round(avg(f1), 9) f1_mean, round(coalesce(stddev_samp(f1), 0), 9) f1_std, round(min(f1), 9) f1_min, round(max(f1), 9) f1_max FROM (SELECT method, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END f1 FROM mq) GROUP BY method", met=MET, mq=MQ))
def a23(spark, sf):
    rows = metric_rows(spark, sf).withColumns(evaluate.quality())
    return rounded(rows.groupBy("method").agg(*stats.mean_std("f1", "f1"), F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max")))


@query("a24_scaling_summary", sql("SELECT total_events, method, round(avg(lookup_mean_ms), 6) ms_mean, round(coalesce(stddev_samp(lookup_mean_ms), 0), 6) ms_std, round(quantile_cont(lookup_mean_ms, 0.95), 6) ms_p95 FROM met GROUP BY ALL", met=MET))
def a24(spark, sf):
    got = metric_rows(spark, sf).groupBy("total_events", "method").agg(*stats.mean_std("lookup_mean_ms", "ms"), F.percentile("lookup_mean_ms", 0.95).alias("ms_p95"))
    return got.select("total_events", "method", *(F.round(c, 6).alias(c) for c in ("ms_mean", "ms_std", "ms_p95")))


STEPS = " + ".join(f"(u > {x!r}::DOUBLE)::INT" for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402))
BOOT = {
    "met": MET, "daily": "SELECT method, day, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM met GROUP BY ALL",
    "drawn": f"SELECT method, b, tp, fp, fn, {STEPS} w FROM (SELECT *, (CAST('0x' || left(sha256(method || ':' || day || ':' || CAST(b AS VARCHAR) || ':42'), 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE u FROM daily, range(1, 10001) r(b))",
    "rounds": "SELECT method, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END r FROM (SELECT method, b, sum(tp * w) tp, sum(fp * w) fp, sum(fn * w) fn FROM drawn GROUP BY ALL)",
    "boot": "SELECT method, " + ", ".join(f"round(quantile_cont({e}, {q}), 9) {n}_{side}" for n, e in (("precision", "p"), ("recall", "r"), ("f1", "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END")) for side, q in (("low", 0.025), ("high", 0.975))) + " FROM rounds GROUP BY method",
}
PAIRED = {
    "f": "SELECT method, day, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END f1 FROM (SELECT method, day, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END r FROM daily)",
    "ranked": "SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0::DOUBLE r FROM (SELECT a.method, a.f1 - b.f1 d FROM f a JOIN f b USING (day) WHERE b.method = 'm0' AND a.method <> 'm0') WHERE d <> 0",
    "zs": "SELECT *, (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) z FROM (SELECT method, count(*) n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) w_plus FROM ranked GROUP BY method)",
    "ps": "SELECT *, least(1.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429::DOUBLE))))) p FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) t FROM zs)",
    "tested": "SELECT method, n, w_plus, round(z, 6) z, round(p, 6) p, round(least(1.0, max(p * (m - k + 1)) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING)), 6) p_holm FROM (SELECT *, count(*) OVER () m, row_number() OVER (ORDER BY p, method) k FROM ps)",
}


def intervals(spark, sf):
    """Bounds of each method's precision, recall and F1 over resampled days."""
    daily = metric_rows(spark, sf).groupBy("method", "day").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    got = stats.bootstrap_counts(daily, ["method"], 10_000)
    return daily, got.select("method", *(F.round(F.col(f"{c}_ci")[k], 9).alias(f"{c}_{side}") for c in ("precision", "recall", "f1") for k, side in enumerate(("low", "high"))))


@query("ml9_paired_statistics", sql("SELECT * FROM boot LEFT JOIN tested USING (method)", **BOOT, **PAIRED))
def ml9(spark, sf):
    """Bootstrap intervals over days, and the signed-rank test of each method's F1 against m0, Holm-corrected."""
    daily, bounds = intervals(spark, sf)
    rows = daily.withColumns(evaluate.quality())
    base = rows.filter("method = 'm0'").select("day", F.col("f1").alias("f1_base"))
    test = stats.holm(stats.signed_rank(rows.filter("method <> 'm0'").join(base, "day"), "f1", "f1_base", "method").withColumn("all", F.lit(1)), "p", "all", tie="method").drop("all")
    return bounds.join(test.select("method", "n", "w_plus", *(F.round(c, 6).alias(c) for c in ("z", "p", "p_holm"))), "method", "left")


@query("ml10_signed_rank", sql("SELECT method, n, w_plus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) z FROM (SELECT method, count(*) n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) w_plus FROM (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0::DOUBLE r FROM (SELECT a.method, CAST(a.tp - b.tp AS DOUBLE) d FROM t a JOIN t b USING (day) WHERE b.method = 'm0' AND a.method <> 'm0') WHERE d <> 0) GROUP BY method)", met=MET, t="SELECT method, day, CAST(sum(tp) AS BIGINT) tp FROM met GROUP BY ALL"))
def ml10(spark, sf):
    rows = metric_rows(spark, sf).groupBy("method", "day").agg(F.sum("tp").cast("double").alias("tp"))
    base = rows.filter("method = 'm0'").select("day", F.col("tp").alias("b"))
    return stats.signed_rank(rows.filter("method <> 'm0'").join(base, "day"), "tp", "b", "method").select("method", "n", "w_plus", F.round("z", 6).alias("z"))


@query("rnd4_bootstrap_intervals", sql("SELECT * FROM boot", **BOOT))
def rnd4(spark, sf):
    return intervals(spark, sf)[1]


@query("rnd4_bca_intervals")
def rnd4_bca(spark, sf):
    """Bias-corrected intervals of the mean F1 of each method's runs: a few means a method, resampled on the driver."""
    means = metric_rows(spark, sf).withColumns(evaluate.quality()).groupBy("method", "tau").agg(F.avg("f1").alias("f1")).groupBy("method").agg(F.sort_array(F.collect_list("f1")).alias("f1")).collect()
    return spark.createDataFrame([(r["method"], *stats.bca_interval(list(r["f1"]))) for r in means], "method string, f1_low double, f1_high double")
