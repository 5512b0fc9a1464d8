"""Replay evaluation: outcomes of events and transactions, method and daily metrics, threshold sweeps, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.functions import address, values
from doppel.functions.values import safe_div
from doppel.operators import detect

#: Bytes that one stored counterparty is taken to need.
ENTRY_BYTES = 184


def event_day(events: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """`day`: that of the block's boundaries, else of block time, else of the observation."""
    plain = F.coalesce(F.date_format("block_time", "yyyy-MM-dd"), F.date_format("observed_at", "yyyy-MM-dd"))
    if boundaries is None:
        return events.withColumn("day", plain)
    # the last boundary that starts at or before the block: days are equal-width buckets of blocks, so the range join is an equi-join on them
    block = F.when(F.col("block_number") > 0, F.col("block_number")).otherwise(values.time_to_block("block_time"))
    width = 7200
    b = boundaries.select(F.col("day").alias("_day"), "start_block", "end_block").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_block") / width), F.floor(F.col("end_block") / width))))
    rows = events.withColumn("_block", block).withColumn("_bucket", F.floor(F.col("_block") / width))
    found = rows.join(b, (rows["_bucket"] == b["_bucket"]) & F.col("_block").between(F.col("start_block"), F.col("end_block")), "left").drop("_bucket", "_block", "start_block", "end_block")
    return found.withColumn("day", F.coalesce("_day", plain)).drop("_day")


def confusion(pred: Column, label: Column) -> dict[str, Column]:
    return {"tp": pred & label, "fp": pred & ~label, "fn": ~pred & label, "tn": ~pred & ~label}


def quality() -> dict[str, Column]:
    """precision, recall and f1 from tp, fp and fn."""
    p, r = safe_div("tp", F.col("tp") + F.col("fp")), safe_div("tp", F.col("tp") + F.col("fn"))
    return {"precision": p, "recall": r, "f1": safe_div(2 * p * r, p + r)}


def outcomes(events: DataFrame, cps: DataFrame, found: DataFrame, alert: Column, alert_at: str, confirmed: bool = False) -> DataFrame:
    """One row for each event: day, label, seen, alerts, candidates, perf rows, latency sum. `events` have a day.

    `found` is read once: alerts and scored histories are counted together for each protected end of an event."""
    seen = F.lit(True) if confirmed else F.coalesce(F.col("visible"), F.lit(True))
    late = (F.unix_micros(alert_at) - F.unix_micros("observed_at")) / 1000.0
    ends = found.groupBy("event_id", "victim", "lookalike").agg(F.sum("n_scored").alias("n"), F.count_if(alert).alias("a"), F.sum(F.when(alert, late)).alias("l"))
    pairs = detect.pair_victims(events.filter(seen)).join(detect.protected(cps), "victim", "left_semi").select("event_id", "victim", "lookalike")
    got = pairs.join(ends, ["event_id", "victim", "lookalike"], "left").groupBy("event_id").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n_candidates"), F.count(F.lit(1)).alias("n_perf"), F.sum(F.coalesce("a", F.lit(0))).alias("n_alerts"), F.sum(F.coalesce("l", F.lit(0.0))).alias("latency")
    )
    rows = events.select("event_id", "hash", "day", F.coalesce("is_poisoning", F.lit(False)).alias("label"), seen.alias("seen"), "observed_at").join(got, "event_id", "left")
    zero = {"n_candidates": F.lit(0), "n_perf": F.lit(0), "n_alerts": F.lit(0), "latency": F.lit(0.0)}
    return rows.withColumns({c: F.coalesce(c, z) for c, z in zero.items()})


def event_measures() -> dict[str, Column]:
    positive, hit = F.col("label") & F.col("seen"), F.col("n_alerts") > 0
    count = lambda c: F.count_if(c)
    return {
        "positive_visible": count(positive), "positive_detected": count(positive & hit), "missed_no_candidate": count(positive & ~hit & (F.col("n_candidates") == 0)),
        "missed_below_tau": count(positive & ~hit & (F.col("n_candidates") > 0)), "total_events": F.count(F.lit(1)), "false_alerts": F.sum(F.when(~F.col("label"), F.col("n_alerts")).otherwise(0)),
        "alerts": F.sum("n_alerts"), "latency": F.sum("latency"), "candidates": F.sum("n_candidates"), "perf": F.sum("n_perf"),
    }


def transactions(rows: DataFrame) -> DataFrame:
    """One row for each transaction hash: label, prediction and first day (by event id)."""
    return rows.groupBy("hash").agg(F.bool_or("label").alias("label"), F.bool_or(F.col("n_alerts") > 0).alias("pred"), F.min_by("day", "event_id").alias("day"))


def evaluate(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, method: str = "trie_union", boundaries: DataFrame | None = None) -> DataFrame:
    """Outcomes of a method on every event."""
    confirmed = detect.METHODS.get(method, detect.METHODS["trie_union"]).confirmed
    events = event_day(events, boundaries)
    shown = events if confirmed else detect.visible(events)
    found = detect.recipients(shown, cps, metadata, cfg, method)
    alert = F.col("total").isNotNull() if confirmed else F.col("total") >= cfg.tau
    return outcomes(events, cps, found, alert, "block_time" if confirmed else "observed_at", confirmed)


def method_metrics(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, method: str = "trie_union") -> DataFrame:
    """One row of metrics: confusion by transaction, the rest by event or alert."""
    rows = evaluate(events, cps, metadata, cfg, method)
    # transactions first, carrying their events' measures: the outcomes are computed once
    measures = event_measures()
    tx = rows.groupBy("hash").agg(F.bool_or("label").alias("label"), F.bool_or(F.col("n_alerts") > 0).alias("pred"), *(c.alias(n) for n, c in measures.items()))
    by_tx = tx.agg(*(F.count_if(c).alias(n) for n, c in confusion(F.col("pred"), F.col("label")).items()), *(F.sum(n).alias(n) for n in measures))
    days = event_day(events).agg(F.countDistinct("day").alias("days"))
    ends = events.select(F.explode(F.array(address.normalize_address("from_addr"), address.normalize_address("to_addr"))).alias("a")).agg(F.countDistinct("a").alias("accounts"))
    victims = cps.agg(F.countDistinct("victim").alias("protected_victims"), F.count(F.lit(1)).alias("n_cps"))
    one = by_tx.crossJoin(days).crossJoin(ends).crossJoin(victims)  # four rows of one
    at_least = lambda c: F.greatest(F.lit(1), F.col(c))
    return one.withColumns(quality()).select(
        F.lit(method).alias("method"), "tp", "fp", "fn", "tn", "precision", "recall", "f1", (F.col("false_alerts") / (at_least("accounts") * at_least("days"))).alias("false_alerts_per_account_day"),
        safe_div("latency", "alerts").alias("mean_latency_ms"), "total_events", "protected_victims", (F.col("candidates") / at_least("perf")).alias("average_candidates"),
        "positive_visible", "positive_detected", "missed_no_candidate", "missed_below_tau", memory_estimate(F.col("n_cps")).alias("memory_kb_per_1k"),
    )


def memory_estimate(n_counterparties) -> Column:
    return F.when(n_counterparties > 0, ENTRY_BYTES * 1000 / 1024).otherwise(0.0)


def daily_metrics(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, method: str = "trie_union", boundaries: DataFrame | None = None) -> DataFrame:
    """A row for each day: confusion by the first day of a transaction, the rest by the event's day."""
    rows = evaluate(events, cps, metadata, cfg, method, boundaries)
    by_tx = transactions(rows).groupBy("day").agg(*(F.count_if(c).alias(n) for n, c in confusion(F.col("pred"), F.col("label")).items()))
    by_event = rows.groupBy("day").agg(*(c.alias(n) for n, c in event_measures().items()))
    victims = cps.agg(F.greatest(F.lit(1), F.countDistinct("victim")).alias("protected_victims"))
    day = by_event.join(by_tx, "day", "left").fillna(0, ["tp", "fp", "fn", "tn"]).crossJoin(F.broadcast(victims))
    return day.withColumns(quality()).select(
        F.lit(method).alias("method"), "day", "tp", "fp", "fn", "tn", "precision", "recall", "f1", (F.col("false_alerts") / F.col("protected_victims")).alias("false_alerts_per_account_day"),
        safe_div("latency", "alerts").alias("mean_latency_ms"), "total_events", "protected_victims", (F.col("candidates") / F.greatest(F.lit(1), F.col("perf"))).alias("average_candidates"),
        "positive_visible", "positive_detected", "missed_no_candidate", "missed_below_tau",
    )


def tau_grid(events: DataFrame, taus: list[float]) -> DataFrame:
    return events.sparkSession.createDataFrame([(float(t),) for t in sorted(set(taus))], "tau double")


def tau_sweep(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, taus: list[float], method: str = "trie_union") -> DataFrame:
    """Confusion by event at each threshold. Events' best scores are counted by the thresholds that they reach, then summed from the top: one pass whatever the grid."""
    taus = sorted(set(taus))
    best = detect.max_score(detect.visible(events), cps, metadata, cfg, method)
    rows = events.select("event_id", F.coalesce("is_poisoning", F.lit(False)).alias("label")).join(best.select("event_id", "total"), "event_id", "left")
    reached = sum((F.coalesce("total", F.lit(-1.0)) >= t).cast("int") for t in taus)
    counts = rows.groupBy(reached.alias("k")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    grid = events.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(taus)], "k int, tau double")
    every = grid.unionByName(events.sparkSession.createDataFrame([(0, None)], "k int, tau double")).join(counts, "k", "left").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("k"))
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = every.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "_pos": F.sum("pos").over(whole), "_neg": F.sum("neg").over(whole)})
    out = summed.filter("tau is not null").withColumns({"fn": F.col("_pos") - F.col("tp"), "tn": F.col("_neg") - F.col("fp")})
    return out.withColumns(quality()).select(F.lit(method).alias("method"), "tau", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def best_threshold(sweep: DataFrame, *keys: str) -> DataFrame:
    """The row of highest F1, then precision, then lowest tau."""
    w = Window.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("precision"), F.asc("tau")) if keys else Window.orderBy(F.desc("f1"), F.desc("precision"), F.asc("tau"))
    return sweep.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def production_threshold(rows: DataFrame) -> DataFrame:
    """The tau to run with, from rows (tau, f1, false_rate) of one method without loss: highest mean F1, then lowest mean false rate, then lowest tau."""
    means = rows.groupBy("tau").agg(F.avg("f1").alias("mean_f1"), F.avg("false_rate").alias("mean_false_rate"))
    return means.orderBy(F.desc(F.round("mean_f1", 12)), F.round("mean_false_rate", 12), "tau").limit(1)


def rates() -> dict[str, Column]:
    return quality() | {
        "specificity": safe_div("tn", F.col("tn") + F.col("fp")), "fpr": safe_div("fp", F.col("fp") + F.col("tn")), "fnr": safe_div("fn", F.col("fn") + F.col("tp")),
        "accuracy": safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
    }


def rollup(metrics: DataFrame, *keys: str) -> DataFrame:
    """Counts summed over the rest, rates computed anew."""
    return metrics.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).withColumns(rates())


def weighted_mean(column: str, weight: str) -> Column:
    """By weight; the plain mean if the weights sum to 0."""
    return F.when(F.sum(weight) > 0, F.sum(F.col(column) * F.col(weight)) / F.sum(weight)).otherwise(F.avg(column))


def full_rollup(metrics: DataFrame, keys: list[str], means: list[str], weight: str = "total_events") -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    return metrics.groupBy(*keys).agg(*sums, F.sum(weight).alias(weight), *(weighted_mean(c, weight).alias(c) for c in means)).withColumns(quality())


def replay_profiles(events: DataFrame, delays: list[int], losses: list[float], runs: int, seed: int = 42) -> DataFrame:
    """Every event under each profile (a few rows): observed earlier by the delay, visible by a hash of seed, run, loss and transaction."""
    spark = events.sparkSession
    profiles = spark.createDataFrame([(r, float(p), d) for r in range(1, runs + 1) for p in losses for d in delays], "run_id int, loss_rate double, delay_profile_sec int")
    text = F.concat_ws("|", F.lit(str(seed)), F.col("run_id").cast("string"), F.format_string("%.6f", "loss_rate"), F.col("hash"))
    draw = F.conv(F.left(F.sha2(text.cast("binary"), 256), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    rows = events.drop("visible", "observed_at").crossJoin(F.broadcast(profiles))
    return rows.withColumns({"visible": (F.col("loss_rate") <= 0) | (draw >= F.col("loss_rate")), "observed_at": F.col("block_time") - F.make_dt_interval(secs=F.col("delay_profile_sec").cast("decimal(18,6)"))})
