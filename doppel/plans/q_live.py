"""The live feed as a batch (ST, J15, A17, A18, W10, W11, P10, P12)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.plans import fixture as fx
from doppel.plans import sqlparts as sp
from doppel.plans.registry import query
from doppel.plans.sqlparts import sql
from doppel.streaming import live

CFG = DetectorConfig()
START = datetime.datetime(2024, 1, 1)


def blocks(spark, sf):
    """Transactions of 12-minute blocks; two thirds of them come from the feed."""
    feed = fx.pending_feed(spark, sf)
    n = F.floor(F.unix_micros("observed_at") / 720_000_000)
    h = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("0xzz"), F.substring("hash", 5, 62))).otherwise(F.upper(F.substring("hash", 3, 64)))
    return feed.select("event_id", n.alias("block_number"), F.timestamp_micros((n + 1) * 720_000_000).alias("block_time"), h.alias("tx_hash"), "input")


BLK = "SELECT event_id, epoch_us(observed_at) // 720000000 block_number, (epoch_us(observed_at) // 720000000 + 1) * 720000000 block_us, event_id % 3 <> 2 seen, epoch_us(observed_at) seen_us, event_id % 5 <= 3 token_call FROM feed"
INC = "SELECT *, CASE WHEN seen THEN (block_us - seen_us) / 1000.0::DOUBLE END lead_ms FROM blk"
ROW = "SELECT block_number, block_us, count(*) tx_total, count(*) FILTER (seen) tx_seen, count(*) FILTER (token_call) erc20_total, count(*) FILTER (token_call AND seen) erc20_seen, coalesce(avg(lead_ms), 0) m, coalesce(quantile_cont(lead_ms, 0.5), 0) q50, coalesce(quantile_cont(lead_ms, 0.95), 0) q95, coalesce(quantile_cont(lead_ms, 0.99), 0) q99 FROM inc GROUP BY ALL"


@query("st1_pending_decode", sql("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'hash' WHEN 1 THEN 'hash' WHEN 2 THEN 'object' ELSE 'error' END kind, CASE WHEN event_id % 4 < 3 THEN hash END tx_hash, CASE WHEN event_id % 4 = 2 THEN to_addr END to_addr FROM feed", "feed"))
def st1(spark, sf):
    k = F.col("event_id") % 4
    payload = F.when(k == 0, F.col("hash")).when(k == 1, F.concat(F.lit('"'), F.col("hash"), F.lit('"'))).when(k == 2, F.to_json(F.struct("hash", F.col("from_addr").alias("from"), F.col("to_addr").alias("to"), "input"))).otherwise(F.lit("oops"))
    got = live.decode(fx.pending_feed(spark, sf).select("event_id", payload.alias("payload")))
    return got.select("event_id", "kind", F.when(F.col("kind") != "error", F.col("tx_hash")).alias("tx_hash"), F.col("tx.to").alias("to_addr"))


@query("st3_detector_rows", sql("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN substr(from_addr, 3) ELSE from_addr END from_addr, CASE WHEN event_id % 5 <= 3 THEN peer ELSE to_addr END to_addr, CASE WHEN event_id % 5 <= 3 THEN to_addr ELSE '' END token_address, amount::DOUBLE AS value FROM feed", "feed"))
def st3(spark, sf):
    return live.detector_rows(fx.pending_feed(spark, sf)).select("event_id", "from_addr", "to_addr", "token_address", "value")


LIVE = {
    "cps2": f"SELECT DISTINCT {sp.addr('acct', 'user_id')} victim, left({sp.addr('peer', '(user_id % 97)')}, 5) || right({sp.addr('decoy', 'user_id')}, 30) || right({sp.addr('peer', '(user_id % 97)')}, 5) recipient, {sp.addr('tok', '1')} token, TIMESTAMP '2023-12-31' last_seen FROM events",
    "lp": "SELECT event_id, hash, substr(from_addr, 3) victim, peer lookalike, substr(to_addr, 3) token_address, amount::DOUBLE AS value, 0.0::DOUBLE value_normalized, observed_at FROM feed WHERE event_id % 5 <= 3",
    "lc": f"SELECT lp.*, c.recipient, c.token, c.last_seen, {sp.lcp('lookalike', 'c.recipient')} ap, {sp.lcs('lookalike', 'c.recipient')} as_, NULL::VARCHAR p_symbol, NULL::VARCHAR p_name, NULL::VARCHAR token_symbol, NULL::VARCHAR token_name, NULL::BOOLEAN p_missing, NULL::BOOLEAN metadata_missing FROM lp JOIN cps2 c USING (victim)",
    "act": f"SELECT * FROM lc WHERE ({sp.UNION}) AND {sp.ACTIVE}",
    "sc": sp.scored(sp.logistic()),
}


@query("st4_stream_static_detect", sql("SELECT event_id, victim, recipient, round(total, 9) total FROM sc WHERE total >= 0.901", "feed", **LIVE))
def st4(spark, sf):
    u = F.col("user_id")
    peer = fx.address("peer", u % 97)
    cps = fx.table(spark, sf, "events").select("user_id").distinct().select(
        fx.address("acct", u).alias("victim"), F.concat(F.left(peer, F.lit(5)), F.right(fx.address("decoy", u), F.lit(30)), F.right(peer, F.lit(5))).alias("recipient"), fx.address("tok", F.lit(1)).alias("token"),
        F.lit("S").alias("token_symbol"), F.lit("N").alias("token_name"), F.lit("2023-12-31").cast("timestamp").alias("last_seen"), F.lit(1).alias("observed_freq"), F.lit(False).alias("metadata_missing"),
    )
    return live.detect_live(fx.pending_feed(spark, sf), cps, CFG).select("event_id", "victim", "recipient", F.round("total", 9).alias("total"))


@query("st5_latest_sighting", sql("SELECT h AS hash, epoch_us(max(observed_at)) seen_us, max(observed_at) >= TIMESTAMP '2024-01-15' - INTERVAL 6 HOUR kept FROM (SELECT '0x' || left(sha256('pend:' || CAST(event_id // 2 AS VARCHAR)), 64) h, observed_at FROM feed WHERE observed_at <= TIMESTAMP '2024-01-15') GROUP BY h", "feed"))
def st5(spark, sf):
    h = F.concat(F.lit("0x"), F.left(F.sha2(F.concat(F.lit("pend:"), F.expr("cast(event_id div 2 as string)")).cast("binary"), 256), F.lit(64)))
    now = datetime.datetime(2024, 1, 15)
    rows = fx.pending_feed(spark, sf).filter(F.col("observed_at") <= F.lit(now)).withColumn("hash", h)
    return live.retained(live.last_seen(rows), "seen_at", now).select("hash", F.unix_micros("seen_at").alias("seen_us"), "kept")


NON = "SELECT event_id, hash, user_id sender, event_id % 50 nonce, observed_at FROM feed"


def nonces(spark, sf):
    return fx.pending_feed(spark, sf).select("event_id", "hash", F.col("user_id").alias("sender"), (F.col("event_id") % 50).alias("nonce"), "observed_at")


@query("st6_nonce_groups", sql("SELECT sender, nonce, arg_min(hash, (observed_at, event_id)) first_hash, count(DISTINCT hash) n FROM non GROUP BY ALL", "feed", non=NON))
def st6(spark, sf):
    return nonces(spark, sf).groupBy("sender", "nonce").agg(F.min(F.struct("observed_at", "event_id", "hash"))["hash"].alias("first_hash"), F.countDistinct("hash").alias("n"))


@query("w11_replacements", sql("SELECT event_id, hash <> first_value(hash) OVER (PARTITION BY sender, nonce ORDER BY observed_at, event_id) is_replacement FROM non", "feed", non=NON))
def w11(spark, sf):
    return live.replacements(nonces(spark, sf)).select("event_id", "is_replacement")


@query("w10_interarrival", sql("SELECT event_id, round((epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (ORDER BY observed_at, event_id))) / 1000.0::DOUBLE, 6) gap_ms FROM feed", "feed"))
def w10(spark, sf):
    return live.interarrival(fx.pending_feed(spark, sf)).select("event_id", F.round("gap_ms", 6).alias("gap_ms"))


@query("st10_sender_interarrival", sql("SELECT event_id, round((epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY user_id ORDER BY observed_at, event_id))) / 1000.0::DOUBLE, 6) gap_ms FROM feed", "feed"))
def st10(spark, sf):
    return live.interarrival(fx.pending_feed(spark, sf), "user_id").select("event_id", F.round("gap_ms", 6).alias("gap_ms"))


@query("j15_block_inclusion", sql("SELECT event_id, block_number, seen, round(lead_ms, 6) lead_ms FROM inc", "feed", blk=BLK, inc=INC))
def j15(spark, sf):
    return live.inclusion(blocks(spark, sf), fx.pending_feed(spark, sf)).select("event_id", "block_number", "seen", F.round("lead_ms", 6).alias("lead_ms"))


def summaries(spark, sf):
    return live.block_summary(live.inclusion(blocks(spark, sf), fx.pending_feed(spark, sf)))


@query("a17_block_summary", sql("SELECT block_number, tx_total, tx_seen, erc20_total, erc20_seen, round(m, 6) lead_mean_ms, round(q50, 6) lead_p50_ms, round(q95, 6) lead_p95_ms, round(q99, 6) lead_p99_ms FROM r", "feed", blk=BLK, inc=INC, r=ROW))
def a17(spark, sf):
    got = summaries(spark, sf).drop("block_time")
    return got.select(*(F.round(c, 6).alias(c) if c.startswith("lead") else F.col(c) for c in got.columns))


WARM = "SELECT *, n > 5 AND block_us - epoch_us(TIMESTAMP '2024-01-01') >= 60000000 counted FROM (SELECT *, row_number() OVER (ORDER BY block_number)::INT n FROM r)"


@query("p10_warmup_blocks", sql("SELECT block_number, n AS ordinal, counted FROM warm", "feed", blk=BLK, inc=INC, r=ROW, warm=WARM))
def p10(spark, sf):
    return live.after_warmup(summaries(spark, sf), START).select("block_number", "ordinal", "counted")


TOT = "SELECT count(*) blocks, CAST(sum(tx_total) AS BIGINT) tx_total, CAST(sum(tx_seen) AS BIGINT) tx_seen, CAST(sum(erc20_total) AS BIGINT) erc20_total, CAST(sum(erc20_seen) AS BIGINT) erc20_seen FROM warm WHERE counted"


@query("a18_visibility_summary", sql("SELECT *, round(1 - tx_seen / tx_total, 9) loss_rate, round(1 - erc20_seen / erc20_total, 9) erc20_loss_rate FROM tot", "feed", blk=BLK, inc=INC, r=ROW, warm=WARM, tot=TOT))
def a18(spark, sf):
    got = live.visibility(live.after_warmup(summaries(spark, sf), START))
    return got.select("blocks", "tx_total", "tx_seen", "erc20_total", "erc20_seen", F.round("loss_rate", 9).alias("loss_rate"), F.round("erc20_loss_rate", 9).alias("erc20_loss_rate"))


@query("st9_acceptance", sql("SELECT blocks, blocks >= 100 valid, CASE WHEN blocks < 100 THEN 'observed blocks ' || CAST(blocks AS VARCHAR) || ' < 100' ELSE '' END reason FROM tot", "feed", blk=BLK, inc=INC, r=ROW, warm=WARM, tot=TOT))
def st9(spark, sf):
    return live.visibility(live.after_warmup(summaries(spark, sf), START)).select("blocks", "valid", "reason")


@query("st8_warmup_counters", sql("SELECT count(*) FILTER (NOT counted) skipped, min(CASE WHEN counted THEN block_us END) warmup_end_us FROM warm", "feed", blk=BLK, inc=INC, r=ROW, warm=WARM))
def st8(spark, sf):
    got = live.after_warmup(summaries(spark, sf), START)
    return got.agg(F.count_if(~F.col("counted")).alias("skipped"), F.min(F.when(F.col("counted"), F.unix_micros("block_time"))).alias("warmup_end_us"))


@query("a18_series_summary", sql("SELECT count(*) messages, round(count(*) / 21600.0::DOUBLE, 9) messages_per_second, round(avg(amount), 6) amount_mean, round(quantile_cont(amount::DOUBLE, 0.5), 6) amount_p50, round(quantile_cont(amount::DOUBLE, 0.95), 6) amount_p95, round(quantile_cont(amount::DOUBLE, 0.99), 6) amount_p99 FROM feed", "feed"))
def a18s(spark, sf):
    got = live.summary(fx.pending_feed(spark, sf).withColumn("amount", F.col("amount").cast("double")), 21600, ["amount"])
    return got.select(*(F.round(c, 9 if c == "messages_per_second" else 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes))


@query("p12_distinct_blocks", sql("SELECT block_number FROM blk GROUP BY block_number", "feed", blk=BLK))
def p12(spark, sf):
    return blocks(spark, sf).select("block_number").dropDuplicates()
