"""The pending feed: decoding, detection, inclusion, retention and summaries.

Every step is a function of DataFrames, so that a batch replay and a stream share it. Stateless steps run as they are on a
stream; inclusion is a stream-stream join with a watermark; sender-nonce state is kept by applyInPandasWithState.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doppel.config import DetectorConfig
from doppel.functions import values
from doppel.operators import detect

RETENTION_HOURS, WARMUP_SECONDS, WARMUP_BLOCKS, MIN_BLOCKS = 6, 60, 5, 100
TX = "hash string, `from` string, `to` string, input string, value string, nonce string"


def decode(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages are a bare hash or a transaction object; `kind` says which, `tx` is the object, bad ones are kind 'error'."""
    text = F.trim(payload)
    tx = F.from_json(text, TX)
    hash_ = F.regexp_extract(text, '^"?(0x[0-9a-fA-F]+)"?$', 1)
    kind = F.when(hash_ != "", "hash").when(text.startswith("{") & tx["hash"].isNotNull(), "object").otherwise("error")
    return messages.withColumns({"kind": kind, "tx": F.when(kind == "object", tx), "tx_hash": values.with_0x(F.when(kind == "hash", hash_).otherwise(tx["hash"]))})


def detector_rows(feed: DataFrame) -> DataFrame:
    """Pending transactions (hash, from_addr, to_addr, input, amount, observed_at) as events: a token call's own parties and token, raw amounts."""
    call = values.transfer_call("input")
    rows = feed.withColumn("_c", call)
    token = F.when(F.col("_c").isNotNull(), F.col("to_addr")).otherwise(F.lit(""))
    return rows.select(
        *[c for c in feed.columns if c not in ("from_addr", "to_addr")],
        F.coalesce(F.col("_c.from_addr"), F.col("from_addr")).alias("from_addr"), F.coalesce(F.col("_c.to_addr"), F.col("to_addr")).alias("to_addr"), token.alias("token_address"),
        F.when(F.col("_c").isNotNull(), values.hex_to_double("_c.amount_hex")).otherwise(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))).alias("value"), F.lit(0.0).alias("value_normalized"),
        F.col("_c").isNotNull().alias("is_token_call"),
    )


def detect_live(feed: DataFrame, cps: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Candidate scores at or above tau for each pending row and recipient history. No aggregation, so it also runs on a stream in append mode.

    Token metadata isn't given: a pending token is never known to look like another."""
    events = detector_rows(feed).withColumn("block_time", F.col("observed_at"))
    pairs = detect.pair_victims(events).withColumns({c: F.lit(None).cast(t) for c, t in (("p_symbol", "string"), ("p_name", "string"), ("p_missing", "boolean"))})
    from doppel.functions import scoring

    rows = scoring.scored(detect.eligible(detect.by_posting_list(pairs, cps, cfg), cfg), cfg)
    return rows.filter(F.col("total") >= cfg.tau)


def last_seen(pending: DataFrame) -> DataFrame:
    """hash -> the latest observation."""
    return pending.groupBy(values.with_0x("hash").alias("hash")).agg(F.max("observed_at").alias("seen_at"))


def retained(state: DataFrame, at: str, now, hours: int = RETENTION_HOURS) -> DataFrame:
    return state.withColumn("kept", F.col(at) >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))


def inclusion(blocks: DataFrame, pending: DataFrame) -> DataFrame:
    """Transactions of blocks (block_number, block_time, tx_hash, input) with whether each was seen pending and by how much ahead, in ms. Negative: seen later."""
    txs = blocks.withColumn("hash", values.with_0x("tx_hash")).join(last_seen(pending), "hash", "left")
    lead = (F.unix_micros("block_time") - F.unix_micros("seen_at")) / 1000.0
    return txs.withColumns({"seen": F.col("seen_at").isNotNull(), "lead_ms": lead, "is_token_call": values.transfer_call("input").isNotNull()})


def block_summary(included: DataFrame) -> DataFrame:
    seen, token = F.col("seen"), F.col("is_token_call")
    lead = F.when(seen, F.col("lead_ms"))
    q = [F.coalesce(F.percentile(lead, p / 100), F.lit(0.0)).alias(f"lead_p{p}_ms") for p in (50, 95, 99)]
    return included.groupBy("block_number", "block_time").agg(
        F.count(F.lit(1)).alias("tx_total"), F.count_if(seen).alias("tx_seen"), F.count_if(token).alias("erc20_total"), F.count_if(token & seen).alias("erc20_seen"), F.coalesce(F.avg(lead), F.lit(0.0)).alias("lead_mean_ms"), *q
    )


def after_warmup(blocks: DataFrame, started_at, at: str = "block_time") -> DataFrame:
    """Blocks after the first WARMUP_BLOCKS and the first WARMUP_SECONDS; `ordinal` from 1, numbered over one row a block."""
    n = F.row_number().over(Window.orderBy("block_number"))
    late = F.unix_micros(at) - F.unix_micros(F.lit(started_at)) >= WARMUP_SECONDS * 1_000_000
    return blocks.withColumn("ordinal", n).withColumn("counted", (F.col("ordinal") > WARMUP_BLOCKS) & late)


def visibility(blocks: DataFrame, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """Totals over counted blocks, rates, and whether the run is valid."""
    s = blocks.filter("counted").agg(F.count(F.lit(1)).alias("blocks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tx_total", "tx_seen", "erc20_total", "erc20_seen")))
    loss = lambda seen, total: F.when(F.col(total) == 0, 0.0).otherwise(1 - F.col(seen) / F.col(total))
    reason = F.concat_ws("; ", F.when(F.col("blocks") == 0, "warmup incomplete"), F.when(F.col("blocks") < min_blocks, F.concat(F.lit("observed blocks "), F.col("blocks").cast("string"), F.lit(f" < {min_blocks}"))))
    return s.withColumns({"loss_rate": loss("tx_seen", "tx_total"), "erc20_loss_rate": loss("erc20_seen", "erc20_total"), "reason": reason}).withColumn("valid", F.col("reason") == "")


def interarrival(pending: DataFrame, *keys: str) -> DataFrame:
    """Milliseconds since the message before. Without keys the feed is one series: numbered within hourly blocks, whose ends are joined, so that no task sorts it all."""
    rows = pending.withColumn("_h", F.floor(F.unix_micros("observed_at") / 3_600_000_000)) if not keys else pending.withColumn("_h", F.lit(0))
    w = Window.partitionBy(*keys, "_h").orderBy("observed_at", "event_id")
    rows = rows.withColumn("_prev", F.lag("observed_at").over(w))
    if not keys:
        ends = rows.groupBy("_h").agg(F.max("observed_at").alias("_last"))
        before = ends.select(F.col("_h"), F.lag("_last").over(Window.orderBy("_h")).alias("_before"))
        rows = rows.join(before, "_h").withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before")
    return rows.withColumn("gap_ms", (F.unix_micros("observed_at") - F.unix_micros("_prev")) / 1000.0).drop("_h", "_prev")


def replacements(pending: DataFrame) -> DataFrame:
    """Messages whose hash differs from the first hash of their sender and nonce."""
    first = pending.groupBy("sender", "nonce").agg(F.min(F.struct("observed_at", "event_id", "hash")).alias("f"))
    return pending.join(first, ["sender", "nonce"]).withColumn("is_replacement", F.col("hash") != F.col("f.hash")).drop("f")


def summary(rows: DataFrame, seconds: float, series: list[str]) -> DataFrame:
    """Counts a second, and mean, p50, p95 and p99 of each series (0 if empty)."""
    aggs = [F.count(F.lit(1)).alias("messages"), (F.count(F.lit(1)) / F.lit(float(seconds))).alias("messages_per_second")]
    for c in series:
        aggs.append(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"))
        aggs += [F.coalesce(F.percentile(c, p / 100), F.lit(0.0)).alias(f"{c}_p{p}") for p in (50, 95, 99)]
    return rows.agg(*aggs)


# ---------------------------------------------------------------- streams


def stream_replacements(pending: DataFrame, retention_hours: int = RETENTION_HOURS) -> DataFrame:
    """The first hash of each sender and nonce as state; messages with another hash are flagged. State goes after the retention (event time)."""
    limit = retention_hours * 3600 * 1000

    def step(key, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, latest = (state.get if state.exists else (None, 0))
        for frame in frames:
            frame = frame.sort_values(["observed_at", "event_id"])
            if first is None:
                first = frame["hash"].iloc[0]
            latest = max(latest, int(frame["observed_at"].max().value // 1_000_000))
            yield pd.DataFrame({"sender": frame["sender"], "nonce": frame["nonce"], "hash": frame["hash"], "is_replacement": frame["hash"] != first})
        state.update((first, latest))
        state.setTimeoutTimestamp(max(latest + limit, state.getCurrentWatermarkMs() + 1))

    rows = pending.withWatermark("observed_at", "1 minute").groupBy("sender", "nonce")
    return rows.applyInPandasWithState(step, "sender string, nonce long, hash string, is_replacement boolean", "hash string, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_inclusion(blocks: DataFrame, pending: DataFrame, retention_hours: int = RETENTION_HOURS) -> DataFrame:
    """Block transactions with their pending sighting of the last hours, if any: a left join of two streams."""
    p = pending.select(values.with_0x("hash").alias("p_hash"), F.col("observed_at").alias("seen_at")).withWatermark("seen_at", "1 minute")
    b = blocks.withColumn("b_hash", values.with_0x("tx_hash")).withWatermark("block_time", "1 minute")
    near = (F.col("b_hash") == F.col("p_hash")) & (F.col("seen_at") <= F.col("block_time") + F.expr("INTERVAL 1 MINUTE")) & (F.col("seen_at") >= F.col("block_time") - F.expr(f"INTERVAL {retention_hours} HOURS"))
    return b.join(p, near, "leftOuter").withColumn("seen", F.col("seen_at").isNotNull())


class Settings:
    """Settings that may be changed while a detector runs; the next micro-batch uses them."""

    def __init__(self, cfg: DetectorConfig) -> None:
        self._cfg, self._lock = cfg, threading.Lock()

    def get(self) -> DetectorConfig:
        with self._lock:
            return self._cfg

    def apply(self, cfg: DetectorConfig) -> None:
        with self._lock:
            self._cfg = cfg


def run_detector(feed: DataFrame, cps: DataFrame, cfg: DetectorConfig | Settings, sink, checkpoint: str, every: str = "30 seconds"):
    """Starts the detector on a stream; `sink` gets each micro-batch of alerts and its number, once committed batches are skipped by the checkpoint."""
    from doppel.operators.detect import best

    settings = cfg if isinstance(cfg, Settings) else Settings(cfg)

    def batch(df: DataFrame, epoch: int) -> None:
        sink(best(detect_live(df, cps, settings.get()), "event_id", "hash", "victim", "lookalike", "recipient"), epoch)

    return feed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(batch).start()
