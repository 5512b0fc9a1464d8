"""Counterparty tables: building, merging, summaries, and the choice of victims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.functions import address, values


def trusted_rows(labels: DataFrame) -> DataFrame:
    """Labelled rows that vouch for a recipient."""
    victim = F.when(F.col("is_sender_victim"), F.col("from_addr")).otherwise(F.col("to_addr"))
    rows = labels.withColumns({"victim": address.normalize_address(victim), "recipient": address.normalize_address("intended_addr"), "token": address.normalize_address("token_addr")})
    return rows.filter(values.is_negative() & F.col("victim").isNotNull() & F.col("recipient").isNotNull() & F.col("token").isNotNull())


def build(labels: DataFrame) -> DataFrame:
    """(victim, recipient, token, last_seen) with how often each was seen."""
    return trusted_rows(labels).groupBy("victim", "recipient", "token", values.block_to_time("block_number").alias("last_seen")).agg(F.count(F.lit(1)).alias("observed_freq"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts summed, the latest time kept."""
    return a.unionByName(b).groupBy("victim", "recipient", "token").agg(F.sum("observed_freq").alias("observed_freq"), F.max("last_seen").alias("last_seen"))


def grouped(cps: DataFrame) -> DataFrame:
    """Histories of each victim and recipient, latest first."""
    return cps.groupBy("victim", "recipient").agg(F.sort_array(F.collect_list(F.struct("last_seen", "token", "observed_freq")), asc=False).alias("histories"))


def attach_metadata(cps: DataFrame, metadata: DataFrame) -> DataFrame:
    m = metadata.select(F.col("address").alias("token"), F.col("symbol").alias("token_symbol"), F.col("name").alias("token_name"), F.col("decimals").alias("token_decimals"), "metadata_missing")
    rows = cps.select("victim", "recipient", "token", "last_seen", "observed_freq").join(m, "token", "left")
    return rows.withColumns({"token_symbol": F.coalesce("token_symbol", F.lit("")), "token_name": F.coalesce("token_name", F.lit("")), "token_decimals": F.coalesce("token_decimals", F.lit(0)), "metadata_missing": F.coalesce("metadata_missing", F.lit(True))})


def active_accounts(calls: DataFrame, both_ways: bool = True) -> DataFrame:
    """(victim, recipient, token): count, methods, and the block and transaction last seen. `calls`: from_addr, to_addr, token, method, seen_at, block_number, hash."""
    forth = calls.select(F.col("from_addr").alias("victim"), F.col("to_addr").alias("recipient"), "token", "method", "seen_at", "block_number", "hash")
    back = calls.select(F.col("to_addr").alias("victim"), F.col("from_addr").alias("recipient"), "token", "method", "seen_at", "block_number", "hash")
    last = F.max(F.struct("seen_at", "block_number", "hash"))
    got = (forth.unionByName(back) if both_ways else forth).groupBy("victim", "recipient", "token").agg(F.count(F.lit(1)).alias("observed_freq"), F.sort_array(F.collect_set("method")).alias("methods"), last.alias("l"))
    return got.select("victim", "recipient", "token", "observed_freq", "methods", F.col("l.seen_at").alias("last_seen"), F.col("l.block_number").alias("last_block"), F.col("l.hash").alias("last_tx"))


def victim_metrics(cps: DataFrame) -> DataFrame:
    return cps.groupBy("victim").agg(F.sum("observed_freq").alias("freq"), F.countDistinct("recipient").alias("n_recipients"), F.countDistinct("token").alias("n_tokens"), F.max("last_seen").alias("last_seen"))


def select_victims(cps: DataFrame, least: int, most: int, contracts: DataFrame | None = None) -> DataFrame:
    """The `most` victims with at least `least` recipients that are no contracts, ranked by recipients, frequency, recency, tokens and address."""
    rows = victim_metrics(cps).filter(F.col("n_recipients") >= least)
    if contracts is not None:
        rows = rows.join(contracts.select(F.col("address").alias("victim")), "victim", "left_anti")
    order = [F.desc("n_recipients"), F.desc("freq"), F.desc("last_seen"), F.desc("n_tokens"), F.desc("victim")]
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("victim_rank", F.row_number().over(Window.orderBy(*order)))


def top_counterparties(cps: DataFrame, victims: DataFrame, per_victim: int, most: int) -> DataFrame:
    """The `per_victim` first of each chosen victim, and of those the `most` first over all."""
    order = [F.desc("observed_freq"), F.desc("last_seen"), F.desc("recipient"), F.desc("token")]
    rows = cps.join(F.broadcast(victims.select("victim", "victim_rank")), "victim").withColumn("n", F.row_number().over(Window.partitionBy("victim").orderBy(*order))).filter(F.col("n") <= per_victim)
    return rows.orderBy("victim_rank", F.desc("observed_freq"), F.desc("last_seen"), "recipient", "token").limit(most)


def dataset_stats(labels: DataFrame) -> DataFrame:
    victim = F.when(F.col("is_sender_victim"), F.col("from_addr")).otherwise(F.col("to_addr"))
    flags = ("intended_transfer", "zero_value_transfer", "tiny_transfer", "counterfeit_token_transfer", "payoff_transfer", "payoff_transfer_unconfirmed", "is_not_categorized")
    return labels.withColumn("v", victim).agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.count_if(c).alias(f"n_{c}") for c in flags), F.count_if(values.is_poisoning()).alias("n_poisoning"),
        F.countDistinct("v").alias("n_victims"), F.countDistinct("token_addr").alias("n_tokens"), F.countDistinct("v", "intended_addr", "token_addr").alias("n_counterparties"),
    )
