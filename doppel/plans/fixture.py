"""Look-alike transfers derived from the order tables: counterparties, events, token metadata, label rows, and a live feed.

Victims are customers, recipients suppliers, tokens parts modulo 20. Every order is one event whose look-alike address is
planted by the order key: class k % 8 tells how many digits it shares with the order's supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions import values
from doppel.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def later(column: str) -> Column:
    """The orders are older than the replay clock: blocks are numbered as if they came 10950 days later."""
    return F.col(column) + F.expr("INTERVAL 10950 DAYS")


def address(kind: str, key: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string")).cast("binary"), 256), F.lit(40))


def fraction(kind: str, key: Column) -> Column:
    """An even number from 0 to 1 by hashing."""
    return F.conv(F.left(F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string")).cast("binary"), 256), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 20).alias("t"), F.col("l_linenumber").alias("n"),
        F.col("l_shipdate").cast("timestamp").alias("d"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"),
    )
    return orders.join(items, "k")


def counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted counterparties, one row for each victim, recipient, token and day. Keys stay numbers until they are summed."""
    rows = lines(spark, sf_dir).groupBy("c", "s", "t", "d").agg(F.count(F.lit(1)).alias("observed_freq"))
    t = F.col("t")
    return rows.select(
        address("acct", F.col("c")).alias("victim"), address("peer", F.col("s")).alias("recipient"), address("tok", t).alias("token"),
        F.concat(F.lit("SYM"), (t % 5).cast("string")).alias("token_symbol"), F.concat(F.lit("Name"), (t % 5).cast("string")).alias("token_name"),
        F.when(t % 3 == 0, 6).otherwise(18).alias("token_decimals"), F.col("d").alias("last_seen"), "observed_freq", (t == 7).alias("metadata_missing"),
    )


def metadata(spark: SparkSession) -> DataFrame:
    t = F.col("id")
    return spark.range(20).select(
        address("tok", t).alias("address"), F.when(t % 3 == 0, 6).otherwise(18).alias("decimals"), F.concat(F.lit("SYM"), (t % 5).cast("string")).alias("symbol"),
        F.concat(F.lit("Name"), (t % 5).cast("string")).alias("name"), (t == 7).alias("metadata_missing"),
    )


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: its first line, and what is planted."""
    first = lines(spark, sf_dir).groupBy("k").agg(F.min(F.struct("n", "s", "t", "d", "q", "x", "c")).alias("f")).select("k", "f.*")
    k = F.col("k")
    r0, mid = F.col("r0"), F.col("mid")
    part = lambda a, n: F.substring(mid, a, n)
    head, tail = (lambda n: F.left(r0, F.lit(n))), (lambda n: F.right(r0, F.lit(n)))
    cls = k % 8
    look = (
        F.when(cls == 0, r0).when(cls == 1, F.concat(head(6), part(7, 28), tail(6))).when(cls == 2, F.concat(head(4), part(5, 32), tail(4)))
        .when(cls == 3, F.concat(head(3), part(4, 37))).when(cls == 4, F.concat(part(1, 37), tail(3))).when(cls == 5, F.concat(head(2), part(3, 36), tail(2))).otherwise(mid)
    )
    value = F.when(F.expr("(k div 8) % 3") == 0, 0.0).when(F.expr("(k div 8) % 3") == 1, F.col("q") / 10).otherwise(F.col("x"))
    tok = F.expr("(k div 24) % 4")
    token = F.when(tok == 0, address("tok", F.col("t"))).when(tok == 1, address("tok", (F.col("t") + 5) % 20)).when(tok == 2, address("tok", (F.col("t") + 1) % 20)).otherwise(F.lit(""))
    return (
        first.withColumns({"r0": address("peer", F.col("s")), "mid": address("mid", k), "victim": address("acct", F.col("c"))})
        .withColumns({"lookalike": look, "value": value, "token_address": token, "cls": cls, "token_class": tok, "is_sender_victim": F.expr("(k div 96) % 2") == 1})
        .withColumn("observed_at", F.col("d") + F.make_dt_interval(days=(k % 40).cast("int")))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay events. Two orders share a transaction hash; a tenth is invisible, some visibilities are null."""
    k = F.col("k")
    base = base_events(spark, sf_dir).withColumn("block_time", F.col("observed_at") + F.expr("INTERVAL 12 SECONDS"))
    return base.select(
        k.alias("event_id"), F.concat(F.lit("tx"), F.expr("cast(k div 2 as string)")).alias("hash"),
        F.when(F.col("is_sender_victim"), F.col("victim")).otherwise(F.col("lookalike")).alias("from_addr"), F.when(F.col("is_sender_victim"), F.col("lookalike")).otherwise(F.col("victim")).alias("to_addr"),
        "token_address", "value", F.when(k % 5 == 0, 0.0).otherwise(F.col("value")).alias("value_normalized"), "observed_at", "block_time", values.time_to_block(later("block_time")).alias("block_number"),
        F.when(k % 97 == 0, F.lit(None)).otherwise(fraction("vis", k) >= 0.1).alias("visible"), (F.col("cls").between(1, 5) & (F.col("value") <= 10)).alias("is_poisoning"),
        F.when(F.col("value") == 0, "zero_value").when(F.col("value") <= 10, "tiny").otherwise("intended").alias("label_tx_class"), F.col("victim").alias("victim_hint"),
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transfers as labelled rows, addresses with 0x."""
    k, x = F.col("k"), lambda c: F.concat(F.lit("0x"), c)
    sender = F.col("is_sender_victim")
    return base_events(spark, sf_dir).select(
        values.time_to_block(later("observed_at")).alias("block_number"), F.concat(F.lit("0x"), F.left(F.sha2(F.concat(F.lit("tx:"), k.cast("string")).cast("binary"), 256), F.lit(64))).alias("tx_hash"),
        x(address("tok", F.col("t"))).alias("token_addr"), x(F.when(sender, F.col("victim")).otherwise(F.col("lookalike"))).alias("from_addr"), x(F.when(sender, F.col("lookalike")).otherwise(F.col("victim"))).alias("to_addr"),
        sender.alias("is_sender_victim"), "value", (F.col("value") * 2).alias("value_usd"), F.col("cls").isin(0, 6).alias("intended_transfer"), ((F.col("value") == 0) & F.col("cls").between(1, 5)).alias("zero_value_transfer"),
        ((F.col("value") > 0) & (F.col("value") <= 10) & F.col("cls").between(1, 5)).alias("tiny_transfer"), ((F.col("token_class") == 1) & F.col("cls").between(1, 5)).alias("counterfeit_token_transfer"),
        (k % 50 == 0).alias("payoff_transfer"), (k % 60 == 0).alias("payoff_transfer_unconfirmed"), (F.col("cls") == 7).alias("is_not_categorized"), x(F.col("r0")).alias("intended_addr"),
        F.when(F.col("cls").isin(1, 2, 3, 5), F.element_at(F.array(*(F.lit(v) for v in (6, 4, 3, 0, 2))), F.col("cls").cast("int"))).otherwise(0).cast("long").alias("num_first_matched_digits"),
        F.when(F.col("cls") == 4, 3).when(F.col("cls") == 1, 6).when(F.col("cls") == 2, 4).when(F.col("cls") == 5, 2).otherwise(0).cast("long").alias("num_last_matched_digits"),
    )


def pending_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of pending transactions from the events table: call data of a token transfer for most rows."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("observed_at"), "user_id", "event_type", "value")
    amount = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.floor(F.col("value") * 100)).cast("long")
    word = lambda c: F.lpad(c, 64, "0")
    plain = F.concat(F.lit("0x" + values.TRANSFER), word(address("peer", F.col("user_id") % 97)), word(F.lower(F.hex(amount))))
    behalf = F.concat(F.lit("0x" + values.TRANSFER_FROM), word(address("acct", F.col("user_id"))), word(address("peer", F.col("user_id") % 97)), word(F.lower(F.hex(amount))))
    kind = F.col("event_id") % 5
    return e.select(
        "event_id", F.concat(F.lit("0x"), F.left(F.sha2(F.concat(F.lit("pend:"), F.expr("cast(event_id as string)")).cast("binary"), 256), F.lit(64))).alias("hash"), "observed_at", "user_id",
        F.concat(F.lit("0x"), address("acct", F.col("user_id"))).alias("from_addr"), F.concat(F.lit("0x"), address("tok", F.col("event_id") % 20)).alias("to_addr"),
        F.when(kind <= 2, plain).when(kind == 3, behalf).otherwise(F.lit("0x")).alias("input"), amount.alias("amount"),
        F.expr("event_id div 3").alias("nonce_seed"),
    )
