"""Counterparty tables and victims (A1-A4, A19-A21, A26, J12, J13, J18, J19, P8, U2, U4-U6, W5, W6, RND)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doppel.functions import address, values
from doppel.operators import accounts, evaluate, stats
from doppel.plans import fixture as fx
from doppel.plans.q_functions import POISON
from doppel.plans.registry import query
from doppel.plans.sqlparts import sql

TRUST = f"intended_transfer AND NOT {POISON} AND NOT payoff_transfer AND NOT payoff_transfer_unconfirmed AND intended_addr <> '' AND token_addr <> ''"
TRUSTED = f"SELECT *, substr(CASE WHEN is_sender_victim THEN from_addr ELSE to_addr END, 3) victim, substr(intended_addr, 3) recipient, substr(token_addr, 3) token FROM labels_ WHERE {TRUST}"
BUILT = "SELECT victim, recipient, token, make_timestamp(CAST((1438214400 + 12 * block_number) * 1000000 AS BIGINT)) last_seen, count(*) observed_freq FROM trusted GROUP BY ALL"


@query("p8_trusted_rows", sql("SELECT tx_hash FROM trusted", "labels_", trusted=TRUSTED))
def p8(spark, sf):
    return accounts.trusted_rows(fx.label_rows(spark, sf)).select("tx_hash")


@query("a1_grouped_counterparties", sql("SELECT victim, recipient, count(*) n, max(last_seen) latest FROM cps GROUP BY ALL", "cps"))
def a1(spark, sf):
    return accounts.grouped(fx.counterparties(spark, sf)).select("victim", "recipient", F.size("histories").cast("long").alias("n"), F.col("histories")[0]["last_seen"].alias("latest"))


@query("a2_build_counterparties", sql("SELECT victim, recipient, token, epoch_us(last_seen) seen_us, observed_freq FROM built", "labels_", trusted=TRUSTED, built=BUILT))
def a2(spark, sf):
    return accounts.build(fx.label_rows(spark, sf)).select("victim", "recipient", "token", F.unix_micros("last_seen").alias("seen_us"), "observed_freq")


@query("u2_merge_counterparties", sql("SELECT victim, recipient, token, CAST(sum(observed_freq) AS BIGINT) observed_freq, epoch_us(max(last_seen)) seen_us FROM (SELECT victim, recipient, token, observed_freq, last_seen FROM built UNION ALL SELECT victim, recipient, token, observed_freq, last_seen FROM cps) GROUP BY ALL", "labels_", "cps", trusted=TRUSTED, built=BUILT))
def u2(spark, sf):
    keep = ["victim", "recipient", "token", "observed_freq", "last_seen"]
    got = accounts.merge(accounts.build(fx.label_rows(spark, sf)).select(*keep), fx.counterparties(spark, sf).select(*keep))
    return got.select("victim", "recipient", "token", "observed_freq", F.unix_micros("last_seen").alias("seen_us"))


CALLS = "SELECT substr(from_addr, 3) from_addr, peer to_addr, substr(to_addr, 3) token, CASE WHEN event_id % 5 = 3 THEN 'transferFrom' ELSE 'transfer' END AS method, observed_at seen_at, event_id block_number, hash FROM feed WHERE event_id % 5 <= 3"
BOTH = "SELECT from_addr victim, to_addr recipient, * FROM calls UNION ALL SELECT to_addr victim, from_addr recipient, * FROM calls"


@query("a3_active_accounts", sql("SELECT victim, recipient, token, count(*) observed_freq, array_to_string(list_sort(list(DISTINCT method)), ',') methods, epoch_us(max(seen_at)) seen_us, arg_max(block_number, (seen_at, block_number)) last_block FROM both_ GROUP BY victim, recipient, token", "feed", calls=CALLS, both_=BOTH))
def a3(spark, sf):
    rows = fx.pending_feed(spark, sf).withColumn("c", values.transfer_call("input")).filter(F.col("c").isNotNull())
    calls = rows.select(
        address.normalize_address("from_addr").alias("from_addr"), F.col("c.to_addr").alias("to_addr"), address.normalize_address("to_addr").alias("token"),
        F.when(F.col("c.from_addr").isNull(), "transfer").otherwise("transferFrom").alias("method"), F.col("observed_at").alias("seen_at"), F.col("event_id").alias("block_number"), "hash",
    )
    got = accounts.active_accounts(calls)
    return got.select("victim", "recipient", "token", "observed_freq", F.array_join("methods", ",").alias("methods"), F.unix_micros("last_seen").alias("seen_us"), "last_block")


VM = "SELECT victim, CAST(sum(observed_freq) AS BIGINT) freq, count(DISTINCT recipient) n_recipients, count(DISTINCT token) n_tokens, max(last_seen) last_seen FROM cps GROUP BY victim"


@query("a4_victim_metrics", sql("SELECT victim, freq, n_recipients, n_tokens, epoch_us(last_seen) seen_us FROM vm", "cps", vm=VM))
def a4(spark, sf):
    return accounts.victim_metrics(fx.counterparties(spark, sf)).select("victim", "freq", "n_recipients", "n_tokens", F.unix_micros("last_seen").alias("seen_us"))


CHOSEN = "SELECT *, row_number() OVER (ORDER BY n_recipients DESC, freq DESC, last_seen DESC, n_tokens DESC, victim DESC)::INT victim_rank FROM vm WHERE n_recipients >= 5 AND victim NOT LIKE '0%' QUALIFY victim_rank <= 50"


def chosen(spark, sf):
    cps = fx.counterparties(spark, sf)
    contracts = cps.filter("victim like '0%'").select(F.col("victim").alias("address")).distinct()
    return accounts.select_victims(cps, 5, 50, contracts)


@query("w5_select_victims", sql("SELECT victim, victim_rank, n_recipients FROM chosen", "cps", vm=VM, chosen=CHOSEN))
def w5(spark, sf):
    return chosen(spark, sf).select("victim", "victim_rank", "n_recipients")


@query("w6_top_counterparties", sql("SELECT victim, recipient, token, epoch_us(last_seen) seen_us, observed_freq FROM (SELECT c.*, victim_rank, row_number() OVER (PARTITION BY victim ORDER BY observed_freq DESC, c.last_seen DESC, recipient DESC, token DESC) n FROM cps c JOIN chosen USING (victim)) WHERE n <= 3 ORDER BY victim_rank, observed_freq DESC, last_seen DESC, recipient, token LIMIT 100", "cps", vm=VM, chosen=CHOSEN))
def w6(spark, sf):
    return accounts.top_counterparties(fx.counterparties(spark, sf), chosen(spark, sf), 3, 100).select("victim", "recipient", "token", F.unix_micros("last_seen").alias("seen_us"), "observed_freq")


@query("a19_dataset_stats", sql(f"SELECT count(*) n_rows, {', '.join(f'count(*) FILTER ({c}) n_{c}' for c in ('intended_transfer', 'zero_value_transfer', 'tiny_transfer', 'counterfeit_token_transfer', 'payoff_transfer', 'payoff_transfer_unconfirmed', 'is_not_categorized'))}, count(*) FILTER ({POISON}) n_poisoning, count(DISTINCT v) n_victims, count(DISTINCT token_addr) n_tokens, count(DISTINCT (v, intended_addr, token_addr)) n_counterparties FROM (SELECT *, CASE WHEN is_sender_victim THEN from_addr ELSE to_addr END v FROM labels_)", "labels_"))
def a19(spark, sf):
    return accounts.dataset_stats(fx.label_rows(spark, sf))


@query("a26_most_common_victims", sql("SELECT victim_hint victim, count(*) n FROM ev GROUP BY 1 ORDER BY n DESC, victim LIMIT 20", "ev"))
def a26(spark, sf):
    return fx.events(spark, sf).groupBy(F.col("victim_hint").alias("victim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "victim").limit(20)


@query("j12_attach_metadata", sql("SELECT c.victim, c.recipient, c.token, epoch_us(c.last_seen) seen_us, coalesce(m.symbol, '') token_symbol, coalesce(m.name, '') token_name, coalesce(m.decimals, 0) token_decimals, coalesce(m.metadata_missing, true) metadata_missing FROM cps c LEFT JOIN (SELECT * FROM meta WHERE decimals = 18) m ON m.address = c.token", "cps", "meta"))
def j12(spark, sf):
    got = accounts.attach_metadata(fx.counterparties(spark, sf), fx.metadata(spark).filter("decimals = 18"))
    return got.select("victim", "recipient", "token", F.unix_micros("last_seen").alias("seen_us"), "token_symbol", "token_name", "token_decimals", "metadata_missing")


@query("j13_block_numbers", sql("SELECT e.event_id, coalesce(b.n, e.block_number, 0) block_number FROM ev e LEFT JOIN (SELECT hash, max(block_number) n FROM ev WHERE event_id % 3 <> 0 GROUP BY hash) b USING (hash)", "ev"))
def j13(spark, sf):
    e = fx.events(spark, sf)
    b = e.filter("event_id % 3 <> 0").groupBy("hash").agg(F.max("block_number").alias("n"))
    return e.join(b, "hash", "left").select("event_id", F.coalesce("n", "block_number", F.lit(0)).alias("block_number"))


@query("j18_touched_victims", sql("SELECT event_id FROM ev WHERE from_addr IN (SELECT victim FROM v) OR to_addr IN (SELECT victim FROM v)", "ev", "cps", v="SELECT victim FROM cps WHERE victim < '4' GROUP BY victim"))
def j18(spark, sf):
    victims = fx.counterparties(spark, sf).filter("victim < '4'").select("victim").distinct()
    e = fx.events(spark, sf)
    touched = e.select("event_id", F.explode(F.array("from_addr", "to_addr")).alias("victim")).join(victims, "victim", "left_semi").select("event_id").distinct()
    return e.join(touched, "event_id", "left_semi").select("event_id")


@query("j19_excluded_hashes", sql(f"SELECT tx_hash FROM labels_ WHERE NOT ({POISON} OR payoff_transfer OR payoff_transfer_unconfirmed)", "labels_"))
def j19(spark, sf):
    rows = fx.label_rows(spark, sf)
    out = rows.filter(values.is_poisoning() | F.col("payoff_transfer") | F.col("payoff_transfer_unconfirmed")).select("tx_hash")
    return rows.join(out, "tx_hash", "left_anti").select("tx_hash")


@query("src13_history_scan", sql("SELECT victim, recipient, token, count(*) observed_freq FROM (SELECT substr(from_addr, 3) victim, peer recipient, substr(to_addr, 3) token, hash, amount FROM feed WHERE event_id % 5 <= 3) WHERE amount > 0 AND hash NOT IN (SELECT hash FROM feed WHERE event_id % 10 = 1) GROUP BY ALL", "feed"))
def src13(spark, sf):
    rows = fx.pending_feed(spark, sf)
    logs = rows.withColumn("c", values.transfer_call("input")).filter(F.col("c").isNotNull() & (F.col("amount") > 0))
    logs = logs.join(rows.filter("event_id % 10 = 1").select("hash"), "hash", "left_anti")
    return logs.groupBy(address.normalize_address("from_addr").alias("victim"), F.col("c.to_addr").alias("recipient"), address.normalize_address("to_addr").alias("token")).agg(F.count(F.lit(1)).alias("observed_freq"))


@query("u4_poisoning_and_benign", sql(f"SELECT tx_hash, true pos FROM labels_ WHERE {POISON} UNION ALL SELECT tx_hash, false FROM trusted", "labels_", trusted=TRUSTED))
def u4(spark, sf):
    rows = fx.label_rows(spark, sf)
    return rows.filter(values.is_poisoning()).select("tx_hash", F.lit(True).alias("pos")).unionByName(accounts.trusted_rows(rows).select("tx_hash", F.lit(False).alias("pos")))


@query("u5_first_insert_wins", sql("SELECT victim, recipient, first.token AS token, epoch_us(first.last_seen) AS seen_us FROM (SELECT victim, recipient, min({'last_seen': last_seen, 'token': token}) AS first FROM cps GROUP BY ALL)", "cps"))
def u5(spark, sf):
    """Of rows with one key the earliest is kept, those that come later are ignored."""
    first = fx.counterparties(spark, sf).groupBy("victim", "recipient").agg(F.min(F.struct("last_seen", "token")).alias("first"))
    return first.select("victim", "recipient", "first.token", F.unix_micros("first.last_seen").alias("seen_us"))


@query("u6_relevant_first", sql("SELECT event_id, CASE WHEN victim_hint IN (SELECT victim FROM v) THEN 0 ELSE 1 END later FROM ev", "ev", "cps", v="SELECT victim FROM cps WHERE victim < '4' GROUP BY victim"))
def u6(spark, sf):
    victims = fx.counterparties(spark, sf).filter("victim < '4'").select(F.col("victim").alias("victim_hint")).distinct()
    e = fx.events(spark, sf)
    first, rest = e.join(victims, "victim_hint", "left_semi"), e.join(victims, "victim_hint", "left_anti")
    return first.select("event_id", F.lit(0).alias("later")).unionByName(rest.select("event_id", F.lit(1).alias("later")))


@query("a21_shard_day_counts", sql("SELECT CAST('0x' || right(victim_hint, 8) AS BIGINT) % 16 shard, strftime(block_time, '%Y-%m-%d') AS day, is_poisoning label, count(*) n FROM ev GROUP BY ALL", "ev"))
def a21(spark, sf):
    e = evaluate.event_day(fx.events(spark, sf))
    return e.groupBy(address.shard("victim_hint", 16).alias("shard"), "day", F.col("is_poisoning").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("snk6_fast_shards", sql("SELECT CAST('0x' || right(victim_hint, 8) AS BIGINT) % 16 shard, count(*) n, count(DISTINCT victim_hint) victims FROM ev GROUP BY 1", "ev"))
def snk6(spark, sf):
    """Written as one folder a shard, read back by partition."""
    import uuid

    from doppel.session import shared_folder
    from doppel.sources import files

    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    files.write_shards(fx.events(spark, sf).select("event_id", "victim_hint"), path, 16)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("victim_hint").alias("victims"))


@query("w9_split_cutoffs", sql("SELECT min(CASE WHEN c >= n * 0.70 THEN day END) train_end, min(CASE WHEN c >= n * 0.85 THEN day END) val_end FROM (SELECT day, sum(k) OVER (ORDER BY day) c, sum(k) OVER () n FROM (SELECT strftime(block_time, '%Y-%m-%d') AS day, count(*) k FROM ev GROUP BY 1))", "ev"))
def w9(spark, sf):
    from doppel.operators.features import split_days

    return split_days(evaluate.event_day(fx.events(spark, sf)))


@query("w14_newest_listings", sql("SELECT event_id, hash FROM ev ORDER BY event_id DESC LIMIT 25", "ev"))
def w14(spark, sf):
    return fx.events(spark, sf).select("event_id", "hash").orderBy(F.desc("event_id")).limit(25)


BENIGN = f"SELECT * FROM labels_ WHERE intended_transfer AND NOT ({POISON}) AND NOT payoff_transfer AND NOT payoff_transfer_unconfirmed"
DRAW = "(CAST('0x' || left(sha256({} || ':{}'), 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"
WANTED = f"SELECT greatest(200, CAST(floor(count(*) * 0.35::DOUBLE) AS BIGINT)) n FROM labels_ WHERE {POISON}"


def benign(spark, sf):
    """The benign rows, and how many of them go with the poisoning ones: 35 % as many, 200 at least."""
    rows = fx.label_rows(spark, sf)
    poisoning = rows.filter(values.is_poisoning()).count()
    pool = rows.filter(F.col("intended_transfer") & ~values.is_poisoning() & ~F.col("payoff_transfer") & ~F.col("payoff_transfer_unconfirmed"))
    return pool, max(200, int(poisoning * 0.35))


@query("rnd1_reservoir_sample", sql(f"SELECT tx_hash FROM (SELECT tx_hash, row_number() OVER (ORDER BY {DRAW.format('tx_hash', 42)}, tx_hash) k FROM benign), wanted WHERE k <= greatest(10 * n, 2000)", "labels_", benign=BENIGN, wanted=WANTED))
def rnd1(spark, sf):
    """The pool: ten times what is wanted, 2000 at least."""
    pool, n = benign(spark, sf)
    return stats.hash_sample(pool, "tx_hash", max(10 * n, 2000)).select("tx_hash")


@query("rnd2_benign_sample_visibility", sql(f"SELECT tx_hash, {DRAW.format('tx_hash', 43)} >= 0.1 AS visible FROM (SELECT tx_hash, row_number() OVER (ORDER BY {DRAW.format('tx_hash', 42)}, tx_hash) k FROM benign), wanted WHERE k <= n", "labels_", benign=BENIGN, wanted=WANTED))
def rnd2(spark, sf):
    pool, n = benign(spark, sf)
    return stats.hash_sample(pool, "tx_hash", n).select("tx_hash", (stats.draw("tx_hash", seed=43) >= 0.1).alias("visible"))


@query("rnd3_per_class_sample", sql(f"SELECT event_id, is_poisoning FROM ev QUALIFY row_number() OVER (PARTITION BY is_poisoning ORDER BY {DRAW.format('CAST(event_id AS VARCHAR)', 42)}, event_id) <= 300", "ev"))
def rnd3(spark, sf):
    return stats.per_class_sample(fx.events(spark, sf), "is_poisoning", "event_id", 300).select("event_id", "is_poisoning")
