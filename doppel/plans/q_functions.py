"""Scalar functions and predicates (F, P) over the derived tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.functions import address, scoring, values
from doppel.operators import detect, evaluate, features
from doppel.plans import fixture as fx
from doppel.plans import sqlparts as sp
from doppel.operators import display_ann
from doppel.plans.registry import query
from doppel.plans.sqlparts import sql

CFG = DetectorConfig()
r9 = lambda c: F.round(c, 9)


def messy(spark, sf):
    """Addresses in various spellings."""
    k = F.col("o_orderkey")
    a = fx.address("acct", F.col("o_custkey"))
    text = F.when(k % 6 == 0, F.concat(F.lit(" 0x"), F.upper(a), F.lit(" "))).when(k % 6 == 1, a).when(k % 6 == 2, F.concat(F.lit("0X"), a)).when(k % 6 == 3, F.left(a, F.lit(39))).when(k % 6 == 4, F.concat(F.lit("0x"), F.left(a, F.lit(39)), F.lit("g"))).otherwise(F.lit(None))
    return fx.table(spark, sf, "orders").select(k.alias("k"), text.alias("raw"))


MESSY = f"SELECT o_orderkey k, CASE o_orderkey % 6 WHEN 0 THEN ' 0x' || upper(a) || ' ' WHEN 1 THEN a WHEN 2 THEN '0X' || a WHEN 3 THEN left(a, 39) WHEN 4 THEN '0x' || left(a, 39) || 'g' END raw FROM (SELECT *, {sp.addr('acct', 'o_custkey')} a FROM orders)"


@query("f1_normalize_address", sql("SELECT k, nullif(regexp_extract(lower(trim(raw)), '^(?:0x)?([0-9a-f]{40})$', 1), '') addr FROM messy", messy=MESSY))
def f1(spark, sf):
    return messy(spark, sf).select("k", address.normalize_address("raw").alias("addr"))


@query("f2_normalize_token", sql("SELECT k, regexp_replace(lower(trim(raw)), '^0x', '') token FROM messy", messy=MESSY))
def f2(spark, sf):
    return messy(spark, sf).select("k", address.normalize_token("raw").alias("token"))


def look(spark, sf):
    return fx.base_events(spark, sf)


@query("f3_prefix_match", sql("SELECT k, CAST(list_sum(list_transform(range(1, 41), lambda d: (left(lookalike, d) = left(r0, d))::INT)) AS INTEGER) n FROM base", "base"))
def f3(spark, sf):
    return look(spark, sf).select("k", address.prefix_match("lookalike", "r0").alias("n"))


@query("f4_suffix_match", sql("SELECT k, CAST(list_sum(list_transform(range(1, 41), lambda d: (right(lookalike, d) = right(r0, d))::INT)) AS INTEGER) n FROM base", "base"))
def f4(spark, sf):
    return look(spark, sf).select("k", address.suffix_match("lookalike", "r0").alias("n"))


@query("f5_reverse", sql("SELECT k, reverse(lookalike) AS rev FROM base", "base"))
def f5(spark, sf):
    return look(spark, sf).select("k", F.reverse("lookalike").alias("rev"))


@query("f6_prefix_suffix_keys", sql("SELECT k, left(lookalike, 3) p3, right(lookalike, 3) s3, left(lookalike, 6) p6, right(lookalike, 40) s40, '' AS p0 FROM base", "base"))
def f6(spark, sf):
    a = "lookalike"
    return look(spark, sf).select("k", address.prefix_key(a, 3).alias("p3"), address.suffix_key(a, 3).alias("s3"), address.prefix_key(a, 6).alias("p6"), address.suffix_key(a, 50).alias("s40"), address.prefix_key(a, -1).alias("p0"))


def act(spark, sf, cfg=CFG):
    return detect.eligible(detect.candidates(fx.events(spark, sf), fx.counterparties(spark, sf), fx.metadata(spark), cfg), cfg)


KEYS = "event_id, victim, recipient, token, last_seen"
COLS = ("event_id", "victim", "recipient", "token", "last_seen")
ACT = {"cand": sp.cand(sp.UNION), "act": f"SELECT * FROM cand WHERE {sp.ACTIVE}"}


def term(name: str, expression: str, column):
    @query(name, sql(f"SELECT {KEYS}, round({expression}, 9) s FROM act", "pairs", "cps", "meta", **ACT))
    def run(spark, sf):
        return act(spark, sf).select(*COLS, r9(column()).alias("s"))


ADDITIVE = CFG.replace(score_mode="additive")
term("f8_s_addr", sp.SUM_ADDR, lambda: scoring.address_score(CFG))
term("f9_mode_prefix_only", "(least(ap, 6) / 6.0::DOUBLE)", lambda: scoring.address_score(CFG.replace(address_mode="prefix_only")))
term("f9_mode_suffix_only", "(least(as_, 6) / 6.0::DOUBLE)", lambda: scoring.address_score(CFG.replace(address_mode="suffix")))
term("f9_mode_balanced", f"CASE WHEN greatest(ap, as_) = 0 THEN 0.0 ELSE {sp.SUM_ADDR} * (0.5 + 0.5 * least(ap, as_)::DOUBLE / greatest(ap, as_)) END", lambda: scoring.address_score(CFG.replace(address_mode="balanced")))
term("f9_mode_balanced_gamma2", f"CASE WHEN greatest(ap, as_) = 0 THEN 0.0 ELSE {sp.SUM_ADDR} * (0.25 + 0.75 * pow(least(ap, as_)::DOUBLE / greatest(ap, as_), 2)) END", lambda: scoring.address_score(CFG.replace(address_mode="balance", balance_alpha=0.25, balance_gamma=2.0)))
term("f10_s_type", sp.S_TYPE, lambda: scoring.type_score(CFG))
term("f11_s_token", sp.S_TOKEN, scoring.token_score)
term("f12_s_time", sp.S_TIME, lambda: scoring.time_score(ADDITIVE))
term("f13_s_value", sp.S_VALUE, lambda: scoring.value_score(ADDITIVE))
term("f18_prior_rule", f"({sp.V} = 0 OR ({sp.V} > 0 AND {sp.V} <= 10) OR {sp.S_TOKEN} >= 1.0)::INT", lambda: scoring.prior_rule(CFG).cast("int"))
term("f19_normalized_value", sp.V, scoring.normalized_value)


def total(name: str, cfg: DetectorConfig, expression: str, timed: bool):
    @query(name, sql(f"SELECT {KEYS}, round(total, 9) total FROM sc", "pairs", "cps", "meta", **ACT, sc=sp.scored(expression, timed=timed)))
    def run(spark, sf):
        return scoring.scored(act(spark, sf, cfg), cfg).select(*COLS, r9("total").alias("total"))


total("f14_total_additive", ADDITIVE, sp.ADDITIVE, True)
total("f15_total_context_gate", CFG.replace(score_mode="context_gate"), sp.GATE, True)
total("f15_total_context_gate_temporal", CFG.replace(score_mode="context_gated_temporal", gate_base=0.8, context_weights=(0.35, 0.35, 0.15, 0.15)), "(s_addr * (0.8 + 0.2 * least(1.0, greatest(0.0, (0.35 * s_type + 0.35 * s_token + 0.15 * s_value + 0.15 * s_time * greatest(s_type, s_token)) / 1.0))))", True)
total("f16_total_logistic", CFG, sp.logistic(), False)
total("f17_total_address_only", CFG.replace(score_mode="address_only"), "s_addr", True)


@query("f20_reason", sql("SELECT event_id, recipient, printf('prefix=%d suffix=%d score=%.3f token=%s trusted_token=%s value=%.6f at=%s', ap, as_, total, token_address, token, " + sp.V + ", strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ')) reason FROM best WHERE rn = 1 AND total >= 0.901", "pairs", "cps", "meta", **sp.alert_ctes()))
def f20(spark, sf):
    return detect.alerts(fx.events(spark, sf), fx.counterparties(spark, sf), fx.metadata(spark), CFG).select("event_id", "recipient", scoring.reason().alias("reason"))


@query("f21_block_clock", sql("SELECT event_id, block_number, epoch_us(make_timestamp(CAST((1438214400 + 12 * block_number) * 1000000 AS BIGINT))) AS us, greatest(0, CAST(round((1438214400 + 12 * block_number - 1438214400) / 12.0) AS BIGINT)) back FROM ev", "ev"))
def f21(spark, sf):
    t = values.block_to_time("block_number")
    return fx.events(spark, sf).select("event_id", "block_number", F.unix_micros(t).alias("us"), values.time_to_block(t).alias("back"))


@query("f22_lenient_casts", """WITH r AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 't' WHEN 1 THEN ' YES ' WHEN 2 THEN 'no' WHEN 3 THEN '' WHEN 4 THEN 'nan' WHEN 5 THEN '12.75' WHEN 6 THEN '-3' WHEN 7 THEN NULL ELSE '1' END raw FROM events)
SELECT event_id, coalesce(lower(trim(raw)) IN ('t', 'true', '1', 'y', 'yes'), false) b, CASE WHEN lower(trim(raw)) = 'nan' THEN 0.0 ELSE coalesce(try_cast(trim(raw) AS DOUBLE), 0.0) END d,
CASE event_id % 9 WHEN 5 THEN 12 WHEN 6 THEN -3 WHEN 8 THEN 1 ELSE 0 END::BIGINT n FROM r""")
def f22(spark, sf):
    m = F.col("event_id") % 9
    raw = F.element_at(F.array(*(F.lit(x) for x in ("t", " YES ", "no", "", "nan", "12.75", "-3", None, "1"))), (m + 1).cast("int"))
    return fx.table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", values.to_bool("raw").alias("b"), values.to_double("raw").alias("d"), values.to_long("raw").alias("n"))


@query("f23_scale_by_decimals", sql("SELECT event_id, round(CASE WHEN d > 0 THEN amount / pow(10.0, d) ELSE amount END, 9) v FROM (SELECT event_id, amount::DOUBLE amount, (event_id % 7)::INT d FROM feed)", "feed"))
def f23(spark, sf):
    return fx.pending_feed(spark, sf).select("event_id", r9(values.scale(F.col("amount").cast("double"), (F.col("event_id") % 7).cast("int"))).alias("v"))


POISON = "(tiny_transfer OR zero_value_transfer OR counterfeit_token_transfer)"


@query("f24_label_derivations", sql(f"SELECT tx_hash, {POISON} poisoning, CASE WHEN is_sender_victim THEN from_addr ELSE to_addr END victim, CASE WHEN is_sender_victim THEN to_addr ELSE from_addr END lookalike FROM labels_", "labels_"))
def f24(spark, sf):
    s = F.col("is_sender_victim")
    return fx.label_rows(spark, sf).select("tx_hash", values.is_poisoning().alias("poisoning"), F.when(s, F.col("from_addr")).otherwise(F.col("to_addr")).alias("victim"), F.when(s, F.col("to_addr")).otherwise(F.col("from_addr")).alias("lookalike"))


@query("f25_label_class", sql("SELECT tx_hash, CASE WHEN zero_value_transfer THEN 'zero_value' WHEN tiny_transfer THEN 'tiny' WHEN counterfeit_token_transfer THEN 'counterfeit_token' WHEN intended_transfer THEN 'intended' WHEN payoff_transfer OR payoff_transfer_unconfirmed THEN 'payoff' ELSE 'other' END cls FROM labels_", "labels_"))
def f25(spark, sf):
    return fx.label_rows(spark, sf).select("tx_hash", values.label_class().alias("cls"))


@query("f26_full_label_negative", sql(f"SELECT tx_hash, intended_transfer AND NOT {POISON} AND NOT payoff_transfer AND NOT payoff_transfer_unconfirmed neg FROM labels_", "labels_"))
def f26(spark, sf):
    return fx.label_rows(spark, sf).select("tx_hash", values.is_negative().alias("neg"))


@query("f27_stable_u64")
def f27(spark, sf):
    """64 bits of BLAKE2b as a decimal string and its shard: no built-in function has it."""
    from doppel.functions.hashing import stable_u64

    return fx.events(spark, sf).select("event_id", stable_u64("hash").alias("u64")).withColumn("shard", (F.col("u64").cast("decimal(20,0)") % 256).cast("int"))


@query("f28_fast_shard", sql("SELECT victim, CAST('0x' || right(victim, 8) AS BIGINT) % 256 shard FROM (SELECT DISTINCT victim FROM cps)", "cps"))
def f28(spark, sf):
    return fx.counterparties(spark, sf).select("victim").distinct().select("victim", address.shard("victim", 256).alias("shard"))


DRAW = "(CAST(CAST('0x' || left(sha256('42|' || CAST(run_id AS VARCHAR) || '|' || printf('%.6f', loss_rate) || '|' || hash), 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


@query("f29_stable_visible", sql(f"SELECT event_id, run_id, loss_rate, loss_rate <= 0 OR {DRAW} >= loss_rate AS visible FROM ev CROSS JOIN (SELECT unnest([1, 2])::INT run_id) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) loss_rate)", "ev"))
def f29(spark, sf):
    return evaluate.replay_profiles(fx.events(spark, sf), [5], [0.0, 0.1, 0.25], 2).select("event_id", "run_id", "loss_rate", "visible")


@query("f30_split_victim", sql("SELECT victim, CASE WHEN m < 70 THEN 'train' WHEN m < 85 THEN 'val' ELSE 'test' END split FROM (SELECT victim, CAST(CAST('0x' || left(sha256(victim), 16) AS UBIGINT) % 100 AS INT) m FROM (SELECT DISTINCT victim FROM cps))", "cps"))
def f30(spark, sf):
    return fx.counterparties(spark, sf).select("victim").distinct().select("victim", address.split_by_victim("victim").alias("split"))


@query("f31_split_time", sql("SELECT event_id, CASE WHEN day <= a THEN 'train' WHEN day <= b THEN 'val' ELSE 'test' END split FROM e, (SELECT min(CASE WHEN c >= n * 0.70 THEN day END) a, min(CASE WHEN c >= n * 0.85 THEN day END) b FROM (SELECT day, sum(k) OVER (ORDER BY day) c, sum(k) OVER () n FROM (SELECT day, count(*) k FROM e GROUP BY day)))", "ev", e="SELECT event_id, strftime(block_time, '%Y-%m-%d') AS day FROM ev"))
def f31(spark, sf):
    rows = evaluate.event_day(fx.events(spark, sf)).withColumn("victim", F.col("victim_hint"))
    return features.with_splits(rows).select("event_id", F.col("split_time").alias("split"))


@query("f32_abi_decode", "SELECT event_id, CAST(event_id AS DOUBLE) n, event_type dynamic, event_type static, event_type FROM events")
def f32(spark, sf):
    """Numbers and texts as ABI words, and back."""
    e = fx.table(spark, sf, "events")
    n, text = F.lower(F.hex("event_id")), F.lower(F.hex(F.col("event_type").cast("binary")))
    word = lambda c: F.lpad(c, 64, "0")
    dynamic = F.concat(word(F.lit("20")), word(F.lower(F.hex(F.length("event_type").cast("long")))), F.rpad(text, 64, "0"))
    return e.select("event_id", values.abi_uint(word(n)).alias("n"), values.abi_string(dynamic).alias("dynamic"), values.abi_string(F.rpad(text, 64, "0")).alias("static"), "event_type")


@query("f33_transfer_calldata", sql("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN substr(from_addr, 3) END call_from, CASE WHEN event_id % 5 <= 3 THEN peer END call_to, CASE WHEN event_id % 5 <= 3 THEN lpad(lower(to_hex(amount)), 64, '0') END amount_hex FROM feed", "feed"))
def f33(spark, sf):
    return fx.pending_feed(spark, sf).withColumn("c", values.transfer_call("input")).select("event_id", F.col("c.from_addr").alias("call_from"), F.col("c.to_addr").alias("call_to"), "c.amount_hex")


@query("f34_hex_to_number", sql("SELECT event_id, amount::DOUBLE v FROM feed", "feed"))
def f34(spark, sf):
    return fx.pending_feed(spark, sf).select("event_id", values.hex_to_double(F.concat(F.lit("0x"), F.lower(F.hex("amount")))).alias("v"))


@query("f35_normalize_live_keys", sql("SELECT event_id, CASE WHEN lower(raw) LIKE '0x%' THEN lower(raw) ELSE '0x' || lower(raw) END h, '0x' || CASE WHEN ltrim(q, '0') = '' THEN '0' ELSE ltrim(q, '0') END nonce FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(substr(hash, 3)) ELSE hash END raw, lpad(lower(to_hex(nonce_seed)), 8, '0') q FROM feed)", "feed"))
def f35(spark, sf):
    feed = fx.pending_feed(spark, sf)
    raw = F.when(F.col("event_id") % 2 == 0, F.upper(F.substring("hash", 3, 64))).otherwise(F.col("hash"))
    return feed.select("event_id", values.with_0x(raw).alias("h"), values.hex_quantity(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("nonce_seed")), 8, "0"))).alias("nonce"))


@query("f36_pad_topic", sql("SELECT DISTINCT victim, lpad(victim, 64, '0') topic FROM cps", "cps"))
def f36(spark, sf):
    return fx.counterparties(spark, sf).select("victim").distinct().select("victim", address.pad_topic("victim").alias("topic"))


@query("f38_safe_div", "SELECT o_orderkey, round(CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE o_totalprice / (o_custkey % 3) END, 6) q FROM orders")
def f38(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", F.round(values.safe_div("o_totalprice", F.col("o_custkey") % 3), 6).alias("q"))


@query("f39_logit", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(1e-12, least(1 - 1e-12, l_discount * 10)) p FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(p / (1 - p)), 6) z FROM p")
def f39(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(values.logit(F.col("l_discount") * 10), 6).alias("z"))


CODE = "list_transform([1,2,3,4,5,6,35,36,37,38,39,40], lambda p: CAST('0x' || substr({}, p, 1) AS INT))"


@query("f40_display_code", sql(f"SELECT k, array_to_string({CODE.format('lookalike')}, ',') code, CAST(list_sum(list_transform(list_zip({CODE.format('lookalike')}, {CODE.format('r0')}), lambda z: (z[1] <> z[2])::INT)) AS INTEGER) differing, 12 AS ones FROM base", "base"))
def f40(spark, sf):
    code = address.display_code("lookalike")
    return look(spark, sf).select("k", F.array_join(code, ",").alias("code"), address.code_distance(code, address.display_code("r0")).alias("differing"), F.aggregate(address.one_hot(code), F.lit(0), lambda s, x: s + x).alias("ones"))


PROJECTIONS = [f"p{t}_{d}" for t in range(display_ann.TABLES) for d in range(display_ann.DIMS)]


def projection_sql() -> str:
    """The weights as literals: for each projection 12 x 16 of them."""
    w = display_ann.weights().astype(float).reshape(len(PROJECTIONS), display_ann.CODE, 16)
    digits = [f"CAST('0x' || substr(lookalike, {p}, 1) AS INT) + 1" for p in (1, 2, 3, 4, 5, 6, 35, 36, 37, 38, 39, 40)]
    cols = (" + ".join(f"[{', '.join(f'{x!r}::DOUBLE' for x in row)}][{d}]" for row, d in zip(table.tolist(), digits, strict=True)) for table in w)
    return ", ".join(f"round({c}, 4) AS {name}" for c, name in zip(cols, PROJECTIONS, strict=True))


@query("f41_random_projection", sql(f"SELECT k, {projection_sql()} FROM base", "base"))
def f41(spark, sf):
    """The 80 projections of each look-alike's code."""

    def run(batches):
        w = display_ann.weights().astype(float)
        for b in batches:
            got = display_ann.project(display_ann.codes(b.column(1).to_pylist()), w).reshape(b.num_rows, len(PROJECTIONS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in got.T)], names=["k", *PROJECTIONS])

    got = look(spark, sf).select("k", "lookalike").mapInArrow(run, "k long, " + ", ".join(f"{n} double" for n in PROJECTIONS))
    return got.select("k", *(F.round(n, 4).alias(n) for n in PROJECTIONS))


@query("p1_victim_pairs", sql("SELECT event_id, victim, lookalike FROM pairs WHERE victim IN (SELECT victim FROM cps)", "pairs", "cps"))
def p1(spark, sf):
    return detect.pair_victims(fx.events(spark, sf)).join(detect.protected(fx.counterparties(spark, sf)), "victim", "left_semi").select("event_id", "victim", "lookalike")


@query("p2_invalid_addresses", sql("SELECT k FROM messy WHERE regexp_matches(lower(trim(raw)), '^(0x)?[0-9a-f]{40}$')", messy=MESSY))
def p2(spark, sf):
    return messy(spark, sf).filter(address.normalize_address("raw").isNotNull()).select("k")


@query("p3_active_histories", sql(f"SELECT event_id, victim, recipient, token, last_seen FROM cand WHERE {sp.ACTIVE.replace('recipient <> lookalike AND ', '')}", "pairs", "cps", "meta", cand=sp.cand(sp.UNION)))
def p3(spark, sf):
    return detect.candidates(fx.events(spark, sf), fx.counterparties(spark, sf), fx.metadata(spark), CFG).filter(detect.active(CFG)).select(*COLS)


@query("p4_other_recipients", sql("SELECT event_id, victim, recipient, token, last_seen FROM cand WHERE recipient <> lookalike", "pairs", "cps", "meta", cand=sp.cand(sp.UNION)))
def p4(spark, sf):
    return detect.candidates(fx.events(spark, sf), fx.counterparties(spark, sf), fx.metadata(spark), CFG).filter("recipient <> lookalike").select(*COLS)


@query("p5_threshold", sql("SELECT event_id, victim, recipient FROM best WHERE rn = 1 AND total >= 0.901", "pairs", "cps", "meta", **sp.alert_ctes()))
def p5(spark, sf):
    return detect.alerts(fx.events(spark, sf), fx.counterparties(spark, sf), fx.metadata(spark), CFG).select("event_id", "victim", "recipient")


@query("p6_theta_gate", sql(f"SELECT event_id, victim, recipient, token, last_seen FROM act WHERE {sp.lcp('lookalike', 'recipient', 12)} >= 4 AND {sp.lcs('lookalike', 'recipient', 12)} >= 4", "pairs", "cps", "meta", **ACT))
def p6(spark, sf):
    return act(spark, sf).filter((address.prefix_match("lookalike", "recipient") >= CFG.theta_p) & (address.suffix_match("lookalike", "recipient") >= CFG.theta_s)).select(*COLS)


@query("p7_visible_events", sql("SELECT event_id FROM shown", "shown"))
def p7(spark, sf):
    return detect.visible(fx.events(spark, sf)).select("event_id")


@query("p9_calldata_filters", sql("SELECT event_id FROM feed WHERE event_id % 5 <= 3 AND peer <> '' AND substr(from_addr, 3) <> peer AND amount <> 0", "feed"))
def p9(spark, sf):
    rows = fx.pending_feed(spark, sf).withColumn("c", values.transfer_call("input")).filter(F.col("c").isNotNull())
    to, zero = F.col("c.to_addr"), F.lit("0" * 40)
    return rows.filter((to != "") & (to != zero) & (to != address.normalize_address("from_addr")) & (values.hex_to_double("c.amount_hex") != 0)).select("event_id")
