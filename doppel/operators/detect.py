"""Retrieval of look-alike counterparties, scoring, ranking, and the detection methods.

A method is one plan: events paired with protected victims, candidates retrieved by a victim-keyed join, pruned per side,
restricted to active histories of other recipients, scored, and reduced to the best history of each recipient.

The flagship's theta join (prefix OR suffix) is written as an equi-join on posting lists: both sides carry the key of each
address end; what the prefix side already matched is dropped on the suffix side, so no pair comes twice and nothing is
shuffled to make it distinct. A hot victim is spread over its address keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel import config as settings
from doppel.config import DetectorConfig
from doppel.functions import address, scoring

EVENT = ("event_id", "hash", "token_address", "value", "value_normalized", "observed_at", "block_time", "victim", "lookalike")
HISTORY = ("recipient", "token", "token_symbol", "token_name", "last_seen", "observed_freq", "metadata_missing")


def pair_victims(events: DataFrame) -> DataFrame:
    """Each event with either end as the victim; events with an invalid address have none."""
    a, b = address.normalize_address("from_addr"), address.normalize_address("to_addr")
    ends = events.withColumns({"_a": a, "_b": b}).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    sides = F.array(F.struct(F.col("_a").alias("victim"), F.col("_b").alias("lookalike")), F.struct(F.col("_b").alias("victim"), F.col("_a").alias("lookalike")))
    return ends.withColumn("_s", F.explode(sides)).select(*[c for c in events.columns if c not in ("from_addr", "to_addr")], "_s.*")


def visible(events: DataFrame) -> DataFrame:
    return events.filter(F.coalesce(F.col("visible"), F.lit(True)))


def protected(cps: DataFrame) -> DataFrame:
    return cps.select("victim").distinct()


def active(cfg: DetectorConfig) -> Column:
    """Seen before the event and within the window; unknown or epoch times always are."""
    free = F.col("observed_at").isNull() | F.col("last_seen").isNull() | (F.unix_micros("last_seen") == 0)
    known = F.col("last_seen") <= F.col("observed_at")
    if cfg.window_days > 0:
        known = known & (scoring.seconds_since() <= cfg.window_days * 86400)
    return free | known


def matched(cfg: DetectorConfig) -> dict[str, Column]:
    return {"ap": address.prefix_match("lookalike", "recipient", cfg.kp), "as_": address.suffix_match("lookalike", "recipient", cfg.ks)}


def _sides(df: DataFrame, col: str, cfg: DetectorConfig, which: str) -> DataFrame:
    """Each row under the keys of its ends: a side, and one number for victim, side and end, cheap to shuffle and to sort."""
    ends = [("p", address.prefix_key(col, cfg.dp))] * ("p" in which) + [("s", address.suffix_key(col, cfg.ds))] * ("s" in which)
    keys = F.array(*(F.struct(F.lit(side).alias("side"), F.xxhash64("victim", F.lit(side), end).alias("key")) for side, end in ends))
    return df.withColumn("_k", F.explode(keys)).select(*df.columns, "_k.*")


def by_posting_list(pairs: DataFrame, cps: DataFrame, cfg: DetectorConfig, which: str = "ps") -> DataFrame:
    """Pairs and histories that share the first dp digits ('p') or the last ds ('s'), each once. What only shares a number is told by victim and digits."""
    narrow = lambda df, *names: df.withColumns({c: address.pack(c) for c in names})
    left = narrow(_sides(pairs, "lookalike", cfg, which), "victim", "lookalike")
    right = narrow(_sides(cps, "recipient", cfg, which), "victim", "recipient").withColumnsRenamed({"victim": "_victim", "side": "_side"})
    same_p = address.prefix_key("lookalike", cfg.dp) == address.prefix_key("recipient", cfg.dp)
    same_s = address.suffix_key("lookalike", cfg.ds) == address.suffix_key("recipient", cfg.ds)
    told = (F.col("victim") == F.col("_victim")) & (F.col("side") == F.col("_side"))
    once = F.when(F.col("side") == "p", same_p).otherwise(same_s & ~same_p if which == "ps" else same_s)
    got = left.join(right, "key").filter(told).withColumns({c: address.unpack(c) for c in ("victim", "lookalike", "recipient")}).filter(once).drop("side", "_side", "_victim", "key")
    return got.withColumns(matched(cfg)).withColumns({"in_p": same_p, "in_s": same_s})


def by_deepest_node(pairs: DataFrame, cps: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Histories of the recipients that share the longest prefix, or suffix, of all of the victim's recipients, expired ones too."""
    # the depths come from the compared ends alone, under numbers of 128 bits; so no history is shuffled to be compared
    ends = lambda c: {"_p": address.prefix_key(c, cfg.kp), "_s": address.suffix_key(c, cfg.ks)}
    whose = {"_v1": F.xxhash64("victim"), "_v2": F.xxhash64("victim", F.lit(1))}
    key = {"_k1": F.xxhash64("victim", *ends("lookalike").values()), "_k2": F.xxhash64(*ends("lookalike").values(), "victim")}
    named = lambda df, cols: df.select(*(c.alias(n) for n, c in cols.items()))
    theirs = named(cps, whose | {"_rp": ends("recipient")["_p"], "_rs": ends("recipient")["_s"]})
    met = named(pairs, whose | ends("lookalike") | key).join(theirs, ["_v1", "_v2"])
    depths = met.groupBy("_k1", "_k2").agg(F.max(address.prefix_match("_p", "_rp", cfg.kp)).alias("_mp"), F.max(address.suffix_match("_s", "_rs", cfg.ks)).alias("_ms")).filter("_mp > 0 or _ms > 0")
    asked = pairs.withColumns(key).join(depths, ["_k1", "_k2"]).withColumns(ends("lookalike")).withColumns({c: address.pack(c) for c in ("victim", "lookalike")})
    same_p = (F.col("_mp") > 0) & F.expr("left(_p, _mp) = left(_rp, _mp)")
    same_s = (F.col("_ms") > 0) & F.expr("right(_s, _ms) = right(_rs, _ms)")
    got = meet(asked, cps.withColumns({"_rp": ends("recipient")["_p"], "_rs": ends("recipient")["_s"]}), same_p | same_s)
    return got.withColumns(matched(cfg)).withColumns({"in_p": (F.col("_mp") > 0) & (F.col("ap") == F.col("_mp")), "in_s": (F.col("_ms") > 0) & (F.col("as_") == F.col("_ms"))}).drop("_k1", "_k2", "_p", "_s", "_rp", "_rs", "_mp", "_ms")


def by_victim(pairs: DataFrame, cps: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Every history of the victim."""
    return pairs.join(cps, "victim").withColumns(matched(cfg)).withColumns({"in_p": F.lit(True), "in_s": F.lit(True)})


def meet(pairs: DataFrame, cps: DataFrame, only: Column) -> DataFrame:
    """Every history of the victim of which `only` holds; it is asked before a row goes anywhere. `pairs` come with packed addresses, and rows go with plain ones."""
    got = pairs.join(cps.withColumns({c: address.pack(c) for c in ("victim", "recipient")}), "victim").filter(only)
    return got.withColumns({c: address.unpack(c) for c in ("victim", "lookalike", "recipient")})


def prune(rows: DataFrame, cfg: DetectorConfig, cumulative: bool = True) -> DataFrame:
    """Keeps, on each side of a pair, the recipients of highest rank where there are more than the limit.

    The rank sums, over all histories of the recipient, the uses of the node, tokens and recency; expired histories count."""
    if cfg.max_candidates_per_side <= 0:
        return rows
    ends = ("lookalike", "recipient")
    rows = rows.withColumns({c: address.pack(c) for c in ends}).repartition("event_id", "victim").withColumns({c: address.unpack(c) for c in ends})  # one shuffle for every window below
    per = Window.partitionBy("event_id", "victim", "lookalike", "recipient")
    days = scoring.seconds_since() / 86400
    pending = F.coalesce(address.normalize_token("token_address"), F.lit(""))
    points = F.when((pending != "") & (address.normalize_token("token") == pending), 1_000_000.0).when(scoring.token_score() >= 1.0, 500_000.0).otherwise(0.0)
    points = points + F.when(F.col("last_seen") <= F.col("observed_at"), 10_000.0 / (1 + days)).otherwise(0.0)
    rows = rows.withColumns({"_h": F.count(F.lit(1)).over(per), "_sum": F.sum(points).over(per), "_most": F.max("observed_freq").over(per)})
    keep = {}
    for side, depth, least in (("p", "ap", cfg.dp), ("s", "as_", cfg.ds)):
        uses = F.col("_h") * (F.col(depth) - least + 1) if cumulative else F.col("_h")
        order = [F.desc(uses + F.col("_sum")), F.desc(F.greatest(uses, F.col("_most"))), F.asc("recipient")]
        keep[f"in_{side}"] = F.col(f"in_{side}") & (F.dense_rank().over(Window.partitionBy("event_id", "victim", "lookalike", f"in_{side}").orderBy(*order)) <= cfg.max_candidates_per_side)
    return rows.withColumns(keep).drop("_h", "_sum", "_most")


def key_index(pairs: DataFrame, cps: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The index baseline: on each side recipients by depth, deepest first, then by address, up to the limit."""
    limit = cfg.max_candidates_per_side or 4096
    rows = by_posting_list(pairs, cps, cfg)
    keep = {}
    for side, depth in (("p", "ap"), ("s", "as_")):
        w = Window.partitionBy("event_id", "victim", "lookalike", f"in_{side}").orderBy(F.desc(depth), "recipient")
        keep[f"in_{side}"] = F.col(f"in_{side}") & (F.dense_rank().over(w) <= limit)
    return rows.withColumns(keep).filter("in_p or in_s")


def with_metadata(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """The pending token's metadata; of repeated addresses the last by name, symbol and decimals."""
    last = metadata.withColumn("_t", address.normalize_token("address")).groupBy("_t").agg(F.max(F.struct("name", "symbol", "decimals", "metadata_missing")).alias("m"))
    m = last.select("_t", F.col("m.symbol").alias("p_symbol"), F.col("m.name").alias("p_name"), F.col("m.metadata_missing").alias("p_missing"))
    return pairs.withColumn("_t", F.coalesce(address.normalize_token("token_address"), F.lit(""))).join(m, "_t", "left").drop("_t")


def eligible(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Active histories of recipients other than the address itself."""
    return rows.filter(wanted(cfg))


def wanted(cfg: DetectorConfig) -> Column:
    return active(cfg) & (F.col("recipient") != F.col("lookalike"))


#: What a best history carries besides the order (total down, last seen down, recipient, token).
_CARRIED = ("ap", "as_", *scoring.TERMS, "token_address", "value", "value_normalized", "observed_at", "block_time", "last_seen", "observed_freq")


def _rank() -> Column:
    return F.struct((-F.col("total")).alias("neg"), (-F.unix_micros("last_seen")).alias("age"), F.col("recipient").alias("recipient"), F.col("token").alias("token"), *(F.col(c).alias(c) for c in _CARRIED))


def best(rows: DataFrame, *keys: str) -> DataFrame:
    """The best history of each key and how many were scored, by an aggregate that combines map-side."""
    got = rows.groupBy(*keys).agg(F.min(_rank()).alias("b"), F.count(F.lit(1)).alias("n_scored"))
    return got.select(*keys, *(F.col(f"b.{c}").alias(c) for c in ("recipient", "token", *_CARRIED) if c not in keys), (-F.col("b.neg")).alias("total"), "n_scored")


@dataclass(frozen=True)
class Method:
    """How a method retrieves, decides, and changes the settings."""

    retrieve: str
    change: Callable[[DetectorConfig], DetectorConfig] = lambda c: c
    sweep: bool = True
    confirmed: bool = False


METHODS: dict[str, Method] = {
    "trie_union": Method("union"),
    "trie_legacy": Method("legacy", sweep=False),
    "confirmed_rule": Method("rule", sweep=False, confirmed=True),
    "address_only": Method("union", settings.address_only),
    "prefix_only": Method("prefix", lambda c: c.replace(address_mode="prefix_only")),
    "suffix_only": Method("suffix", lambda c: c.replace(address_mode="suffix_only")),
    "trie_intersection": Method("both"),
    "no_type": Method("union", lambda c: settings.ablate(c, "type")),
    "no_token": Method("union", lambda c: settings.ablate(c, "token")),
    "no_time": Method("union", lambda c: settings.ablate(c, "time")),
    "no_value": Method("union", lambda c: settings.ablate(c, "value")),
    "linear_scan": Method("linear", sweep=False),
    "key_index": Method("index"),
    "lsh_display": Method("lsh"),
    "lsh_graph": Method("graph"),
}


def candidates(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, retrieve: str = "union", only: Column | None = None) -> DataFrame:
    """Candidate histories of every event and victim, pruned, not yet restricted to eligible ones. The approximate retrievals can
    leave out early what `only` doesn't hold of: they search the same points, and hand on fewer rows."""
    pairs = with_metadata(pair_victims(events), metadata)
    if retrieve in ("lsh", "graph"):
        from doppel.operators import display_ann

        return display_ann.retrieve(pairs, cps, cfg, graph=retrieve == "graph", only=only)
    if retrieve == "linear":
        return by_victim(pairs, cps, cfg)
    if retrieve == "index":
        return key_index(pairs, cps, cfg)
    if retrieve == "legacy":
        return prune(by_deepest_node(pairs, cps, cfg), cfg, cumulative=False).filter("in_p or in_s")
    if retrieve == "rule":
        return by_deepest_node(pairs, cps, cfg).filter("in_p and in_s")
    if retrieve in ("prefix", "suffix"):
        return prune(by_posting_list(pairs, cps, cfg, retrieve[0]), cfg).filter(f"in_{retrieve[0]}")
    rows = prune(by_posting_list(pairs, cps, cfg), cfg)
    return rows.filter("in_p and in_s" if retrieve == "both" else "in_p or in_s")


def recipients(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, method: str = "trie_union") -> DataFrame:
    """The best history of each (event, victim, recipient), with n_scored. For the confirmed rule, `total` is null where no history passes."""
    m = METHODS.get(method, METHODS["trie_union"])
    cfg = m.change(cfg)
    rows = eligible(candidates(events, cps, metadata, cfg, m.retrieve, only=wanted(cfg)), cfg)
    if m.confirmed:
        full = {"ap": address.prefix_match("lookalike", "recipient"), "as_": address.suffix_match("lookalike", "recipient")}
        rows = rows.withColumns(full).filter((F.col("ap") >= cfg.theta_p) & (F.col("as_") >= cfg.theta_s)).withColumn("_rule", scoring.prior_rule(cfg))
        rows = scoring.scored(rows, cfg).withColumn("total", F.when(F.col("_rule"), F.col("total")))
        # histories that fail the rule are counted but can't be best
        rank = F.when(F.col("_rule"), _rank())
        keys = ("event_id", "hash", "victim", "lookalike", "recipient")
        got = rows.groupBy(*keys).agg(F.min(rank).alias("b"), F.count(F.lit(1)).alias("n_scored"))
        return got.select(*keys, *(F.col(f"b.{c}").alias(c) for c in ("token", *_CARRIED)), (-F.col("b.neg")).alias("total"), "n_scored")
    return best(scoring.scored(rows, cfg), "event_id", "hash", "victim", "lookalike", "recipient")


def alerts(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, method: str = "trie_union") -> DataFrame:
    """One alert for each recipient whose best score reaches tau (or that passes the confirmed rule). Unknown methods mean the flagship."""
    got = recipients(events, cps, metadata, cfg, method)
    if METHODS.get(method, METHODS["trie_union"]).confirmed:
        return got.filter(F.col("total").isNotNull()).withColumn("observed_at", F.col("block_time"))
    return got.filter(F.col("total") >= cfg.tau)


def max_score(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, method: str = "trie_union") -> DataFrame:
    """The best score of each event over both ends and all recipients, before any threshold."""
    if method not in METHODS or not METHODS[method].sweep:
        raise ValueError(f"no score of {method!r} without a threshold")
    rows = recipients(events, cps, metadata, cfg, method)
    rank = F.struct((-F.col("total")).alias("neg"), (-F.unix_micros("last_seen")).alias("age"), "recipient", "token", "victim", "ap", "as_", *scoring.TERMS)
    got = rows.groupBy("event_id", "hash").agg(F.min(rank).alias("b"), F.sum("n_scored").alias("n_scored"))
    return got.select("event_id", "hash", (-F.col("b.neg")).alias("total"), *(F.col(f"b.{c}").alias(c) for c in ("victim", "recipient", "token", "ap", "as_", *scoring.TERMS)), "n_scored")


def performance(events: DataFrame, cps: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, victim, candidates): a row for every protected end of an event, with the histories scored there, 0 if none."""
    pairs = pair_victims(events).join(protected(cps), "victim", "left_semi").select("event_id", "victim", "lookalike")
    scored = found.groupBy("event_id", "victim", "lookalike").agg(F.sum("n_scored").alias("n"))
    return pairs.join(scored, ["event_id", "victim", "lookalike"], "left").select("event_id", "victim", F.coalesce("n", F.lit(0)).alias("candidates"))
