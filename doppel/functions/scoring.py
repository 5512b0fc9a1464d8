"""Scores of a candidate counterparty as columns of a candidate row.

Candidate rows have ap, as_ (matched digits), value, value_normalized, token_address, observed_at, the history's token,
token_symbol, token_name, metadata_missing, last_seen, and the pending token's p_symbol, p_name, p_missing (null: unknown).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.functions.address import normalize_token

TERMS = ("s_addr", "s_type", "s_token", "s_time", "s_value")


def normalized_value() -> Column:
    return F.when(F.coalesce(F.col("value_normalized"), F.lit(0.0)) != 0, F.col("value_normalized")).otherwise(F.col("value"))


def address_score(cfg: DetectorConfig) -> Column:
    p, s = F.least("ap", F.lit(cfg.kp)).cast("double"), F.least("as_", F.lit(cfg.ks)).cast("double")
    raw = (p + s) / (cfg.kp + cfg.ks)
    mode = cfg.address_mode.strip().lower()
    if mode in ("prefix", "prefix_only"):
        return p / cfg.kp
    if mode in ("suffix", "suffix_only"):
        return s / cfg.ks
    if mode in ("balanced", "balanced_sum", "balance"):
        alpha = cfg.balance_alpha if 0 <= cfg.balance_alpha <= 1 else 0.5
        gamma = cfg.balance_gamma if cfg.balance_gamma > 0 else 1.0
        most = F.greatest(p / cfg.kp, s / cfg.ks)
        return F.when(most <= 0, 0.0).otherwise(raw * (alpha + (1 - alpha) * F.pow(F.least(p / cfg.kp, s / cfg.ks) / most, F.lit(gamma))))
    return raw


def type_score(cfg: DetectorConfig) -> Column:
    v = normalized_value()
    return F.when(v == 0, 1.0).when((v > 0) & (v <= cfg.tiny_value), 0.8).otherwise(0.25)


def token_score() -> Column:
    pending, trusted = F.coalesce(normalize_token("token_address"), F.lit("")), F.coalesce(normalize_token("token"), F.lit(""))
    same = lambda a, b: (F.lower(F.trim(F.col(a))) == F.lower(F.trim(F.col(b)))) & (F.trim(F.col(a)) != "")
    shown = F.coalesce(same("p_symbol", "token_symbol"), F.lit(False)) | F.coalesce(same("p_name", "token_name"), F.lit(False))
    known = F.coalesce(~F.col("p_missing") & ~F.col("metadata_missing"), F.lit(False))
    return F.when((pending == "") | (trusted == ""), 0.4).when(pending == trusted, 0.2).when(known & shown, 1.0).otherwise(0.7)


def seconds_since() -> Column:
    return (F.unix_micros("observed_at") - F.unix_micros("last_seen")) / 1e6


def time_score(cfg: DetectorConfig) -> Column:
    return F.lit(0.0) if cfg.mode() == "logistic" else F.exp(-F.greatest(F.lit(0.0), seconds_since()) / cfg.lambda_sec)


def value_score(cfg: DetectorConfig) -> Column:
    if cfg.mode() == "logistic":
        return F.lit(0.0)
    v = normalized_value()
    return F.when(v == 0, 1.0).when(v <= cfg.tiny_value, 0.7).otherwise(F.greatest(F.lit(0.1), 1 / (1 + F.log10(1 + v))))


def total(cfg: DetectorConfig) -> Column:
    a, typ, token, time, value = (F.col(c) for c in TERMS)
    mode = cfg.mode()
    if mode == "logistic":
        w = cfg.logistic_weights
        return 1 / (1 + F.exp(-(cfg.logistic_intercept + w[0] * a + w[1] * a * typ + w[2] * a * token)))
    if mode == "context_gate":
        base = cfg.gate_base if 0 < cfg.gate_base < 1 else 0.30
        w = cfg.context_weights if sum(cfg.context_weights) > 0 else (0.65, 0.35, 0.0, 0.0)
        context = (w[0] * typ + w[1] * token + w[2] * value + w[3] * time * F.greatest(typ, token)) / sum(w)
        return a * (base + (1 - base) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), context)))
    if mode == "address_only":
        return a
    return sum(w * x for w, x in zip(cfg.weights, (a, typ, token, time, value), strict=True))


def scored(rows, cfg: DetectorConfig):
    """Candidate rows with the five terms and the total."""
    terms = dict(zip(TERMS, (address_score(cfg), type_score(cfg), token_score(), time_score(cfg), value_score(cfg)), strict=True))
    return rows.withColumns(terms).withColumn("total", total(cfg))


def prior_rule(cfg: DetectorConfig) -> Column:
    v = normalized_value()
    return (v == 0) | ((v > 0) & (v <= cfg.tiny_value)) | (token_score() >= 1.0)


def reason() -> Column:
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.format_string("prefix=%d suffix=%d score=%.3f token=%s trusted_token=%s value=%.6f at=%s", "ap", "as_", "total", "token_address", "token", normalized_value(), at)
