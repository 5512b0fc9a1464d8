"""Feature rows of events, derived features, and families of scores to compare."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.functions import address, scoring
from doppel.operators import detect, evaluate

PRESSURE_AT = 128.0


def interactions() -> dict[str, Column]:
    """Products with the address score and the two gates, from s_* and the matched digits."""
    out = {f"s_addr_x_{c}": F.col("s_addr") * F.col(f"s_{c}") for c in ("type", "token", "time", "value")}
    for name, least in (("weak", 3), ("strong", 4)):
        out[f"address_gate_{name}"] = ((F.col("matched_prefix") >= least) | (F.col("matched_suffix") >= least)).cast("int")
    return out


def feature_rows(events: DataFrame, cps: DataFrame, metadata: DataFrame, cfg: DetectorConfig, shards: int = 256) -> DataFrame:
    """The best candidate of every event (zeros where there is none), its features and splits. The score is the context gate's unless `cfg` says otherwise."""
    cfg = cfg.replace(score_mode="context_gate") if cfg.mode() == "logistic" else cfg
    best = detect.max_score(events, cps, metadata, cfg).drop("hash", "total").withColumnRenamed("victim", "b_victim")
    rows = evaluate.event_day(events).join(best, "event_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    a, b = address.normalize_address("from_addr"), address.normalize_address("to_addr")
    victim = F.coalesce("b_victim", "victim_hint")
    out = rows.select(
        F.col("hash").alias("tx_hash"), F.col("event_id").cast("string").alias("event_id"), "block_number", "day", address.shard(victim, shards).cast("int").alias("shard"), victim.alias("victim"),
        F.when(a == victim, b).otherwise(a).alias("lookalike"), F.coalesce("recipient", F.lit("")).alias("matched_recipient"), F.coalesce(F.col("is_poisoning").cast("int"), F.lit(0)).alias("label"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in scoring.TERMS), zero("ap").alias("matched_prefix"), zero("as_").alias("matched_suffix"), zero("n_scored").alias("candidates_scored"),
        F.col("recipient").isNotNull().cast("int").alias("found_candidate"),
    )
    return out.withColumns(interactions())


def split_days(rows: DataFrame, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """(train_end, val_end): the first days by which these shares of the rows have come. Cumulated over days, one row each."""
    days = rows.groupBy("day").count()
    w = Window.orderBy("day")
    cum = days.select("day", F.sum("count").over(w).alias("c"), F.sum("count").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    return cum.agg(*(F.min(F.when(F.col("c") >= F.col("n") * share, F.col("day"))).alias(name) for share, name in ((train, "train_end"), (val, "val_end"))))


def with_split_days(rows: DataFrame) -> DataFrame:
    """split_time by day."""
    out = rows.crossJoin(F.broadcast(split_days(rows)))  # one row
    time = F.when(F.col("day") <= F.col("train_end"), "train").when(F.col("day") <= F.col("val_end"), "val").otherwise("test")
    return out.withColumn("split_time", time).drop("train_end", "val_end")


def with_splits(rows: DataFrame) -> DataFrame:
    """split_time by day and split_victim by the victim's hash."""
    return with_split_days(rows).withColumn("split_victim", address.split_by_victim("victim"))


def derived() -> dict[str, Column]:
    """Columns that the variants are made of, besides s_*; names with _x_ are products."""
    p, s = F.least(F.col("matched_prefix").cast("double"), F.lit(6.0)) / 6, F.least(F.col("matched_suffix").cast("double"), F.lit(6.0)) / 6
    low, high = F.least(p, s), F.greatest(p, s)
    balance = F.when(high > 0, low / high).otherwise(0.0)
    pressure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(F.col("candidates_scored").cast("double")) / F.log1p(F.lit(PRESSURE_AT))))
    a, t, k = F.col("s_addr"), F.col("s_type"), F.col("s_token")
    least, gap = F.least(t, k), F.abs(t - k)
    out = {
        "prefix_addr": p, "suffix_addr": s, "both_addr": low, "either_addr": high, "balance_addr": balance, "prefix_suffix_gap": F.abs(p - s),
        "candidate_pressure": pressure, "context_min": least, "context_gap": gap, "type_x_token": t * k,
    }
    out |= {f"s_addr_x_{c}": a * F.col(f"s_{c}") for c in ("type", "token", "time", "value")}
    out |= {"s_addr_x_token2": a * k * k, "s_addr_x_type_token": a * t * k, "s_addr_x_context_min": a * least, "s_addr_x_context_gap": a * gap, "s_addr_x_candidate_pressure": a * pressure}
    return out | {f"{side}_x_{c}": x * F.col(f"s_{c}") for side, x in (("prefix", p), ("suffix", s), ("both", low), ("balance", balance)) for c in ("type", "token")}


#: The columns of each variant, in order.
VARIANTS: dict[str, tuple[str, ...]] = {
    "full_addr_type_token": ("s_addr", "s_addr_x_type", "s_addr_x_token"),
    "full_addr_type_token_time": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_time"),
    "full_addr_type_token_value": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_value"),
    "full_addr_type_token_time_value": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_time", "s_addr_x_value"),
    "full_context_product": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_type_token", "s_addr_x_context_min", "s_addr_x_context_gap"),
    "full_context_product_value": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_type_token", "s_addr_x_context_min", "s_addr_x_context_gap", "s_addr_x_value"),
    "full_token_quadratic_value": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_token2", "s_addr_x_type_token", "s_addr_x_value"),
    "full_hard_negative": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_time", "s_addr_x_value", "balance_addr", "both_addr", "prefix_suffix_gap", "candidate_pressure", "s_addr_x_candidate_pressure", "balance_x_type", "balance_x_token"),
    "full_hard_negative_no_candidate": ("s_addr", "s_addr_x_type", "s_addr_x_token", "s_addr_x_time", "s_addr_x_value", "balance_addr", "both_addr", "prefix_suffix_gap", "balance_x_type", "balance_x_token"),
    "full_display_addr_type_token": ("s_addr", "prefix_addr", "suffix_addr", "both_addr", "balance_addr", "s_addr_x_type", "s_addr_x_token", "prefix_x_type", "suffix_x_type", "both_x_type", "prefix_x_token", "suffix_x_token", "both_x_token"),
    "display_address_only": ("s_addr", "prefix_addr", "suffix_addr", "both_addr", "balance_addr"),
    "display_no_type": ("s_addr", "prefix_addr", "suffix_addr", "both_addr", "balance_addr", "s_addr_x_token", "prefix_x_token", "suffix_x_token", "both_x_token"),
    "display_no_token": ("s_addr", "prefix_addr", "suffix_addr", "both_addr", "balance_addr", "s_addr_x_type", "prefix_x_type", "suffix_x_type", "both_x_type"),
    "address_only": ("s_addr",),
    "no_type": ("s_addr", "s_addr_x_token"),
    "no_token": ("s_addr", "s_addr_x_type"),
    "prefix_only": ("prefix_addr", "prefix_x_type", "prefix_x_token"),
    "suffix_only": ("suffix_addr", "suffix_x_type", "suffix_x_token"),
    "type_token_without_address": ("s_type", "s_token"),
}


def variant(rows: DataFrame, name: str) -> DataFrame:
    """Rows with columns x0, x1, ... of a variant's features."""
    known = derived()
    return rows.withColumns({f"x{k}": known.get(c, F.col(c)).cast("double") for k, c in enumerate(VARIANTS[name])})


def variant_vectors(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, variant, vector): a row for each variant, in one pass."""
    known = derived()
    used = dict.fromkeys(c for cols in VARIANTS.values() for c in cols)
    vectors = F.array(*(F.struct(F.lit(n).alias("variant"), F.array(*(F.col(c).cast("double") for c in cols)).alias("vector")) for n, cols in VARIANTS.items()))
    return rows.withColumns({c: known[c] for c in used if c in known}).select(*keep, F.explode(vectors).alias("_c")).select(*keep, "_c.*")


@dataclass(frozen=True)
class ScoreSpec:
    name: str
    kind: str
    addr: str
    base: float
    weights: tuple[float, float, float, float]  # type, token, time, value


#: Context scores compared with the address score.
SCORE_SPECS = (
    ScoreSpec("ctx_gate_sum_symbolic_30", "gate", "sum", 0.30, (0.65, 0.35, 0.0, 0.0)),
    ScoreSpec("ctx_gate_sum_symbolic_30_no_type", "gate", "sum", 0.30, (0.0, 0.35, 0.0, 0.0)),
    ScoreSpec("ctx_gate_sum_symbolic_30_no_token", "gate", "sum", 0.30, (0.65, 0.0, 0.0, 0.0)),
    ScoreSpec("ctx_boost_ttv_weak", "boost", "sum", 0.0, (0.05, 0.05, 0.0, 0.025)),
    ScoreSpec("ctx_boost_ttv_mid", "boost", "sum", 0.0, (0.10, 0.10, 0.0, 0.05)),
    ScoreSpec("ctx_boost_ttv_strong", "boost", "sum", 0.0, (0.20, 0.20, 0.0, 0.10)),
    ScoreSpec("ctx_boost_tttv_weak", "boost", "sum", 0.0, (0.05, 0.05, 0.025, 0.025)),
    ScoreSpec("ctx_boost_type_only", "boost", "sum", 0.0, (0.15, 0.0, 0.0, 0.0)),
    ScoreSpec("ctx_boost_token_only", "boost", "sum", 0.0, (0.0, 0.15, 0.0, 0.0)),
    ScoreSpec("ctx_mult_ttv_weak", "multiplicative", "sum", 0.0, (0.10, 0.10, 0.0, 0.05)),
    ScoreSpec("ctx_mult_ttv_mid", "multiplicative", "sum", 0.0, (0.20, 0.20, 0.0, 0.10)),
    ScoreSpec("ctx_mult_tttv_weak", "multiplicative", "sum", 0.0, (0.10, 0.10, 0.05, 0.05)),
    ScoreSpec("ctx_gate_ttv_90", "gate", "sum", 0.90, (0.4, 0.4, 0.0, 0.2)),
    ScoreSpec("ctx_gate_ttv_85", "gate", "sum", 0.85, (0.4, 0.4, 0.0, 0.2)),
    ScoreSpec("ctx_gate_ttv_80", "gate", "sum", 0.80, (0.4, 0.4, 0.0, 0.2)),
    ScoreSpec("ctx_gate_ttv_75", "gate", "sum", 0.75, (0.4, 0.4, 0.0, 0.2)),
    ScoreSpec("ctx_gate_type_token_85", "gate", "sum", 0.85, (0.5, 0.5, 0.0, 0.0)),
    ScoreSpec("ctx_gate_token_85", "gate", "sum", 0.85, (0.0, 1.0, 0.0, 0.0)),
    ScoreSpec("ctx_gate_balanced_tuned_30", "gate", "balanced", 0.30, (0.20, 0.55, 0.0, 0.0)),
    ScoreSpec("ctx_gate_balanced_tuned_30_with_value", "gate", "balanced", 0.30, (0.20, 0.55, 0.0, 0.05)),
    ScoreSpec("ctx_gate_balanced_tuned_30_with_time", "gate", "balanced", 0.30, (0.20, 0.55, 0.20, 0.05)),
    ScoreSpec("ctx_gate_balanced_tuned_30_no_type", "gate", "balanced", 0.30, (0.0, 0.55, 0.20, 0.05)),
    ScoreSpec("ctx_gate_balanced_tuned_30_no_token", "gate", "balanced", 0.30, (0.20, 0.0, 0.20, 0.05)),
    ScoreSpec("ctx_gate_balanced_tuned_30_no_time", "gate", "balanced", 0.30, (0.20, 0.55, 0.0, 0.05)),
    ScoreSpec("ctx_gate_balanced_tuned_30_no_value", "gate", "balanced", 0.30, (0.20, 0.55, 0.20, 0.0)),
    ScoreSpec("ctx_gate_temporal_80", "gate", "sum", 0.80, (0.35, 0.35, 0.15, 0.15)),
    ScoreSpec("ctx_gate_temporal_no_type", "gate", "sum", 0.80, (0.0, 0.35, 0.15, 0.15)),
    ScoreSpec("ctx_gate_temporal_no_token", "gate", "sum", 0.80, (0.35, 0.0, 0.15, 0.15)),
    ScoreSpec("ctx_gate_temporal_no_time", "gate", "sum", 0.80, (0.35, 0.35, 0.0, 0.15)),
    ScoreSpec("ctx_gate_temporal_no_value", "gate", "sum", 0.80, (0.35, 0.35, 0.15, 0.0)),
)


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def balanced_address() -> Column:
    d = derived()
    return F.col("s_addr") * (0.5 + 0.5 * d["balance_addr"])


def family_score(spec: ScoreSpec) -> Column:
    a = balanced_address() if spec.addr == "balanced" else F.col("s_addr")
    t, k, time, v = (F.col(f"s_{c}") for c in ("type", "token", "time", "value"))
    w = spec.weights
    if spec.kind == "gate":
        total = sum(w)
        context = (w[0] * t + w[1] * k + w[2] * time * F.greatest(t, k) + w[3] * v) / total if total > 0 else F.lit(0.0)
        return _clip(a * (spec.base + (1 - spec.base) * context))
    return _clip(a * (1 + w[0] * t + w[1] * k + w[2] * time + w[3] * v))


def named_scores() -> dict[str, Column]:
    """Four baselines and the families."""
    a, t, k, time, v = (F.col(c) for c in scoring.TERMS)
    manual = (0.30, 0.20, 0.20, 0.15, 0.15)
    rest = sum(manual) - manual[3]
    out = {
        "address_only": a, "address_only_balanced": balanced_address(), "manual_full_score": sum(w * x for w, x in zip(manual, (a, t, k, time, v), strict=True)),
        "manual_no_time": sum(w / rest * x for w, x in zip((*manual[:3], 0.0, manual[4]), (a, t, k, time, v), strict=True)),
    }
    return out | {s.name: family_score(s) for s in SCORE_SPECS}


def long_scores(rows: DataFrame, scores: dict[str, Column], *keep: str) -> DataFrame:
    """(keep, name, score): one pass, a row for each score."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("score")) for n, c in scores.items()))
    return rows.withColumn("_p", F.explode(pairs)).select(*keep, "_p.name", "_p.score")


def histogram(scored: DataFrame, bins: int, *keys: str) -> DataFrame:
    """(keys, bin, pos, neg): the last grid point k / (bins - 1) at or below the score, guarded against rounding."""
    n = bins - 1
    k = F.floor(_clip(F.col("score")) * n)
    k = F.when((k + 1) / F.lit(float(n)) <= F.col("score"), k + 1).when(k / F.lit(float(n)) > F.col("score"), k - 1).otherwise(k)
    k = F.greatest(F.lit(0), F.least(F.lit(n), k)).cast("int")
    return scored.groupBy(*keys, k.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def threshold_curve(hist: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Confusion at every grid threshold that has scores, summed from the top; from `tau_from` on it is the same."""
    down = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    whole = Window.partitionBy(*keys)
    rows = hist.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "_p": F.sum("pos").over(whole), "_n": F.sum("neg").over(whole)})
    rows = rows.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp"), "tau": F.col("bin") / F.lit(float(bins - 1)), "tau_from": F.coalesce(F.lead("bin").over(down) + 1, F.lit(0)) / F.lit(float(bins - 1))})
    return rows.withColumns(evaluate.quality()).select(*keys, "tau", "tau_from", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def best_of_curve(curve: DataFrame, *keys: str) -> DataFrame:
    """The best threshold by f1, then precision and recall, then the least: empty grid points below count too."""
    w = Window.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "tau")
    return curve.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "tau").withColumnRenamed("tau_from", "tau")


@dataclass(frozen=True)
class Formula:
    """A context score under an address score: addr * (beta + (1 - beta) * context)."""

    name: str
    addr_mode: str
    alpha: float
    gamma: float
    beta: float
    w_type: float
    w_token: float
    w_value: float
    w_time: float
    time_mode: str

    @property
    def weights(self) -> tuple[float, float, float, float]:
        return self.w_type, self.w_token, self.w_value, self.w_time


#: Address scores (mode, alpha, gamma), floors, uses of time, and weights of type, token, value and time.
FORMULA_ADDRESSES = (("sum", 1.0, 1.0), ("balanced", 0.75, 1.0), ("balanced", 0.50, 1.0), ("balanced", 0.50, 2.0), ("harmonic", 1.0, 1.0), ("min", 1.0, 1.0))
FORMULA_BETAS = (0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95)
FORMULA_TIMES = ("max_type_token", "avg_type_token", "token", "raw")
FORMULA_WEIGHTS = (
    (0.35, 0.35, 0.15, 0.15),
    (0.30, 0.30, 0.10, 0.30),
    (0.25, 0.25, 0.10, 0.40),
    (0.20, 0.20, 0.10, 0.50),
    (0.15, 0.15, 0.10, 0.60),
    (0.30, 0.45, 0.10, 0.15),
    (0.45, 0.30, 0.10, 0.15),
    (0.20, 0.55, 0.05, 0.20),
    (0.55, 0.20, 0.05, 0.20),
    (0.25, 0.35, 0.05, 0.35),
    (0.35, 0.25, 0.05, 0.35),
    (0.25, 0.25, 0.25, 0.25),
    (0.50, 0.50, 0.00, 0.00),
    (0.35, 0.65, 0.00, 0.00),
    (0.65, 0.35, 0.00, 0.00),
    (0.30, 0.50, 0.00, 0.20),
    (0.50, 0.30, 0.00, 0.20),
)
#: The scores that a formula has to beat, and what is taken from it.
BASELINES = ("address_only_sum", "prefix_only", "suffix_only", "manual_additive")
ABLATIONS = ("type", "token", "value", "time")


def formula_grid() -> list[Formula]:
    """Every address score x floor x use of time x context weights."""
    return [
        Formula(f"gate_{mode}_a{alpha:.2f}_g{gamma:.1f}_b{beta:.2f}_t{time}_w{'-'.join(f'{x:.2f}' for x in w)}", mode, alpha, gamma, beta, *w, time)
        for mode, alpha, gamma in FORMULA_ADDRESSES for beta in FORMULA_BETAS for time in FORMULA_TIMES for w in FORMULA_WEIGHTS
    ]


def formula_inputs(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, label, low, high, prefix, suffix, s_*): what every formula is computed from."""
    d = derived()
    return rows.select(*keep, F.col("label").cast("int").alias("label"), d["prefix_addr"].alias("prefix"), d["suffix_addr"].alias("suffix"), *(F.col(c).cast("double").alias(c) for c in scoring.TERMS))


class Scores:
    """Formulas over one batch of rows; whatever several formulas share is computed once."""

    def __init__(self, batch) -> None:
        col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64)
        self.prefix, self.suffix = col("prefix"), col("suffix")
        self.addr, self.type, self.token, self.time, self.value = (col(f"s_{c}") for c in ("addr", "type", "token", "time", "value"))
        self.known: dict[tuple, np.ndarray] = {}

    def address(self, f: Formula) -> np.ndarray:
        key = (f.addr_mode, f.alpha, f.gamma)
        if key not in self.known:
            low, high = np.minimum(self.prefix, self.suffix), np.maximum(self.prefix, self.suffix)
            if f.addr_mode == "balanced":
                got = self.addr * (f.alpha + (1 - f.alpha) * np.divide(low, high, out=np.zeros_like(low), where=high > 0) ** f.gamma)
            elif f.addr_mode == "harmonic":
                got = np.divide(2 * low * high, low + high, out=np.zeros_like(low), where=low + high > 0)
            else:
                got = low if f.addr_mode == "min" else self.addr
            self.known[key] = got
        return self.known[key]

    def context(self, time_mode: str, w: tuple[float, float, float, float]) -> np.ndarray:
        key = (time_mode, w)
        if key not in self.known:
            share = {"max_type_token": np.maximum(self.type, self.token), "avg_type_token": (self.type + self.token) / 2, "token": self.token, "raw": 1.0}[time_mode]
            self.known[key] = np.clip((w[0] * self.type + w[1] * self.token + w[2] * self.value + w[3] * (self.time * share)) / sum(w), 0, 1)
        return self.known[key]

    def formula(self, f: Formula, without: str = "") -> np.ndarray:
        """`without` one of ABLATIONS, or "context": the address score alone."""
        w = tuple(0.0 if without in (c, "context") else x for c, x in zip(ABLATIONS, f.weights, strict=True))
        if sum(w) <= 0:
            return self.address(f)
        return np.clip(self.address(f) * (f.beta + (1 - f.beta) * self.context(f.time_mode, w)), 0, 1)

    def baseline(self, name: str) -> np.ndarray:
        plain = {"address_only_sum": self.addr, "prefix_only": self.prefix, "suffix_only": self.suffix}
        return plain[name] if name in plain else np.clip(0.30 * self.addr + 0.20 * self.type + 0.20 * self.token + 0.15 * self.time + 0.15 * self.value, 0, 1)


def formula_means(rows: DataFrame, formulas: list[Formula]) -> DataFrame:
    """(name, label, n, mean_score) of every formula: rows x formulas are computed in Arrow batches, a sum for each leaves a task."""

    def run(batches):
        total, n = np.zeros((2, len(formulas))), np.zeros(2, np.int64)
        for b in batches:
            s, positive = Scores(b), b.column(0).to_numpy(zero_copy_only=False) == 1
            for k, f in enumerate(formulas):
                score = s.formula(f)
                total[1, k] += score[positive].sum()
                total[0, k] += score[~positive].sum()
            n += [(~positive).sum(), positive.sum()]
        for label in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([f.name for f in formulas]), pa.array(np.full(len(formulas), label, np.int32)), pa.array(total[label]), pa.array(np.full(len(formulas), n[label]))], names=["name", "label", "total", "n"])

    sums = formula_inputs(rows).mapInArrow(run, "name string, label int, total double, n long").groupBy("name", "label").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select("name", "label", "n", (F.col("total") / F.col("n")).alias("mean_score"))


def counted(rows: DataFrame, jobs: list[tuple[str, Formula | None, str]], bins: int) -> DataFrame:
    """(job, bin, pos, neg): a histogram for each job (name, formula, what it goes without; without a formula a baseline's name).

    The rows aren't multiplied: a task counts them under every job and hands on counts. Scores are rounded to 9 digits first."""

    def run(batches):
        counts = np.zeros((2, len(jobs) * bins), np.int64)
        for b in batches:
            s, positive = Scores(b), b.column(0).to_numpy(zero_copy_only=False) == 1
            known: dict[tuple, np.ndarray] = {}
            for k, (_, f, without) in enumerate(jobs):
                same = (f.addr_mode, f.alpha, f.gamma) if f and without == "context" else (without,) if f is None else (f, without)
                if same not in known:
                    score = s.baseline(without) if f is None else s.formula(f, without)
                    known[same] = np.clip(np.floor(np.round(score, 9) * (bins - 1) + 1e-7).astype(np.int64), 0, bins - 1)
                for label, which in enumerate((~positive, positive)):
                    counts[label, k * bins : (k + 1) * bins] += np.bincount(known[same][which], minlength=bins)
        some = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(some), 1 << 16):
            at = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)), pa.array(counts[1, at]), pa.array(counts[0, at])], names=["job", "bin", "pos", "neg"])

    got = formula_inputs(rows).mapInArrow(run, "job int, bin int, pos long, neg long")
    return got.groupBy("job", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def best_of_jobs(rows: DataFrame, jobs: list[tuple[str, Formula | None, str]], bins: int) -> list:
    """The best threshold of each job, one row each: as many as jobs, so the driver may hold them."""
    best = best_of_curve(threshold_curve(counted(rows, jobs, bins), bins, "job"), "job").collect()
    of = {r["job"]: r for r in best}
    return [of[k] for k in range(len(jobs))] if of else []


def _measures(r) -> tuple:
    return r["tau"], r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"], r["f1"]


MEASURES = "tau double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double"


class FormulaSearch:
    """Formulas searched on the validation split; each part is computed when it is asked for.

    What the driver holds are counts of formulas, whatever the rows. Ties are broken by place in the grid."""

    PARTS = f"place int, name string, ablation string, {MEASURES}, full_margin_vs_best_ablation double"

    def __init__(self, rows: DataFrame, bins: int = 1001, split: str = "split_time", top: int = 200, report: int = 10) -> None:
        self.spark, self.bins, self.top, self.report, self.grid = rows.sparkSession, bins, top, report, formula_grid()
        self.rows = {x: rows.filter(F.col(split) == x) for x in ("val", "test")}
        self.alone = {self.address(k): f for k, f in reversed(list(enumerate(self.grid)))}

    def address(self, k: int) -> tuple:
        f = self.grid[k]
        return f.addr_mode, f.alpha, f.gamma

    def full(self, split: str, which: list[int]) -> tuple[dict, list, dict]:
        """The best thresholds of formulas, of the baselines and of the address scores alone."""
        jobs = [(self.grid[k].name, self.grid[k], "") for k in which] + [(n, None, n) for n in BASELINES] + [("", f, "context") for f in self.alone.values()]
        found = best_of_jobs(self.rows[split], jobs, self.bins)
        if not found:
            return {}, [], {}
        rest = found[len(which) :]
        return dict(zip(which, found, strict=False)), rest[: len(BASELINES)], dict(zip(self.alone, rest[len(BASELINES) :], strict=True))

    @functools.cached_property
    def validated(self) -> tuple[dict, list, dict]:
        return self.full("val", list(range(len(self.grid))))

    @functools.cached_property
    def margins(self) -> list[tuple]:
        found, base, same = self.validated
        if not found:
            return []
        ceiling = max(r["f1"] for r in base)
        out = []
        for k, f in enumerate(self.grid):
            own, f1 = same[self.address(k)]["f1"], found[k]["f1"]
            out.append((k, f.name, *_measures(found[k]), own, f1 - ceiling, f1 - own, f1 - max(ceiling, own)))
        return out

    def taken_apart(self, split: str, which: list[int], full: dict, base: list, same: dict) -> list[tuple]:
        got = best_of_jobs(self.rows[split], [(self.grid[k].name, self.grid[k], c) for k in which for c in ABLATIONS], self.bins) if full else []
        out, n = [], len(ABLATIONS)
        for i, k in enumerate(which if got else ()):
            others = [("address_only_same", same[self.address(k)]), *((f"no_{c}", r) for c, r in zip(ABLATIONS, got[i * n : i * n + n], strict=True)), *zip(BASELINES, base, strict=True)]
            margin = full[k]["f1"] - max(r["f1"] for _, r in others)
            out += [(k, self.grid[k].name, name, *_measures(r), margin) for name, r in (("full", full[k]), *others)]
        return out

    @functools.cached_property
    def parts(self) -> list[tuple]:
        best = sorted(self.margins, key=lambda r: (-r[-1], -r[-2], -self.validated[0][r[0]]["f1"], r[0]))[: self.top]
        return self.taken_apart("val", [r[0] for r in best], *self.validated)

    def table(self) -> DataFrame:
        """(place, name, measures, same_address_f1, margins): every formula at its best threshold, against the best baseline, the
        address score that it uses, and the better of both (the fair ceiling)."""
        return self.spark.createDataFrame(self.margins, f"place int, name string, {MEASURES}, same_address_f1 double, margin_vs_baseline double, margin_vs_same_address double, margin_vs_fair_ceiling double")

    def ablations(self) -> DataFrame:
        """(place, name, ablation, measures, full_margin_vs_best_ablation): the `top` formulas by margin, in parts and against baselines."""
        return self.spark.createDataFrame(self.parts, self.PARTS)

    def test(self) -> DataFrame:
        """The same of the `report` best by that last margin, on the test split."""
        margin = {r[0]: r[-1] for r in self.parts}  # in the order of the parts, which sorting keeps among ties
        chosen = sorted(margin, key=lambda k: (-margin[k], -self.validated[0][k]["f1"]))[: self.report]
        return self.spark.createDataFrame(self.taken_apart("test", chosen, *self.full("test", chosen)), self.PARTS)
