"""Detector settings: defaults, validation, ablations, files and environment."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class DetectorConfig:
    window_days: int = 30
    kp: int = 6
    ks: int = 6
    theta_p: int = 4
    theta_s: int = 4
    min_prefix_depth: int = 3
    min_suffix_depth: int = 3
    max_candidates_per_side: int = 2048
    tau: float = 0.901
    lambda_sec: float = 604800.0
    weights: tuple[float, ...] = (0.30, 0.20, 0.20, 0.15, 0.15)
    score_mode: str = "logistic_lr"
    logistic_intercept: float = -3.1619704800591686
    logistic_weights: tuple[float, ...] = (-8.127027112801793, 20.659171304234917, 22.44110879456234)
    address_mode: str = "sum"
    balance_alpha: float = 0.5
    balance_gamma: float = 1.0
    gate_base: float = 0.30
    context_weights: tuple[float, ...] = (0.65, 0.35, 0.0, 0.0)
    tiny_value: float = 10.0
    delays_sec: tuple[int, ...] = (5, 15, 30)
    bootstrap: int = 10000
    runs: int = 30
    seed: int = 42

    def replace(self, **changes) -> DetectorConfig:
        return dataclasses.replace(self, **changes)

    @property
    def dp(self) -> int:
        return clamp_depth(self.min_prefix_depth, self.kp)

    @property
    def ds(self) -> int:
        return clamp_depth(self.min_suffix_depth, self.ks)

    def mode(self) -> str:
        mode = self.score_mode.strip().lower()
        if mode in ("logistic", "logistic_lr"):
            return "logistic"
        if mode in ("context_gate", "context_gated_temporal"):
            return "context_gate"
        return "address_only" if mode == "address_only" else "additive"

    def validate(self) -> DetectorConfig:
        """Raises ValueError at the first setting that can't be used."""
        checks = (
            (self.window_days > 0, "window_days must be positive"),
            (1 <= self.kp <= 40 and 1 <= self.ks <= 40, "kp and ks must be 1 to 40"),
            (0 <= self.theta_p <= self.kp and 0 <= self.theta_s <= self.ks, "theta_p and theta_s must not exceed kp and ks"),
            (0 <= self.min_prefix_depth <= self.kp and 0 <= self.min_suffix_depth <= self.ks, "least depths must not exceed kp and ks"),
            (self.max_candidates_per_side >= 0, "max_candidates_per_side must not be negative"),
            (0 <= self.tau <= 1, "tau must be 0 to 1"),
            (self.lambda_sec > 0, "lambda_sec must be positive"),
            (len(self.weights) == 5 and len(self.logistic_weights) == 3 and len(self.context_weights) == 4, "5 weights, 3 logistic and 4 context weights are needed"),
            (self.mode() != "additive" or abs(sum(self.weights) - 1) < 1e-6, "additive weights must sum to 1"),
            (self.tiny_value >= 0, "tiny_value must not be negative"),
        )
        for ok, message in checks:
            if not ok:
                raise ValueError(message)
        return self


def clamp_depth(depth: int, most: int) -> int:
    """Depths that aren't 1 to `most` mean `most`."""
    return depth if 0 < depth <= most else most


#: What a removed term is worth at its least: a transfer of a usual value, the trusted token itself.
TYPE_FLOOR, TOKEN_FLOOR = 0.25, 0.20


def ablate(config: DetectorConfig, term: str) -> DetectorConfig:
    """The settings without one term: 'type', 'token', 'time' or 'value'.

    Logistic: the term is held at its floor (time and value have none). Gate: its context weight is 0. Additive: its weight
    is 0 and the others are scaled to sum 1."""
    mode = config.mode()
    if mode == "logistic":
        w = list(config.logistic_weights)
        k, floor = {"type": (1, TYPE_FLOOR), "token": (2, TOKEN_FLOOR)}.get(term, (None, 0.0))
        if k is None:
            return config
        w[0] += floor * w[k]
        w[k] = 0.0
        return config.replace(logistic_weights=tuple(w))
    if mode == "context_gate":
        w = list(config.context_weights)
        w[{"type": 0, "token": 1, "value": 2, "time": 3}[term]] = 0.0
        return config.replace(context_weights=tuple(w))
    w = list(config.weights)
    w[{"type": 1, "token": 2, "time": 3, "value": 4}[term]] = 0.0
    total = sum(w)
    return config.replace(weights=tuple(x / total for x in w) if total else tuple(w))


def address_only(config: DetectorConfig) -> DetectorConfig:
    mode = config.mode()
    if mode == "logistic":
        w = config.logistic_weights
        return config.replace(logistic_weights=(w[0] + TYPE_FLOOR * w[1] + TOKEN_FLOOR * w[2], 0.0, 0.0))
    if mode == "context_gate":
        return config.replace(score_mode="address_only")
    return config.replace(weights=(1.0, 0.0, 0.0, 0.0, 0.0), score_mode="address_only")


def _scalar(text: str):
    text = text.strip().strip("\"'")
    if text.startswith("[") and text.endswith("]"):
        return tuple(_scalar(x) for x in text[1:-1].split(",") if x.strip())
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text)


def parse_settings(text: str) -> dict:
    """Two levels of `key: value` lines with scalars and [lists], or JSON. Comments begin with #."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    inner: dict | None = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(":")
        if line[0] not in " \t":
            inner = None
            if value.strip():
                out[key] = _scalar(value)
            else:
                inner = out.setdefault(key, {})
        elif inner is not None:
            inner[key] = _scalar(value)
    return out


def import_detector(text: str, current: DetectorConfig | None = None) -> DetectorConfig:
    """Settings from text with a `detector:` block, or bare; what it leaves out stays as it is."""
    current = current or DetectorConfig()
    found = parse_settings(text)
    found = found.get("detector", found)
    known = {f.name for f in dataclasses.fields(DetectorConfig)}
    return current.replace(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known and v is not None}).validate()


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "DETECTOR_") -> DetectorConfig:
    """Defaults, then the file, then environment variables such as DETECTOR_TAU."""
    config = import_detector(Path(path).read_text()) if path else DetectorConfig()
    environ = os.environ if environ is None else environ
    changes = {f.name: _scalar(environ[prefix + f.name.upper()]) for f in dataclasses.fields(DetectorConfig) if prefix + f.name.upper() in environ}
    return config.replace(**changes).validate()
