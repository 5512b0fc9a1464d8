"""Small results as text: tables, settings, fitted models. Only tables of a few rows come here; `most` bounds them."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame

from doppel.config import DetectorConfig
from doppel.operators.learn import Fitted


def _cells(df: DataFrame, digits: int, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return df.columns, [[text(v) for v in r] for r in rows]


def markdown(df: DataFrame, digits: int = 6, most: int = 1000) -> str:
    head, rows = _cells(df, digits, most)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def latex(df: DataFrame, digits: int = 6, most: int = 1000) -> str:
    head, rows = _cells(df, digits, most)
    clean = lambda c: c.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(map(clean, r)) + r" \\" for r in [head, *rows])
    return f"\\begin{{tabular}}{{{'l' * len(head)}}}\n{body}\n\\end{{tabular}}"


def config_text(config: DetectorConfig) -> str:
    """A `detector:` block that import_detector() reads back."""
    value = lambda v: "[" + ", ".join(map(repr, v)) + "]" if isinstance(v, tuple) else v
    return "detector:\n" + "".join(f"  {f.name}: {value(getattr(config, f.name))}\n" for f in dataclasses.fields(config))


def tau_configs(config: DetectorConfig, taus: list[float], folder: str) -> list[str]:
    """A settings file for each threshold; the names say which."""
    out = []
    for tau in taus:
        path = Path(folder) / f"tau_{tau:.6f}.yaml".replace("0.", "0p", 1)
        path.write_text(config_text(config.replace(tau=tau)))
        out.append(str(path))
    return out


def save_model(fitted: Fitted, path: str) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(fitted)))


def load_model(path: str) -> Fitted:
    got = json.loads(Path(path).read_text())
    return Fitted(tuple(got["names"]), got["intercept"], tuple(got["coefficients"]), got["threshold"])
