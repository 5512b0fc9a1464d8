"""Alert messages: text, and a sink that posts each micro-batch's alerts and returns receipts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message() -> Column:
    return F.format_string("look-alike transfer %s\nvictim %s\naddress %s\ntrusted %s\nscore %.3f", "hash", "victim", "lookalike", "recipient", "total")


def sink(post: Callable[[str], bool] | None) -> Callable[[DataFrame, int], list[dict]]:
    """A foreachBatch function; does nothing if `post` is None. Alerts of a micro-batch are few: they come to the driver as an iterator."""

    def run(alerts: DataFrame, epoch: int) -> list[dict]:
        receipts = []
        if post is None:
            return receipts
        for row in alerts.select("hash", message().alias("text")).toLocalIterator():
            began = time.time()
            receipts.append({"hash": row["hash"], "sent": bool(post(row["text"])), "latency_ms": (time.time() - began) * 1000, "epoch": epoch})
        return receipts

    return run
