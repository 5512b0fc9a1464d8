"""What a live run leaves: CSV of events and of blocks, and a manifest with checksums."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the event file, with how numbers are written (digits; "" as they are).
EVENT_COLUMNS = {
    "observed_at": "time", "tx_hash": "", "from": "", "nonce": "", "payload_kind": "", "fetch_ok": "", "fetch_attempts": "", "fetch_latency_ms": 6, "erc20": "", "erc20_method": "",
    "detector_completed_at": "time", "detector_latency_ms": 6, "detector_latency_us": 3, "detector_latency_ns": "", "lookup_mean_ms": 6, "lookup_mean_us": 3, "lookup_mean_ns": "", "lookup_p95_ms": 6, "lookup_p95_us": 3, "lookup_p95_ns": "",
    "pending_interarrival_ms": 6, "candidates_scored": "", "alerts": "", "replacement_candidate": "", "gas": "", "gas_price": "", "max_fee_per_gas": "", "max_priority_fee_per_gas": "", "error": "",
}
#: The columns of the block file.
BLOCK_COLUMNS = {
    "observed_at": "time", "block_timestamp": "time", "block_number": "", "block_hash": "", "tx_total": "", "tx_seen_pending": "", "erc20_transfer_total": "", "erc20_transfer_seen_pending": "",
    "pending_to_block_timestamp_lead_mean_ms": 6, "pending_to_block_timestamp_lead_p50_ms": 6, "pending_to_block_timestamp_lead_p95_ms": 6, "pending_to_block_timestamp_lead_p99_ms": 6,
}


def as_written(rows: DataFrame, columns: dict) -> DataFrame:
    """The columns as texts, in order; absent ones and nulls are empty."""
    have = {c.lower() for c in rows.columns}

    def text(name: str, how):
        if name.lower() not in have:
            return F.lit("")
        c = F.col(f"`{name}`")
        if how == "time":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        elif how != "":
            c = F.format_string(f"%.{how}f", c.cast("double"))
        return F.coalesce(c.cast("string"), F.lit(""))

    return rows.select(*(text(n, how).alias(n) for n, how in columns.items()))


def write_events(rows: DataFrame, path: str, mode: str = "append") -> None:
    as_written(rows, EVENT_COLUMNS).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_blocks(rows: DataFrame, path: str, mode: str = "append") -> None:
    as_written(rows, BLOCK_COLUMNS).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of a folder's files' sums in the order of their names; each file is read by one task."""
    sums = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sum")).filter(~F.col("name").rlike("^[._]")).orderBy("name").collect()
    if len(sums) == 1:
        return sums[0]["sum"]
    return hashlib.sha256("".join(r["sum"] for r in sums).encode()).hexdigest()


def manifest(spark: SparkSession, cfg, summary: dict, files: dict[str, str], **more) -> dict:
    """What ran on what: the settings' checksum (they hold no keys), the files' checksums, and the run's summary."""
    settings = json.dumps(dataclasses.asdict(cfg) if dataclasses.is_dataclass(cfg) else cfg, sort_keys=True, default=str)
    sums, failed = {}, {}
    for name, path in files.items():
        try:
            sums[name] = checksum(spark, path)
        except Exception as e:  # a missing file is part of the report
            failed[name] = type(e).__name__
    return {"config_sha256": hashlib.sha256(settings.encode()).hexdigest(), "files": files, "sha256": sums, "sha256_errors": failed, "spark": spark.version, **summary, **more}


def write_manifest(spark: SparkSession, found: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(found, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def discover_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Runs told by their summary files (JSON objects with `metrics`), newest first; what isn't JSON is passed by."""
    files = spark.read.option("wholetext", True).text(pattern).select("value", F.col("_metadata.file_path").alias("artifacts"), F.col("_metadata.file_modification_time").alias("created_at"))
    method = F.get_json_object("value", "$.metrics.method")
    rows = files.filter(F.get_json_object("value", "$").isNotNull())
    return rows.select("created_at", F.lit("local-benchmark").alias("mode"), F.coalesce(method, F.lit("")).alias("method"), F.lit("artifact-only").alias("status"), F.col("value").alias("metrics"), "artifacts").orderBy(F.desc("created_at"), "artifacts")
