"""A corpus pipeline: each stage takes (spark, docs, sf_dir), is written as Parquet and reread as the next one's docs.

Toxic documents go; of near duplicates one document stays; passages of 200 bytes or more that occur again are cut out;
documents that hold a benchmark item go; what is left is packed into sequences. All stages but the last return the columns
of `documents`. A stage works on whatever its predecessor kept.

In every stage null and empty texts, rows without an id, repeated rows and further columns of any name are allowed, and an
empty table gives no rows; what becomes of them is said with each stage. A text is worked on whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import decontam, neardup, packing, shared, suffixes, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learnt from the labels that aren't held out.

    Null and empty texts have the score of a text without words; repeated rows go or stay together; without labels of both
    classes all rows have one score, the share of toxic labels."""
    shared.prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.fit(spark, docs, labels)
    return toxicity.score(docs, model, score_col="_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id.

    Documents without a word all stay, as do null ids whose class has no other; of rows that repeat id and text one stays."""
    shared.prepare(spark)
    return neardup.deduplicated(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur again; n_chars follows the text.

    All rows stay: equal texts of 200 bytes or more become empty, as do repeated rows; a null text becomes empty."""
    shared.prepare(spark)
    left = suffixes.remove(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; items that are null or without a word match nothing."""
    shared.prepare(spark)
    return decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), only_clean=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are one id long; repeated rows are packed each; ties along the curve are broken by a hash."""
    shared.prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("neardup", drop_near_duplicates),
    ("suffixes", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of `sf_dir`."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return docs
