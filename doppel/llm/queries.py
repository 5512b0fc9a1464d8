"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import ann, binpack, chat, decontam, neardup, packing, quality, shared, suffixes, toxicity, warc


def _remainder(of: int):
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    model = quality.fit(spark, docs, labels.filter(_remainder(4) != 2))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    model = toxicity.fit(spark, docs, labels.filter(_remainder(5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(shared.table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(shared.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id, count(*) OVER (PARTITION BY payload_digest) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q
"""


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove(docs, digest=True)


def op7_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each written sequence: what it holds, and checksums of its ids and positions."""
    got = binpack.write(shared.table(spark, sf_dir, "documents"), shared.fresh_path(spark, "matrices"))
    return got.select("sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "starts", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(shared.table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, md5(CAST(list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS VARCHAR)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t),
whole AS (SELECT n_turns, h, min(conv_id) AS conv_id, count(*) AS n_same FROM p WHERE pos = n_turns GROUP BY n_turns, h),
kept AS (
  SELECT * FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = w.n_turns AND p.h = w.h AND p.n_turns > p.pos))
SELECT k.conv_id, CAST((t.pos - 1) // 1024 AS INTEGER) AS part, any_value(k.n_turns) AS n_turns, any_value(k.n_same) AS n_same,
       string_agg('<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS text
FROM kept k JOIN t USING (conv_id) GROUP BY k.conv_id, (t.pos - 1) // 1024
"""

def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), F.sort_array("items").alias("item_ids"))


QUERIES = {"op1_quality": op1_quality, "op2_ann": op2_ann, "op3_neardup": op3_neardup, "op4_packing": op4_packing, "op5_warc": op5_warc, "op6_suffixes": op6_suffixes, "op7_binpack": op7_binpack, "op8_chat": op8_chat, "op9_toxicity": op9_toxicity, "op10_decontam": op10_decontam}
ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op8_chat": OP8_SQL}
