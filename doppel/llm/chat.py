"""Chat formatting: logged snapshots of growing conversations collapse to the maximal ones, which are then rendered.

A log that saves a conversation after each turn holds every prefix of it. A rolling hash of each turn prefix (128 bits,
the position hashed in with each turn) is compared with the full hash of every conversation: conversations that equal a
proper prefix of another leave by an anti-join, and of equal ones that of the least id stays. The rest is rendered.

Only DataFrame operations. No step needs a conversation in one task: turns are dealt by range of (conversation, turn), and
running positions and hashes are summed within a block, then over blocks. Prefixes are made distinct before the join, so
that a first turn that many share is one row. A rendered row holds at most PART_TURNS turns.

Defined results: rows without a conversation id belong to none and are left out; a null role reads "unknown", a null text
is empty; a null turn comes first; equal turn numbers are ordered by role, then by the hash of the text; repeated rows are
turns of their own; other columns are ignored; an empty table gives no rows. "<|" within a text is written "< |".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm import shared

PART_TURNS = 1024


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(_conv, _turn, _role, _t1, _t2, _block, _pos, _h1, _h2): the position (from 1) of each turn and the hashes of the prefix that it ends."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), F.xxhash64(role, text).alias("_t1"), F.xxhash64(text, role, F.lit(1)).alias("_t2")
    )
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_t1"), F.col("_t2")]
    dealt = light.repartitionByRange(F.col("_conv"), *order)
    blocks = shared.cut(dealt.withColumn("_block", F.spark_partition_id()), "turns")
    before = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_conv", "_block").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = blocks.groupBy("_conv", "_block").agg(F.count(F.lit(1)).alias("_n")).select("_conv", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = blocks.join(sizes, ["_conv", "_block"]).withColumn("_pos", F.col("_off") + F.row_number().over(within))
    placed = placed.withColumns({f"_c{i}": F.xxhash64("_pos", "_t1", "_t2", F.lit(i)) for i in (1, 2)})
    totals = placed.groupBy("_conv", "_block").agg(F.bit_xor("_c1").alias("_s1"), F.bit_xor("_c2").alias("_s2"))
    totals = totals.select("_conv", "_block", *(F.coalesce(F.bit_xor(f"_s{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in (1, 2)))
    summed = placed.withColumns({f"_x{i}": F.bit_xor(f"_c{i}").over(running) for i in (1, 2)}).join(totals, ["_conv", "_block"])
    return summed.select("_conv", "_turn", "_role", "_t1", "_t2", "_block", "_pos", *(F.col(f"_x{i}").bitwiseXOR(F.col(f"_o{i}")).alias(f"_h{i}") for i in (1, 2)))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(_conv, n_turns, n_same): conversations that are no proper prefix of another, one of each set of equal ones."""
    ends = prefixes.groupBy("_conv").agg(F.max(F.struct("_pos", "_h1", "_h2")).alias("_end"))
    whole = ends.select("_conv", "_end.*").groupBy("_pos", "_h1", "_h2").agg(F.min("_conv").alias("_conv"), F.count(F.lit(1)).alias("n_same"))
    # a prefix is proper unless it is an end: a prefix that more conversations have than end with it
    seen = prefixes.groupBy("_pos", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_seen"))
    grown = seen.join(whole.select("_pos", "_h1", "_h2", "n_same"), ["_pos", "_h1", "_h2"], "left").filter(F.col("_seen") > F.coalesce("n_same", F.lit(0)))
    return whole.join(grown.select("_pos", "_h1", "_h2"), ["_pos", "_h1", "_h2"], "left_anti").select("_conv", F.col("_pos").alias("n_turns"), "n_same")


def render(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered: id, part (from 0), n_turns and n_same of the conversation, text of the part."""
    prefixes = shared.cut(numbered(turns, id_col, turn_col, role_col, text_col), "prefixes")
    kept = maximal(prefixes)
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # texts come back by what tells a turn: equal turns of one conversation are numbered on both sides alike
    same = ["_conv", "_turn", "_role", "_t1", "_t2"]
    nth = Window.partitionBy(*same).orderBy(F.lit(0))
    places = prefixes.join(kept, "_conv").select(*same, "n_turns", "n_same", "_pos").withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy("_pos")))
    texts = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), F.xxhash64(role, text).alias("_t1"), F.xxhash64(text, role, F.lit(1)).alias("_t2"), text.alias("_text")
    ).withColumn("_nth", F.row_number().over(nth))
    a, b = places.alias("a"), texts.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "_turn" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*same, "_nth"]]
    line = F.concat(F.lit("<|im_start|>"), F.replace(F.col("b._role"), F.lit("<|"), F.lit("< |")), F.lit("\n"), F.replace(F.col("b._text"), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))
    turns_out = a.join(b, on).select(F.col("a._conv").alias("_conv"), "a.n_turns", "a.n_same", "a._pos", line.alias("_line"), F.floor((F.col("a._pos") - 1) / PART_TURNS).cast("int").alias("part"))
    parts = turns_out.groupBy("_conv", "part").agg(F.first("n_turns").alias("n_turns"), F.first("n_same").alias("n_same"), F.array_sort(F.collect_list(F.struct("_pos", "_line"))).alias("_lines"))
    return parts.select(F.col("_conv").alias(id_col), "part", "n_turns", "n_same", F.array_join(F.transform("_lines", lambda x: x["_line"]), "").alias("text"))
