"""Chat formatting with collapse of cumulative snapshots.

A log often holds a conversation again each time it grew. The rolling hash of a conversation's first n
turns is a running XOR of the turns' hashes, position included, so one window pass gives the hashes of
all prefixes. A conversation whose whole hash is among the prefixes of a longer one is taken out by an
anti-join; of equal conversations the smallest id stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(text: Column) -> Column:
    """A blank divides what could be read as a marker of turns."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), _safe(role), F.lit("\n"), _safe(text), F.lit("<|im_end|>\n"))


def format_chats(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, rendered) of every maximal conversation.

    Turns go by turn number, nulls first, ties by role and then text. A null role counts as "user", a
    null text as empty. Rows without a conversation id belong to none and are left out. Rows repeated
    within a conversation are turns of their own. Markers of turns within a role or text are written as "<| im_".
    An empty table gives no rows; extra columns are not read. A conversation's turns are ordered in one task, since
    its text is one value.
    """
    turns = df.select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where(F.col("conv").isNotNull())
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = turns.withColumn("at", F.row_number().over(order))
    so_far = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.select("conv", "at", F.xxhash64("at", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "at", "role").alias("h2"))
    rolling = hashed.select("conv", "at", F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"), F.lead("at").over(Window.partitionBy("conv").orderBy("at")).isNull().alias("last"))
    whole = rolling.where("last").groupBy("at", "p1", "p2").agg(F.min("conv").alias("conv"))
    prefixes = rolling.where("not last").select("at", "p1", "p2").distinct()
    kept = whole.join(prefixes, ["at", "p1", "p2"], "left_anti").select("conv", F.col("at").alias("n_turns"))
    parts = placed.join(kept, "conv").groupBy("conv", "n_turns").agg(F.array_sort(F.collect_list(F.struct("at", _render(F.col("role"), F.col("text")).alias("part")))).alias("parts"))
    return parts.select(F.col("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.concat_ws("", F.col("parts.part")).alias("rendered"))


#: The same rows in DuckDB's SQL over `conversations`, prefixes compared as lists.
SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos,
    '<|im_start|>' || replace(coalesce(role, 'user'), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS part,
    struct_pack(r := coalesce(role, 'user'), t := coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(part, '' ORDER BY pos) AS rendered, list(said ORDER BY pos) AS parts FROM turns GROUP BY conv_id
), prefix AS (
  SELECT DISTINCT n, parts[1:n] AS parts FROM (SELECT parts, unnest(range(1, n_turns)) AS n FROM whole)
)
SELECT min(conv_id) AS conv_id, w.n_turns, w.rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM prefix p WHERE p.n = w.n_turns AND p.parts = w.parts)
GROUP BY w.n_turns, w.rendered, w.parts
"""
