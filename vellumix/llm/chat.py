"""Chat formatting by perspective rotation: every participant of a dialogue in turn is the assistant.

For each conversation and each speaker in it, the whole dialogue is rendered with that speaker's turns as `assistant`, the
others' as `user` with their name, and turns of the role `system` as `system`, who never is a participant. `mask` lists the spans
of characters to learn, as start:end pairs joined by commas: the speaker's own words with the end mark, nothing else.

Defined results. Turns are ordered by turn, then role, then text, nulls first, so ties have one order; repeated rows are turns
that are said again. A null role is the speaker `unknown`, a null text is empty. Rows without conv_id belong to no
conversation and are left out. A conversation of system turns alone has no participant and gives no row. Markers within names or texts
are broken up (`<|` becomes `< |`) and line ends within names are blanks, so no text or name can forge a turn. Texts of any length are rendered whole. Other columns
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM, START, END = "system", "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, text and mask for every conversation and participant; one shuffle by conv_id."""
    safe: Column = lambda c, d: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(d)), F.lit("<|"), F.lit("< |"))
    name = F.regexp_replace(safe("role", "unknown"), r"[\r\n]+", " ")  # a name is one line
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"), safe("text", "").alias("words"))
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("speakers", F.collect_set("name").over(whole))
    rows = rows.withColumn("speaker", F.explode(F.filter("speakers", lambda x: x != system)))
    own = F.col("name") == F.col("speaker")
    head = F.when(own, F.lit(f"{START}assistant\n")).when(F.col("name") == system, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), "name", F.lit("\n")))
    rows = rows.select("conv_id", "speaker", "turn", "name", "words", own.alias("own"), head.alias("head"), F.concat("words", F.lit(f"{END}\n")).alias("tail"))
    order = Window.partitionBy("conv_id", "speaker").orderBy("turn", "name", "words")
    size = F.length("head") + F.length("tail")
    rows = rows.withColumn("end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("at", F.row_number().over(order))
    start = F.col("end") - F.length("tail") + 1
    span = F.when(F.col("own"), F.concat_ws(":", start.cast("string"), F.col("end").cast("string")))
    one = F.struct("at", F.concat("head", "tail").alias("s"), span.alias("m"))
    done = rows.groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(one)).alias("all"), F.count_if("own").alias("n_own"))
    return done.select("conv_id", "speaker", F.size("all").alias("n_turns"), "n_own", F.array_join(F.col("all.s"), "").alias("text"), F.array_join(F.col("all.m"), ",").alias("mask"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH a AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\\r\\n]+', ' ', 'g') AS name,
  replace(coalesce(text, ''), '<|', '< |') AS words FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, name AS speaker FROM a WHERE name <> '{SYSTEM}'),
b AS (SELECT conv_id, speaker, turn, name, words, name = speaker AS own, CASE WHEN name = speaker THEN '{START}assistant' || chr(10)
  WHEN name = '{SYSTEM}' THEN '{START}system' || chr(10) ELSE '{START}user name=' || name || chr(10) END AS head, words || '{END}' || chr(10) AS tail FROM a JOIN p USING (conv_id)),
c AS (SELECT *, row_number() OVER w AS nth, sum(length(head) + length(tail)) OVER w - 1 AS fin FROM b
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, words ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, CAST(count(*) AS INTEGER) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || tail, '' ORDER BY nth) AS text,
  coalesce(string_agg(CAST(CAST(fin - length(tail) + 1 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(fin AS BIGINT) AS VARCHAR), ',' ORDER BY nth) FILTER (own), '') AS mask
FROM c GROUP BY conv_id, speaker"""
