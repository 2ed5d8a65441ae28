"""Sequence operators over events (paragraphs of a user) and conversations (runs of a dialogue) (F, Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence as S
from .registry import query

W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
K, O = ["user_id"], ["ts", "event_id"]


@query("F05 O13", f"SELECT event_id, CAST(coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grp FROM events")
def group_ending_with(t, _):
    return S.group_ending_with(t("events"), K, O, F.col("event_type") == "purchase").select("event_id", "grp")


@query("F06 N23 ", "SELECT event_id, coalesce(max(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS after FROM events")
def split_at_first_block(t, _):
    return S.split_at_first(t("events"), K, O, F.col("event_type") == "purchase").select("event_id", "after")


@query("F07 F08 Q03", "SELECT event_id FROM events QUALIFY min(CAST(value < 60 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1")
def take_while(t, _):
    return S.take_while(t("events"), K, O, F.col("value") < 60).select("event_id")


@query("F09", f"SELECT event_id FROM events QUALIFY lag(event_type) {W} IS DISTINCT FROM event_type")
def skip_repeats(t, _):
    before = F.lag("event_type").over(S.window(K, O))
    return t("events").withColumn("b", before).filter(~F.col("b").eqNullSafe(F.col("event_type"))).select("event_id")


@query("F10 Q08", f"""WITH a AS (SELECT *, event_type = 'click' AS c FROM events), b AS (SELECT *, c OR coalesce((lag(c) {W}) AND (lead(c) {W}), false) AS i FROM a)
SELECT event_id, i AS inside, i AND NOT coalesce(lag(i) {W}, false) AS open, i AND NOT coalesce(lead(i) {W}, false) AS close FROM b""")
def bridged_islands(t, _):
    return S.bridged(t("events"), K, O, F.col("event_type") == "click").select("event_id", "inside", "open", "close")


@query("F10 ", f"""SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, CAST(lag(event_type) {W} IS DISTINCT FROM event_type AS INTEGER) AS n FROM events)""")
def islands_event_type(t, _):
    return S.islands(t("events"), K, O, "event_type").select("event_id", "island")


_LIST = "CASE WHEN event_type <> 'view' THEN CAST(floor(value / 50) AS INTEGER) END"


@query("F11 Q08", f"""WITH a AS (SELECT *, {_LIST} AS li, CAST(event_id % 3 AS INTEGER) AS lv FROM events), b AS (SELECT *, lag(li) {W} AS pi, lag(lv) {W} AS pv, lead(li) {W} AS ni, lead(lv) {W} AS nv FROM a)
SELECT event_id, CAST(CASE WHEN li IS NULL THEN 0 WHEN pi IS NULL OR pi <> li THEN 2 * (lv + 1) WHEN lv > pv THEN 2 * (lv - pv) ELSE 1 END AS INTEGER) AS opens,
CAST(CASE WHEN li IS NULL THEN 0 WHEN ni IS NULL OR ni <> li THEN 2 * (lv + 1) WHEN nv <= lv THEN 2 * (lv - nv) + 1 ELSE 0 END AS INTEGER) AS closes FROM b""")
def list_moves(t, _):
    rows = t("events").withColumn("li", F.when(F.col("event_type") != "view", F.floor(F.col("value") / 50).cast("int"))).withColumn("lv", (F.col("event_id") % 3).cast("int"))
    return S.list_moves(rows, K, O, "li", "lv").select("event_id", "opens", "closes")


@query("F12 P04 Q04", f"""WITH a AS (SELECT *, CAST(floor(value / 25) AS INTEGER) + 1 AS level FROM events), b AS (SELECT *, lag(level) {W} AS p FROM a) SELECT event_id, 'Heading' || level AS style, CAST(CASE WHEN level <= p THEN p - level + 1 ELSE 0 END AS INTEGER) AS closes FROM b""")
def section_moves(t, _):
    rows = t("events").withColumn("level", (F.floor(F.col("value") / 25) + 1).cast("int"))
    return S.section_moves(rows, K, O, "level").select("event_id", F.concat(F.lit("Heading"), F.col("level").cast("string")).alias("style"), "closes")


@query("F14 F15", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS item FROM events")
def segmented_regroup(t, _):
    return S.regroup(t("events"), K, O, "event_type").select("event_id", F.col("item").cast("long").alias("item"))


@query("F16 Q05 Q06", f"SELECT event_id, CASE WHEN lag(event_type) {W} = 'view' THEN 'before' WHEN lead(event_type) {W} = 'view' THEN 'after' ELSE 'none' END AS caption FROM events QUALIFY event_type = 'purchase'")
def caption_near(t, _):
    w = S.window(K, O)
    rows = t("events").withColumn("b", F.lag("event_type").over(w)).withColumn("a", F.lead("event_type").over(w)).filter("event_type = 'purchase'")
    return rows.select("event_id", F.when(F.col("b") == "view", "before").when(F.col("a") == "view", "after").otherwise("none").alias("caption"))


_FLAGS = "list_filter([CASE WHEN value > 30 THEN 'bold' END, CASE WHEN value > 60 THEN 'italic' END, CASE WHEN event_type = 'click' THEN 'code' END], lambda x: x IS NOT NULL)"


@query("F17 M10", f"""WITH a AS (SELECT *, {_FLAGS} AS f FROM events), b AS (SELECT event_id, f, coalesce(lag(f) {W}, []) AS p FROM a)
SELECT event_id, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(p, x))), ',') AS added, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(f, x))), ',') AS removed FROM b""")
def run_format_delta(t, _):
    flags = F.array_compact(F.array(F.when(F.col("value") > 30, "bold"), F.when(F.col("value") > 60, "italic"), F.when(F.col("event_type") == "click", "code")))
    rows = S.set_changes(t("events").withColumn("f", flags), K, O, "f")
    return rows.select("event_id", F.array_join(F.array_sort("added"), ",").alias("added"), F.array_join(F.array_sort("removed"), ",").alias("removed"))


@query("F18 Q12", f"""WITH a AS (SELECT *, CAST(lag(event_type) {W} IS DISTINCT FROM event_type AS INTEGER) AS n, row_number() {W} AS pos FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT user_id, event_type, min(pos) AS pos, string_agg(props, '' ORDER BY pos) AS text FROM b GROUP BY user_id, event_type, island""")
def coalesce_adjacent(t, _):
    rows = t("events").withColumn("pos", F.row_number().over(S.window(K, O)).cast("long")).select("user_id", "pos", "event_type", F.col("props").alias("text"))
    return S.coalesce_adjacent(rows, K, "pos", ["event_type"], "text").select("user_id", "event_type", "pos", "text")


@query("F19 P14", r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[ \t\r\n]+', ' ', 'g') || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN lag(s) OVER (PARTITION BY conv_id ORDER BY turn) LIKE '% ' THEN ltrim(' ' || s) ELSE ' ' || s END AS text FROM a""")
def whitespace_look_back(t, _):
    s = F.concat(F.regexp_replace("text", "[ \\t\\r\\n]+", " "), F.when(F.col("turn") % 2 == 0, " ").otherwise(""))
    rows = t("conversations").select("conv_id", "turn", s.alias("s"))
    before = F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("b", before)
    return rows.select("conv_id", "turn", F.when(F.col("b").endswith(" "), F.ltrim("s")).otherwise(F.concat(F.lit(" "), "s")).alias("text"))


@query("F20", "SELECT o_orderkey, '[' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY o_custkey) AS VARCHAR)) AS INTEGER), '0') || '/' || count(*) OVER (PARTITION BY o_custkey) || ']' AS label FROM orders")
def progress_label(t, _):
    w = Window.partitionBy("o_custkey")
    rows = t("orders").withColumn("n", F.count("*").over(w).cast("string")).withColumn("i", F.row_number().over(w.orderBy("o_orderkey")).cast("string"))
    return rows.select("o_orderkey", F.concat(F.lit("["), F.lpad("i", F.length("n"), F.lit("0")), F.lit("/"), "n", F.lit("]")).alias("label"))


@query("Q01 Q02 B10 P05", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS style, bool_or(length(props) > 0) AS has_text, count(*) AS n FROM events GROUP BY user_id")
def document_type(t, _):
    first = F.min_by("event_type", F.struct("ts", "event_id"))
    return t("events").groupBy("user_id").agg(first.alias("style"), F.bool_or(F.length("props") > 0).alias("has_text"), F.count("*").alias("n"))


@query("N23 M7 N27 A16", """SELECT doc_id, '<paragraph>' || array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '</paragraph><paragraph>') || '</paragraph>' AS xml FROM documents""")
def doc_to_paras(t, _):
    """A row is a whole document, so its paragraphs are put together within the row, without a shuffle."""
    paras = F.array_join(F.filter(F.split("text", "\n"), lambda x: x != ""), "</paragraph><paragraph>")
    return t("documents").select("doc_id", F.concat(F.lit("<paragraph>"), paras, F.lit("</paragraph>")).alias("xml"))


@query("N07 A15 E11 N19 P08", """SELECT l_orderkey, '<tableau>' || string_agg('<ligne><colonne>' || l_partkey || '</colonne><colonne>' || l_suppkey || '</colonne></ligne>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) || '</tableau>' AS xml FROM lineitem GROUP BY l_orderkey""")
def serialize_tables(t, _):
    cell = lambda c: F.concat(F.lit("<colonne>"), F.col(c).cast("string"), F.lit("</colonne>"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("<ligne>"), cell("l_partkey"), cell("l_suppkey"), F.lit("</ligne>")).alias("x"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["x"]), "").alias("x"))
    return rows.select("l_orderkey", F.concat(F.lit("<tableau>"), "x", F.lit("</tableau>")).alias("xml"))
