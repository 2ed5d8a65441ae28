"""Tree navigation, numbering, mapping and checks over trees of customers, priorities and orders (C, F, N, R, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import merge, tree
from .registry import query


def section_nodes(t):
    """One document per customer with orders: article > section (priorities) > para (orders, their days as text). Documents grow in number, not in size."""
    c, o = t("customer"), t("orders")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_custkey").cast("long").alias("doc_id"), "c_name", F.coalesce("o_orderpriority", F.lit("")).alias("part"), "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    doc = Window.partitionBy("doc_id").orderBy("part", "o_orderkey")
    rows = rows.withColumn("row", F.row_number().over(doc)).withColumn("sec", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("part")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("o_orderkey")))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "part"))).withColumn("all", F.count("*").over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("secs", F.max("sec").over(Window.partitionBy("doc_id")))
    # each order is a para and a text; before a row stand its sections (one each) and the rows before it (two each)
    at = F.col("sec") + 2 * F.col("row")  # pre of the para
    first = F.col("row") - F.col("k")  # rows before the section
    sec_pre = F.col("sec") + 2 * first + 1
    node = lambda pre, post, parent, depth, sib, kind, local, attrs, text: F.struct(pre.cast("int").alias("pre"), post.cast("int").alias("post"), parent.cast("int").alias("parent"), F.lit(depth).alias("depth"), sib.cast("int").alias("sib"), F.lit(kind).alias("kind"), F.lit(local).alias("local"), attrs.alias("id"), text.alias("text"))
    none = F.lit(None).cast("string")
    para_post = 2 * F.col("row") + F.col("sec") - 1
    nodes = F.array(
        node(at, para_post, sec_pre, 2, F.col("k"), "elem", "para", F.col("o_orderstatus"), none),
        node(at + 1, para_post - 1, at, 3, F.lit(1), "text", "#text", none, F.col("day")),
    )
    section = F.when(F.col("k") == 1, F.array(node(sec_pre, 2 * (first + F.col("size")) + F.col("sec"), F.lit(1), 1, F.col("sec"), "elem", "section", F.col("part"), none))).otherwise(F.array().cast("array<struct<pre:int,post:int,parent:int,depth:int,sib:int,kind:string,local:string,id:string,text:string>>"))
    root = F.when(F.col("row") == 1, F.array(node(F.lit(1), 2 * F.col("all") + F.col("secs") + 1, F.lit(0), 0, F.lit(1), "elem", "article", F.col("c_name"), none))).otherwise(F.array().cast("array<struct<pre:int,post:int,parent:int,depth:int,sib:int,kind:string,local:string,id:string,text:string>>"))
    return rows.select("doc_id", F.explode(F.concat(nodes, section, root)).alias("n")).select("doc_id", "n.*")


NODES = """WITH base AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_name, coalesce(o_orderpriority, '') AS part, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, o_orderkey) AS r, dense_rank() OVER (PARTITION BY doc_id ORDER BY part) AS s, row_number() OVER (PARTITION BY doc_id, part ORDER BY o_orderkey) AS k FROM base),
flat AS (SELECT doc_id, 1 AS pre, 0 AS parent, 0 AS depth, 'elem' AS kind, 'article' AS local, any_value(c_name) AS id, NULL AS text FROM numbered GROUP BY doc_id
UNION ALL SELECT doc_id, min(s + 2 * (r - k) + 1), 1, 1, 'elem', 'section', part, NULL FROM numbered GROUP BY doc_id, part
UNION ALL SELECT doc_id, s + 2 * r, s + 2 * (r - k) + 1, 2, 'elem', 'para', o_orderstatus, NULL FROM numbered
UNION ALL SELECT doc_id, s + 2 * r + 1, s + 2 * r, 3, 'text', '#text', NULL, day FROM numbered),
ends AS (SELECT *, coalesce(min(pre) FILTER (depth <= 0) OVER w, 2147483647) AS e0, coalesce(min(pre) FILTER (depth <= 1) OVER w, 2147483647) AS e1, coalesce(min(pre) FILTER (depth <= 2) OVER w, 2147483647) AS e2 FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY pre ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
nodes AS (SELECT doc_id, CAST(pre AS INTEGER) AS pre, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE depth WHEN 3 THEN pre + 1 WHEN 2 THEN e2 WHEN 1 THEN e1 ELSE e0 END, depth DESC) AS INTEGER) AS post, CAST(parent AS INTEGER) AS parent, depth,
CAST(row_number() OVER (PARTITION BY doc_id, parent ORDER BY pre) AS INTEGER) AS sib, kind, local, id, text FROM ends)
"""


@query("C02 C12 C16 M4", NODES + "SELECT * FROM nodes")
def shredded_tree(t, _):
    return section_nodes(t)


@query("C01", NODES + "SELECT doc_id, pre, id FROM nodes WHERE (doc_id, parent) IN (SELECT doc_id, pre FROM nodes WHERE local = 'section' AND id LIKE '%E%')")
def child_axis(t, _):
    nodes = section_nodes(t)
    return tree.children(nodes, nodes.filter("local = 'section' AND id LIKE '%E%'")).select("doc_id", "pre", "id")


@query("C03 C18 ", NODES + "SELECT a.doc_id, a.pre, b.local AS parent_local, b.id AS parent_id FROM nodes a LEFT JOIN nodes b ON a.doc_id = b.doc_id AND a.parent = b.pre")
def parent_axis(t, _):
    return tree.parents(section_nodes(t), "local", "id").select("doc_id", "pre", "parent_local", "parent_id")


@query("C02 C04", NODES + "SELECT a.doc_id, b.pre AS top_pre, count(*) AS n FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.pre > b.pre AND a.post < b.post WHERE b.local = 'section' GROUP BY ALL")
def descendant_axis(t, _):
    nodes = section_nodes(t)
    return tree.descendants(nodes, nodes.filter("local = 'section'")).groupBy("doc_id", "top_pre").agg(F.count("*").alias("n"))


@query("C04", NODES + "SELECT doc_id, pre, EXISTS (SELECT 1 FROM nodes b WHERE b.doc_id = a.doc_id AND b.local = 'section' AND b.sib = 1 AND a.pre > b.pre AND a.post < b.post) AS inside FROM nodes a")
def ancestor_axis(t, _):
    return tree.inside(section_nodes(t), (F.col("local") == "section") & (F.col("sib") == 1)).select("doc_id", "pre", "inside")


@query("C05 F21 ", NODES + "SELECT doc_id, pre, lag(id) OVER (PARTITION BY doc_id, parent ORDER BY pre) AS before FROM nodes WHERE local = 'para' QUALIFY before IS DISTINCT FROM id")
def preceding_sibling_axis(t, _):
    rows = section_nodes(t).filter("local = 'para'").withColumn("before", tree.preceding_sibling("id"))
    return rows.filter(~F.col("before").eqNullSafe(F.col("id"))).select("doc_id", "pre", "before")


@query("C06 F08", NODES + "SELECT doc_id, pre FROM nodes a WHERE EXISTS (SELECT 1 FROM nodes b WHERE a.doc_id = b.doc_id AND a.parent = b.parent AND a.pre > b.pre AND b.id = 'F')")
def following_sibling_axis(t, _):
    nodes = section_nodes(t)
    return tree.following_siblings(nodes, nodes.filter("id = 'F'")).select("doc_id", "pre")


@query("C07 F04 ", NODES + "SELECT doc_id, pre, count(*) FILTER (id = 'F') OVER (PARTITION BY doc_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM nodes")
def count_preceding_axis(t, _):
    return section_nodes(t).select("doc_id", "pre", tree.count_preceding(F.col("id") == "F").alias("n"))


@query("C09 F01", NODES + "SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id, parent, local ORDER BY pre) AS position, count(*) OVER (PARTITION BY doc_id, parent, local) AS last FROM nodes")
def position_last(t, _):
    return tree.positions(section_nodes(t)).select("doc_id", "pre", F.col("position").cast("long").alias("position"), "last")


@query("C11 E11", NODES + "SELECT b.doc_id, b.pre, string_agg(a.text, '' ORDER BY a.pre) AS value FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND a.pre > b.pre AND a.post < b.post WHERE b.local = 'section' AND a.kind = 'text' AND a.text IS NOT NULL GROUP BY ALL")
def string_values(t, _):
    nodes = section_nodes(t)
    return tree.string_value(nodes, nodes.filter("local = 'section'"))


@query("F02 N17 N09 K01", """WITH a AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, dense_rank() OVER (ORDER BY n_regionkey) AS x, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS y, dense_rank() OVER (PARTITION BY n_regionkey, n_nationkey ORDER BY c_custkey) AS z FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c AS c_custkey, list_extract(['I','II','III','IV','V','VI','VII','VIII','IX'], x) || '.' || y || '.' || z AS number FROM a""")
def hier_numbering(t, _):
    # the first level is small: it is numbered among the regions, so no window spans all rows
    regions = t("nation").select("n_regionkey").distinct().withColumn("x", F.dense_rank().over(Window.orderBy("n_regionkey")))
    rows = t("customer").join(t("nation").join(regions, "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    plain = lambda n: n.cast("string")
    rows = tree.numbering(rows.withColumn("doc_id", F.col("n_regionkey")), ["n_nationkey", "c_custkey"], [plain, plain])
    return rows.select("c_custkey", F.concat(N.roman(F.col("x")), F.lit("."), "number").alias("number"))


#: Rules of a mapping: element, opening and closing; $id is the node's id.
RULES = [("article", "<document lang='fr'><titre>$id</titre>", "</document>"), ("section", "<section id='$id'>", "</section>"), ("para", "<paragraph>", "</paragraph>")]


@query("N02 N17 N23 M7 B17 O04", NODES + """, tok AS (SELECT doc_id, pre AS a, 0 AS b, 0 AS c, CASE local WHEN 'article' THEN '<document lang=''fr''><titre>' || id || '</titre>' WHEN 'section' THEN '<section id=''' || id || '''>' WHEN 'para' THEN '<paragraph>' ELSE coalesce(text, '') END AS t FROM nodes
UNION ALL SELECT doc_id, (SELECT max(m.pre) FROM nodes m WHERE m.doc_id = n.doc_id AND m.pre >= n.pre AND m.post <= n.post), 1, -depth, CASE local WHEN 'article' THEN '</document>' WHEN 'section' THEN '</section>' WHEN 'para' THEN '</paragraph>' ELSE '' END FROM nodes n WHERE kind = 'elem')
SELECT doc_id, md5(string_agg(t, '' ORDER BY a, b, c)) AS xml FROM tok GROUP BY doc_id""")
def mapped_documents(t, spark):
    """Rules are a small table; each node takes its rule, and one group per document puts the tokens in order."""
    rules = spark.createDataFrame(RULES, "local string, opening string, closing string")
    rows = section_nodes(t).join(rules, "local", "left")
    opening = F.replace("opening", F.lit("$id"), F.coalesce("id", F.lit("")))
    return tree.serialise(rows, F.coalesce(opening, F.lit("")), F.coalesce("closing", F.lit(""))).select("doc_id", F.md5("xml").alias("xml"))


_KEYS = NODES + """, k AS (SELECT doc_id, pre, id, CAST(depth - 1 AS VARCHAR) || '_' || count(*) FILTER (local = 'section') OVER (PARTITION BY doc_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS key, local FROM nodes)
"""


@query("S01 D06 C07", _KEYS + """SELECT a.doc_id, a.key, coalesce(a.id, b.id) AS id FROM (SELECT doc_id, key, CASE WHEN length(id) > 7 THEN NULL ELSE id END AS id FROM k WHERE local = 'section') a LEFT JOIN (SELECT doc_id, key, id FROM k WHERE local = 'section') b USING (doc_id, key)""")
def structural_merge(t, _):
    nodes = section_nodes(t)
    key = merge.structural_key(F.col("depth") - 1, tree.count_preceding(F.col("local") == "section"))
    sections = nodes.withColumn("key", key).filter("local = 'section'").select("doc_id", "key", "id")
    altered = sections.withColumn("id", F.when(F.length("id") <= 7, F.col("id")))
    return merge.merge_by_key(altered, sections, ["doc_id", "key"], ["id"]).select("doc_id", "key", "id")
