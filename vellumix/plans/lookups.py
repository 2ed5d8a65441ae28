"""Joins, reconciliation, set operations, aggregates and order (D, E, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, reconcile, sets
from .registry import query

TITLE, H1 = "<title>([^<]*)</title>", "<h1>([^<]*)</h1>"


def _tags(t, pattern: str):
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return t("pages").select("page_id", F.explode(F.array_distinct(found)).alias("element"))


_SETS = f"""a AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{TITLE}', 1))) AS element FROM pages),
b AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{H1}', 1))) AS element FROM pages)"""


@query("D01 D02 D25 E05", f"""WITH {_SETS} SELECT page_id, element, CASE WHEN a.element IS NULL THEN 'missing_title' WHEN b.element IS NULL THEN 'missing_h1' ELSE 'both' END AS status
FROM a FULL JOIN b USING (page_id, element)""")
def reconcile_title_h1(t, _):
    return reconcile.reconcile(_tags(t, TITLE), _tags(t, H1), ["page_id", "element"], ("title", "h1"))


@query("D01 D02 H05 G01", """SELECT k AS module, CASE WHEN c IS NULL THEN 'missing_customer' WHEN s IS NULL THEN 'missing_supplier' ELSE 'both' END AS status
FROM (SELECT DISTINCT c_nationkey AS k, 1 AS c FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey AS k, 1 AS s FROM supplier) USING (k)""")
def reconcile_modules(t, _):
    a = t("customer").select(F.col("c_nationkey").alias("module"))
    return reconcile.reconcile(a, t("supplier").select(F.col("s_nationkey").alias("module")), ["module"], ("customer", "supplier"))


@query("D03 A03", """WITH w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)"', 1)) AS image FROM pages), h AS (SELECT DISTINCT page_id, unnest(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ')) AS image FROM pages)
SELECT CASE WHEN w.image IS NULL THEN 'missing_nav' WHEN h.image IS NULL THEN 'missing_title' ELSE 'both' END AS status, count(*) AS n FROM w FULL JOIN h USING (page_id, image) GROUP BY 1""")
def reconcile_images(t, _):
    pages = t("pages")
    nav = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)"'), F.lit(1))).alias("image"))
    title = pages.select("page_id", F.explode(F.split(F.regexp_extract("html", TITLE, 1), " ")).alias("image"))
    return reconcile.reconcile(nav, title, ["page_id", "image"], ("nav", "title")).groupBy("status").agg(F.count("*").alias("n"))


_COMPARE = f"""WITH {_SETS}, m AS (SELECT page_id, element, a.element IS NOT NULL AS l, b.element IS NOT NULL AS r FROM a FULL JOIN b USING (page_id, element)),
c AS (SELECT page_id, count(*) FILTER (l) AS n_left, count(*) FILTER (r) AS n_right, coalesce(string_agg(element, ',' ORDER BY element) FILTER (NOT r), '') AS only_left,
coalesce(string_agg(element, ',' ORDER BY element) FILTER (NOT l), '') AS only_right, bool_and(l AND r) AS equal FROM m GROUP BY page_id)"""
_COMPARE = _COMPARE.replace("SELECT page_id, element, a.element IS NOT NULL AS l, b.element IS NOT NULL AS r FROM a FULL JOIN b USING (page_id, element)", "SELECT page_id, element, bool_or(s = 1) AS l, bool_or(s = 2) AS r FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL")


@query("D25 E04 E05 E06 M11 M12", f"{_COMPARE} SELECT * FROM c")
def compare_member_sets(t, _):
    return reconcile.compare_sets(_tags(t, TITLE), _tags(t, H1), ["page_id"], "element")


@query("E03 M13", f"""{_COMPARE} SELECT count(*) AS n_pages, count(*) FILTER (NOT equal) AS n_different, CAST(sum(CASE WHEN only_left = '' THEN 0 ELSE len(string_split(only_left, ',')) END) AS BIGINT) AS n_only_left,
CAST(sum(CASE WHEN only_right = '' THEN 0 ELSE len(string_split(only_right, ',')) END) AS BIGINT) AS n_only_right FROM c""")
def consistency_roll_up(t, _):
    return reconcile.roll_up(reconcile.compare_sets(_tags(t, TITLE), _tags(t, H1), ["page_id"], "element"))


@query("D04 E15", """SELECT l_orderkey, l_linenumber, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END, ''), nullif(CASE WHEN p_size % 3 = 1 THEN p_type ELSE '' END, ''), '[]') AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def xref_lookup(t, _):
    n = F.col("p_size") % 3
    parts = t("part").select("p_partkey", F.when(n == 0, F.col("p_name")).otherwise("").alias("title"), F.when(n == 1, F.col("p_type")).otherwise("").alias("bridge"))
    return lookup.resolve(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", parts, "p_partkey", ["title", "bridge"]).select("l_orderkey", "l_linenumber", "label")


@query("D05 E11", "SELECT o_orderkey, string_agg(l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS sections FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def page_sections(t, _):
    both = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return sets.joined(both.select("o_orderkey", "l_linenumber", "l_partkey"), ["o_orderkey"], "l_linenumber", "l_partkey", " ", "sections")


@query("D07 D08 C13", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def anti_semi_join(t, _):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus")
    left = t("customer").join(orders.filter("o_totalprice > 400000"), "c_custkey", "left_anti")
    pending = orders.filter("o_orderstatus = 'P'").select("c_custkey", F.lit(True).alias("p")).distinct()
    return left.join(pending, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(False)).alias("pending"))


_PATH = "regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1)"


@query("D09 D10 D12 M14 E15", f"""WITH p AS (SELECT page_id, string_split({_PATH}, '/') AS s FROM pages), f AS (SELECT array_to_string(s[1:2], '/') AS folder, min(page_id) AS config FROM p WHERE ends_with(s[-1], '.html') GROUP BY 1
UNION ALL SELECT s[1], min(page_id) FROM p WHERE len(s) > 1 AND starts_with(s[1], 'www.') GROUP BY 1), c AS (SELECT page_id, i, array_to_string(s[1:i], '/') AS folder FROM (SELECT *, unnest(range(0, len(s))) AS i FROM p))
SELECT page_id, max_by(config, i) FILTER (config IS NOT NULL) AS config FROM c LEFT JOIN f USING (folder) GROUP BY page_id""")
def nearest_ancestor(t, _):
    p = t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*[^?#/])", 1).alias("path"))
    s = F.split("path", "/")
    two = p.filter(F.col("path").endswith(".html")).groupBy(F.array_join(F.slice(s, 1, 2), "/").alias("folder")).agg(F.min("page_id").alias("config"))
    one = p.filter((F.size(s) > 1) & F.col("path").startswith("www.")).groupBy(s[0].alias("folder")).agg(F.min("page_id").alias("config"))
    return lookup.nearest_ancestor(p, "page_id", "path", two.unionByName(one), "folder", "config")


@query("D13 D14 G03 G04 E15", "SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def candidate_first(t, _):
    return lookup.first_candidate(t("orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"], "o_orderkey")


@query("D19 D20 D21", """SELECT l_orderkey, l_linenumber, n_name AS note, CASE WHEN r_name = 'EUROPE' THEN 'bullet' ELSE 'ordered' END AS fmt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def numbering_lookup(t, _):
    """Two levels of small definitions reach the rows through one broadcast, if they are small enough for one."""
    defs = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    levels = t("supplier").join(defs, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("note"), F.when(F.col("r_name") == "EUROPE", "bullet").otherwise("ordered").alias("fmt"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(levels, "l_suppkey").select("l_orderkey", "l_linenumber", "note", "fmt")


@query("D22", """WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS parent, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS font, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END AS color FROM customer),
c AS (SELECT id, parent, font, color FROM s UNION ALL SELECT c.id, s.parent, coalesce(c.font, s.font), coalesce(c.color, s.color) FROM c JOIN s ON c.parent = s.id)
SELECT id, font, color FROM c WHERE parent IS NULL""")
def style_climb(t, _):
    c = F.col("c_custkey")
    styles = t("customer").select(
        c.alias("id"), F.when(c >= 10, F.floor(c / 10)).alias("parent"), F.when(c % 5 == 0, F.col("c_name")).alias("font"), F.when(c % 7 == 0, F.col("c_mktsegment")).alias("color")
    )
    return lookup.climb(styles, "id", "parent", ["font", "color"]).select("id", "font", "color")


@query("D17 F03 E07", """WITH a AS (SELECT l_partkey AS ref, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1) SELECT ref, row_number() OVER (ORDER BY first, ref) AS number FROM a""")
def bibliography_numbers(t, _):
    """Numbers by first appearance. A number over the whole corpus needs one order: only the distinct references, not their uses, pass through it."""
    from pyspark.sql import Window

    first = t("lineitem").groupBy(F.col("l_partkey").alias("ref")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return first.select("ref", F.row_number().over(Window.orderBy("first", "ref")).cast("long").alias("number"))


@query("H01 H02 H03 H08", """SELECT 'minus' AS op, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A')
UNION ALL SELECT 'differ', k FROM ((SELECT l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A') UNION (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R'))
UNION ALL SELECT 'union', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A')
UNION ALL SELECT 'both', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A')""")
def set_operations(t, _):
    k = F.col("l_partkey").alias("k")
    a, b = t("lineitem").filter("l_returnflag <> 'R'").select(k), t("lineitem").filter("l_returnflag <> 'A'").select(k)
    named = {"minus": sets.difference(a, b), "differ": sets.symmetric_difference(a, b), "union": sets.union_all_distinct(a, b), "both": a.intersect(b)}
    from functools import reduce

    return reduce(lambda x, y: x.unionByName(y), (d.select(F.lit(n).alias("op"), "k") for n, d in named.items()))


@query("H04 H06 C10", """WITH a AS (SELECT l_partkey AS k, 0 AS part, l_orderkey AS place FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_partkey, 1, l_orderkey FROM lineitem WHERE l_returnflag <> 'A')
SELECT k, CAST(min((part, place)).part AS INTEGER) AS part, min((part, place)).place AS place FROM (SELECT k, part, place FROM a) GROUP BY k""".replace("min((part, place)).part", "min(part)").replace("min((part, place)).place", "arg_min(place, part * 1000000000 + place)"))
def ordered_union(t, _):
    rows = t("lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_returnflag")
    return sets.ordered_union([rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag <> 'A'")], "k", "l_orderkey")


@query("G02 G04 G05 C09", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders QUALIFY pos <= 2")
def nth_of_group(t, _):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").withColumn("pos", F.row_number().over(w).cast("long")).filter("pos <= 2").select("o_custkey", "o_orderkey", "pos")


@query("E02 B08 R-V1", "SELECT coalesce(quality, -1) AS quality, count(*) AS n_total, count(*) FILTER (length(text) > 100) AS n_valid, count(*) FILTER (length(text) <= 100 AND length(text) > 0) AS n_invalid, count(*) FILTER (length(text) = 0) AS n_empty FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def validate_counters(t, _):
    n = F.length("text")
    rows = t("documents").join(t("labels"), "doc_id", "left").groupBy(F.coalesce("quality", F.lit(-1)).alias("quality"))
    return rows.agg(F.count("*").alias("n_total"), F.count_if(n > 100).alias("n_valid"), F.count_if((n <= 100) & (n > 0)).alias("n_invalid"), F.count_if(n == 0).alias("n_empty"))


@query("S02 M1", """SELECT coalesce(a.i, b.i) AS i, CASE WHEN a.i IS NULL THEN 'added' WHEN b.i IS NULL THEN 'deleted' WHEN md5(a.text) <> md5(b.text) THEN 'changed' ELSE 'same' END AS flag FROM (SELECT doc_id AS i, text FROM documents) a FULL JOIN (SELECT item_id AS i, text FROM benchmark) b ON a.i = b.i""")
def merge_flags(t, _):
    from ..operators import merge

    return merge.revision_flags(t("documents").select(F.col("doc_id").alias("i"), "text"), t("benchmark").select(F.col("item_id").alias("i"), "text"), ["i"], "text")


@query("I05 E14", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) > 1 OR count(DISTINCT o_orderstatus) = 0")
def multiple_media_guard(t, _):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("kinds")).filter("n > 1 OR kinds = 0")


