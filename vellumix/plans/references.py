"""Bibliographies, cross references, inherited classes, node kinds and module tables (N35, N38, R-C2, B19, M18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping, reconcile, tree
from ..sources import context, markup
from .constructs import HEAD
from .registry import query
from .trees import NODES, section_nodes


@query("N35 N38 D17 F03", """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), f AS (SELECT k, p, min(i) AS first FROM l GROUP BY k, p), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first) AS number FROM f)
SELECT k AS doc_id, '<document><paragraph>' || (SELECT string_agg('[' || number || ']', '' ORDER BY i) FROM l JOIN n USING (k, p) WHERE l.k = o.k) || '</paragraph><paragraph><renvoi id="b">Sources</renvoi></paragraph><section noNumber="1"><signet id="e"></signet><title>Sources</title></section></document>' AS xml FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o""".replace(
    '<section noNumber="1"><signet id="e"></signet><title>Sources</title></section>', '<section noNumber="1"><title>Sources</title><signet id="e"></signet></section>'
))
def bibliographies(t, _):
    """Each order cites its parts: numbers are by first citation; a cross reference takes its target's title."""
    cite = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit('<biblioref endterm="p'), F.col("l_partkey").cast("string"), F.lit('"/>')).alias("s"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cite)), lambda x: x["s"]), "").alias("s"))
    end = '</para><para><xref linkend="b"/></para><bibliography xml:id="b"><title>Sources</title><bibliomixed xml:id="e"/></bibliography></article>'
    docs = rows.select("l_orderkey", F.concat(F.lit(HEAD + "<para>"), "s", F.lit(end)).alias("content"))
    return mapping.to_article(context.in_context(docs, "l_orderkey", "content", dropped=mapping.DROPPED))


@query("C15 E04", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1)) AS target, unnest(regexp_extract_all(html, '<li><a href="/[^"]*">([^<]*)</a>', 1)) AS shown FROM pages)
SELECT page_id, count(DISTINCT target) AS n_left, count(DISTINCT shown) AS n_right, bool_and(target = shown) AS equal FROM a GROUP BY page_id""")
def inherited_by(t, _):
    """The targets of a page's list of links against what they show."""
    pages = t("pages")
    nodes = markup.shredded(pages, "page_id", "html", "html")
    inside = tree.inside(nodes, F.col("local") == "li").filter("local = 'a' AND inside")
    target = inside.select(F.col("doc_id").alias("page_id"), F.substring(mapping.attr("href"), F.lit(2), F.length(mapping.attr("href"))).alias("element"))
    shown = tree.string_value(nodes, inside).select(F.col("doc_id").alias("page_id"), F.col("value").alias("element"))
    return reconcile.compare_sets(target, shown, ["page_id"], "element").select("page_id", "n_left", "n_right", "equal")


@query("B19 C12", NODES + "SELECT doc_id, kind, local, count(*) AS n, count(text) AS n_text FROM nodes GROUP BY ALL")
def node_kinds(t, _):
    return section_nodes(t).groupBy("doc_id", "kind", "local").agg(F.count("*").alias("n"), F.count("text").alias("n_text"))


@query("M18 A27 D14", """SELECT n_nationkey AS module, r_name || '/' || n_name || '/' || n_name || '.conf' AS path, n_name IN ('CHINA', 'JAPAN') AS special FROM nation JOIN region ON n_regionkey = r_regionkey""")
def module_table(t, _):
    """A small dimension: modules with their places, special ones marked."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").alias("module"), F.concat_ws("/", "r_name", "n_name", F.concat("n_name", F.lit(".conf"))).alias("path"), F.col("n_name").isin("CHINA", "JAPAN").alias("special"))
