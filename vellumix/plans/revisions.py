"""Merges of two versions, and the members of classes in DocBook and HTML (S, R-C1-R-C3, B06, B07, D06-D08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import revise
from ..sources import members
from .constructs import _fill, _sql
from .registry import query

HEAD = '<article xmlns="http://docbook.org/ns/docbook">'
FIELD, METHOD = "<fieldsynopsis><varname>vP</varname></fieldsynopsis>", "<methodsynopsis><methodname>X</methodname></methodsynopsis>"
ORIGINAL = HEAD + f'<info><title>X</title><pubdate>P</pubdate></info><classsynopsis><ooclass>X</ooclass></classsynopsis><section xml:id="a"><title>A</title>{FIELD}{METHOD}<para>old</para><section><title>In</title>{METHOD}</section></section><section xml:id="b"><title>B</title></section></article>'
PROOFREAD = HEAD + '<info><title>New X</title></info><section><title>A</title><para>new P</para><section><title>In</title></section></section><bridgehead xml:id="b">B</bridgehead></article>'
MERGED = HEAD + f'<info><title>New X</title><pubdate>P</pubdate></info><classsynopsis><ooclass>X</ooclass></classsynopsis><section><title>A</title>{FIELD}{METHOD}<para>new P</para><section><title>In</title>{METHOD}</section></section><bridgehead xml:id="b">B</bridgehead></article>'
OLD = HEAD + '<section xml:id="a"><title>A</title><para>X</para></section><section xml:id="gone"><title>G</title></section><section xml:id="s"><title>S</title><para>P</para></section></article>'
NEW = HEAD + '<section xml:id="a"{a}><title>A</title><para>X, changed</para></section><section xml:id="n"{n}><title>N</title></section><section xml:id="s"><title>S</title><para>P</para></section></article>'
FLAGGED = NEW.replace("{a}", ' revisionflag="changed"').replace("{n}", ' revisionflag="added"')
TRANSLATED = HEAD + '<section xml:id="a"><title>Ah</title><para>Le X</para></section><section xml:id="s"><title>Es</title><para>Le P</para></section></article>'
UPDATED = HEAD + '<section revisionflag="deleted"><title>Ah</title><para>Le X</para></section><section xml:id="a" revisionflag="changed"><title>A</title><para>X, changed</para></section><section xml:id="n" revisionflag="added"><title>N</title></section><section xml:id="s"><title>Es</title><para>Le P</para></section></article>'


def _merged(t, original: str, altered: str, kind: str):
    rows = t("part").select("p_partkey", _fill(original).alias("o"), _fill(altered).alias("n"))
    return revise.merge_documents(rows, "p_partkey", "o", "n", kind).select("name", "content", F.array_join("problems", " ").alias("problems"))


@query("S01 D06 D07 D08", f"SELECT CAST(p_partkey AS VARCHAR) AS name, {_sql(MERGED)} AS content, 'section_became_bridgehead:b' AS problems FROM part")
def merged_after_proofreading(t, _):
    return _merged(t, ORIGINAL, PROOFREAD, "after_proofreading")


@query("S02 D06", f"SELECT CAST(p_partkey AS VARCHAR) AS name, {_sql(FLAGGED)} AS content, 'section_deleted:gone' AS problems FROM part")
def merged_update(t, _):
    return _merged(t, OLD, NEW.replace("{a}", "").replace("{n}", ""), "update")


@query("S03", f"SELECT CAST(p_partkey AS VARCHAR) AS name, {_sql(UPDATED)} AS content, '' AS problems FROM part")
def merged_translation(t, _):
    return _merged(t, TRANSLATED, FLAGGED, "update_translation")


@query("R-C3", """SELECT CAST(c_custkey AS VARCHAR) AS name, CASE c_custkey % 4 WHEN 0 THEN 'original_lacks' WHEN 1 THEN 'altered_not_docbook' WHEN 2 THEN 'original_not_well_formed' ELSE '' END AS problems FROM customer""")
def merge_preconditions(t, _):
    k = F.col("c_custkey") % 4
    rows = t("customer").select("c_custkey", F.when(k == 0, F.lit(None)).when(k == 2, "<article").otherwise(HEAD + "</article>").alias("o"), F.when(k == 1, "<html/>").otherwise(HEAD + "</article>").alias("n"))
    return revise.merge_documents(rows, "c_custkey", "o", "n", "update").select("name", F.array_join("problems", " ").alias("problems"))


#: The market segment of a customer says what kind of member of its nation's class it is.
SEGMENTS = {"AUTOMOBILE": members.TYPES, "BUILDING": members.PROPERTIES, "FURNITURE": members.FUNCTIONS, "HOUSEHOLD": members.SIGNALS, "MACHINERY": members.INHERITED}
DOCBOOK = {
    "AUTOMOBILE": "<enumsynopsis><enumname>{}</enumname></enumsynopsis><typedefsynopsis><typedefname>{}s</typedefname></typedefsynopsis>",
    "BUILDING": "<fieldsynopsis><varname>{}</varname></fieldsynopsis>",
    "FURNITURE": "<methodsynopsis><methodname>{}</methodname></methodsynopsis>",
    "HOUSEHOLD": "<methodsynopsis><modifier>signal</modifier><methodname>{}</methodname></methodsynopsis>",
    "MACHINERY": '<classsynopsis><classsynopsisinfo role="inheritedBy">{}</classsynopsisinfo></classsynopsis>',
}
HTML_HEAD = {"AUTOMOBILE": "public-types", "BUILDING": "properties", "FURNITURE": "public-slots", "HOUSEHOLD": "signals"}


def _classes(t):
    """Nations are pages, of a class unless their key is divisible by 5; the HTML lacks customers in debt."""
    filled = lambda text: F.replace(F.lit(text), F.lit("{}"), F.col("c_name"))
    case = lambda table: F.coalesce(*(F.when(F.col("c_mktsegment") == k, filled(v)) for k, v in table.items()))
    rows = t("customer").select("c_nationkey", "c_custkey", "c_mktsegment", (F.col("c_acctbal") >= 0).alias("shown"), case(DOCBOOK).alias("d"))
    link = F.concat(F.lit('<tr><td>x</td><td><b><a href="#'), "c_custkey", F.lit('">'), "c_name", F.lit("</a></b></td></tr>"))
    flags = F.concat(F.lit('<tr><td>flags</td><td><b><a href="#'), "c_custkey", F.lit('">'), "c_name", F.lit("s</a></b></td></tr>"))
    cells = t("customer").filter("c_acctbal >= 0").groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.collect_list(F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(link, flags)).otherwise(link)), "").alias("rows"))
    head = F.coalesce(*(F.when(F.col("c_mktsegment") == k, F.lit(f'<h2 id="{v}">H</h2>')) for k, v in HTML_HEAD.items()), F.lit("<p>Inherited By:</p>"))
    block = cells.select("c_nationkey", F.concat(F.lit("<div>"), head, F.lit("<table>"), "rows", F.lit("</table></div>")).alias("s"))
    html = block.groupBy("c_nationkey").agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list("s"), ""), F.lit("</body></html>")).alias("content"))
    synopsis = F.when(F.col("c_nationkey") % 5 == 0, "").otherwise("<classsynopsis/>")
    body = F.array_join(F.collect_list(F.when((F.col("c_mktsegment") != "MACHINERY") | (F.col("c_nationkey") % 5 != 0), F.col("d"))), "")
    docbook = rows.groupBy("c_nationkey").agg(body.alias("b")).select("c_nationkey", F.concat(F.lit(HEAD), synopsis, "b", F.lit("</article>")).alias("content"))
    return members.members(docbook, "c_nationkey", "content", "docbook"), members.members(html, "c_nationkey", "content", "html")


_CHECK = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items()) + " END"


@query("R-C1 R-C2 B06 D25 E05 E06", f"""SELECT CAST(c_nationkey AS BIGINT) AS doc_id, {_CHECK} AS "check", count(*) AS n_docbook, count(*) FILTER (c_acctbal >= 0) AS n_html,
coalesce(string_agg(c_name, ',' ORDER BY c_name) FILTER (c_acctbal < 0), '') AS only_docbook, '' AS only_html, count(*) FILTER (c_acctbal < 0) = 0 AS equal FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY ALL""")
def members_compared(t, _):
    """Types, properties, functions, signals and inheriting classes of the pages of classes, in DocBook and in HTML."""
    return members.compare_members(*_classes(t))


@query("B06", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_nationkey % 5 <> 0 AS is_class FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def class_pages(t, _):
    return _classes(t)[0].select("doc_id", "is_class").distinct()


@query("B07 F09", """SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN 'types' ELSE 'public_functions' END AS "check", 'm' || l_linenumber AS element
FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber FROM lineitem)""")
def first_column_predicate(t, _):
    """Related non-members are types where the cell before says typedef, and functions elsewhere."""
    n = F.col("l_linenumber").cast("string")
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("l_linenumber") % 3 == 0, "typedef").otherwise("int"), F.lit('</td><td><b><a href="#'), n, F.lit('">m'), n, F.lit("</a></b></td></tr>"))
    pages = t("lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('<h2 id="related-non-members">R</h2><table>'), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("content"))
    return members.members(pages, "l_orderkey", "content", "html").select("doc_id", "check", "element")
