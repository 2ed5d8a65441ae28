"""Includes, sidecar chains, relative paths, versions, attributes and predicates over nodes, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import checks, include, mapping
from ..sources import context, markup
from .registry import query

HEAD = '<article xmlns="http://docbook.org/ns/docbook">'


@query("A07 D18", """SELECT CAST(c_custkey AS VARCHAR) || '.xml' AS name, CASE WHEN c_custkey % 4 = 0 THEN '<para>' || c_name || '</para>'
ELSE '<article><title>' || c_custkey || '</title><para>' || (SELECT c_name FROM customer b WHERE b.c_custkey = a.c_custkey - a.c_custkey % 4) || '</para><section>x &lt;y&gt;</section></article>' END AS content, CASE WHEN c_custkey % 4 = 3 THEN 'gone.xml' ELSE '' END AS missing FROM customer a
WHERE c_custkey % 4 = 0 OR EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey - a.c_custkey % 4)""")
def xinclude(t, _):
    """Three of four customers include the paragraph of the one before them, the second of them through the first; what isn't there is told and its fallback taken."""
    key = F.col("c_custkey")
    k, whole = key % 4, (key - key % 4).cast("string")
    inc = F.concat(F.lit('<xi:include xmlns:xi="http://www.w3.org/2001/XInclude" href="'), whole, F.lit('.xml"/>'))
    piece = F.when(k == 3, F.lit('<xi:include href="gone.xml"><xi:fallback><section>x &lt;y&gt;</section></xi:fallback></xi:include>')).otherwise(F.lit('<xi:include href="snippet.txt" parse="text"/>'))
    piece = F.when(k == 3, piece).otherwise(F.concat(F.lit("<section>"), piece, F.lit("</section>")))
    own = F.concat(F.lit('<?xml version="1.0"?>\n<article><title>'), key.cast("string"), F.lit("</title>"), inc, piece, F.lit("</article>"))
    docs = t("customer").select(F.concat(key.cast("string"), F.lit(".xml")).alias("name"), F.when(k == 0, F.concat(F.lit('<?xml version="1.0"?><para>'), "c_name", F.lit("</para>"))).otherwise(own).alias("content"), (key - k).alias("base"))
    there = t("customer").select(F.col("c_custkey").alias("base")).filter("base % 4 = 0")
    docs = docs.join(there, "base", "left_semi").drop("base")
    text = t("region").agg(F.lit("snippet.txt").alias("name"), F.lit("x <y>").alias("content"))
    return include.expand(docs.unionByName(text), "name", "content").filter("name <> 'snippet.txt'")


def _lists(t):
    """An order's lines as a list of terms: some items are a paragraph, some two, some text alone; paragraphs stand in items, sections and behind other elements."""
    n = F.col("l_linenumber")
    item = F.when(n % 3 == 0, F.lit("<para>a</para><para>b</para>")).when(n % 3 == 1, F.lit("<para>a</para>")).otherwise(F.lit("text"))
    entry = F.concat(F.lit("<varlistentry><term>t</term><listitem>"), item, F.lit("</listitem></varlistentry>"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("s")))), lambda x: x["s"]), "").alias("s"))
    return rows.select("l_orderkey", F.concat(F.lit(HEAD + "<variablelist>"), "s", F.lit("</variablelist><quote><para>first</para><para>second</para></quote></article>")).alias("content"))


@query("B15", "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(sum(CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS admitted, CAST(1 AS BIGINT) AS refused FROM lineitem GROUP BY l_orderkey")
def paragraphs_admitted(t, _):
    """A paragraph counts in one of eleven parents, or where nothing stands before it."""
    return markup.each(_lists(t), "l_orderkey", "content", mapping.paras_counted, "admitted long, refused long")


@query("B16 N28", "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, count(*) FILTER (l_linenumber % 3 <> 1) AS complex, count(*) AS items FROM lineitem GROUP BY l_orderkey")
def complex_items(t, _):
    """An item is complex if it has more than one element, or no paragraph."""
    return markup.each(_lists(t), "l_orderkey", "content", mapping.items_counted, "complex long, items long")


@query("B18 I18", """SELECT o_orderkey, '<link href="' || replace(replace(o_orderpriority || '&' || o_orderkey, '&', '&amp;'), '<', '&lt;') || '"' || CASE WHEN o_orderstatus <> 'O' THEN ' langue="' || o_orderstatus || '"' ELSE '' END || '>' AS opening FROM orders""")
def attribute_templates(t, _):
    """Attributes whose values are computed; those that are empty are left out."""
    made = mapping.tag("link", href=F.concat("o_orderpriority", F.lit("&"), F.col("o_orderkey").cast("string")), langue=F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise(""))
    return t("orders").select("o_orderkey", made.alias("opening"))


@query("D10 D12 D11", """WITH p AS (SELECT p_partkey, 'd' || p_size || '/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_article' ELSE '' END || '.xml' AS path, p_size, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'given' WHEN k = 1 THEN 'sidecar ' || p_partkey WHEN k = 2 THEN 'appended ' || p_partkey WHEN p_size % 2 = 0 THEN 'related ' || p_size ELSE '{}' END AS config FROM p""")
def sidecar_chain(t, _):
    """A document's configuration: given, else the file of its name with .json (without _article), else its whole name and .json, else its folder's related.json, else nothing."""
    part = t("part").withColumn("k", F.col("p_partkey") % 4)
    folder = F.concat(F.lit("d"), F.col("p_size").cast("string"))
    key = F.col("p_partkey").cast("string")
    path = F.concat(folder, F.lit("/"), key, F.when(F.col("p_partkey") % 3 == 0, "_article").otherwise(""), F.lit(".xml"))
    docs = part.select("p_partkey", path.alias("path"), F.when(F.col("k") == 0, "given").alias("given"))
    beside = part.filter("k = 1").select(F.concat(folder, F.lit("/"), key, F.lit(".json")).alias("file"), F.concat(F.lit("sidecar "), key).alias("config"))
    behind = part.filter("k = 2").select(F.concat(path, F.lit(".json")).alias("file"), F.concat(F.lit("appended "), key).alias("config"))
    related = part.filter("p_size % 2 = 0").select(F.concat(folder, F.lit("/related.json")).alias("file"), F.concat(F.lit("related "), F.col("p_size").cast("string")).alias("config")).distinct()
    return include.configured(docs, "path", "given", beside.unionByName(behind).unionByName(related)).select("p_partkey", F.coalesce("config", F.lit("{}")).alias("config"))


@query("D14 D13 G03", """WITH c AS (SELECT s_suppkey, s_nationkey, s_name FROM supplier), special(k, v) AS (VALUES (1, 'tools'), (3, 'core'))
SELECT n_nationkey, coalesce((SELECT v FROM special WHERE k = n_nationkey), (SELECT arg_min(s_name, s_suppkey) FROM c WHERE s_nationkey = n_nationkey), 'none') AS chosen FROM nation""")
def special_lists(t, spark):
    """Some modules have a list of their own that comes before all candidates found."""
    special = spark.createDataFrame([(1, "tools"), (3, "core")], "n_nationkey int, value string").withColumn("rank", F.lit(0).cast("long"))
    found = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("value"), (F.col("s_suppkey") + 1).alias("rank"))
    first = special.unionByName(found).groupBy("n_nationkey").agg(F.min_by("value", "rank").alias("chosen"))
    return t("nation").select("n_nationkey").join(first, "n_nationkey", "left").select("n_nationkey", F.coalesce("chosen", F.lit("none")).alias("chosen"))


@query("E08", "SELECT doc_id, CAST(length(text) - length(replace(text, 'ee', '')) AS BIGINT) AS plain_chars, CAST(len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'ee')) AS BIGINT) AS overlapping FROM documents")
def overlapping_matches(t, _):
    """Matches counted from each place on, so that they may overlap; beside it, the characters of those that don't."""
    c = F.col("text")
    return t("documents").select("doc_id", (F.regexp_count(c, F.lit("ee")) * 2).cast("long").alias("plain_chars"), F.regexp_count(c, F.lit("(?=ee)")).cast("long").alias("overlapping"))


@query("I13", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'd' || c_custkey || 'e' || i AS id, CASE i WHEN 1 THEN 'article' WHEN 2 THEN 'title' WHEN 4 THEN 'section' ELSE 'para' END AS local FROM customer, (VALUES (1), (2), (4), (5)) v(i)")
def generated_ids(t, _):
    """Every element has an id of its own that is the same in each run."""
    docs = t("customer").select("c_custkey", F.concat(F.lit(HEAD + "<title>"), "c_name", F.lit("</title><section><para/></section></article>")).alias("content"))
    return context.in_context(docs, "c_custkey", "content").filter("kind = 'elem'").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("e"), F.col("pre").cast("string")).alias("id"), "local")


@query("K04 K03", "SELECT p_partkey, p_size || '.' || p_partkey % 10 AS version, CAST(p_size AS INTEGER) AS major FROM part")
def version_of_index(t, _):
    """The version that the first title of an index page names."""
    key = F.col("p_partkey")
    text = F.concat(F.lit("<db:article>\n<db:info>\n  <db:title>Docs "), F.col("p_size").cast("string"), F.lit("."), (key % 10).cast("string"), F.lit(" </db:title>\n<db:title>Docs 99.9</db:title>"))
    v = paths.title_version(text, "Docs")
    return t("part").select("p_partkey", v.alias("version"), F.split(v, "[.]")[0].cast("int").alias("major"))


@query("L04 I16", "SELECT p_partkey, p_name AS href, p_brand AS lang, CAST(2 AS INTEGER) AS n FROM part")
def local_attributes(t, _):
    """Attributes by their local names."""
    m = F.create_map(F.lit("xlink:href"), F.col("p_name"), F.lit("xml:lang"), F.col("p_brand"))
    local = F.transform_keys(m, lambda k, _: F.substring_index(k, ":", -1))
    return t("part").select("p_partkey", local["href"].alias("href"), local["lang"].alias("lang"), F.size(local).alias("n"))


@query("L08", """SELECT o_orderkey, CAST(3 AS INTEGER) AS n, o_orderstatus || ',x,' || o_orderkey AS joined FROM orders""")
def json_string_arrays(t, _):
    made = F.to_json(F.array("o_orderstatus", F.lit("x"), F.col("o_orderkey").cast("string")))
    a = F.from_json(made, "array<string>")
    return t("orders").select("o_orderkey", F.size(a).alias("n"), F.array_join(a, ",").alias("joined"))


@query("L09", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '.' WHEN c_custkey % 4 = 1 THEN 'sub/' || c_nationkey WHEN c_custkey % 4 = 2 THEN '..' ELSE '../../n' || c_nationkey || '/x' END AS relative FROM customer""")
def relative_paths(t, _):
    """How one folder is reached from another."""
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    to = F.when(k == 0, "/a/b").when(k == 1, F.concat(F.lit("/a/b/sub/"), n)).when(k == 2, "/a").otherwise(F.concat(F.lit("/n"), n, F.lit("/x")))
    return t("customer").select("c_custkey", paths.relative(F.lit("/a/b"), to).alias("relative"))



DB = '<article xmlns="http://docbook.org/ns/docbook"><title>t</title>'
#: check, element, the piece that has the fault; the last ones have none.
FAULTS = [
    ("not_allowed", "para", "<itemizedlist><listitem><para>a</para></listitem></itemizedlist><table><title>t</title><tr><para>b</para><td/></tr></table>"),
    ("child_lacks", "itemizedlist", "<itemizedlist><title>no items</title></itemizedlist>"),
    ("child_lacks", "varlistentry", "<variablelist><varlistentry><term>t</term></varlistentry></variablelist>"),
    ("attribute_lacks", "xref", "<para><xref/></para>"),
    ("not_allowed", "section", "<para><section><title>s</title></section></para>"),
    ("child_lacks", "section", "<section><para>no title</para></section>"),
    ("not_allowed", "b", "<para>html <b>tags</b></para>"),
    ("", "", "<section><title>s</title><para>a<footnote><para>f</para></footnote><emphasis>e</emphasis></para><mediaobject><imageobject><imagedata fileref='x'/></imageobject></mediaobject></section>"),
]
ARTICLE_FAULTS = [("not_allowed", "para", "<summary><para>x</para></summary>"), ("attribute_lacks", "image", '<summary><image/></summary>'), ("child_lacks", "liste", '<summary><liste type="1"></liste></summary>'), ("", "", '<summary><section id="I"><title>s</title><paragraph>x <b>y</b></paragraph></section></summary>')]


def _faults_sql() -> str:
    every = [*FAULTS, *ARTICLE_FAULTS]
    rows = ", ".join(f"({k}, '{c}', '{e}')" for k, (c, e, _) in enumerate(every) if c)
    return f'SELECT CAST(o_orderkey AS BIGINT) AS doc_id, "check", element FROM orders JOIN (VALUES {rows}) v(k, "check", element) ON o_orderkey % {len(every)} = k'


@query("R-V1", _faults_sql())
def grammar_faults(t, _):
    """Documents of both markups with one fault each, and some without, by the grammar of their markup."""
    k = (F.col("o_orderkey") % (len(FAULTS) + len(ARTICLE_FAULTS)) + 1).cast("int")
    texts = [DB + x + "</article>" for *_, x in FAULTS] + [f"<document><entete></entete>{x}</document>" for *_, x in ARTICLE_FAULTS]
    docs = t("orders").select("o_orderkey", k.alias("k"), F.element_at(F.array(*map(F.lit, texts)), k).alias("content"))
    judged = lambda df, *tables: markup.each(df, "o_orderkey", "content", lambda nodes: checks.judged(nodes, *tables), "pre int, check string, severity string, element string")
    found = judged(docs.filter(F.col("k") <= len(FAULTS))).unionByName(judged(docs.filter(F.col("k") > len(FAULTS)), *checks.ARTICLE))
    return found.select("doc_id", "check", "element")
