"""Sources, sinks and path derivation (A, B)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sets
from .registry import query

PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query("A01 A03 A04 B05", f"""SELECT page_id, {PATH} AS path, regexp_replace({PATH}, '[.][A-Za-z0-9]+$', '') AS name FROM pages
WHERE lower(regexp_extract({PATH}, '[.]([A-Za-z0-9]+)$', 1)) IN ('html', 'xml') AND NOT starts_with({PATH}, 'search-results')""")
def scan_extension(t, _):
    path = T.url_path(F.col("url"))
    return t("pages").filter(T.extension(path).isin("html", "xml") & ~path.startswith("search-results")).select("page_id", path.alias("path"), T.strip_extension(path).alias("name"))


@query("A02", f"""SELECT page_id, len(string_split(trim({PATH}, '/'), '/')) AS depth FROM pages WHERE len(string_split(trim({PATH}, '/'), '/')) <= 2""")
def scan_depth(t, _):
    depth = F.size(F.split(F.trim(T.url_path(F.col("url")), F.lit("/")), "/")).cast("long")
    return t("pages").select("page_id", depth.alias("depth")).filter("depth <= 2")


@query("A05 B09 E01", """SELECT source, count(*) AS n_files, count(*) FILTER (coalesce(length(text), 0) = 0) AS n_empty, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source""")
def whole_text_counts(t, _):
    n = F.length("text")
    return t("documents").groupBy("source").agg(F.count("*").alias("n_files"), F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("n_empty"), F.sum(n).cast("long").alias("n_chars"))


@query("A18 A19 B17", """WITH a AS (SELECT page_id AS id, 'page' AS origin, html AS content, lower(regexp_extract(url, '[.]([a-z]+)$', 1)) AS ext FROM pages
UNION ALL SELECT doc_id, 'document', text, '' FROM documents)
SELECT origin, CASE WHEN ext IN ('db', 'dbk') THEN 'docbook' WHEN contains(content, 'xmlns') AND contains(content, 'http://docbook.org/ns/docbook') THEN 'docbook'
WHEN contains(content, '<html') THEN 'html' ELSE 'text' END AS fmt, count(*) AS n FROM a GROUP BY ALL""")
def format_sniff(t, _):
    pages = t("pages").select(F.lit("page").alias("origin"), F.col("html").alias("content"), F.lower(F.regexp_extract("url", "[.]([a-z]+)$", 1)).alias("ext"))
    docs = t("documents").select(F.lit("document").alias("origin"), F.col("text").alias("content"), F.lit("").alias("ext"))
    c = F.col("content")
    fmt = F.when(F.col("ext").isin("db", "dbk"), "docbook").when(c.contains("xmlns") & c.contains("http://docbook.org/ns/docbook"), "docbook").when(c.contains("<html"), "html").otherwise("text")
    return pages.unionByName(docs).groupBy("origin", fmt.alias("fmt")).agg(F.count("*").alias("n"))


@query("A17 F20", f"""WITH a AS (SELECT page_id, regexp_replace({PATH}, '[.][A-Za-z0-9]+$', '') AS stem, {PATH} AS path FROM pages),
b AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page_id) AS k FROM a)
SELECT page_id, CASE WHEN path = stem || '.xml' THEN stem || '_out.xml' ELSE stem || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.xml' END AS out_path FROM b""")
def output_names(t, _):
    path = T.url_path(F.col("url"))
    rows = t("pages").select("page_id", path.alias("path"), T.strip_extension(path).alias("stem"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("page_id")))
    again = F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit(""))
    out = F.when(F.col("path") == F.concat("stem", F.lit(".xml")), F.concat("stem", F.lit("_out.xml"))).otherwise(F.concat("stem", again, F.lit(".xml")))
    return rows.select("page_id", out.alias("out_path"))


@query("A20 A21 H07", f"""SELECT target, max(page_id) AS page_id, count(*) AS n_writers FROM (SELECT page_id, regexp_replace(trim({PATH}, '/'), '^.*/', '') AS target FROM pages)
WHERE target <> 'search-results.xml' GROUP BY target""")
def flatten_targets(t, _):
    rows = t("pages").select("page_id", T.file_name(F.trim(T.url_path(F.col("url")), F.lit("/"))).alias("target")).filter("target <> 'search-results.xml'")
    return rows.groupBy("target").agg(F.max("page_id").alias("page_id"), F.count("*").alias("n_writers"))


@query("A22 I02", """WITH p AS (SELECT min(regexp_extract(p_name, '^([^ ]+) ', 1)) AS prefix FROM part)
SELECT p_partkey, replace(CASE WHEN starts_with(p_name, prefix) THEN substr(p_name, length(prefix) + 2) ELSE p_name END, '--', '-') AS renamed FROM part, p""")
def rename_examples(t, _):
    part = t("part")
    prefix = part.agg(F.min(F.regexp_extract("p_name", "^([^ ]+) ", 1)).alias("prefix")).scalar()
    rest = F.when(F.col("p_name").startswith(prefix), F.substring(F.col("p_name"), F.length(prefix) + 2, F.length("p_name"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", F.replace(rest, F.lit("--"), F.lit("-")).alias("renamed"))


@query("A23 B17", f"""SELECT page_id, CASE WHEN regexp_matches({PATH}, '(^|/)(index[.][a-z]+)?$') THEN 'index.xml' WHEN regexp_matches({PATH}, '[.](png|jpe?g|svg)$') THEN 'images/' || regexp_replace({PATH}, '^.*/', '')
ELSE {PATH} END AS moved FROM pages""")
def index_to_root(t, _):
    path = T.url_path(F.col("url"))
    moved = F.when(path.rlike("(^|/)(index[.][a-z]+)?$"), "index.xml").when(path.rlike("[.](png|jpe?g|svg)$"), F.concat(F.lit("images/"), T.file_name(path))).otherwise(path)
    return t("pages").select("page_id", moved.alias("moved"))


@query("A24 D15 C08 E04", f"""WITH a AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/?([^"#]+)"', 1))) AS target FROM pages),
f AS (SELECT DISTINCT {PATH} AS target FROM pages)
SELECT a.page_id, a.target, f.target IS NOT NULL AS found FROM a LEFT JOIN f USING (target)""")
def referenced_files(t, _):
    pages = t("pages")
    wanted = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/?([^"#]+)"'), F.lit(1)))).alias("target"))
    files = pages.select(T.url_path(F.col("url")).alias("target"), F.lit(True).alias("there")).distinct()
    return wanted.join(files, "target", "left").select("page_id", "target", F.coalesce("there", F.lit(False)).alias("found"))


@query("A12 L01 L02 L05 K02 D11", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 1) AS k, coalesce(json_extract_string(props, '$.missing'), 'default') AS other FROM events""")
def json_config_fallback(t, _):
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.coalesce(F.element_at(m, "k").try_cast("int"), F.lit(1)).alias("k"), F.coalesce(F.element_at(m, "missing"), F.lit("default")).alias("other"))


@query("A13 L03 L06 A12", """SELECT o_orderkey, '{' || concat_ws(',', '"status":"' || o_orderstatus || '"', CASE WHEN o_orderstatus <> 'O' THEN '"priority":"' || o_orderpriority || '"' END, '"key":' || o_orderkey) || '}' AS sidecar FROM orders""")
def json_sidecar(t, _):
    fields = F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("priority"), F.col("o_orderkey").alias("key"))
    return t("orders").select("o_orderkey", F.to_json(fields).alias("sidecar"))


@query("A14 J02", """SELECT c_custkey, '{"section":1,"license-year":' || year(current_date) || ',"license-author":"' || c_name || '"}' AS config FROM customer""")
def default_config(t, _):
    made = F.struct(F.lit(1).alias("section"), F.year(F.current_date()).alias("license-year"), F.col("c_name").alias("license-author"))
    return t("customer").select("c_custkey", F.to_json(made).alias("config"))


@query("A15 I18 E11 D23 M15", """SELECT o_custkey, '<references>' || string_agg('<link href="' || replace(replace(o_orderpriority, '&', '&amp;'), '<', '&lt;') || '">' || o_orderkey || '</link>', '' ORDER BY o_orderkey) || '</references>' AS xml
FROM orders GROUP BY o_custkey""")
def reference_list(t, _):
    link = F.concat(F.lit('<link href="'), T.xml_escape(F.col("o_orderpriority")), F.lit('">'), F.col("o_orderkey").cast("string"), F.lit("</link>"))
    rows = sets.joined(t("orders").select("o_custkey", "o_orderkey", link.alias("link")), ["o_custkey"], "o_orderkey", "link", "", "links")
    return rows.select("o_custkey", F.concat(F.lit("<references>"), "links", F.lit("</references>")).alias("xml"))


@query("A16 N07 F01", """SELECT doc_id, 'doc' || doc_id || '_part' || i || '.xml' AS out_path, length(string_split(text, chr(10))[i]) AS n, i = len(string_split(text, chr(10))) AS last
FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def result_documents(t, _):
    lines = F.split("text", "\n")
    rows = t("documents").select("doc_id", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("i", "line"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_part"), (F.col("i") + 1).cast("string"), F.lit(".xml"))
    return rows.select("doc_id", name.alias("out_path"), F.length("line").cast("long").alias("n"), (F.col("i") + 1 == F.col("n_lines")).alias("last"))


@query("B01 B02 B03 B13", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS module FROM pages
WHERE (starts_with(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'th') OR regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) = 'activex.example.org')
AND NOT contains(url, '.example.net') AND NOT regexp_matches(url, '(private|/[0-9]+[.][0-9]+)$')""")
def module_filter(t, _):
    host, url = T.url_host(F.col("url")), F.col("url")
    return t("pages").filter((host.startswith("th") | (host == "activex.example.org")) & ~url.contains(".example.net") & ~url.rlike("(private|/[0-9]+[.][0-9]+)$")).select("page_id", host.alias("module"))


@query("B04 B14", """SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE NOT regexp_matches(line, '^(warning|note): ') AND NOT regexp_matches(line, '-(members|obsolete)$') GROUP BY doc_id""")
def log_line_filter(t, _):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(~F.col("line").rlike("^(warning|note): ") & ~F.col("line").rlike("-(members|obsolete)$")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("A30", f"""SELECT page_id, CASE WHEN lower(regexp_extract({PATH}, '[.]([A-Za-z0-9]+)$', 1)) IN ('xml', 'php', 'htm', 'html') THEN 'text' ELSE 'binary' END AS mode FROM pages""")
def transfer_mode(t, _):
    return t("pages").select("page_id", F.when(T.extension(T.url_path(F.col("url"))).isin("xml", "php", "htm", "html"), "text").otherwise("binary").alias("mode"))


@query("K07 K08 A28", """SELECT c_nationkey, (SELECT min(i) FROM range(0, 100000) r(i) WHERE NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey // 25 = i)) AS free
FROM (SELECT DISTINCT c_nationkey FROM customer) c""")
def first_free_number(t, _):
    used = t("customer").select("c_nationkey", F.floor(F.col("c_custkey") / 25).alias("i")).distinct()
    follows = Window.partitionBy("c_nationkey").orderBy("i")
    gap = used.withColumn("n", F.row_number().over(follows) - 1).groupBy("c_nationkey").agg(F.count("*").alias("all"), F.min(F.when(F.col("i") != F.col("n"), F.col("n"))).alias("gap"))
    return gap.select("c_nationkey", F.coalesce("gap", "all").cast("long").alias("free"))


@query("M20 A26 E12 E13", """SELECT source, CAST(sum(length(text) + 2) + count(*) - 1 AS BIGINT) AS command_length, sum(length(text) + 2) + count(*) - 1 > 32768 AS too_long,
bool_or(contains(text, 'License')) AS any_license, bool_and(length(text) > 0) AS all_full, CAST(sum(len(regexp_extract_all(text, 'the '))) AS BIGINT) AS n_the FROM documents GROUP BY source""")
def command_length(t, _):
    total = F.sum(F.length("text") + 2) + F.count("*") - 1
    return t("documents").groupBy("source").agg(
        total.cast("long").alias("command_length"), (total > 32768).alias("too_long"), F.bool_or(F.col("text").contains("License")).alias("any_license"),
        F.bool_and(F.length("text") > 0).alias("all_full"), F.sum(F.regexp_count("text", F.lit("the "))).cast("long").alias("n_the"),
    )
