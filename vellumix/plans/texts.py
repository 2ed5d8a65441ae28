"""Scalar functions, dates, numbers, maps and repair rules (I, J, K, L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import repair
from .registry import query


@query("I05 I06 I07 I08 I10 I11 I16 I17 C11", r"""SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS flat, substr(text, 1, 9) AS from_zero, CASE WHEN contains(text, '.') THEN string_split(text, '.')[1] ELSE '' END AS sentence,
lower(text) AS low, CAST(length(text) AS INTEGER) AS n, starts_with(text, 'The') AS the, ends_with(text, '.') AS dot FROM documents""")
def string_functions(t, _):
    c = F.col("text")
    return t("documents").select(
        "doc_id", T.normalize_space(c).alias("flat"), T.xpath_substring(c, 0, 10).alias("from_zero"), T.substring_before(c, ".").alias("sentence"),
        F.lower(c).alias("low"), F.length(c).alias("n"), c.startswith("The").alias("the"), c.endswith(".").alias("dot"),
    )


@query("I14 I15 I16 I30 I09 I27", """SELECT p_partkey, string_split('ns::' || replace(p_name, ' ', '::'), '::')[-1] AS member, regexp_replace(regexp_replace(lower(p_name || ': ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
string_split(p_name, ' ')[1] AS given, regexp_replace(p_name, '^[^ ]+ ?', '') AS family, translate(p_brand, 'ABC', 'abc') AS brand, string_split('db:' || p_brand, ':')[-1] AS local FROM part""")
def name_functions(t, _):
    n = F.col("p_name")
    return t("part").select(
        "p_partkey", T.member_name(F.concat(F.lit("ns::"), F.replace(n, F.lit(" "), F.lit("::")))).alias("member"), T.slug(F.concat(n, F.lit(": "), "p_type")).alias("slug"),
        T.given_name(n).alias("given"), T.family_name(n).alias("family"), F.translate("p_brand", "ABC", "abc").alias("brand"), T.local_name(F.concat(F.lit("db:"), "p_brand")).alias("local"),
    )


@query("I25 I26 A24", """SELECT page_id, md5(regexp_replace(html, 'href="/?([A-Za-z0-9][^":]*)"', 'href="https://docs.example.org/\\1"', 'g')) AS rebased,
md5(regexp_replace(replace(html, 'href="/', 'href="../mod/'), 'href="(?:[.][.]/)+(?:[^"/]+/)*([^"/]+)"', 'href="\\1"', 'g')) AS flattened FROM pages""")
def link_rewrite(t, _):
    h = F.col("html")
    up = F.replace(h, F.lit('href="/'), F.lit('href="../mod/'))
    return t("pages").select("page_id", F.md5(T.rebase_link(h, "https://docs.example.org/")).alias("rebased"), F.md5(T.flatten_link(up)).alias("flattened"))


@query("I20 I21 I22 N15 N35 O12", """WITH a AS (SELECT o_orderkey, 'https://forum.example.org/showthread.php?t=' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '#post' || o_orderkey ELSE '' END AS url FROM orders)
SELECT o_orderkey, CAST(regexp_extract(url, '[?]t=([0-9]+)', 1) AS BIGINT) AS topic, TRY_CAST(regexp_extract(url, '#post([0-9]+)', 1) AS BIGINT) AS post,
replace(url, 'https://forum.example.org/showthread.php', 'x') AS rebuilt, replace(replace(url, 'showthread.php?t=', 'watch?v='), 'watch?v=', 'embed/') AS video FROM a""")
def forum_links(t, _):
    post = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("#post"), F.col("o_orderkey").cast("string"))).otherwise(F.lit(""))
    rows = t("orders").select("o_orderkey", F.concat(F.lit("https://forum.example.org/showthread.php?t="), F.col("o_custkey").cast("string"), post).alias("url"))
    topic, at = T.forum_topic(F.col("url")), T.forum_post(F.col("url"))
    return rows.select("o_orderkey", topic.alias("topic"), at.alias("post"), T.forum_url("x", topic, at).alias("rebuilt"), T.video_embed(F.replace("url", F.lit("showthread.php?t="), F.lit("watch?v="))).alias("video"))


@query("I18 I19", """SELECT c_custkey, repeat('  ', c_nationkey % 4) || replace(replace(replace(replace(c_name || ' & <' || c_mktsegment || '> "q"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS line,
'd1e' || c_custkey AS id FROM customer""")
def xml_writer_functions(t, _):
    s = F.concat("c_name", F.lit(" & <"), "c_mktsegment", F.lit('> "q"'))
    return t("customer").select("c_custkey", T.indent(T.xml_escape(s), (F.col("c_nationkey") % 4).cast("int")).alias("line"), F.concat(F.lit("d1e"), F.col("c_custkey").cast("string")).alias("id"))


@query("I28 I29 P02 P03 Q06", """WITH a AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Author : ' WHEN 1 THEN 'Auteur : ' ELSE '' END || c_name AS line FROM customer),
d(label, field) AS (VALUES ('author', 'author'), ('auteur', 'author'), ('date', 'date'))
SELECT c_custkey, field, CASE WHEN contains(line, ':') THEN trim(regexp_extract(line, '^[^:]{1,40}: *(.*)$', 1)) END AS value FROM a LEFT JOIN d ON CASE WHEN contains(line, ':') THEN lower(trim(string_split(line, ':')[1])) END = label""")
def labelled_fields(t, spark):
    n = F.col("c_nationkey") % 3
    line = F.concat(F.when(n == 0, "Author : ").when(n == 1, "Auteur : ").otherwise(""), F.col("c_name"))
    rows = t("customer").select("c_custkey", T.label_name(line).alias("label"), T.label_value(line).alias("value"))
    labels = spark.createDataFrame([("author", "author"), ("auteur", "author"), ("date", "date")], "label string, field string")
    return rows.join(labels, "label", "left").select("c_custkey", "field", "value")


@query("I23 I24 K05 K06 B20 N19 N40", """SELECT p_partkey, p_size * CASE p_partkey % 5 WHEN 0 THEN 914400 WHEN 1 THEN 360000 WHEN 2 THEN 36000 WHEN 3 THEN 12700 ELSE 9525 END AS emu, CAST(p_size * 10 // 72 AS VARCHAR) || 'in' AS inches,
CASE WHEN p_partkey % 3 = 0 THEN p_size || 'px' WHEN p_partkey % 3 = 1 THEN p_size || '%' ELSE '100%' END AS width, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 640 END AS media FROM part""")
def lengths(t, _):
    n = F.col("p_partkey") % 5
    unit = F.when(n == 0, "in").when(n == 1, "cm").when(n == 2, "mm").when(n == 3, "pt").otherwise("px")
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    width = F.when(m == 0, size).when(m == 1, F.concat(size, F.lit("%")))
    return t("part").select(
        "p_partkey", N.to_emu(F.concat(size, unit)).alias("emu"), N.points_to_inches(F.col("p_size") * 10).alias("inches"),
        N.pixel_width(width).alias("width"), F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")), F.lit(640)).alias("media"),
    )


@query("J01 J02 J03 J04", """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || '+02:00' ELSE 'soon' END AS s FROM orders)
SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(s, '%d/%m/%Y'), try_strptime(replace(s, '+02:00', ''), '%Y-%m-%d')), '%Y-%m-%d'), '2024-01-01') AS day FROM a""")
def dates(t, _):
    n = F.col("o_orderkey") % 3
    s = F.when(n == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(n == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("+02:00"))).otherwise(F.lit("soon"))
    return t("orders").select("o_orderkey", F.coalesce(F.date_format(N.any_date(s), "yyyy-MM-dd"), F.lit("2024-01-01")).alias("day"))


@query("J05 J06", """WITH a AS (SELECT page_id, replace(html, '</title>', '</title><pubdate>2024-01-01</pubdate>') AS s FROM pages)
SELECT page_id, md5(replace(s, '</pubdate>', '</pubdate><authorgroup>A</authorgroup>')) AS text_md5 FROM a""")
def inject_dates_authors(t, _):
    c = F.col("html")
    for _ in range(2):  # doing it twice changes nothing more
        c = repair.inject_after(c, "title", "<pubdate>2024-01-01</pubdate>", "<pubdate>")
        c = repair.inject_after(c, "pubdate", "<authorgroup>A</authorgroup>", "<authorgroup>")
    return t("pages").select("page_id", F.md5(c).alias("text_md5"))


@query("K01 K09 F02", "SELECT o_orderkey, repeat('M', CAST(n // 1000 AS INTEGER)) || list_extract(['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'], n // 100 % 10 + 1) || list_extract(['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'], n // 10 % 10 + 1) || list_extract(['','I','II','III','IV','V','VI','VII','VIII','IX'], n % 10 + 1) AS roman, 'Heading' || least(n % 12, 9) AS style FROM (SELECT o_orderkey, o_orderkey % 3999 + 1 AS n FROM orders)")
def roman_numerals(t, _):
    n = F.col("o_orderkey") % 3999 + 1
    return t("orders").select("o_orderkey", N.roman(n).alias("roman"), N.heading((n % 12).cast("int")).alias("style"))


@query("K02 K03 M16", """WITH a AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_partkey || '.' || l_suppkey WHEN 1 THEN l_partkey || '.' || l_suppkey || '.' || l_linenumber ELSE 'x' || l_partkey END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, TRY_CAST(NULLIF(regexp_extract(v, '^([0-9]+)[.]', 1), '') AS INTEGER) AS major, CASE WHEN regexp_matches(v, '^[0-9]') THEN v ELSE '' END AS shown, coalesce(TRY_CAST(string_split(v, '.')[3] AS INTEGER), 21) AS patch FROM a""")
def versions(t, _):
    p, s, k = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    v = F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws(".", p, s)).when(F.col("l_linenumber") % 3 == 1, F.concat_ws(".", p, s, k)).otherwise(F.concat(F.lit("x"), p))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", N.version(v).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", F.col("v.major").alias("major"), N.version_text(F.col("v")).alias("shown"), F.coalesce("v.patch", F.lit(21)).alias("patch"))


@query("L01 L03 L06 L07 D16 D24 M17", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'info' WHEN 'MACHINERY' THEN 'idea' WHEN 'HOUSEHOLD' THEN 'warning' ELSE 'error' END AS kind,
CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS n_keys, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'none') AS value FROM customer""")
def map_functions(t, _):
    kinds = F.create_map(*(F.lit(x) for x in ("BUILDING", "info", "MACHINERY", "idea", "HOUSEHOLD", "warning")))
    m = F.map_filter(F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.when(F.col("c_acctbal") > 0, F.col("c_name"))), lambda _, v: v.isNotNull())
    inverse = F.map_from_arrays(F.map_values(m), F.map_keys(m))
    return t("customer").select("c_custkey", F.coalesce(F.try_element_at(kinds, F.col("c_mktsegment")), F.lit("error")).alias("kind"), F.size(inverse).alias("n_keys"), F.coalesce(F.try_element_at(m, F.lit("name")), F.lit("none")).alias("value"))


@query("E09 E10", """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages), q AS (SELECT page_id, parts, regexp_extract(parts[1], '[a-z]+$') AS zone FROM p),
e AS (SELECT zone, i, count(DISTINCT parts[i]) AS n, count(*) AS c, min(parts[i]) AS v FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM q) GROUP BY ALL), m AS (SELECT zone, min(len(parts)) AS least, count(*) AS pages FROM q GROUP BY zone),
x AS (SELECT zone, coalesce(min(i) FILTER (n > 1 OR c < pages), 1000000000) AS stop FROM e JOIN m USING (zone) GROUP BY zone)
SELECT zone, least, pages, coalesce((SELECT string_agg(v, '/' ORDER BY i) FROM e WHERE e.zone = m.zone AND i < stop), '') AS prefix FROM m JOIN x USING (zone)""")
def common_prefix(t, _):
    rows = t("pages").select("page_id", F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("parts"))
    rows = rows.withColumn("zone", F.regexp_extract(F.col("parts")[0], "[a-z]+$", 0))
    least = rows.groupBy("zone").agg(F.min(F.size("parts")).cast("long").alias("least"), F.count("*").alias("pages"))
    steps = rows.select("zone", F.posexplode("parts").alias("i", "v")).groupBy("zone", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c"))
    joined = steps.join(least, "zone").withColumn("same", (F.col("lo") == F.col("hi")) & (F.col("c") == F.col("pages")))
    stop = joined.groupBy("zone", "least", "pages").agg(F.min(F.when(~F.col("same"), F.col("i"))).alias("stop"), F.array_sort(F.collect_list(F.struct("i", "lo"))).alias("s"))
    kept = F.filter("s", lambda x: x["i"] < F.coalesce("stop", F.lit(1_000_000_000)))
    return stop.select("zone", "least", "pages", F.array_join(F.transform(kept, lambda x: x["lo"]), "/").alias("prefix"))


OWN_MARKUP = {r.id for r in repair.RULES if r.guard or "\\1" in r.pattern or "\\R" in r.pattern or "++" in r.pattern or "(?" in r.pattern}


def _rules_sql() -> str:
    c = "html"
    for r in repair.RULES:
        if r.id in OWN_MARKUP:
            continue  # no page has such markup, and the rule needs what these patterns can't say; `repair_damage` shows it
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, r.pattern.replace("'", "''"), r.replacement.replace("$1", "\\1"))
    return f"SELECT page_id, md5({c}) AS repaired, {c} <> html AS changed FROM pages"


@query("M I01 I02 I03", _rules_sql())
def repair_rules(t, _):
    fixed = repair.repair_documents(t("pages").select("page_id", "url", "html"), "url", "html")
    return fixed.select("page_id", F.md5("html").alias("repaired"), "changed")


@query("E01 E02", f"SELECT count(*) AS n_total, count(*) FILTER (changed) AS n_changed, CAST(0 AS BIGINT) AS n_ignored FROM ({_rules_sql()})")
def repair_counters(t, _):
    fixed = repair.repair_documents(t("pages").select("url", "html"), "url", "html")
    return repair.counters(fixed, "html")


@query("I18", "SELECT page_id, md5(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS plain FROM pages")
def entity_unescape(t, _):
    return t("pages").select("page_id", F.md5(T.xml_unescape(F.col("html"))).alias("plain"))


@query("I04 I12 C14", """SELECT doc_id, CAST(len(string_split(text, '. ')) AS INTEGER) AS n_sentences, CAST(coalesce(list_position(string_split(text, ' '), 'the'), 0) AS BIGINT) AS first_the, array_to_string(list_transform(range(1, 4), lambda i: 'h' || i), ',') AS seq FROM documents""")
def tokenize_index_for(t, _):
    return t("documents").select(
        "doc_id", F.size(F.split("text", "[.] ")).alias("n_sentences"), F.array_position(F.split("text", " "), "the").alias("first_the"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("h"), i.cast("string"))), ",").alias("seq"),
    )
