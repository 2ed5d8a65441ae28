"""One construct each, on articles made from the parts table: DocBook on one side, the article markup on the other (N, O, R)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import articles, mapping
from ..sources import context, markup, word
from .registry import query

HEAD = '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'
#: In each pair, X stands for the part's name and P for its number.
THERE = [
    ('<para>X <emphasis role="bold">X</emphasis> <emphasis>i</emphasis> <emphasis role="underline">u</emphasis> <emphasis role="strike">s</emphasis></para>', "<paragraph>X <b>X</b> <i>i</i> <u>u</u> <s>s</s></paragraph>"),
    ("<para><code>X<emphasis>y</emphasis></code> <superscript>2</superscript> <subscript>P</subscript></para>", "<paragraph><inline>Xy</inline> <sup>2</sup> <sub>P</sub></paragraph>"),
    ('<para><phrase role="color:red">X</phrase> <acronym>P</acronym></para>', '<paragraph><font color="red">X</font> <acronyme>P</acronyme></paragraph>'),
    ('<para><link xlink:href="https://x.org/?p=P&amp;q=1" xml:lang="en">X</link></para>', '<paragraph><link href="https://x.org/?p=P&amp;q=1" langue="en">X</link></paragraph>'),
    ('<para><link linkend="P">X</link><anchor xml:id="aP"/></para>', '<paragraph><renvoi id="P">X</renvoi><signet id="aP"></signet></paragraph>'),
    ("<para>X<footnote><para>P</para></footnote><indexterm><primary>X</primary><secondary>P</secondary></indexterm></para>", "<paragraph>X<noteBasPage><paragraph>P</paragraph></noteBasPage><index><index1>X</index1><index2>P</index2></index></paragraph>"),
    ('<orderedlist numeration="upperroman"><listitem><para>X</para></listitem><listitem><para>P</para></listitem></orderedlist>', '<liste type="I"><element useText="0"><paragraph>X</paragraph></element><element useText="0"><paragraph>P</paragraph></element></liste>'),
    ("<variablelist><varlistentry><term>X</term><listitem><para>P</para></listitem></varlistentry></variablelist>", '<liste type="none"><b>X</b> : <element useText="0"><paragraph>P</paragraph></element></liste>'),
    ("<simplelist><member>X</member><member>P</member><member>z</member></simplelist>", "X, P, z"),
    ("<warning><para>X</para></warning><tip><para>P</para></tip><caution><para>c</para></caution>", '<rich-imgtext type="warning"><paragraph>X</paragraph></rich-imgtext><rich-imgtext type="idea"><paragraph>P</paragraph></rich-imgtext><rich-imgtext type="error"><paragraph>c</paragraph></rich-imgtext>'),
    ('<programlisting language="cpp">X</programlisting><programlisting role="raw-html">P</programlisting><screen>s</screen>', '<code langage="cpp">X</code><html-brut><![CDATA[P]]></html-brut><code langage="other">s</code>'),
    ("<blockquote><para>X</para></blockquote><bridgehead>P</bridgehead>", "<tableau><ligne><colonne><paragraph>X</paragraph></colonne></ligne></tableau><paragraph><b>P</b></paragraph>"),
    ('<table width="P" border="1"><caption>X</caption><thead><tr><th>h</th></tr></thead><tbody><tr><td>X</td></tr></tbody><tfoot><tr><td>f</td></tr></tfoot></table>', '<tableau width="Ppx" border="1"><legende>X</legende><entete><colonne>h</colonne></entete><ligne><colonne>X</colonne></ligne></tableau>'),
    ("<informaltable><tgroup><tbody><row><entry>X</entry></row></tbody></tgroup></informaltable>", "<tableau><ligne><colonne>X</colonne></ligne></tableau>"),
    ('<mediaobject><imageobject><imagedata fileref="P.png" align="center"/></imageobject></mediaobject>', '<image src="P.png" align="center"></image>'),
    ('<mediaobject><videoobject><videodata fileref="https://v.org/watch?v=P"/></videoobject></mediaobject>', '<animation width="640" height="480" src="https://v.org/embed/P"></animation>'),
    ("<informalequation><mathphrase>x^P</mathphrase></informalequation><classsynopsis><ooclass>X</ooclass></classsynopsis>", "<latex>x^P</latex>"),
    ("<para>X<itemizedlist><listitem><para>P</para></listitem></itemizedlist></para>", '<paragraph>X</paragraph><liste type="none"><element useText="0"><paragraph>P</paragraph></element></liste>'),
]
BACK = [
    ("<paragraph>X <b>X</b> <i>i</i> <u>u</u> <s>s</s></paragraph>", '<para>X <emphasis role="bold">X</emphasis> <emphasis>i</emphasis> <emphasis role="underline">u</emphasis> <emphasis role="strikethrough">s</emphasis></para>'),
    ("<paragraph><inline>X</inline> <sup>2</sup> <sub>P</sub></paragraph>", "<para><code>X</code> <superscript>2</superscript> <subscript>P</subscript></para>"),
    ('<paragraph><font color="red">X</font> <acronyme>P</acronyme></paragraph>', '<para><phrase role="color:red">X</phrase> <acronym>P</acronym></para>'),
    ('<paragraph><lien-forum id="P" idpost="7">X</lien-forum></paragraph>', '<para><link xlink:href="https://forum.example.org/showthread.php?t=P#post7">X</link></para>'),
    ('<liste type="I"><element useText="0"><paragraph>X</paragraph></element><element>P</element></liste>', '<orderedlist numeration="upperroman"><listitem><para>X</para></listitem><listitem><para>P</para></listitem></orderedlist>'),
    ('<rich-imgtext type="idea"><paragraph>X</paragraph></rich-imgtext><citation><paragraph>P</paragraph></citation>', "<tip><para>X</para></tip><blockquote><para>P</para></blockquote>"),
    ("<tableau><entete><colonne>h</colonne></entete><ligne><colonne>X</colonne></ligne></tableau>", "<informaltable><thead><tr><th>h</th></tr></thead><tr><td>X</td></tr></informaltable>"),
    ('<image src="P.png"></image><paragraph><image src="i.png"></image></paragraph>', '<mediaobject><imageobject><imagedata fileref="P.png"></imagedata></imageobject></mediaobject><para><inlinemediaobject><imageobject><imagedata fileref="i.png"></imagedata></imageobject></inlinemediaobject></para>'),
    ("<paragraph>X<noteBasPage>P<br/>z</noteBasPage></paragraph><latex>x^P</latex>", "<para>X<footnote><para>P</para><para>z</para></footnote></para><informalequation><mathphrase>x^P</mathphrase></informalequation>"),
    ('<animation width="640" height="480" src="P.mp4"></animation>', '<mediaobject><videoobject><videodata width="640" height="480" fileref="P.mp4"></videodata></videoobject></mediaobject>'),
]


def _marked(text: str) -> str:
    return re.sub("P(?!age)", "{p}", text.replace("X", "{x}"))


def _fill(text: str) -> Column:
    return F.replace(F.replace(F.lit(_marked(text)), F.lit("{x}"), F.col("p_name")), F.lit("{p}"), F.col("p_partkey").cast("string"))


def _sql(text: str) -> str:
    return "replace(replace('" + _marked(text).replace("'", "''") + "', '{x}', p_name), '{p}', CAST(p_partkey AS VARCHAR))"


@query("N04 N19 N20 N22 N24 N25 N26 N27 N28 N29 N30 N31 N32 N33 N34 N36", f"SELECT p_partkey AS doc_id, {_sql('<document><section noNumber=\"1\">' + ''.join(b for _, b in THERE) + '</section><section id=\"I\"><title>X</title></section></document>')} AS xml FROM part")
def constructs_there(t, _):
    docs = t("part").select("p_partkey", _fill(HEAD + "".join(a for a, _ in THERE) + "<section><title>X</title></section></article>").alias("content"))
    return mapping.to_article(context.in_context(docs, "p_partkey", "content", dropped=mapping.DROPPED))


@query("O05 O06 O07 O08 O09 O10 O11 O12 O13 O14", f"SELECT p_partkey AS doc_id, {_sql(HEAD + ''.join(b for _, b in BACK) + '</article>')} AS xml FROM part")
def constructs_back(t, _):
    docs = t("part").select("p_partkey", _fill("<document>" + "".join(a for a, _ in BACK) + "</document>").alias("content"))
    return mapping.to_docbook(context.in_context(docs, "p_partkey", "content"))


INFO = '<info><title>X</title><titleabbrev>aP</titleabbrev><keywordset><keyword>k</keyword><keyword>kP</keyword></keywordset><abstract role="description"><para>dP</para></abstract><abstract><para>X</para><para><simplelist><member>&lt;X&gt;</member><member>^P</member></simplelist></para></abstract>'
PEOPLE = '<author><personname><firstname>A</firstname><surname>X</surname><othername role="pseudonym">nP</othername></personname></author><othercredit class="technicaleditor"><orgname>oP</orgname></othercredit><author><personname>Y P</personname></author>'
LINKS = '<extendedlink><locator xlink:label="prev" xlink:href="pP.xml"/><locator xlink:label="next" xlink:href="nP.xml"/></extendedlink><bibliorelation type="isreplacedby" xlink:href="rP.xml"/></info>'


def _texts(t):
    body = '<section xml:id="sP"><title>X</title><para xml:id="tP">b</para></section></article>'
    return t("part").select("p_partkey", _fill(HEAD + INFO + PEOPLE + LINKS + body).alias("content"))


def _articles(t):
    return markup.shredded(_texts(t), "p_partkey", "content")


@query("N10 N16", "SELECT p_partkey AS doc_id, p_name AS title, CAST(NULL AS VARCHAR) AS subtitle, 'a' || p_partkey AS abbrev, 'd' || p_partkey AS description, 'k,k' || p_partkey AS keywords, p_name || '<' || p_name || '>^' || p_partkey AS abstract FROM part")
def article_header(t, _):
    return markup.each(_texts(t), "p_partkey", "content", articles.header_of, "title string, subtitle string, abbrev string, description string, keywords string, abstract string")


@query("N11 O03", """SELECT p_partkey AS doc_id, CAST(1 AS INTEGER) AS pos, 'author' AS role, 'n' || p_partkey AS key, 'A ' || p_name AS fullname FROM part UNION ALL SELECT p_partkey, 2, 'reviewer', 'o' || p_partkey, 'o' || p_partkey FROM part
UNION ALL SELECT p_partkey, 3, 'author', 'Y ' || p_partkey, 'Y ' || p_partkey FROM part""")
def article_authors(t, _):
    return markup.each(_texts(t), "p_partkey", "content", articles.authors_of, "pos int, role string, key string, fullname string")


@query("N13", "SELECT p_partkey AS doc_id, CAST(1 AS INTEGER) AS pos, p_name AS entry FROM part UNION ALL SELECT p_partkey, 2, CAST(p_partkey AS VARCHAR) FROM part")
def article_see_also(t, _):
    return articles.see_also(_articles(t))


@query("N03 N05 N14", "SELECT p_partkey AS doc_id, 's' || p_partkey || ' t' || p_partkey AS ids, 'p' || p_partkey || '.xml' AS previous, CAST(NULL AS VARCHAR) AS start, 'n' || p_partkey || '.xml' AS following, 'r' || p_partkey || '.xml' AS replaced_by FROM part")
def article_links(t, _):
    nodes = _articles(t)
    return articles.ids(nodes).join(articles.navigation(nodes), "doc_id").join(articles.obsolete_by(nodes), "doc_id")


@query("N12 R-C4 L10", """WITH a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS n, CASE WHEN p_size % 3 = 0 THEN 2024 END AS y, CASE WHEN p_size % 2 = 0 THEN p_brand END AS w, CASE WHEN p_size % 5 = 0 THEN p_type END AS x, CASE WHEN p_size % 7 = 0 THEN p_size END AS topic, CASE WHEN p_size % 4 = 0 THEN 1 END AS post FROM part)
SELECT p_partkey, CASE WHEN n IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND x IS NULL THEN '<licence type="' || n || '" annee="2024" auteur="' || w || '"/>' WHEN NOT (n IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL) AND x IS NOT NULL THEN '<licence>' || x || '</licence>' END AS licence,
CASE WHEN (n IS NOT NULL OR y IS NOT NULL OR w IS NOT NULL) AND x IS NOT NULL THEN 'licence_twice' WHEN (n IS NOT NULL OR y IS NOT NULL OR w IS NOT NULL) AND NOT (n IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL) THEN 'licence_incomplete' WHEN post IS NOT NULL AND topic IS NULL THEN 'post_without_topic' ELSE '' END AS problem FROM a""")
def article_config(t, _):
    s = F.col("p_size")
    n, y, w, x = F.when(s % 2 == 0, s), F.when(s % 3 == 0, F.lit(2024)), F.when(s % 2 == 0, F.col("p_brand")), F.when(s % 5 == 0, F.col("p_type"))
    return t("part").select("p_partkey", articles.licence(n, y, w, x).alias("licence"), articles.config_problem(n, y, w, x, F.when(s % 7 == 0, s), F.when(s % 4 == 0, F.lit(1))).alias("problem"))


@query("N06 N07 N08 A16", """SELECT c_nationkey || '/' || k AS out_path, '<section id="I"><title>' || c_name || '</title></section>' AS xml FROM (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
UNION ALL SELECT c_nationkey || '/0', '<document></document>' FROM customer GROUP BY c_nationkey""")
def books_in_parts(t, _):
    """Each nation is a book and each of its customers a chapter: a page of contents and a page per chapter."""
    chapter = F.struct("c_custkey", F.concat(F.lit("<chapter><title>"), "c_name", F.lit("</title></chapter>")).alias("s"))
    rows = t("customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(chapter)), lambda x: x["s"]), "").alias("b"))
    books = rows.select("c_nationkey", F.concat(F.lit("<book>"), "b", F.lit("</book>")).alias("content"))
    return mapping.to_article(articles.parts(markup.shredded(books, "c_nationkey", "content"))).select(F.col("doc_id").alias("out_path"), "xml")


@query("P01 N01", "SELECT c_nationkey AS doc_id, CASE WHEN c_acctbal < 0 THEN 'set_not_supported' ELSE 'bad_nesting' END AS \"check\", count(*) AS n FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING' GROUP BY ALL")
def nesting_findings(t, _):
    piece = F.when(F.col("c_acctbal") < 0, "<set/>").when(F.col("c_mktsegment") == "BUILDING", "<part/>").otherwise("<para/>")
    docs = t("customer").groupBy("c_nationkey").agg(F.concat(F.lit("<article>"), F.array_join(F.collect_list(piece), ""), F.lit("</article>")).alias("content"))
    return articles.nesting(markup.shredded(docs, "c_nationkey", "content")).groupBy("doc_id", "check").agg(F.count("*").alias("n"))


WORDS = (
    '<info><title>X</title></info><section><title>One</title><para>a <emphasis role="bold">X</emphasis><emphasis>i</emphasis> <code>P</code><code>{i}</code> x<superscript>2</superscript></para>'
    "<itemizedlist><listitem><para>X</para></listitem><listitem><para>P</para></listitem></itemizedlist><section><title>Inner</title><note><para>X</para><para>P</para></note><programlisting>int P;</programlisting></section></section>"
    '<section><title>Two</title><orderedlist><listitem><para>z</para></listitem></orderedlist><para><link xlink:href="https://x.org/?a=1&amp;b=P">l</link></para></section>'
)


@query("P06 P09 P11 P13 P15 Q08 Q10 Q11 Q12 F17 D20", f"SELECT p_partkey AS doc_id, {_sql((HEAD + WORDS + '</article>').replace('{i}', '<replaceable>v</replaceable>'))} AS xml FROM part")
def word_constructs(t, _):
    """Articles with headings, lists, notes, listings and formats, through word-processing files and back; italics within code come back as replaceable."""
    docs = t("part").select("p_partkey", _fill((HEAD + WORDS + "</article>").replace("{i}", "<emphasis>v</emphasis>")).alias("content"))
    files = word.files_of(docs, "p_partkey", "content")
    return word.to_docbook(word.read(files, "doc_id", "file"))
