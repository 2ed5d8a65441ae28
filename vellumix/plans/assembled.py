"""Whole documents in the article markup, and what their assembly is made of (N02-N21, N31, N34, N36-N40, O02, B11, B12, R-W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, mapping
from ..sources import assembly, context, markup
from .constructs import HEAD, INFO, LINKS, PEOPLE, _fill, _sql
from .registry import query

BODY = '<para>lead</para><section xml:id="sP"><title>X<indexterm><primary>iP</primary></indexterm></title><para>b</para></section></article>'
DOCUMENT = (
    "<document><entete><rubrique>7</rubrique><meta><description>dP</description><keywords>k,kP</keywords></meta><titre><page>aP</page><article>X</article></titre>"
    "<licauteur>X</licauteur><lictype>2</lictype><licannee>2024</licannee><urlhttp>https://x.org/P</urlhttp></entete>"
    "<voiraussi><lien><texte>X</texte></lien><lien><texte>P</texte></lien></voiraussi>"
    '<authorDescriptions><authorDescription name="nP" role="author"><fullname>A X</fullname></authorDescription><authorDescription name="oP" role="reviewer"><fullname>oP</fullname></authorDescription><authorDescription name="Y P" role="author"><fullname>Y P</fullname></authorDescription></authorDescriptions>'
    '<synopsis><paragraph>X</paragraph><paragraph><renvoi id="sP">sP</renvoi></paragraph><paragraph><lien-forum id="12" idpost="1"/></paragraph><rich-imgtext type="error"><paragraph><link href="rP.xml">rP.xml</link></paragraph></rich-imgtext></synopsis>'
    '<summary><section noNumber="1"><paragraph>lead</paragraph></section><section id="I"><signet id="sP"/><title>X</title><index><index1>iP</index1></index><paragraph>b</paragraph></section></summary>'
    '<tableau width="100%"><ligne><colonne><link href="pP.xml">pP.xml</link></colonne><colonne><link href="nP.xml">nP.xml</link></colonne></ligne></tableau></document>'
)


@query("N02 N03 N04 N05 N10 N11 N12 N13 N14 N15 N16 N18 D10 L10", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_sql(DOCUMENT)} AS xml FROM part")
def article_assembled(t, _):
    """The whole document: head, see-also, authors, synopsis, body, navigation."""
    key = F.col("p_partkey").cast("string")
    config = {"section": F.lit("7"), "licence_number": F.lit("2"), "licence_year": F.lit("2024"), "licence_author": F.col("p_name"), "forum_topic": F.lit("12"), "forum_post": F.lit("1"), "url": F.concat(F.lit("https://x.org/"), key)}
    docs = t("part").select("p_partkey", _fill(HEAD + INFO + PEOPLE + LINKS + BODY).alias("content"), F.create_map(*(x for k, v in config.items() for x in (F.lit(k), v))).alias("config"))
    return assembly.to_article(docs, "p_partkey", "content", "config")


@query("N02 N11 N16 D12", """SELECT doc_id, '<document><entete><rubrique>1</rubrique><meta><description>' || source || '</description></meta><titre><page>' || source || '</page><article>' || source || '</article></titre></entete><authorDescriptions><authorDescription name="Dummy" role="author"><fullname>Dummy</fullname></authorDescription></authorDescriptions><synopsis></synopsis><summary><section id="I"><title>' || lang || '</title>' || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
lambda x: '<paragraph>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</paragraph>'), '') || '</section></summary></document>' AS xml FROM documents""")
def documents_assembled(t, _):
    """All that a document lacks has its fallback."""
    from .markup import _articles

    return assembly.to_article(_articles(t), "doc_id", "content")


_AUTHOR = '<authorDescriptions><authorDescription name="Dummy" role="author"><fullname>Dummy</fullname></authorDescription></authorDescriptions>'
BOOK = "<info><title>X</title></info><part><info><title>One</title></info><chapter><info><title>C1</title></info><section><title>s</title><para>P</para></section></chapter><chapter><title>C2</title><para>X</para></chapter></part><part><title>Two</title><chapter><title>C3</title></chapter></part></book>"


def _head(title: str) -> str:
    return f"<entete><rubrique>1</rubrique><meta><description>{title}</description></meta><titre><page>{title}</page><article>{title}</article></titre></entete>"


def _toc(*entries: tuple) -> str:
    return '<liste type="none">' + "".join(f'<element useText="0"><paragraph>{f"{n}. " if n else ""}<renvoi id="{n}">{t}</renvoi></paragraph>{_toc(*inner) if inner else ""}</element>' for n, t, inner in entries) + "</liste>"


PAGES = [
    f"<document>{_head('X')}{_AUTHOR}<synopsis>{_toc(('', 'One', [('I', 'C1', [('I.1', 's', [])]), ('II', 'C2', [])]), ('', 'Two', [('I', 'C3', [])]))}</synopsis><summary></summary></document>",
    f'<document>{_head("One")}<summary><section id="I"><title>C1</title><section id="I.1"><title>s</title><paragraph>P</paragraph></section></section><section id="II"><title>C2</title><paragraph>X</paragraph></section></summary></document>',
    f'<document>{_head("Two")}<summary><section id="I"><title>C3</title></section></summary></document>',
]
CHAPTERS = [
    f"<document>{_head('X')}{_AUTHOR}<synopsis>{_toc(('I', 'C1', []), ('II', 'P', []))}</synopsis><summary></summary></document>",
    f'<document>{_head("C1")}<summary><section id="I"><title>C1</title><paragraph>X</paragraph></section></summary></document>',
    f'<document>{_head("P")}<summary><section id="II"><title>P</title></section></summary></document>',
]


def _pages_sql(pages: list[str], where: str) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey || '/{k}' AS out_path, {_sql(x)} AS xml FROM part WHERE {where}" for k, x in enumerate(pages))


@query("N06 N07 N08 N09 A16", _pages_sql(PAGES, "p_partkey % 2 = 0") + " UNION ALL " + _pages_sql(CHAPTERS, "p_partkey % 2 = 1"))
def books_assembled(t, _):
    """Books with parts give a document of contents and one for each part; books without give one for each chapter."""
    head = HEAD.replace("<article", "<book")
    chapters = "<info><title>X</title></info><chapter><title>C1</title><para>X</para></chapter><chapter><title>P</title></chapter></book>"
    docs = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, _fill(head + BOOK)).otherwise(_fill(head + chapters)).alias("content"))
    return assembly.to_pages(docs, "p_partkey", "content")


CONSTRUCTS = [  # N20 N21 N31 N36 N38 N39 N40
    ('<figure><title>X</title><mediaobject xlink:href="lP"><alt>aP</alt><imageobject><imagedata fileref="P.png"/></imageobject><imageobject><imagedata fileref="other.png"/></imageobject><caption><para>cP</para></caption></mediaobject></figure>',
     '<image src="P.png" titre="X" alt="aP" legende="cP" url="lP"></image>'),
    ('<mediaobject><imageobject><imagedata fileref="poster.png"/></imageobject><videoobject><videodata fileref="P.mp4" role="mp4"/><videodata fileref="P.ogv"/></videoobject></mediaobject>', '<animation width="640" height="480" src="P.mp4" type="mp4"></animation>'),
    ('<mediaobject><audioobject><audiodata fileref="P.ogg"/></audioobject></mediaobject>', '<animation width="640" height="480" src="P.ogg" type="audio"></animation>'),
    ('<mediaobject><imageobject><svg viewBox="0 0 P 1"><circle r="P"/></svg></imageobject></mediaobject>', '<image src="images/document-svg1.svg"></image>'),
    ('<formalgroup><figure><title>X</title><mediaobject><imageobject><imagedata fileref="a.png"/></imageobject></mediaobject></figure></formalgroup>', '<tableau><ligne><colonne><image src="a.png" titre="X"></image></colonne></ligne></tableau>'),
    ("<para>by <personname><firstname>A</firstname><surname>P</surname></personname> <inlinemediaobject><imageobject><imagedata fileref=\"i.png\"/></imageobject></inlinemediaobject></para>", '<paragraph>by A P <image src="i.png"></image></paragraph>'),
    ('<bibliography><title>X</title><bibliodiv><title>D</title><biblioentry xml:id="eP"><title>T</title></biblioentry></bibliodiv></bibliography>', '<section noNumber="1"><title>X</title><section noNumber="1"><title>D</title><signet id="eP"><i>T</i></signet></section></section>'),
]


@query("N20 N21 N31 N36 N38 N39 N40", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_sql('<document>' + _head('X') + _AUTHOR + '<synopsis><paragraph><renvoi id=\"eP\">eP</renvoi></paragraph></synopsis><summary>' + ''.join(b for _, b in CONSTRUCTS) + '</summary></document>')} AS xml FROM part")
def constructs_assembled(t, _):
    docs = t("part").select("p_partkey", _fill(HEAD + "<info><title>X</title></info>" + "".join(a for a, _ in CONSTRUCTS) + "</article>").alias("content"))
    return assembly.to_article(docs, "p_partkey", "content")


@query("N39 F04 A16", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'images/document-svg1.svg' AS name, '<svg viewBox=\"0 0 ' || p_partkey || ' 1\"><circle r=\"' || p_partkey || '\"></circle></svg>' AS svg FROM part UNION ALL SELECT p_partkey, 'images/document-svg2.svg', '<svg>' || p_name || '</svg>' FROM part")
def drawings(t, _):
    """Drawings within documents, each to be a file of its own."""
    docs = t("part").select("p_partkey", _fill(HEAD + '<svg viewBox="0 0 P 1"><circle r="P"/></svg><para><svg>X</svg></para></article>').alias("content"))
    return assembly.drawings(docs, "p_partkey", "content")


@query("N37", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, p_name || ' b ' || p_partkey || ' q' AS text, 'quote' AS unknown FROM part")
def no_formatting(t, _):
    """Nine elements are transparent, eight are silent, and the rest is told."""
    title = "<section><title>X <emphasis role=\"bold\">b</emphasis> <code>P</code><footnote><para>f</para></footnote><indexterm><primary>i</primary></indexterm><anchor xml:id=\"a\"/> <quote>q</quote></title></section></article>"
    return assembly.without_formats(t("part").select("p_partkey", _fill(HEAD + title).alias("content")), "p_partkey", "content").select("doc_id", "text", "unknown")


WARNED = '<?xml-model href="http://docbook.org/xml/5.2/rng/docbook.rng"?><?odd data?><article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" {a}><para {b}><link xlink:href="u" xlink:label="l" xlink:type="simple">X</link></para>{c}</article>'


@query("N34 N30 B11 B12 R-W E14", """SELECT c_nationkey % 2 AS kind, "check", detail, count(*) AS n FROM customer JOIN (VALUES (0, 'instruction_ignored', 'odd'), (0, 'link_attribute', 'label'), (0, 'link_attribute', 'type'), (0, 'unknown_attribute', 'colour'), (0, 'equation_without_tex', 'equation'),
(1, 'instruction_ignored', 'odd'), (1, 'link_attribute', 'label'), (1, 'link_attribute', 'type'), (1, 'unknown_attribute', 'xsi:odd'), (1, 'only_the_first', 'imageobject')) v(k, "check", detail) ON k = c_nationkey % 2 GROUP BY ALL""")
def mapping_warnings(t, _):
    """Attributes of links, unknown attributes, instructions but for the schema's own, equations without TeX, and objects beyond the first."""
    even = WARNED.format(a='version="5.2"', b='colour="red" xml:id="p"', c="<equation><title>e</title></equation>")
    odd = WARNED.format(a='xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:odd="1"', b="", c='<mediaobject><imageobject><imagedata fileref="a"/></imageobject><imageobject><imagedata fileref="b"/></imageobject></mediaobject>')
    docs = t("customer").select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") % 2 == 0, even).otherwise(odd).alias("content"))
    found = assembly.warnings(docs, "c_custkey", "content").join(docs.select(F.col("c_custkey").alias("doc_id"), "c_nationkey"), "doc_id")
    return found.groupBy((F.col("c_nationkey") % 2).alias("kind"), "check", "detail").agg(F.count("*").alias("n"))


@query("O02", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'https://other.org/' || c_custkey AS url, 'https://x.org/' || c_custkey AS expected FROM customer WHERE c_nationkey % 3 = 0")
def url_consistency(t, _):
    """Articles whose address isn't what server and folder make of it."""
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.when(F.col("c_nationkey") % 3 == 0, "https://other.org/").otherwise("https://x.org/"), key)
    xml = F.concat(F.lit("<document><entete><serveur>https://x.org</serveur><chemin>/"), key, F.lit("</chemin><urlhttp>"), url, F.lit("</urlhttp></entete></document>"))
    return assembly.url_findings(t("customer").select("c_custkey", xml.alias("content")), "c_custkey", "content")


SICK = {
    "list_in_para": ("warning", "<para>a<itemizedlist><listitem><para>b</para></listitem></itemizedlist></para>"),
    "content_before_section": ("error", "<para>early</para><section><title>s</title></section>"),
    "cals_table": ("warning", "<informaltable><tgroup><tbody><row><entry>1</entry></row></tbody></tgroup></informaltable>"),
    "one_column_table": ("warning", "<informaltable><tr><td>1</td></tr></informaltable>"),
    "code_in_para": ("warning", "<para><screen>c</screen></para>"),
}


@query("R-S2 R-S3 R-S4 R-S5 R-S6", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, " + " ".join(["CASE c_custkey % 5", *(f"WHEN {k} THEN '{n}'" for k, n in enumerate(SICK)), "END"]) + ' AS "check", ' + " ".join(["CASE c_custkey % 5", *(f"WHEN {k} THEN '{v[0]}'" for k, v in enumerate(SICK.values())), "END"]) + " AS severity FROM customer")
def sanity_each(t, _):
    """Each check of sanity on documents that need it."""
    body = F.element_at(F.array(*(F.lit(HEAD + "<info><title>t</title></info>" + v[1] + "</article>") for v in SICK.values())), (F.col("c_custkey") % 5 + 1).cast("int"))
    return checks.sanity(markup.shredded(t("customer").select("c_custkey", body.alias("content")), "c_custkey", "content")).select("doc_id", "check", "severity")


BACK = HEAD + (
    '<info><title>X</title><titleabbrev>aP</titleabbrev><abstract role="description"><para>dP</para></abstract><keywordset><keyword>k</keyword><keyword>kP</keyword></keywordset>'
    '<author><personname><firstname>A</firstname><surname>X</surname><othername role="pseudonym">nP</othername></personname></author><othercredit class="technicaleditor"><personname>oP</personname></othercredit>'
    '<abstract><para>X</para><para><simplelist><member><link xlink:href="u">X</link></member></simplelist></para></abstract></info><section><title>X</title><para>b</para></section></article>'
)
FORTH = (
    "<document><entete><rubrique>7</rubrique><meta><description>dP</description><keywords>k,kP</keywords></meta><titre><page>aP</page><article>X</article></titre><licauteur>X</licauteur><lictype>2</lictype><licannee>2024</licannee></entete>"
    '<voiraussi><lien><texte>X</texte><url>u</url></lien></voiraussi><authorDescriptions><authorDescription name="nP" role="author"><fullname>A X</fullname></authorDescription><authorDescription name="oP" role="reviewer"><fullname>oP</fullname></authorDescription></authorDescriptions>'
    '<synopsis><paragraph>X</paragraph><paragraph><lien-forum id="P" idpost="1"/></paragraph></synopsis><summary><section id="I"><title>X</title><paragraph>b</paragraph></section></summary></document>'
)


@query("O01 O03 I27", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_sql(BACK)} AS xml FROM part")
def documents_disassembled(t, _):
    """A whole document becomes an article with its info again."""
    return assembly.to_docbook(t("part").select("p_partkey", _fill(FORTH).alias("content")), "p_partkey", "content")


@query("O01 A13 L06", f"""SELECT CAST(p_partkey AS BIGINT) AS doc_id, '{{"forum_post": "1", "forum_topic": "' || p_partkey || '", "licence_author": "' || p_name || '", "licence_number": "2", "licence_year": "2024", "section": "7"}}' AS json FROM part""")
def config_sidecars(t, _):
    """What a document's head says of its configuration, as JSON beside it."""
    return assembly.sidecars(t("part").select("p_partkey", _fill(FORTH).alias("content")), "p_partkey", "content")


BOOK_BACK = HEAD.replace("<article", "<book") + "<info><title>X</title></info><chapter><title>P</title><para>b</para></chapter></book>"
FORMS = [
    ('<image src="P.png" titre="X" alt="a" legende="c" url="l"/>', '<figure><title>X</title><mediaobject xlink:href="l"><alt>a</alt><imageobject><imagedata fileref="P.png"></imagedata></imageobject><caption><para>c</para></caption></mediaobject></figure>'),
    ('<animation src="P.mp4" width="1" height="2" type="mp4" autoplay="1" loop="0"/>', '<mediaobject><videoobject><videodata fileref="P.mp4" width="1" height="2" role="mp4"><multimediaparam name="autoplay" value="1"/><multimediaparam name="loop" value="0"/></videodata></videoobject></mediaobject>'),
    ('<liste type="1" debut="3" titre="X"><element>P</element></liste>', '<orderedlist numeration="arabic" continuation="continues"><title>X</title><listitem><para>P</para></listitem></orderedlist>'),
    ('<tableau titre="X" width="9"><ligne><colonne>P</colonne></ligne></tableau>', '<table width="9"><title>X</title><tr><td>P</td></tr></table>'),
]


@query("O01 O05 O06 O09 O10", f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN {_sql(BOOK_BACK)} ELSE {_sql(HEAD + '<info><title>X</title></info>' + ''.join(b for _, b in FORMS) + '</article>')} END AS xml FROM part")
def forms_disassembled(t, _):
    """Documents of several pages are books; pictures, animations, lists and tables with titles, captions and parameters."""
    head = "<document><entete><titre><page>X</page><article>X</article></titre></entete>"
    book = head + "<multi-page/><summary><section><title>P</title><paragraph>b</paragraph></section></summary></document>"
    content = F.when(F.col("p_partkey") % 2 == 0, _fill(book)).otherwise(_fill(head + "<summary>" + "".join(a for a, _ in FORMS) + "</summary></document>"))
    return assembly.to_docbook(t("part").select("p_partkey", content.alias("content")), "p_partkey", "content")
