"""Whole documents through word-processing files and back, one kind of content each (A10, A11, D19, D20, F13-F15, P, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import office, word
from .constructs import HEAD, _fill, _sql
from .registry import query

TITLE = "<info><title>X</title></info>"
BODIES = {
    "office_metadata": (
        "P02 P03 Q03 Q06 P04",
        "<info><title>X</title><author><personname><firstname>A</firstname><surname>X</surname></personname><email>eP@x.org</email></author><editor><personname>E P</personname></editor>"
        '<othercredit class="reviewer"><orgname>oP &amp; Co</orgname></othercredit><pubdate>2024-01-02</pubdate><date>P</date><abstract><para>About <emphasis>X</emphasis></para><para>More</para></abstract></info><para>b</para>',
    ),
    "office_tables": (
        "P08 Q09 A10",
        TITLE + "<para>before</para><table><caption>Table P</caption><tr><td><para>X</para></td><td></td></tr><tr><td><para>a</para><para>b</para></td><td><itemizedlist><listitem><para>P</para></listitem></itemizedlist></td></tr></table>"
        "<para>between</para><informaltable><tr><td><para>P</para></td></tr></informaltable><para>behind</para>",
    ),
    "office_pictures": (
        "P10 Q05 Q07 F16 A10",
        TITLE + '<figure><title>Figure P</title><mediaobject><imageobject><imagedata fileref="images/P.png" width="3cm" depth="40px"/></imageobject><caption><para>X</para></caption></mediaobject></figure>'
        '<mediaobject><imageobject><imagedata fileref="bP.png"/></imageobject></mediaobject><para>in <inlinemediaobject><imageobject><imagedata fileref="c.png"/></imageobject></inlinemediaobject> line</para>',
    ),
    "office_footnotes": ("P06 P07 D19 D21 Q10", TITLE + '<section><title>X</title><para>a<footnote><para>note <emphasis role="bold">P</emphasis></para><para>two</para></footnote> <link xlink:href="https://x.org/?a=1&amp;b=P">l</link><footnote><para>X</para></footnote></para></section>'),
    "office_lists": (
        "P11 P15 Q08 F11 D20",
        TITLE + "<itemizedlist><listitem><para>X</para><para>more</para><orderedlist><listitem><para>P</para></listitem><listitem><para>2</para><itemizedlist><listitem><para>deep</para></listitem></itemizedlist></listitem></orderedlist></listitem>"
        "<listitem><para>b</para></listitem></itemizedlist><orderedlist><listitem><para>n</para></listitem></orderedlist><orderedlist><listitem><para>again P</para></listitem></orderedlist>",
    ),
    "office_named_lists": (
        "P11 F14 F15 Q08",
        TITLE + "<variablelist><varlistentry><term>X</term><term>P</term><listitem><para>d</para><para>e</para></listitem></varlistentry><varlistentry><term>t</term><listitem><para>f</para></listitem></varlistentry></variablelist>"
        "<segmentedlist><segtitle>A</segtitle><segtitle>B</segtitle><seglistitem><seg>X</seg><seg>P</seg></seglistitem><seglistitem><seg>3</seg><seg>4</seg></seglistitem></segmentedlist>",
    ),
    "office_listings": (
        "P09 Q06 P05 Q08 P14",
        TITLE + '<programlisting language="cpp" role="bad">int P;\n  y</programlisting><screen>$ X</screen><note><para>X</para><para>m</para></note><tip><para>P</para></tip><para><code>a<replaceable>b</replaceable></code><emphasis role="bold">b<emphasis>X</emphasis></emphasis> x<superscript>P</superscript></para>',
    ),
}
BOOK = HEAD.replace("<article", "<book") + (
    "<info><title>X</title></info><part><info><title>One</title></info><chapter><info><title>C1</title></info><section><title>s</title><para>P</para></section></chapter><chapter><info><title>C2</title></info><para>X</para></chapter></part>"
    "<part><info><title>Two</title></info><chapter><info><title>C3</title></info></chapter></part></book>"
)


def _round_trip(name: str, operators: str, xml: str) -> None:
    def run(t, _):
        files = office.to_word(t("part").select("p_partkey", _fill(xml).alias("content")), "p_partkey", "content")
        back = office.from_word(files, "doc_id", "file")
        return back.select("doc_id", "xml", F.size("problems").alias("n_problems"))

    run.__name__, run.__doc__ = name, "The document is the same after it was a word-processing file."
    query(operators, f"SELECT CAST(p_partkey AS BIGINT) AS doc_id, {_sql(xml)} AS xml, CAST(0 AS INTEGER) AS n_problems FROM part")(run)


for _name, (_operators, _body) in BODIES.items():
    _round_trip(_name, _operators, HEAD + _body + "</article>")
_round_trip("office_books", "P01 F12 F13 Q01 Q02 Q04 N06", BOOK)


@query("A11 Q07", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, '1-' || p_partkey || '.png' AS name, md5(p_name) AS image_md5 FROM part")
def office_images(t, _):
    """Pictures packed into files come out again, byte for byte."""
    xml = HEAD + TITLE + '<mediaobject><imageobject><imagedata fileref="images/P.png"/></imageobject></mediaobject></article>'
    name = F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    docs = t("part").select("p_partkey", _fill(xml).alias("content"), F.create_map(name, F.col("p_name").cast("binary")).alias("pictures"))
    files = office.to_word(docs, "p_partkey", "content", "pictures")
    return word.images(files, "doc_id", "file").select("doc_id", "name", F.md5("image").alias("image_md5"))


@query("P12 P01 R-W", """SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'bad_nesting:part' WHEN 1 THEN 'cals_table' WHEN 2 THEN 'unknown_block:weird' WHEN 3 THEN 'unknown_inline:odd' ELSE 'root: set' END AS problem FROM customer""")
def office_problems(t, _):
    """What word-processing files can't hold is told."""
    pieces = ["<part><title>p</title></part>", "<informaltable><tgroup><tbody><row><entry>e</entry></row></tbody></tgroup></informaltable>", "<weird><para>w</para></weird>", "<para><odd>o</odd></para>"]
    k = (F.col("c_custkey") % 5).cast("int")
    body = F.when(k < 4, F.concat(F.lit(HEAD + TITLE), F.element_at(F.array(*map(F.lit, pieces)), F.least(k, F.lit(3)) + 1), F.lit("</article>"))).otherwise("<set/>")
    files = office.to_word(t("customer").select("c_custkey", body.alias("content")), "c_custkey", "content")
    return files.select("doc_id", F.explode("problems").alias("problem"))
