"""Shredding, mapping in both directions and checks on articles of our own."""

import random

from vellumix.operators import checks, mapping, tree
from vellumix.sources import markup

HEAD = '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'
ARTICLE = (
    HEAD + "<info><title>On trees</title><pubdate>2024-01-02</pubdate><abstract><para>Short.</para></abstract><author><personname>Ann Lee</personname></author></info>"
    '<section xml:id="s1"><title>First</title><para>A &lt;b&gt; and <emphasis role="bold">bold</emphasis>, <code>x<emphasis>y</emphasis></code>, see <xref linkend="s2"/>.</para>'
    '<itemizedlist><listitem><para>one</para></listitem><listitem><para>two</para></listitem></itemizedlist><section><title>Inner</title><para>Text<programlisting language="cpp">int i;</programlisting></para></section></section>'
    '<section xml:id="s2"><title>Second</title><simplelist><member>a</member><member>b</member></simplelist><note><para>N</para></note><orderedlist numeration="loweralpha"><listitem><para>z</para></listitem></orderedlist>'
    '<para><link xlink:href="https://x.org/?a=1&amp;b=2">l</link><link xlink:href="https://forum.example.org/showthread.php?t=12#post34">f</link></para>'
    '<informaltable width="50"><thead><tr><th>h</th></tr></thead><tbody><tr><td>c</td></tr></tbody><tfoot><tr><td>gone</td></tr></tfoot></informaltable></section></article>'
)


def nodes(spark, *texts, fmt="xml"):
    return markup.shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"), "doc_id", "content", fmt)


def test_shredding_and_writing_again(spark):
    r = random.Random(1)

    def some(depth):
        name = r.choice("abc")
        inner = "".join(some(depth - 1) if r.random() < 0.6 and depth else r.choice(["t", "u &amp; v", "é"]) for _ in range(r.randint(0, 4)))
        return f"<{name}>{inner}</{name}>"

    texts = [f"<root>{some(5)}</root>" for _ in range(30)]
    for part in (1, 7):
        got = nodes(spark, *texts).repartition(part)
        out = tree.serialise(got.withColumn("text", mapping.T.xml_escape(mapping.F.col("text"))), mapping.F.concat(mapping.F.lit("<"), "local", mapping.F.lit(">")), mapping.F.concat(mapping.F.lit("</"), "local", mapping.F.lit(">")))
        assert [x.xml for x in out.orderBy("doc_id").collect()] == texts


def test_order_numbers_hold_the_tree(spark):
    rows = nodes(spark, ARTICLE).collect()
    by = {r.pre: r for r in rows}
    assert sorted(by) == list(range(1, len(rows) + 1)) == sorted(r.post for r in rows)
    for r in rows:
        if r.parent:
            up = by[r.parent]
            assert up.pre < r.pre and up.post > r.post and r.depth == up.depth + 1
    assert by[1].ns == "http://docbook.org/ns/docbook"


def test_broken_and_empty_input(spark):
    got = nodes(spark, "<a><b></a>", "", None, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>')
    assert [(r.doc_id, r.kind) for r in got.orderBy("doc_id").collect()] == [(0, "error"), (3, "error")]
    assert {r.check for r in checks.grammar(got).collect()} == {"not_well_formed"}


def test_html_is_lenient(spark):
    got = nodes(spark, "<ul><li>a<li>b</ul><p>x<br>y<p>z <b>q", fmt="html").filter("kind = 'elem'").orderBy("pre").collect()
    assert [(r.local, r.depth) for r in got] == [("ul", 0), ("li", 1), ("li", 1), ("p", 0), ("br", 1), ("p", 0), ("b", 1)]


def test_article_mapping(spark):
    xml = mapping.to_article(nodes(spark, ARTICLE)).first().xml
    for part in (
        "<document><entete><titre>On trees</titre><date>2024-01-02</date><synopsis><paragraph>Short.</paragraph></synopsis>",
        '<auteur role="author"><nom>Ann Lee</nom></auteur>',
        '<section id="I"><signet id="s1"/><title>First</title>',
        "<paragraph>A &lt;b&gt; and <b>bold</b>, <inline>xy</inline>, see <renvoi id=\"s2\">Second</renvoi>.</paragraph>",
        '<liste type="none"><element useText="0"><paragraph>one</paragraph></element>',
        '<section id="I.1"><title>Inner</title><paragraph>Text</paragraph><code langage="cpp">int i;</code></section>',
        '<section id="II">',
        'a, b<rich-imgtext type="info">',
        '<liste type="a">',
        '<link href="https://x.org/?a=1&amp;b=2">l</link><lien-forum id="12" idpost="34">f</lien-forum>',
        '<tableau width="50px"><entete><colonne>h</colonne></entete><ligne><colonne>c</colonne></ligne></tableau>',
    ):
        assert part in xml, part
    assert "gone" not in xml


def test_there_and_back(spark):
    plain = (
        HEAD + "<info><title>T</title><pubdate>2024-01-02</pubdate></info><section><title>S</title><para>a <emphasis>i</emphasis> <superscript>2</superscript></para>"
        "<itemizedlist><listitem><para>x</para></listitem></itemizedlist><tip><para>hint</para></tip><section><title>U</title><para>b</para></section></section></article>"
    )
    there = mapping.to_article(nodes(spark, plain)).first().xml
    assert mapping.to_docbook(nodes(spark, there)).first().xml == plain


def test_unknown_elements_are_findings(spark):
    got = mapping.unknown_elements(nodes(spark, HEAD + "<para><blink>x</blink></para></article>"), mapping.article_rules(), mapping.DROPPED)
    assert [r.element for r in got.collect()] == ["blink"]


def test_sanity_checks(spark):
    bad = "<book><chapter><para>early<itemizedlist><listitem/></itemizedlist><screen>x</screen></para><section><title>s</title><informaltable><tr><td>1</td></tr></informaltable><table><tgroup/></table></section></chapter></book>"
    got = {(r.check, r.severity) for r in checks.sanity(nodes(spark, bad)).collect()}
    assert got == {("root", "warning"), ("list_in_para", "warning"), ("code_in_para", "warning"), ("cals_table", "warning"), ("content_before_section", "error"), ("one_column_table", "warning")}
    assert sorted(r.check for r in checks.sanity(nodes(spark, ARTICLE)).collect()) == ["code_in_para", "one_column_table"]
    assert checks.grammar(nodes(spark, ARTICLE)).count() == 0


def test_reading_folders(spark, tmp_path):
    for name in ("a.xml", "search-results.xml", "b.txt", "in/c.xml", "in/deep/d.xml"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("<x/>")
    names = lambda depth: sorted(r.name for r in markup.read_folder(spark, str(tmp_path), depth=depth).collect())
    assert names(1) == ["a"] and names(2) == ["a", "c"] and names(None) == ["a", "c", "d"]
    assert markup.write_files(spark.createDataFrame([("p1", "one"), ("p2", "two")], "out_path string, content string"), str(tmp_path / "out")) == 2
    assert spark.read.text(str(tmp_path / "out" / "p2")).first().value == "two"
