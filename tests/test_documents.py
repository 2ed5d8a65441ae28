"""Whole documents: what happens to nulls, empty and broken ones, long ones, and columns of clashing names; plans with few exchanges."""

import pytest
from pyspark.sql import functions as F

from vellumix.operators import include, mapping, repair, revise
from vellumix.sources import assembly, context, markup, members, office, shared

HEAD = '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, content string").selectExpr("*", "1 AS file", "2 AS xml", "3 AS problems", "4 AS pre", "5 AS gone")


def test_office_cases(spark):
    long = HEAD + "<title>L</title>" + "<para>word</para>" * 20_000 + "</article>"
    deep = HEAD + "<title>D</title>" + "<section><title>s</title>" * 12 + "</section>" * 12 + "</article>"
    df = docs(spark, None, "", "<article", "<html/>", '<!DOCTYPE a [<!ENTITY x "y">]><article>&x;</article>', long, deep, HEAD + "</article>")
    got = {r.doc_id: r for r in office.to_word(df, "doc_id", "content").collect()}
    assert [got[i].file is None for i in range(8)] == [True] * 5 + [False] * 3
    assert got[3].problems == ["root: html"] and got[4].problems == ["not_well_formed: entities may not be declared"] and got[6].problems == ["sections_too_deep"]
    files = spark.createDataFrame([(i, got[i].file) for i in got] + [(9, bytearray(b"no zip"))], "doc_id long, file binary")
    back = {r.doc_id: r for r in office.from_word(files, "doc_id", "file").collect()}
    assert back[5].xml.count("<para>word</para>") == 20_000 and back[9].xml is None and back[0].problems == ["empty"]
    assert back[7].xml == HEAD + "</article>" and back[7].problems == ["no_title"]
    assert office.to_word(df.limit(0), "doc_id", "content").count() == office.from_word(files.limit(0), "doc_id", "file").count() == 0


def test_lists_of_other_makers(spark):
    """A list is ordered by what the file's own definitions say, whatever its number."""
    made, _ = office.to_file(HEAD + "<title>T</title><orderedlist><listitem><para>a</para></listitem></orderedlist></article>")
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(made)) as z, zipfile.ZipFile(out, "w") as y:
        for n in z.namelist():
            data = z.read(n)
            y.writestr(n, data.replace(b'w:numId w:val="1"', b'w:numId w:val="77"').replace(b'w:num w:numId="1"', b'w:num w:numId="77"'))
    assert "<orderedlist><listitem><para>a</para></listitem></orderedlist>" in office.from_file(out.getvalue())[0]


def test_mappings_need_one_exchange(spark):
    df = docs(spark, HEAD + "<info><title>t</title></info><section><title>s</title><para>p</para></section></article>")
    for made in (mapping.to_article(context.in_context(df, "doc_id", "content", dropped=mapping.DROPPED)), assembly.to_article(df, "doc_id", "content"), assembly.to_docbook(df, "doc_id", "content")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    assert office.to_word(df, "doc_id", "content")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_context_equals_windows(spark):
    """What the parser tells is what windows and joins over the nodes find."""
    text = HEAD + (
        "<info><title>t</title></info><para>early<note><para>n</para></note><tip><para>u</para></tip></para><section xml:id='a'><title>A</title><para><code>c<emphasis>e</emphasis></code></para><section><title>B</title></section><section/></section>"
        "<section><title>C</title><table><thead><tr><th>h</th></tr></thead><tr><td>d</td></tr></table><para><xref linkend='a'/><biblioref endterm='x'/><biblioref endterm='y'/><biblioref endterm='x'/></para></section></article>"
    )
    df = docs(spark, text, text.replace("early", "later"))
    told = context.in_context(df, "doc_id", "content", dropped=mapping.DROPPED)
    nodes = markup.shred(df, "doc_id", "content")
    windows = mapping.context(nodes).join(mapping.section_numbers(nodes), ["doc_id", "pre"], "left")
    cols = ["doc_id", "pre", "parent_local", "before", "nth", "in_code", "in_head", "splits", "split", "number"]
    assert sorted(map(str, told.select(cols).collect())) == sorted(map(str, windows.select(cols).collect()))
    assert {r.xml for r in mapping.to_article(told).collect()} == {r.xml for r in mapping.to_article(nodes).collect()}


def test_assembly_cases(spark):
    df = docs(spark, None, "", "<broken", "<article/>", "<article><title>only</title></article>", "<html><p>x</p></html>")
    got = {r.doc_id: r.xml for r in assembly.to_article(df, "doc_id", "content").collect()}
    assert set(got) == {2, 3, 4, 5} and got[5] == "x" and "<document>" in got[4]
    assert assembly.to_article(df.limit(0), "doc_id", "content").count() == assembly.to_pages(df.limit(0), "doc_id", "content").count() == 0


def test_pages_are_mapped_whole(spark):
    """The text of a page's mapping is that of the page but for what is dropped, and shredding counts each tag."""
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/x>n</a></nav><article><p>one <b>two</b><p>three<ul><li>four<li>five</ul></article></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    xml = {r.doc_id: r.xml for r in mapping.html_to_article(context.in_context(df, "page_id", "html", "html", mapping.HTML_DROPPED)).collect()}
    assert xml == {1: '<document><titre>T</titre><section><paragraph>one <b>two</b></paragraph><paragraph>three</paragraph><liste type="none"><element>four</element><element>five</element></liste></section></document>'}
    n = {r.local: r["count"] for r in markup.shred(df, "page_id", "html", "html").filter("kind = 'elem'").groupBy("local").count().collect()}
    assert (n["p"], n["li"], n["b"], n["script"], n["a"]) == (2, 2, 1, 1, 1)


def test_include_cases(spark):
    inc = '<xi:include href="%s"/>'
    rows = [("a", f"<a>{inc % 'b'}{inc % 'b'}</a>"), ("b", '<?xml version="1.0"?>\n<!DOCTYPE b>\n<b/>'), ("loop", f"<l>{inc % 'loop'}</l>"), ("n", None), ("none", "")]
    got = {r.name: r for r in include.expand(spark.createDataFrame(rows, "name string, content string"), "name", "content").collect()}
    assert (got["a"].content, got["b"].content, got["n"].content, got["none"].content) == ("<a><b/><b/></a>", "<b/>", "", "")
    assert got["loop"].content == "<l>" * 6 + "</l>" * 6 and got["loop"].missing == "loop"


def test_merge_and_member_cases(spark):
    df = spark.createDataFrame([(None, None, None), ("b", "<x", HEAD + "</article>"), ("c", "", HEAD + "</article>")], "k string, o string, n string")
    got = revise.merge_documents(df, "k", "o", "n", "update").collect()
    assert [r.content for r in got] == [None] * 3 and [r.problems[0] for r in got] == ["original_lacks", "original_not_well_formed", "original_not_well_formed"]
    with pytest.raises(ValueError):
        revise.merge_documents(df, "k", "o", "n", "other")
    for fmt in ("docbook", "html"):
        assert {r.check for r in members.members(docs(spark, None, "", "<broken <p", "<p>"), "doc_id", "content", fmt).collect()} == {None}


def test_rules_of_a_prefix_and_long_texts(spark):
    text = '<db:section xml:id=""><db:term>Since:</db:term>'
    long = "<para>" + "a <simplelist><member>x</member></simplelist> " * 50_000
    df = spark.createDataFrame([("a.xml", text), ("b.xml", long), ("c.xml", None)], "name string, content string")
    got = {r.name: r for r in repair.repair_documents(df, "name", "content", repair.BOTH).collect()}
    assert got["a.xml"].content == "<db:section><db:term>Since</db:term>" and len(got["b.xml"].content) == len(long) and got["c.xml"].content is None


def test_files_are_written_by_name(spark, tmp_path):
    df = spark.createDataFrame([("a/x.txt", "1", None), ("y.bin", None, bytearray(b"2")), ("../out", "3", None), ("none", None, None)], "out_path string, content string, file binary")
    assert markup.write_files(df, str(tmp_path)) == markup.write_files(df, f"file://{tmp_path}") == 2
    assert (tmp_path / "a" / "x.txt").read_text() == "1" and (tmp_path / "y.bin").read_bytes() == b"2"
    assert [(r.path.rpartition("/")[2], r.size) for r in markup.listing(spark, str(tmp_path), "txt", True).collect()] == [("x.txt", 1)]


def test_a_shared_folder_is_there(spark):
    assert shared.shared_folder(spark)
    t = shared.cut(spark.range(3).select(F.col("id")))
    assert t.count() == 3
    shared.drop(t)
