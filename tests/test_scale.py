"""Steps over many small documents: over all cores, in bounded memory, and the same results by either reading of the rules."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumix.operators import mapping, revise
from vellumix.plans import constructs
from vellumix.sources import assembly, context, markup, members, office, shared

HEAD = constructs.HEAD


def fill(text: str, k: int) -> str:
    return constructs._marked(text).replace("{x}", f"a <part> &amp; {k}".replace("<part>", "part")).replace("{p}", str(k))


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """A table in one file of one row group, which a scan gives as one task."""
    path = str(tmp_path_factory.mktemp("scale") / "docs.parquet")
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(HEAD + "<info><title>t"), F.col("id").cast("string"), F.lit("</title></info><para>p</para></article>")).alias("content"))
    rows.coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert df.rdd.getNumPartitions() == 1
    return df


def test_documents_of_one_file_go_over_all_cores(spark, one_file):
    steps = {
        "to_article": assembly.to_article(one_file, "doc_id", "content"),
        "to_pages": assembly.to_pages(one_file, "doc_id", "content"),
        "to_docbook": assembly.to_docbook(one_file, "doc_id", "content"),
        "sidecars": assembly.sidecars(one_file, "doc_id", "content"),
        "shred": markup.shred(one_file, "doc_id", "content"),
        "to_word": office.to_word(one_file, "doc_id", "content"),
        "members": members.members(one_file, "doc_id", "content", "docbook"),
        "merge": revise.merge_documents(one_file, "doc_id", "content", "content", "update"),
    }
    for name, df in steps.items():
        used = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism, name
    assert {r.n for r in steps["to_article"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1}
    assert steps["to_word"].select("doc_id").distinct().count() == steps["shred"].select("doc_id").distinct().count() == 400


def test_rules_are_the_same_in_either_reading(spark):
    """Nodes that are changed after the parser gave them are mapped by columns, others by calls."""
    more = '<para><link xlink:href="https://forum.example.org/?t=0012#post7">f</link><link href="/d/5">d</link><xref linkend="s"/><biblioref endterm="e"/><phrase role="color:red">r</phrase></para><informaltable width=" 12 "><tr><td>1</td></tr></informaltable><inlineequation><alt>a</alt></inlineequation>'
    there = [HEAD + "".join(a for a, _ in constructs.THERE) + more + '<section xml:id="s"><title>X</title></section></article>', HEAD + "<?pi x?><para>early</para><section/></article>", "<broken", "<section/>"]
    df = spark.createDataFrame([(k, fill(t, k)) for k, t in enumerate(there)], "doc_id long, content string")
    told = context.in_context(df, "doc_id", "content", dropped=mapping.DROPPED)
    assert sorted(mapping.to_article(told).collect()) == sorted(mapping.to_article(told.select("*")).collect())
    back = ["<document>" + "".join(a for a, _ in constructs.BACK) + '<liste type="1" debut="2" titre="t"><element>x</element></liste><tableau titre="t" border="1"><ligne/></tableau></document>', "<latex>x</latex>", "<livre><chapitre/></livre>"]
    df = spark.createDataFrame([(k, fill(t, k)) for k, t in enumerate(back)], "doc_id long, content string")
    told = context.in_context(df, "doc_id", "content")
    assert sorted(mapping.to_docbook(told).collect()) == sorted(mapping.to_docbook(told.select("*")).collect())


def test_pieces_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x" * 10_000] * 5000)], ["doc_id", "content"])
    cut = list(shared.pieces([batch]))
    assert sum(b.num_rows for b in cut) == 5000 and max(b.nbytes for b in cut) <= shared.PIECE_BYTES and max(b.num_rows for b in cut) <= shared.PIECE_ROWS
    assert [b.num_rows for b in shared.pieces([batch.slice(0, 1), batch.slice(0, 0)])] == [1]


def test_lists_are_counted_where_they_are_parsed(spark):
    """What is counted of a document is what its nodes in context say."""
    xml = HEAD + "<para>a</para><itemizedlist><listitem><para>x</para></listitem><listitem>t</listitem><listitem><para>y</para><note/></listitem><listitem/></itemizedlist><quote><para>1</para><para>2</para></quote></article>"
    rows = markup.shred_xml(xml)
    told = context.in_context(spark.createDataFrame([(1, xml)], "doc_id long, content string"), "doc_id", "content").filter("local = 'para'").select(mapping.para_admitted().alias("ok")).collect()
    assert mapping.paras_counted(rows) == [(sum(r.ok for r in told), sum(not r.ok for r in told))] == [(4, 1)]
    assert mapping.items_counted(rows) == [(3, 4)] and mapping.items_counted(markup.shred_xml("<para/>")) == mapping.paras_counted(markup.shred_xml("<a/>")) == []


def test_grammar_is_the_same_in_either_reading_and_joins_nothing(spark):
    from vellumix.operators import checks
    from vellumix.plans import extras

    texts = [extras.DB + x + "</article>" for *_, x in extras.FAULTS] + [f"<document><entete></entete>{x}</document>" for *_, x in extras.ARTICLE_FAULTS] + ["<broken", "<section/>", "<article><itemizedlist/><listitem/></article>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    for tables in ((), checks.ARTICLE):
        found = checks.grammar(context.in_context(df, "doc_id", "content"), *tables)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan  # AQE broadcasts what is small when compressed, through the driver
        mine = markup.each(df, "doc_id", "content", lambda nodes, tables=tables: checks.judged(nodes, *tables), "pre int, check string, severity string, element string")
        assert sorted(map(str, found.select("doc_id", "pre", "check", "severity", "element").collect())) == sorted(map(str, mine.collect()))


def test_headings_cut_within_a_reference(spark, tmp_path):
    from vellumix.plans import catalog

    spark.createDataFrame([(1, "u", "<html><h1>a &amp; b&amp</h1></html>"), (2, "u", "<h1>&&amp</h1>"), (3, "u", "<h1>x &quot;y&amp;quot;</h1>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.title for r in catalog.QUERIES["page_headings"](spark, str(tmp_path)).collect()}
    assert got == {1: "a & b&amp", 2: "&&amp", 3: "x &quot;y&quot;"}


def test_members_of_a_long_page(spark):
    """What stands before an element is found without going through all that do."""
    import time

    n = 20_000
    xml = HEAD + "<classsynopsis/>" + "".join(f"<enumsynopsis><enumname>e{k}</enumname></enumsynopsis><typedefsynopsis><typedefname>e{k}s</typedefname></typedefsynopsis>" for k in range(n)) + "<fieldsynopsis/><typedefsynopsis><typedefname>own</typedefname></typedefsynopsis></article>"
    began = time.process_time()
    is_class, found = members.of_docbook(xml)
    assert is_class and len(found) == n + 1 and ("types", "own") in found and ("types", "e0s") not in found
    assert time.process_time() - began < 10


def test_what_is_told_of_one_document_is_what_joins_tell(spark):
    from vellumix.operators import articles
    from vellumix.sources import word

    info = fill(constructs.INFO, 3) + fill(constructs.PEOPLE, 3) + fill(constructs.LINKS, 3)
    odd = "<info><title> A\n <emphasis>b</emphasis></title><abstract/><keywordset><keyword/><keyword>k</keyword></keywordset><author class='translator'><personname><surname> z </surname><surname>a</surname></personname></author><author><othername>o</othername></author></info>"
    words = constructs._marked(constructs.WORDS.replace("{i}", "<emphasis>v</emphasis>")).replace("{x}", "x").replace("{p}", "7")
    deep = "<section>" * 11 + "<title>t</title>" + "</section>" * 11 + '<para>a<emphasis role="strike">s<subscript>1<superscript>2</superscript></subscript></emphasis><link xlink:href="b">l<link linkend="c">m</link></link><para>inner</para>rest</para><tip><orderedlist><listitem><screen>c</screen></listitem></orderedlist></tip>'
    texts = [HEAD + x + "</article>" for x in (info + "<section><title>s</title></section>", odd, words, deep, "<para/>", "text")] + ["<para>root</para>", "<broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    nodes = markup.shredded(df, "doc_id", "content")
    rows = {k: markup.shred_xml(t) for k, t in enumerate(texts)}
    same = lambda found, mine: sorted(map(str, map(tuple, found.collect()))) == sorted(str((k, *x)) for k, r in rows.items() for x in mine(r))
    assert same(articles.header(nodes), articles.header_of) and same(articles.authors(nodes), articles.authors_of)
    files = {r.doc_id: bytes(r.file) for r in word.files_of(df, "doc_id", "content").collect()}
    assert files == {r.doc_id: bytes(r.file) for r in word.write(word.paragraphs_of(nodes)).collect()} and len(files) == 5
    assert "Join" not in word.files_of(df, "doc_id", "content")._jdf.queryExecution().executedPlan().toString()


def test_plain_html_gives_what_the_parser_gives():
    row = '<tr><td>int</td><td class="a b"><b><a href="#1">m1</a></b><br/>x<br></td></tr>'
    odd = ["", "a & b&amp", "<p>x&amp<b>y", "<p>&#6&;x<p>y", "<b><p>z</b></p>", "<li>a<li>b</ul>", "</p>", "<p >x", "<P>x</P>", "a < b", "<p/>t", '<td a="1" a="2">x', '<a href="x&amp;y">z</a>', "<!-- c --><p>", "<title>a<b>c</title>", "\n<p>\n", "x<", "x<p", "<a b>", "<script>a<b</script>", '<p a="">', f"<table>{row * 3}</table>"]
    for text in odd:
        p = markup._Html()
        p.feed(text)
        p.close()
        assert markup.shred_html(text) == p.out.done(), text
    assert markup._plain_html(f"<table>{row}</table>") is not None and markup._plain_html("<!-- c -->") is None
