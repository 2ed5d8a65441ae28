"""Word-processing files: round trips, formats and nesting."""

from vellumix.sources import markup, word

HEAD = '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'
BODY = (
    "<info><title>T</title></info><section><title>One</title><para>a <emphasis role=\"bold\">b</emphasis><emphasis>i</emphasis> <code>c</code> x<superscript>2</superscript></para>"
    "<itemizedlist><listitem><para>p</para></listitem><listitem><para>q</para></listitem></itemizedlist>"
    "<section><title>Inner</title><note><para>n1</para><para>n2</para></note><programlisting>int i;</programlisting></section></section>"
    "<section><title>Two</title><orderedlist><listitem><para>z</para></listitem></orderedlist><para><link xlink:href=\"https://x.org/?a=1&amp;b=2\">l</link></para></section>"
)


def paras(spark, *bodies):
    docs = spark.createDataFrame([(i, HEAD + b + "</article>") for i, b in enumerate(bodies)], "doc_id long, content string")
    return word.paragraphs_of(markup.shred(docs, "doc_id", "content"))


def test_paragraphs_survive_the_file(spark):
    df = paras(spark, BODY, "<para>only &lt;text&gt;</para>")
    back = word.read(word.write(df), "doc_id", "file")
    key = lambda r: (r.doc_id, r.pos)
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
    assert sorted(map(tuple, word.write(df).collect())) == sorted(map(tuple, word.write(df.repartition(3)).collect()))


def test_styles_and_lists(spark):
    got = [(r.style, r.num_id, r.num_lvl) for r in paras(spark, BODY).orderBy("pos").collect()]
    assert got == [("Title", None, None), ("Heading1", None, None), ("Normal", None, None), ("Normal", "1", 0), ("Normal", "1", 0), ("Heading2", None, None), ("Note", None, None), ("Note", None, None), ("ProgramListing", None, None), ("Heading1", None, None), ("Normal", "2", 0), ("Normal", None, None)]


def test_article_and_back(spark):
    xml = word.to_docbook(word.read(word.write(paras(spark, BODY)), "doc_id", "file")).first().xml
    assert xml == HEAD + BODY + "</article>"


def test_empty_input(spark):
    df = paras(spark, BODY).limit(0)
    assert word.write(df).count() == 0 and word.to_docbook(df).count() == 0
    assert word.read(spark.createDataFrame([(1, None)], "doc_id long, file binary"), "doc_id", "file").count() == 0


def test_tables_and_images(spark):
    file = word._file([], [[["a", ""], ["<c>", "d"]], [["x"]]], {"p.png": b"\x89PNG", "q.jpg": b"J"})
    df = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(word._file([])))], "doc_id long, file binary")
    found = word.cells(df, "doc_id", "file")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 1, "a"), (1, 1, 1, 2, ""), (1, 1, 2, 1, "<c>"), (1, 1, 2, 2, "d"), (1, 2, 1, 1, "x")]
    xml = {r.tbl: r.xml for r in word.tables_docbook(found).collect()}
    assert xml == {1: "<informaltable><tr><td><para>a</para></td><td></td></tr><tr><td><para>&lt;c&gt;</para></td><td><para>d</para></td></tr></informaltable>", 2: "<informaltable><tr><td><para>x</para></td></tr></informaltable>"}
    assert sorted((r.doc_id, r.name, bytes(r.image)) for r in word.images(df, "doc_id", "file").collect()) == [(1, "p.png", b"\x89PNG"), (1, "q.jpg", b"J")]


def test_properties(spark):
    people = "<author><personname>Ann Lee</personname></author><author><orgname>Org</orgname></author>"
    docs = spark.createDataFrame([(1, HEAD + f"<info><title>Root</title>{people}</info><section><title>Below</title></section></article>")], "doc_id long, content string")
    assert tuple(word.properties(markup.shred(docs, "doc_id", "content")).first()) == (1, "Root", "Ann Lee; Org")
