"""Workflows over folders, through the command line's own entry."""

import pytest

from vellumix import __main__ as cli
from vellumix.plans import workflows as W

HEAD = '<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.2">'


def page(title, body="<para>x</para>"):
    return f'{HEAD}<info><title>{title}</title><abstract><para>a</para></abstract></info><section xml:id="s"><title>S</title>{body}</section></article>'


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.xml").write_text(page("One", '<para><link xlink:href="two.xml">t</link>&amp;quot;</para>'))
    (d / "two.xml").write_text(page("Two"))
    (d / "index.xml").write_text(page("Index"))
    (d / "empty.xml").write_text("")
    (d / "bad.xml").write_text(HEAD + "<itemizedlist><para/></itemizedlist></article>")
    return d


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_transform_there_and_back(spark, folder, tmp_path, capsys):
    out = tmp_path / "out"
    cli.main(["transform", "--to", "article", "-i", str(folder), "-o", str(out)], spark)
    assert names(out) == ["bad_article.xml", "index_article.xml", "one_article.xml", "two_article.xml"]
    assert "empty: empty" in capsys.readouterr().err
    back = tmp_path / "articles"
    back.mkdir()
    (back / "two.xml").write_text((out / "two_article.xml").read_text())
    got = {r.out_path: r.content for r in W.transform(spark, str(back), "docbook").collect()}
    assert "<section><anchor xml:id=\"s\"></anchor><title>S</title><para>x</para></section>" in got["two_db.xml"]
    with pytest.raises(ValueError):
        W.transform(spark, str(folder), "odt")


def test_transform_without_a_target_drops_nothing(spark, folder, tmp_path, capsys):
    (folder / "art.xml").write_text('<document><entete><titre>A</titre></entete><section><title>S</title><paragraph>p</paragraph></section></document>')
    (folder / "odd.xml").write_text("<svg/>")
    out, words = tmp_path / "out", tmp_path / "words"
    cli.main(["transform", "-i", str(folder), "-o", str(out)], spark)
    assert names(out) == ["art_db.xml", "bad.docx", "index.docx", "one.docx", "two.docx"]
    err = capsys.readouterr().err
    assert "empty: empty" in err and "odd: format_not_recognised" in err
    cli.main(["transform", "-i", str(out), "-o", str(words)], spark)  # and back
    assert names(words) == ["art_db.docx", "bad.xml", "index.xml", "one.xml", "two.xml"]
    assert "<section><title>S</title><para>x</para></section>" in (words / "two.xml").read_text()


def test_merge_writes_files(spark, folder, tmp_path, capsys):
    new = tmp_path / "new"
    new.mkdir()
    (new / "one.xml").write_text(f"{HEAD}<info><title>Proofread</title></info></article>")
    (new / "three.xml").write_text(page("Three"))
    cli.main(["merge", "--with", str(new), "--type", "after_proofreading", "-i", str(folder), "-o", str(tmp_path / "m")], spark)
    assert names(tmp_path / "m") == ["one.xml"] and "<title>Proofread</title><abstract>" in (tmp_path / "m" / "one.xml").read_text()
    err = capsys.readouterr().err
    assert "three.xml: original_lacks" in err and "two.xml: altered_lacks" in err


def test_members(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "c.xml").write_text(f"{HEAD}<classsynopsis/><fieldsynopsis><varname>size</varname></fieldsynopsis><fieldsynopsis><varname>own</varname></fieldsynopsis></article>")
    (b / "c.html").write_text('<h2 id="properties">P</h2><ul><li><b><a href="#s">size</a></b></li></ul>')
    got = W.members_of(spark, str(a), str(b)).collect()
    assert [(r.name, r.check, r.only_docbook, r.only_html) for r in got] == [("c", "properties", "own", "")]


def test_fix_twice(spark, folder):
    got = {r.name: r for r in W.fix(spark, str(folder), "2024-01-01", "<author/>").collect()}
    assert "<pubdate>2024-01-01</pubdate><authorgroup><author/></authorgroup><date>" in got["one"].content and "&quot;" in got["one"].content
    assert got["empty"].content == "" and not got["empty"].changed
    for name, r in got.items():
        (folder / f"{name}.xml").write_text(r.content)
    assert not any(r.changed for r in W.fix(spark, str(folder), "2024-02-02", "<author/>").collect())


def test_validate_and_check(spark, folder):
    assert tuple(W.validate(spark, str(folder)).first()) == (5, 1, 3, 1)
    assert {(r.name, r.check) for r in W.findings(spark, str(folder)).collect()} == {("bad", "child_lacks")}


def test_consistency(spark, folder, tmp_path):
    html = tmp_path / "html"
    html.mkdir()
    (html / "one.html").write_text('<a href="two.html">t</a><a href="three.html">3</a>')
    (html / "more.html").write_text("<p>")
    got = {r.name: r for r in W.consistency(spark, str(folder), str(html)).collect()}
    assert got["more"].status == "missing_docbook" and got["two"].status == "missing_html"
    assert (got["one"].status, got["one"].only_right, got["one"].equal) == ("both", "three", False)


def test_revisions_and_publish(spark, folder, tmp_path):
    new = tmp_path / "new"
    new.mkdir()
    (new / "one.xml").write_text(page("One", "<para>other</para>"))
    (new / "three.xml").write_text(page("Three"))
    (new / "two.xml").write_text(page("Two"))
    flags = {(r.name, r.flag) for r in W.revisions(spark, str(folder), str(new)).collect()}
    assert flags == {("one", "changed"), ("two", "same"), ("three", "added"), ("index", "deleted")}
    out = {r.out_path: r.content for r in W.publish(spark, str(folder), "https://x.org/").collect()}
    assert {"index.xml", "one.xml"} <= set(out) and 'href="https://x.org/two.xml"' in out["one.xml"]
