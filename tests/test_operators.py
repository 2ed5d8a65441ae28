"""Properties of operators: idempotence, symmetry, and results that don't depend on partitions."""

import pytest
from pyspark.sql import functions as F

from vellumix.functions import numbers as N
from vellumix.functions import text as T
from vellumix.operators import lookup, merge, reconcile, repair, sequence, sets


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


def test_roman_numerals(spark):
    def want(n):
        out = ""
        for s, k in N.ROMAN:
            out, n = out + s * (n // k), n % k
        return out

    got = spark.range(0, 4001).select("id", N.roman(F.col("id")).alias("r")).collect()
    assert all(r.r == (want(r.id) if 1 <= r.id <= 3999 else "") for r in got)


@pytest.mark.parametrize(("text", "want"), [("6.5", (6, 5, None)), ("6.5.3", (6, 5, 3)), ("6", None), ("a.b", None), ("1.2.3.4", None)])
def test_versions(spark, text, want):
    got = one(spark, text, N.version(F.col("v")))
    assert (tuple(got) if got else None) == want


def test_dates(spark):
    for text, want in (("31/12/2023", "2023-12-31"), ("2018-09-09+02:00", "2018-09-09"), ("2018-09-09", "2018-09-09"), ("soon", None), ("2018-09-09Z", "2018-09-09")):
        got = one(spark, text, N.any_date(F.col("v")))
        assert (str(got) if got else None) == want


def test_text_functions(spark):
    c = F.col("v")
    cases = [
        ("  a \n b ", T.normalize_space(c), "a b"), ("motor car", T.xpath_substring(c, 0, 3), "mo"), ("a/b/c", T.substring_after(c, "/"), "b/c"), ("abc", T.substring_after(c, "/"), ""),
        ("A::B::c", T.member_name(c), "c"), ("db:para", T.local_name(c), "para"), ("Hello, World!", T.slug(c), "hello-world"), ("Ann Mary Lee", T.family_name(c), "Mary Lee"), ("Ann", T.family_name(c), ""),
        ("https://f.org/d12-x/p34", T.forum_topic(c), 12), ("https://f.org/x?t=7#post8", T.forum_post(c), 8), ("https://v.org/watch?v=Q", T.video_embed(c), "https://v.org/embed/Q"),
        ("Date: 2024", T.label_value(c), "2024"), ("no label", T.label_value(c), None), ("12cm", N.to_emu(c), 4320000), ("12ells", N.to_emu(c), None), ("<&>", T.xml_unescape(T.xml_escape(c)), "<&>"),
    ]
    for value, column, want in cases:
        assert one(spark, value, column) == want, value


def test_repair(spark):
    text = '<section xml:id=""><para> <para>x</para>\n</para><anchor xml:id="a"/> <section xml:id="a"><link href="">t</link><term>Since:</term> &amp;quot; <tr>1</tr>'
    docs = spark.createDataFrame([("intro.xml", text + "<table>"), ("other.xml", text), ("clean.xml", "<p>fine</p>"), ("intro-clean.xml", "<table>1</table>"), ("empty.xml", "")], "name string, content string")
    once = repair.repair_documents(docs, "name", "content")
    got = {r.name: r for r in once.collect()}
    assert got["other.xml"].content == '<section><para>x</para><section xml:id="a">t<term>Since</term> &quot; <tr>1</tr>'
    assert "<informaltable>" in got["intro.xml"].content and got["intro-clean.xml"].content == "<table>1</table>"
    assert {n for n, r in got.items() if r.changed} == {"intro.xml", "other.xml"}
    assert tuple(repair.counters(once, "content").first()) == (5, 2, 1)
    again = repair.repair_documents(once.drop("changed"), "name", "content")
    assert again.filter("changed").count() == 0
    new = repair.inject_after(F.col("v"), "abstract", "<d/>", "<d/>")
    assert one(spark, "<abstract>a</abstract>b", new) == one(spark, "<abstract>a</abstract><d/>b", new) == "<abstract>a</abstract><d/>b"
    link = T.flatten_link(F.col("v"))
    assert one(spark, '<a href="../m/n/x.xml"/>', link) == one(spark, '<a href="x.xml"/>', link) == '<a href="x.xml"/>'


def test_many_rules_stay_small(spark):
    rules = tuple(repair.Rule(f"a{i}", f"b{i}", "x" if i % 2 else "") for i in range(80))
    docs = spark.createDataFrame([("x", "a1 a2 a79"), ("y", "a1 a2 a79")], "name string, content string")
    assert [r.content for r in repair.repair_documents(docs, "name", "content", rules).orderBy("name").collect()] == ["b1 b2 b79", "a1 b2 a79"]


def test_reconcile_is_symmetric(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("abcc", "bcd"))
    there, back = reconcile.reconcile(a, b, ["k"]), reconcile.reconcile(b, a, ["k"])
    turn = {"both": "both", "missing_left": "missing_right", "missing_right": "missing_left"}
    assert {(r.k, r.status) for r in there.collect()} == {(r.k, turn[r.status]) for r in back.collect()} == {("a", "missing_right"), ("b", "both"), ("c", "both"), ("d", "missing_left")}
    assert {r.k for r in sets.symmetric_difference(a, b).collect()} == {"a", "d"}


def test_list_moves_close_all_they_open(spark):
    import random

    r = random.Random(3)
    rows = []
    for d in range(40):
        level = 0
        for pos in range(30):
            kind = r.choice(["1", "1", "1", None])
            level = 0 if not pos or rows[-1][2] != kind else max(0, min(level + r.choice([-2, -1, 0, 0, 1]), 8))
            rows.append((d, pos, kind, level))
    df = spark.createDataFrame(rows, "doc_id long, pos int, num_id string, num_lvl int")
    for n in (1, 7):
        got = sequence.list_moves(df.repartition(n), ["doc_id"], ["pos"], "num_id", "num_lvl").groupBy("doc_id").agg(F.sum("opens").alias("o"), F.sum("closes").alias("c")).collect()
        assert all(x.o == x.c for x in got)


def test_nearest_ancestor_and_climb(spark):
    items = spark.createDataFrame([(1, "a/b/c"), (2, "a/x"), (3, "q")], "id long, path string")
    folders = spark.createDataFrame([("a", "A"), ("a/b", "B"), ("a/b/c/d", "D")], "folder string, value string")
    assert {tuple(r) for r in lookup.nearest_ancestor(items, "id", "path", folders, "folder", "value").collect()} == {(1, "B"), (2, "A"), (3, None)}
    styles = spark.createDataFrame([("a", None, "F", "1"), ("b", "a", None, "2"), ("c", "b", None, None)], "id string, parent string, font string, size string")
    assert {(r.id, r.font, r["size"]) for r in lookup.climb(styles, "id", "parent", ["font", "size"]).collect()} == {("a", "F", "1"), ("b", "F", "2"), ("c", "F", "2")}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, t string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k long, t string")
    flags = merge.revision_flags(old, new, ["k"], "t")
    assert {tuple(r) for r in flags.collect()} == {(1, "deleted"), (2, "changed"), (3, "same"), (4, "added")}
    todo = merge.translation_flags(flags, spark.createDataFrame([(1,), (2,)], "k long"), ["k"])
    assert {(r.k, r.todo) for r in todo.collect()} == {(1, "drop"), (2, "revise"), (3, "translate"), (4, "translate")}
