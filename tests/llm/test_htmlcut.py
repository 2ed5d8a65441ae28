"""Minimum cuts against all labellings, and extraction of small pages."""

import itertools
import random
import time

from vellumix.llm import htmlcut as h


def smallest(cost, smooth):
    """The least energy and the smallest set of content that has it, of all labellings."""
    best = None
    for label in itertools.product((False, True), repeat=len(cost)):
        e = sum((-c if s else 0) if c < 0 else (0 if s else c) for c, s in zip(cost, label)) + sum(w for (i, j), w in smooth.items() if label[i] != label[j])
        if best is None or (e, sum(label)) < best[:2]:
            best = e, sum(label), label
    return list(best[2])


def test_minimum_cut_equals_all_labellings():
    r = random.Random(2)
    for _ in range(400):
        n = r.randint(1, 9)
        cost = [r.randint(-6, 6) for _ in range(n)]
        smooth = {(i, j): r.randint(0, 4) for i in range(n) for j in range(i + 1, n) if j == i + 1 or r.random() < 0.3}
        assert h.minimum_cut(cost, smooth) == smallest(cost, smooth), (cost, smooth)


def test_fifty_thousand_disputed_blocks():
    r = random.Random(3)
    n = 50_000
    smooth = {(i, i + 1): 1500 // (1 + i % 3) for i in range(n - 1)} | {(i, i + 3): 400 for i in range(n - 3)}
    for spread in (300, 1500):
        cost = [r.randint(-spread, spread) for _ in range(n)]
        began = time.process_time()
        side = h.minimum_cut(cost, smooth)
        assert time.process_time() - began < 30
        # no single block, and no run of blocks, is better off on the other side
        at = lambda i: (smooth.get((i - 1, i), 0), smooth.get((i - 3, i), 0), smooth.get((i, i + 1), 0), smooth.get((i, i + 3), 0))
        for i in r.sample(range(3, n - 3), 3000):
            other = sum(w * (1 if side[i] == side[j] else -1) for w, j in zip(at(i), (i - 1, i - 3, i + 1, i + 3)))
            assert other + (cost[i] if side[i] else -cost[i]) >= 0
    one = h.minimum_cut([700] + [0] * 20_000 + [-600], {(i, i + 1): 1000 for i in range(20_001)})  # one long way
    assert all(one)


def test_quoted_attributes():
    assert [b[0] for b in h.blocks('<p title="a > b">one</p><p title="x>two</p><p a=\'>\' b=1>three</p>')] == ["one", "two", "three"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a><li><a href=/c>More</a></ul></nav><!-- x --><div class="ad">Buy now.</div>
<article><h1>A long way home</h1><p>It was a dark night, and the rain fell on the roofs of the town &amp; the river. Nobody was out.<p>In the morning the sun came out again, and all the people of the town went down to the river to see it.</article>
<footer>&copy; 2024 Example</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_blocks():
    found = h.blocks(PAGE)
    assert [b[0] for b in found] == ["T", "Home", "News", "More", "Buy now.", "A long way home", found[6][0], found[7][0], "© 2024 Example"]
    assert [b[4] for b in found] == [-1, -1, -1, -1, -1, 1, 1, 1, -1] and found[1][1] == 4 and "& the river" in found[6][0]
    assert h.blocks("") == [] and [b[0] for b in h.blocks("plain < text")] == ["plain < text"] and h.blocks("<script>x") == []
    assert [b[0] for b in h.blocks("<div>a<b>b</b> c<br>d</div>e")] == ["ab c d", "e"]


def test_extraction_of_cases(spark):
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    long = "<body>" + "<p>The river ran through the town, and it was old. It had always been there.</p>" * 8000
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (1, "u", PAGE), (4, "u", bare), (5, "u", long), (6, "u", deep)]
    df = pages(spark, rows).selectExpr("*", "'x' AS text", "1 AS n_blocks", "2 AS feature")
    got = h.extract(df).collect()
    assert len(got) == len(rows) and [r.page_id for r in got].count(1) == 2
    by = {r.page_id: r for r in got}
    for i in (1, None, 4):
        assert "dark night" in by[i].text and "sun came out" in by[i].text
        assert not any(x in by[i].text for x in ("Home\n", "News", "Buy now", "©", "var t"))
    assert (by[2].text, by[2].n_blocks, by[3].text, by[3].n_content) == ("", 0, "", 0)
    assert by[5].n_blocks == by[5].n_content == 8000 and by[6].n_blocks == 1
    assert h.extract(df.limit(0)).count() == 0


def test_the_classifier_learns_from_all_pages(spark):
    df = pages(spark, [(i, "u", PAGE) for i in range(60)])
    odds = h.train(df)
    assert odds[13] < -500 and odds[22] + odds[21] > 0 and odds[30] > 0 > odds[31]
    assert (h.train(df.repartition(5)) == odds).all()
