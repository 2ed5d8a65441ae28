"""Benchmark decontamination against a search by brute force."""

import random
import re
import time

import ahocorasick
import numpy as np
import pyarrow as pa
import pytest

from vellumix.llm import decontaminate as d

WORDS = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "é", "ou", "Ü", "in")]


def brute(text, items, min_words):
    """The same spans from the longest common runs of words."""
    tok = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text or "")]
    out = set()
    for item_id, item in items:
        words = [w.lower() for w in re.findall(r"\w+", item or "")]
        if len(words) < d.WINDOW:
            continue
        need, spans = min(min_words, len(words)), []
        for i in range(len(tok)):
            for j in range(len(words)):
                if i and j and tok[i - 1][0] == words[j - 1]:
                    continue
                n = 0
                while i + n < len(tok) and j + n < len(words) and tok[i + n][0] == words[j + n]:
                    n += 1
                if n >= need:
                    spans.append((i, i + n))
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(item_id, tok[a][1], tok[b - 1][2], b - a) for a, b in merged}
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(7)
    prose = lambda n: "".join(r.choice(WORDS) + r.choice([" ", " ", ", ", ".\n", " – ", " *** "]) for _ in range(n))
    items = [(i, prose(r.choice([3, 6, 9, 20, 40]))) for i in range(12)] + [(50, None), (51, ""), (None, prose(9))]
    items += [(60, items[4][1])]
    docs = []
    for i in range(60):
        text = prose(r.choice([0, 5, 30, 200]))
        for _ in range(r.choice([0, 1, 2])):
            words = (r.choice(items)[1] or "").split(" ")
            a = r.randrange(max(1, len(words) - 8))
            text += " " + " ".join(words[a : a + r.choice([6, 8, 12, 99])]).upper().replace(" ", r.choice([" ", "  ", "... ", "### "])) + " " + prose(5)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "İ K ẞ " + items[4][1] + " Å"), (103, "\0" + items[5][1] + "\0")]
    docs += [(104, prose(20_000) + items[3][1] + prose(20_000)), (105, items[3][1]), (105, items[3][1]), (None, items[5][1])]
    return docs, items


def test_scan_equals_brute_force(case):
    docs, items = case
    known, a = d.automaton([x for x in items if x[0] is not None])
    for i, (doc, text) in enumerate(docs):
        if doc == 104:
            continue
        got = {h[1:] for h in d.scan(pa.array([text or ""]), known, a)}
        assert got == brute(text, [x for x in items if x[0] is not None], d.MIN_WORDS), (doc, text)
    many = d.scan(pa.array([t or "" for _, t in docs]), known, a)
    assert [h[1:] for h in many] == [h[1:] for t in docs for h in d.scan(pa.array([t[1] or ""]), known, a)]


def test_hot_windows_give_the_same(case, monkeypatch):
    docs, items = case
    r = random.Random(9)
    items = [x for x in items if x[0] is not None]
    items += [(200 + i, "Which of the following is " + " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 3, 9])))) for i in range(40)]
    texts = [t or "" for i, t in docs if i != 104] + [f"so {items[k][1]} then which of the following is {items[k + 1][1]}" for k in range(20, 50)]
    known, a = d.automaton(items)
    got = d.scan(pa.array(texts), known, a)
    for k in (0, 1000):
        monkeypatch.setattr(d, "HOT", k)
        known, other = d.windows(items)
        b = ahocorasick.Automaton()
        for w, where in other.items():
            b.add_word(w, (len(w), where))
        b.make_automaton()
        assert d.scan(pa.array(texts), known, b) == got
        assert sorted({h[0] for h in got}) == np.flatnonzero(d.contaminated(pa.array(texts), known, b)).tolist()


def test_many_items_of_one_beginning_cost_no_more():
    items = [(i, f"which of the following is item{i} with answer{i * 7} and more of it") for i in range(100_000)]
    known, a = d.automaton(items)
    text = "which of the following is never asked in this text. " * 1600 + items[77_777][1]
    began = time.process_time()
    assert [h[1] for h in d.scan(pa.array([text]), known, a)] == [77_777]
    assert time.process_time() - began < 5


def test_hits_and_removal(spark, docs, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(rows).selectExpr("*", "1 AS start", "2 AS item_id")
    got = [tuple(r) for r in d.hits(df, bench).collect()]
    text = {i: t for i, t in rows}
    assert {h[0] for h in got} >= {102, 103, 104, 105, None}
    assert all(len(re.findall(r"\w+", text[h[0]][h[2] : h[3]])) == h[4] for h in got)
    kept = d.remove_contaminated(df, bench)
    dirty = {h[0] for h in got}
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in dirty)


def test_empty_tables(spark, docs, case):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.hits(docs(case[0][:5]), none).count() == 0
    assert d.remove_contaminated(docs(case[0][:5]), none).count() == 5
    assert d.hits(docs([]), spark.createDataFrame(case[1], "item_id long, text string")).count() == 0


def test_several_automata_give_the_same(spark, docs, case, monkeypatch):
    bench = spark.createDataFrame(case[1], "item_id long, text string")
    one = sorted(map(str, d.hits(docs(case[0][:40]), bench).collect()))
    monkeypatch.setattr(d, "GROUP_CHARS", 200)
    assert sorted(map(str, d.hits(docs(case[0][:40]), bench).collect())) == one
