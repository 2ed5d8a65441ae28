"""Sanitisation against co-occurrence counted by brute force."""

import math
import random
import re

import numpy as np
import pytest

from vellumix.llm import pii
from vellumix.llm.words import WordHasher


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to Ann.Lee+x@mail.example.com.", ["EMAIL"]),
        ("é.12@mail5.example.com x@y a@b.c @ @@", ["EMAIL", "EMAIL"]),
        ("call +1 (743) 555-3824 or 555-123-4567, (020) 555 1234", ["PHONE", "PHONE", "PHONE"]),
        ("from 10.0.0.255 not 300.1.1.1 nor 1.2.3.4.5", ["IP"]),
        ("card 4111 1111 1111 1111 and 9807915762804490", ["ACCOUNT", "ACCOUNT"]),
        ("ssn 123-45-6789, iban DE44 5001 0517 5407 3249 31", ["SSN", "IBAN"]),
        ("in 1999 and 12345 at 10:30, version 2.0.1", []),
        ("from 2001:db8:0:0:8:800:200c:417a and fe80:12::1 at 10:30:59 in std::vector", ["IP", "IP"]),
        ("a" * 5000 + "@x.example.org", ["EMAIL"]),
        ("", []),
    ],
)
def test_entities(text, want):
    assert [k for _, _, k in pii.entities(text)] == want


def test_a_long_address_leaves_nothing():
    text = "to " + "a.b" * 50 + "@x.example.org now"
    assert pii.clean(text, np.zeros(0, np.uint64), np.zeros(0, bool), WordHasher())[0] == "to <EMAIL> now"


def test_shared_parts():
    names = lambda t: {n for m in pii.entities(t) for n in pii.entity_names(t, m)}
    assert names("x@Mail.example.org 10.1.2.3") == {"EMAIL:x@mail.example.org", "EMAIL*mail.example.org", "IP:10.1.2.3", "IP*10.1.2"}
    assert names("+1 (743) 555-3824") == {"PHONE:17435553824", "PHONE*17435"}


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(40)]
    prose = lambda n: " ".join(r.choice(common) for _ in range(n))
    out = []
    for i in range(12):  # Zorro only ever meets this address, Quill mostly, Maybe rarely
        out.append((i, f"{prose(8)} Zorro {'Quill' if i < 8 else ''} {prose(300)} zed.1@x.example.org {prose(6)} {'Maybe' if i < 4 else ''}"))
    out += [(20 + i, f"{prose(10)} Quill {prose(2)} Maybe maybe") for i in range(10)]
    out += [(40 + i, f"{prose(5)} Hapaxone bob{i}@y.example.org " + prose(4) + f" 77{i}1") for i in range(2)]
    out += [(50 + i, "Copied words near carl@z.example.org always the same") for i in range(9)]
    out += [(60 + i, f"{prose(6)} ann{i}@acme.example.org Acmeville") for i in range(3)]  # one domain, three people
    out += [(70, None), (71, ""), (72, "clean prose stays  as it is\n"), (None, "Zorro zed.1@x.example.org"), (73, "word " * 30_000 + "zed.1@x.example.org Zorro")]
    return out


def brute(rows):
    """(entity, term) -> bits, by the definition, over all pairs."""
    docs = [t for _, t in rows if t is not None]
    sets = [set(re.findall(r"\w+", t.lower())) for t in docs]
    of, terms, around = [], [], []
    for t in docs:
        found = pii.entities(t)
        of.append({n for m in found for n in pii.entity_names(t, m)})
        words = [w.group().lower() for w in re.finditer(r"\w+", t) if not any(x <= w.start() < y for x, y, _ in found)]
        terms.append(set(words))
        around.append(tuple(words))
    out = {}
    for e in set().union(*of):
        have = [i for i, x in enumerate(of) if e in x]
        p = len(have) / len(docs)
        if -math.log2(p) <= pii.GENERALISE_BITS:
            continue
        for t in set().union(*(terms[i] for i in have)):
            both = [i for i in have if t in terms[i]]
            k, n = len({around[i] for i in both}), sum(t in s for s in sets)
            bits = -math.log2((k * len(both) / n + pii.PRIOR * p) / (k + pii.PRIOR))
            if bits <= pii.GENERALISE_BITS:
                out[e, t] = bits
    return out


def test_against_brute_force(docs):
    data = rows()
    want = brute(data)
    assert ("EMAIL:zed.1@x.example.org", "zorro") in want and ("EMAIL*acme.example.org", "acmeville") in want
    assert ("EMAIL:bob0@y.example.org", "7701") in want and ("EMAIL:bob0@y.example.org", "hapaxone") not in want and ("EMAIL*y.example.org", "hapaxone") in want
    df = docs(data).selectExpr("*", "1 AS entity", "2 AS term", "3 AS n")
    found = pii.disclosing(df).collect()
    assert sorted(round(r.hidden_bits, 6) for r in found) == sorted(round(v, 6) + 0.0 for v in want.values())
    key = lambda e: pii._hash(e.encode())
    assert {(r.entity, round(r.hidden_bits, 6)) for r in found} == {(key(e), round(v, 6)) for (e, _), v in want.items()}
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(got) == len({i for i, _ in data}) == len(data)
    for i, t in data:
        if t is None or not pii.entities(t):
            assert got[i].text == t and got[i].n_entities == got[i].n_removed == 0
            continue
        assert not pii.entities(got[i].text) and got[i].n_entities >= 1
        mine = [(w, want[e, w]) for m in pii.entities(t) for e in pii.entity_names(t, m) for w in {x for f, x in want if f == e}]
        left = set(re.findall(r"\w+", got[i].text.lower()))
        assert not {w for w, _ in mine} & (left - {"email", "term", "name", "number"})
    assert all("Zorro" not in got[i].text and "<NAME>" not in got[i].text[:60].split("Quill")[0] for i in range(8, 12))
    assert "Quill" in got[20].text and "Acmeville" not in got[60].text
    assert got[50].text == "<NAME> <TERM> <TERM> <EMAIL> <TERM> <TERM> <TERM>"  # one surrounding, however often it is copied
    assert "Zorro" not in got[73].text and got[73].text.count("<TERM>") + got[73].text.count("word") == 30_000


def test_common_terms_are_broadcast_or_not(docs, monkeypatch):
    df = docs(rows())
    one = {r.doc_id: r.asDict() for r in pii.sanitise(df).collect()}
    monkeypatch.setattr(pii, "COMMON", 8)
    assert {r.doc_id: r.asDict() for r in pii.sanitise(df).collect()} == one


def test_everyones_entity_has_nothing_to_protect(docs):
    df = docs([(i, f"write word{i} to info@firm.example.org please") for i in range(10)])
    assert pii.disclosing(df).count() == 0 and "please" in pii.sanitise(df).first().text


def test_columns_stay_and_empty_tables(docs):
    df = docs(rows()).selectExpr("doc_id", "1 AS n_entities", "text", "'x' AS remove", "7 AS uid", "8 AS `c.1`", "9 AS terms")
    assert pii.sanitise_columns(df).columns == df.columns and pii.sanitise_columns(df).count() == len(rows())
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.sanitise(df.filter("text IS NULL")).count() == 1
