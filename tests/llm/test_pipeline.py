"""The pipeline against a brute-force version, on a small corpus of its own and on the test tables."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from vellumix.llm import decontaminate, pieces_bpe, pii, quality, simhash
from vellumix.llm.words import WordHasher

from . import test_pii, test_simhash

STOP = "the of and to in is it that for with".split()


def corpus():
    r = random.Random(9)
    vocab = ["".join(r.choice("aeioubcdfgl") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(r.choice(STOP) if r.random() < 0.4 else r.choice(vocab) for _ in range(n))
    items = [(i, prose(25)) for i in range(4)]
    rows = [(i, prose(r.randint(60, 200))) for i in range(60)]
    for i in range(60, 80):
        words = rows[i - 60][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(80 + i, prose(50) + ". " + items[i][1].upper() + " " + prose(30)) for i in range(4)]
    rows += [(90, "@@@ ### $$$ " * 60), (91, "spam " * 300), (92, None), (93, ""), (94, prose(90) + " mail joe@x.example.org or +1 (743) 555-3824 " + prose(20))]
    rows += [(10, rows[10][1]), (None, prose(80))]
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], items


def brute(rows, items):
    keep = [x for x in rows if x[1] and len(x[1].split()) > 10 and "###" not in x[1] and not x[1].startswith("spam")]
    n, f = simhash.fingerprint_arrays(pa.array([x[1] for x in keep]), WordHasher())
    root = list(range(len(keep)))
    for _ in range(3):
        for a in range(len(keep)):
            for b in range(len(keep)):
                if keep[a][0] is None or keep[b][0] is None:
                    continue
                near = np.bitwise_count(f[a] ^ f[b]).sum() <= simhash.BUDGET and min(n[a], n[b]) >= simhash.LENGTH_RATIO * max(n[a], n[b])
                if near:
                    root[a] = root[b] = min(root[a], root[b])
    seen, left = set(), []
    for k, x in enumerate(keep):
        if root[k] == k and (x[0] is None or x[0] not in seen):
            seen.add(x[0])
            left.append(x)
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    left = [x for x in left if not any(norm(t) in norm(x[1]) for _, t in items)]
    out, bits = {}, test_pii.brute([x[:2] for x in left])
    for i, t, *_ in left:
        found = pii.entities(t)
        mine = {e for m in found for e in pii.entity_names(t, m)}
        edits = [(a, b, f"<{kind}>") for a, b, kind in found]
        for w in re.finditer(r"\w+", t):
            told = [v for (e, term), v in bits.items() if e in mine and term == w.group().lower()]
            if told and not any(a <= w.start() < b for a, b, _ in found):
                new = "<NUMBER>" if re.search("[0-9]", w.group()) else "<NAME>" if w.group()[0].isupper() else "<TERM>"
                edits.append((w.start(), w.end() + (t[w.end() : w.end() + 1] == " "), "") if min(told) <= pii.REMOVE_BITS else (w.start(), w.end(), new))
        for a, b, new in sorted(edits, reverse=True):
            t = t[:a] + new + t[b:]
        out[i] = t
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(rows, items)
    assert {i: r.text for i, r in got.items()} == want
    assert 94 in want and "<TERM>" in want[94] and "joe" not in got[94].text and not {90, 91, 92, 93} & got.keys() and not set(range(80, 84)) & got.keys()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces_bpe.MODEL)
    for r in got.values():
        assert r.piece_ids == library.encode(r.text) and r.round_trip and r.n_chars == len(r.text)


def test_stages_keep_columns_and_take_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame(corpus()[1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (corpus()[0], []):
        df = docs(data).selectExpr("*", "1 AS item_id", "'x' AS entity", "2 AS words", "3 AS __vellumix_tokens", "4 AS __gone", "5 AS `a.b c`")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.columns[: len(df.columns)] == df.columns and (len(out.columns) == len(df.columns)) == (k < 4)
            if not data:
                assert out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "sentence_pieces"]
    assert quality.RULES and decontaminate.MIN_WORDS == 8


def test_near_dedup_leaves_no_pair_within_the_budget(spark, docs):
    """Pairs that use up nearly the whole budget go as well: one document of each group of all pairs stays."""
    texts = test_simhash.far_copies()
    _, _, pairs = test_simhash.all_pairs(texts)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(list(enumerate(texts))), "").collect()}
    assert kept == set(test_simhash.groups(pairs, len(texts)))


def test_near_dedup_leaves_out_no_link_through_a_document_of_several_texts(spark, docs):
    """Rows of one doc_id are one document: what is near to any of its texts is in its group, whichever doc_id is the smallest."""
    texts = test_simhash.far_copies(150)
    _, _, pairs = test_simhash.all_pairs(texts)
    r = random.Random(4)
    ids = [r.randrange(10**6) if r.random() < 0.6 else 500_000 + k // 8 for k in range(len(texts))]
    texts, ids = texts + texts[:40], ids + [r.randrange(10**6) for _ in range(40)]
    nodes = sorted(set(ids))
    at = [nodes.index(i) for i in ids]
    root = test_simhash.groups([(at[a], at[b]) for a, b in pairs + [(k, len(texts) - 40 + k) for k in range(40)]], len(nodes))
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs(list(zip(ids, texts))), "").collect())
    assert kept == [i for k, i in enumerate(nodes) if root[k] == k]
    a, b, c, d, e, f = texts[:24:4]
    rows = [(3, a), (5, a), (5, b), (4, b), (11, c), (11, d), (12, c), (13, d), (16, e), (17, e), (17, f), (15, f)]
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()) == [3, 11, 15]
