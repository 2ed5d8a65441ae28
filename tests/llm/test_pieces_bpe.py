"""Encoding against the library that made the model, and exact round trips."""

from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumix.llm import pieces_bpe as p

if not Path(p.MODEL).exists():
    pytest.skip("no model file", allow_module_level=True)
sentencepiece = pytest.importorskip("sentencepiece")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
VOCAB = p.Vocabulary(Path(p.MODEL).read_bytes())
EDGE = ["", " ", "  a", "a  b   c ", "\n\n x\ty", "日本語テキスト 🎉🎉", "aaaaaaaaa aaaa aaa", "▁a▁▁b", " x", " \0 ", "ﬁ é é", "1234567 89", "    def f(x):\n        return x", "<0x0A> <s> </s> <unk>", "ab" * 9000, "the " * 30_000]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aabcde  theinrsé▁\n.,0１ß漢🎉"))) | st.text(), max_size=6))
def test_ids_are_the_librarys(texts):
    ids, n, same = p.encode_array(pa.array(texts, pa.string()), VOCAB)
    assert ids.to_pylist() == LIBRARY.encode(texts) and all(same.to_pylist())
    assert n.tolist() == [len(x) for x in ids.to_pylist()]


def test_edge_cases_with_and_without_table():
    for kept in (True, False):
        rows = [t.replace("▁", " ").encode() for t in EDGE]
        ids, n, _, _ = VOCAB.encode(rows, kept)
        out, at = [], 0
        for k in n:
            out.append(ids[at : at + k].tolist())
            at += k
        assert out == LIBRARY.encode(EDGE)


def test_the_table_is_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(p, "KEPT_UNITS", 3)
    vocab = p.Vocabulary(Path(p.MODEL).read_bytes())
    for t in EDGE * 2:
        assert p.encode_array(pa.array([t]), vocab)[0].to_pylist() == [LIBRARY.encode(t)]


def test_query_and_decode(docs):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(EDGE)] + [(90, None), (None, "null id"), (1, " ")]
    df = docs(rows).selectExpr("*", "1 AS ids", "'x' AS vocab")
    got = p.encode(df)
    by = {(r.doc_id, r.n_pieces): r for r in got.collect()}
    assert got.count() == len(rows)
    assert by[90, 0].piece_ids is None and by[90, 0].round_trip is None and by[0, 0].piece_ids == []
    for i, t in enumerate(EDGE):
        assert next(r for (d, _), r in by.items() if d == i).piece_ids == LIBRARY.encode(t)
    back = {r.doc_id: r.text for r in p.decode(got).collect()}
    assert back[90] is None and all(back[i] == t.replace("▁", " ") for i, t in enumerate(EDGE))
    wide = p.encode_columns(df)
    assert wide.columns == [*df.columns, "piece_ids", "n_pieces", "round_trip"] and wide.count() == len(rows)
    assert p.encode_columns(wide).columns == wide.columns
    assert p.encode(df.limit(0)).count() == 0


def test_decode_takes_any_ids(spark):
    df = spark.createDataFrame([(1, [-5, 99999, 0, 1, 2]), (2, [VOCAB.of_byte[0xFF].item()]), (3, None)], "doc_id long, piece_ids array<int>")
    assert [r.text for r in p.decode(df).orderBy("doc_id").collect()] == ["", "�", None]


def test_columns_of_the_same_names_stay(docs):
    df = docs([(1, "some text")]).selectExpr("*", "'mine' AS piece_ids", "7 AS N_PIECES")
    out = p.encode_columns(df).first()
    assert (out["piece_ids"], out["N_PIECES"]) == ("mine", 7) and out["piece_ids_"] and out["n_pieces_"] == len(out["piece_ids_"]) and out["round_trip"]
