import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlode.llm import piece
from siftlode.llm.piece import MODEL, PieceModel


@pytest.fixture(scope="module")
def both():
    return PieceModel(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def agree(both, texts):
    m, sp = both
    for t, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == sp.encode(t, add_eos=True), t
        assert m.decode(ids.tolist()) == sp.decode(ids.tolist()) == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" ab\n\tthe.,é日ñｆ́😀\x00'-1", max_size=40), max_size=4))
def test_any_text(both, texts):
    m, sp = both
    for t, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == sp.encode(t, add_eos=True)
        assert m.decode(ids.tolist()) == sp.decode(ids.tolist())


def test_cases(both):
    agree(both, ["", " ", "  a  b ", "a\n\tb", "<s> </s> <0x41> <unk>", " " * 77 + "x", "a" * 500, "ab" * 3000, "trail ", "日本語" * 400, "😀🙂ｆｕｌｌ", "don't.stop,now"])


def test_rows_of_pieces(both):
    rng = random.Random(3)
    every = list(both[0].piece.values())
    agree(both, ["".join(rng.choice(every) for _ in range(rng.randint(1, 6))).replace("▁", " ") for _ in range(3000)])


def test_ids_that_no_text_has(both):
    m, sp = both
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 259, 28705, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(3, 32000)]) for _ in range(rng.randint(0, 8))]
        assert m.decode(ids) == sp.decode(ids)


def test_forgetting(both, monkeypatch):
    monkeypatch.setattr(piece, "SPANS", 5)
    monkeypatch.setattr(piece, "PAIRS", 5)
    monkeypatch.setattr(piece, "BLOCK", 20)
    monkeypatch.setattr(piece, "SHORT", 4)
    agree(both, ["the quick brown fox", "jumps over", "the lazy dog " * 10, "the quick brown fox"])


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, t: t)
    with pytest.raises(ValueError):
        PieceModel(MODEL)


def test_encode_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, "p", "q"), (2, None, "p", "q")], "doc_id long, text string, IDS string, row string")
    got = piece.encode(d)
    assert got.columns == ["doc_id", "text", "row", "ids", "decoded"]
    rows = sorted(got.collect(), key=str)
    assert [(r.doc_id, r.row, r.decoded, r.ids[-1]) for r in rows] == [(1, "y", "a b", 2), (2, "q", "", 2), (2, "q", "", 2)]
    assert piece.encode(d.limit(0)).count() == 0


def test_query(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in piece.op11_pieces(d).collect()}
    want = {}
    for r in d.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert got == want
