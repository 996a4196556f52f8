import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from siftlode.llm import bpe


@pytest.fixture(scope="module")
def reference():
    c = bpe.codec(bpe.RANKS, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def texts():
    r = random.Random(4)
    letters = "etaoin shrdlu éßñ漢字🙂 0123 \n\t'.,<|endoftext|>\x00 "
    out = ["".join(r.choices(letters, k=r.choice([1, 5, 80, 700]))) for _ in range(120)]
    return [*out, None, "", " ", "   a", "a   ", "the" * 3000, "a" * 20_000, "<|endoftext|>", "it's we'll I'D", "x" * 1024, "é" * 513, "word " * 50_000]


def test_against_the_public_library(spark, reference):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in bpe.op6_bpe(docs).collect()}
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    for r in bpe.stage(spark, docs, "").collect():
        assert r.round_trip and r.n_tokens == len(r.ids) and r.ids == reference.encode_ordinary(r.text or "")


def test_sql_and_heap_agree(monkeypatch):
    c = bpe.codec(bpe.RANKS, P.PATTERN)
    r = random.Random(9)
    pieces = [bytes(r.choices(b"abcdeth ing\xc3\xa9", k=k)) for k in [*range(1, 200), 500, 1023, 1024, 1025, 3000]]
    assert [a.tolist() for a in c.contract(pieces)] == [c._long(p).tolist() for p in pieces]
    monkeypatch.setattr(bpe, "DECODED", 700)
    assert c.decode(c.contract(pieces)) == pieces and c.decode([]) == [] and c.contract([b""])[0].size == 0


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    c = bpe.Codec(bpe.RANKS, P.PATTERN)
    for _ in range(2):
        assert [i.tolist() for i, _ in c.texts(["one two", "three one", None])] == [reference.encode_ordinary(t) for t in ("one two", "three one", "")]


def test_empty(spark):
    assert bpe.op6_bpe(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_batches_of_several_blocks(spark, reference):
    rows = [(i, f"row {i} " * (bpe.BLOCK // 24 if i % 7 == 3 else 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    staged = {r.doc_id: r for r in bpe.stage(spark, docs, "").collect()}
    digests = {r.doc_id: r for r in bpe.op6_bpe(docs).collect()}
    assert len(staged) == len(digests) == 40
    for i, t in rows:
        ids = reference.encode_ordinary(t)
        assert staged[i].ids == ids and staged[i].round_trip and staged[i].text == t
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
