"""Stages and operators keep columns whose names are those that they use inside."""

import pytest

from siftlode.llm import bpe, conversation, decontaminate, merkle, neardup, piece, quality, sharding, substring
from siftlode.llm.shared import numbered, shared_path, unused

NAMES = """
id tx gx key items most own a n made t w lines s h g pos at run first size shift bucket place start row f label item ipos dpos diagonal fill slots __id __tx __gx __t __a __n __c __e __i __key __w __h __f __m __p
__bucket __place __start __r _id _tx _key _own _quality_n_words _quality_keep _quality___t _quality_n_lines __quality_keep n_words n_removed shard slot contaminated item_ids coverage l1 l4 l8 copies m own_n_words KEY Id
""".split()
TEXT = "the words of this text are not the same as those of any other text and it is long enough to be kept by all rules that look at length so there are more than fifty words in it which is what the rule wants to see and then some more for good measure number {}"


@pytest.fixture(scope="module")
def tables(spark):
    names = [c for i, c in enumerate(NAMES) if c.lower() not in {x.lower() for x in NAMES[:i]}]
    d = shared_path(spark, "names")
    rows = [(i, TEXT.format(f"{i} " * 40 + " ".join(f"w{i}x{j} of" for j in range(60))), "en", "s", 5, *(f"{c}-{i}" for c in names)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    spark.createDataFrame([(1, "an item that no document has in its text at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return docs, d, names


def same(got, docs, names, but=()):
    rows = {r.doc_id: r for r in got.collect()}
    assert rows.keys() == {0, 1, 2, 3}
    for i, r in rows.items():
        assert all(r[c] == f"{c}-{i}" for c in names if c not in but)


@pytest.mark.parametrize("stage", [quality.stage, neardup.stage, substring.stage, decontaminate.stage, bpe.stage])
def test_stages(spark, tables, stage):
    docs, d, names = tables
    got = stage(spark, docs, d)
    same(got, docs, names)
    if stage is not bpe.stage:
        assert got.columns == docs.columns


def test_operators(spark, tables):
    docs, d, names = tables
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    same(decontaminate.contaminated(docs, bench), docs, names, ("contaminated", "item_ids", "coverage"))
    same(sharding.shuffled_shards(docs), docs, names, ("shard", "slot"))
    same(substring.dedup_substrings(docs), docs, names, ("n_words", "n_removed"))
    same(piece.encode(docs), docs, names)
    same(numbered(docs, ["lang"], ["doc_id"]), docs, names, ("pos", "n"))
    assert merkle.op12_merkle(docs).count() == 4
    assert conversation.op13_conversations(docs.selectExpr("doc_id as conv_id", "doc_id as turn", "lang as role", "*")).count() == 4


def test_unused(spark):
    assert unused(spark.createDataFrame([], "KEY int, _key int"), "key", "b") == ("__key", "__b")
