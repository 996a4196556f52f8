import gzip

import pytest

from siftlode.sources import readers, writers
from siftlode.streaming.incremental import run_new_files


def test_tables(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿CID , Name\n1,"a, b"\n2,"x\ny"\n')
    d = readers.table(spark, str(p), source=True, line_ends_in_cells=True)
    assert d.columns == ["cid", "name", "source_file"] and [tuple(r) for r in d.collect()] == [("1", "a, b", "a.csv"), ("2", "x\ny", "a.csv")]
    assert readers.sniff(spark, str(p)) == "," and readers.resolve(["Smiles", "CID"], "cid", "id") == "CID"
    with pytest.raises(ValueError, match="missing"):
        readers.require(d, "cid", "energy")
    with pytest.raises(ValueError, match="none of"):
        readers.resolve(["a"], "b")


def test_ragged_lines(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text("name,cid,smiles,journal\n2,3-di, x,1,CC,J\nplain,2,C,K\nshort,1\n")
    assert sorted(tuple(r) for r in readers.repaired(spark, str(p), ["name", "cid", "smiles", "journal"]).collect()) == [("2,3-di, x", "1", "CC", "J"), ("plain", "2", "C", "K")]


def test_tagged_and_json(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("FN x\nPT J\nTI A long\n   title\nSO J. One\nAB Text\n   more\nER\n\nPT J\nTI No abstract\nSO J\nER\nEF\n")
    assert [tuple(r) for r in readers.tagged(spark, str(p), {"TI": "title", "SO": "journal", "AB": "abstract"}, "abstract").collect()] == [("A long title", "J. One", "Text more")]
    j = tmp_path / "j.txt"
    j.write_text('{"a": 1,\n "b": "x"}\n\nnot json\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_blocks(spark, str(j), "a int, b string").collect()) == [1, 2]
    k = tmp_path / "l.jsonl"
    k.write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(k), "a int").collect()) == [1, 2] and readers.json_lines(spark, str(k), "a int").count() == 2
    s = tmp_path / "s.sdf.gz"
    s.write_bytes(gzip.compress(b"m\n> <CID>\n7\n\n> <SMI>\nCC\n\n$$$$\nm\n> <ID>\n8\n\n$$$$\n"))
    got = readers.structure_blocks(spark, str(s), {"cid": ["CID", "ID"], "smiles": ["SMILES", "SMI"]}).collect()
    assert sorted((r.cid, r.smiles) for r in got) == [("7", "CC"), ("8", None)]


def test_writers(spark, tmp_path):
    t = str(tmp_path / "t")
    d = spark.createDataFrame([(1, "a b"), (2, "C/d"), (2, None)], "k int, g string")
    writers.append_new(d, t, ["k"])
    writers.append_new(spark.createDataFrame([(2, "x"), (3, "y")], "k int, g string"), t, ["k"])
    assert sorted(r.k for r in spark.read.parquet(t).collect()) == [1, 2, 2, 3]
    writers.replace(spark.read.parquet(t).where("k > 1"), t)
    assert sorted(r.k for r in spark.read.parquet(t).collect()) == [2, 2, 3]
    writers.by_group(d, str(tmp_path / "g"), "g")
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["group_slug=a_b", "group_slug=c_d", "group_slug=none"]
    writers.indexed(d.withColumn("reason", d.g), "reason", str(tmp_path / "i"), ["k"])
    assert spark.read.parquet(str(tmp_path / "i/index")).count() == 1 and spark.read.json(str(tmp_path / "i/manifest")).count() == 3
    writers.quoted_csv(d, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().startswith('"k","g"')


def test_new_files_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    for k in (1, 2, 2):
        spark.createDataFrame([(k,)], "k int").write.mode("append").parquet(src)
        run_new_files(spark, src, "k int", out, chk, lambda d: d.selectExpr("k * 10 as k"))
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [10, 20, 20]


def test_line_ends_of_other_systems(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_bytes(b"PT J\r\nTI One\r\nAB x\r\nER\r\n\r\nPT J\nTI Two\n   more\nAB y\nER  \nPT J\r\nTI Three\r\nAB z\r\nER")
    got = readers.tagged(spark, str(p), {"TI": "title", "AB": "abstract"}, "abstract").collect()
    assert sorted(tuple(r) for r in got) == [("One", "x"), ("Three", "z"), ("Two more", "y")]
    j = tmp_path / "j.txt"
    j.write_bytes(b'{"a": 1,\r\n "b": "x"}\r\n\r\nnot json\r\n\r\n{"a": 2}\r\n')
    assert sorted(r.a for r in readers.json_blocks(spark, str(j), "a int, b string").collect()) == [1, 2]


def test_lines_and_pending(spark, tmp_path):
    for name, n in (("a.txt", 5), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = sorted((r.source_file, r.line_no, r.value) for r in readers.lines(spark, str(tmp_path), 2).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a.txt", i + 2, f"a.txt{i}") for i in range(5)] + [("b.txt", i + 2, f"b.txt{i}") for i in range(3)]
    d = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "source_file string")
    done = spark.createDataFrame([("a",), ("b",)], "source_file string")
    assert sorted(r.source_file for r in readers.pending_files(d, done).collect()) == ["a", "c"]


def test_a_broken_replacement_is_put_right(spark, tmp_path):
    t = str(tmp_path / "t")
    spark.range(3).write.parquet(t)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert writers.recovered(spark, t) and not writers.recovered(spark, t) and spark.read.parquet(t).count() == 3


def test_positional_counts_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,smiles,z\n5,,z\n6,"a,b"\n7\n8,\n9,c,d,e\n10,"x""y",\n')
    got = {r.cid: r.smiles for r in readers.positional(spark, str(tmp_path / "a.csv"), ["cid", "smiles"], ",").collect()}
    assert got == {"5": "", "6": "a,b", "8": "", "9": "c", "10": 'x"y'}
    with pytest.raises(ValueError):
        readers.positional(spark, str(tmp_path / "a.csv"), ["a", "b", "c", "d"], ",")


def test_repaired_reads_quotes_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,cid,smiles,journal\n"a, b",5,CC,"J, x"\n2,3-di, x,6,C,K\n"say ""hi"", you",7,O,"L"\n"open,8,N,M\nshort,1\n')
    got = {tuple(r) for r in readers.repaired(spark, str(tmp_path / "a.csv"), ["name", "cid", "smiles", "journal"]).collect()}
    assert got == {("a, b", "5", "CC", "J, x"), ("2,3-di, x", "6", "C", "K"), ('say "hi", you', "7", "O", "L"), ('"open', "8", "N", "M")}


def test_only_a_line_of_its_own_ends_a_record(spark, tmp_path):
    (tmp_path / "a.txt").write_text("TI One\nAB Start\nERp57 is a protein\nERK too\nER\n\nTI Two\nAB More\nER  \nTI Three\nER\nTI Four\nAB Last\nER")
    (tmp_path / "b.txt").write_text("TI Five\r\nAB x\r\nER\r\nTI Six\r\nAB ERA\r\nERB\r\nER\r\n")
    got = {(r.title, r.abstract) for r in readers.tagged(spark, str(tmp_path), {"TI": "title", "AB": "abstract"}, "abstract").collect()}
    assert got == {("One", "Start ERp57 is a protein ERK too"), ("Two", "More"), ("Four", "Last"), ("Five", "x"), ("Six", "ERA ERB")}


def test_blocks_of_both_line_ends(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"a": 1}\r\n\r\n{"a":\r\n 2}\r\n')
    (tmp_path / "b b.json").write_bytes(b'{"a": 3}\n\n{"a": 4}\n \n{"a": 5}\n\n\n\n{"a": 6}')
    (tmp_path / "c.json").write_bytes(b'{"a": 7}\r\n\r\n{"a": 8}\n\n{"a": 9}')
    assert sorted(r.a for r in readers.json_blocks(spark, str(tmp_path), "a int").collect()) == list(range(1, 10))


def test_cells_and_index(spark, tmp_path):
    d = spark.createDataFrame([(1, [0.5, -1.25]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0])], "i int, v array<double>")
    got = sorted(tuple(r) for r in writers.with_cells(d, "v", 2).collect())
    assert got == [(1, "ok", "0.500000", "-1.250000"), (2, "failed", None, None), (3, "failed", None, None), (4, "failed", None, None)]
    out, src = str(tmp_path / "x"), spark.createDataFrame([(i, f"f{i % 3}", i, "bad" if i % 4 == 0 else None) for i in range(20)], "k int, source_file string, line_no int, why string")
    writers.indexed(src, "why", out, ["k"], ["source_file", "line_no"])
    index = spark.read.parquet(f"{out}/index")
    assert {(r.k, r.row.k, r.row.line_no) for r in writers.at_places(spark, f"{out}/rows", index).collect()} == {(i, i, i) for i in range(20) if i % 4}
    assert {(r.k, r.why) for r in spark.read.parquet(f"{out}/failures").collect()} == {(i, "bad") for i in range(0, 20, 4)}
    assert {(r.reason, r.n) for r in spark.read.json(f"{out}/manifest").collect()} == {("ok", 15), ("bad", 5)}


def test_cells_round_half_to_even(spark):
    # exact ties in the seventh decimal, a value just under one, and zeros that keep their sign
    d = spark.createDataFrame([(1, [0.0078125, 0.0234375, -0.0703125, 5e-7, -1e-7, 1e17])], "i int, v array<float>")
    got = tuple(writers.with_cells(d, "v", 6).first())[2:]
    assert got == tuple("%.6f" % x for x in d.first().v) == ("0.007812", "0.023438", "-0.070312", "0.000000" if d.first().v[3] < 5e-7 else "0.000001", "-0.000000", "%.6f" % d.first().v[5])
