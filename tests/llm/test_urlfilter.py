import datetime as dt

from siftlode.llm import urlfilter

D = lambda m, d: dt.date(2024, m, d)


def test_intervals_and_verdicts(spark):
    e = [
        ("d:bad.org", D(1, 10), "add", "spam"), ("d:bad.org", D(2, 10), "remove", None), ("d:bad.org", D(3, 10), "add", "mal"), ("d:org", D(6, 1), "add", "tld"),
        ("p:ok.com/x/y", D(1, 1), "add", "path"), ("d:same.com", D(1, 1), "add", "a"), ("d:same.com", D(1, 1), "remove", "a"), (None, D(1, 1), "add", "n"), ("d:n.com", None, "add", "n"),
    ]
    entries = spark.createDataFrame(e, "key string, dated date, action string, category string")
    got = sorted((r.key, r.valid_from, r.valid_to) for r in urlfilter.intervals(entries).where("key = 'd:bad.org'").collect())
    assert [x[1:] for x in got if x[2]] == [(D(1, 10), D(2, 10))] and len(got) == 2
    assert urlfilter.intervals(entries).where("key = 'd:same.com'").count() == 0
    caps = [
        (1, "https://www.BAD.org:80/a?q#f", D(1, 9)), (2, "https://www.bad.org./a", D(1, 10)), (3, "http://u@bad.org", D(2, 9)), (4, "//bad.org/", D(2, 10)),
        (5, "http://bad.org/z", D(7, 1)), (6, "http://other.org", D(7, 1)), (7, "http://ok.com/x/y/z", D(1, 2)), (8, "http://ok.com/x", D(1, 2)), (9, "http://ok.com/x/yy", D(1, 2)),
        (10, None, D(1, 2)), (11, "", D(1, 2)), (12, "mailto:x", D(1, 2)), (13, "http://bad.org", None), (None, "http://bad.org", D(1, 20)), (3, "http://u@bad.org", D(2, 9)),
        (14, "http://same.com", D(1, 5)), (15, "http://ok.com/" + "s/" * 500, D(1, 2)), (16, "http://notbad.org.uk", D(1, 20)),
    ]
    docs = spark.createDataFrame([(*c, "k") for c in caps], "page_id long, url string, fetched date, key string")
    out = urlfilter.judged(docs, entries).collect()
    assert len(out) == len(caps)
    by = {r.id: r for r in out}
    assert {i for i, r in by.items() if r.blocked} == {2, 3, 5, 6, 7, None}
    assert (by[5].key, by[5].category, by[5].since) == ("d:bad.org", "mal", D(3, 10)) and by[6].key == "d:org" and by[7].key == "p:ok.com/x/y"
    assert not any(r.blocked for r in urlfilter.judged(docs, entries.limit(0)).collect())
    assert urlfilter.judged(docs.limit(0), entries).collect() == []
