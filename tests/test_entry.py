from decimal import Decimal
from itertools import permutations
from pathlib import Path

import duckdb
from pyspark.sql import Row

import __spark_entry__ as e


def test_registered_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert set(e.catalog.queries()) == set(e.catalog.oracle_sql())


def test_assignment_covers_every_order(spark):
    d = "/root/testdata/sf0.001"
    lines = {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").collect():
        lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_shipdate.toordinal(), float(r.l_quantity)))
    lines = {k: {i: (q, day) for i, (_, day, q) in enumerate(sorted(x), 1)} for k, x in lines.items()}
    got = {}
    for r in e.catalog.graph.assigned(e.catalog._waiting(spark, d), ["k"], "a", "b", "cost").collect():
        got.setdefault(r.k, {})[r.a] = r.b
    assert got.keys() == lines.keys()
    for k, x in lines.items():
        assert sorted(got[k]) == sorted(got[k].values()) == sorted(x)
        if len(x) <= 5:
            cost = [sum(x[i][0] * x[j][1] for i, j in zip(x, p)) for p in permutations(x)]
            assert abs(sum(x[i][0] * x[j][1] for i, j in got[k].items()) - min(cost)) < 1e-3


def test_every_query_against_its_sql(spark):
    """All rows of all queries of the core at the smallest scale, compared with DuckDB."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def plain(v):
        if isinstance(v, (float, Decimal)):
            return "nan" if v != v else round(float(v), 5)
        if isinstance(v, Row):
            v = v.asDict()
        if isinstance(v, dict):
            return sorted((k, plain(x)) for k, x in v.items())
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    for name, sql in e.catalog.oracle_sql().items():
        got = e.catalog.queries()[name](spark, d)
        cols, want = sorted(got.columns), con.sql(sql)
        assert sorted(want.columns) == cols, name
        at = [want.columns.index(c) for c in cols]
        assert sorted(repr([plain(r[c]) for c in cols]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall()), name
