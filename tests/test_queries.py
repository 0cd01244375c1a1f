"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexgrove.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return v if math.isinf(v) else float(f"{v:.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = core.QUERIES[name](spark, SF)
    want = con.execute(core.ORACLE[name])
    names = sorted(got.columns)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    rows = sorted(([value(r[c]) for c in names] for r in got.collect()), key=repr)
    assert rows == sorted(([value(r[columns.index(c)]) for c in names] for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_targets_are_sought_where_documents_have_them(spark, monkeypatch):
    """Passages of documents without any benchmark text are not searched for one, and no target is lost."""
    sought, containing = {}, core.evaluate.containing
    monkeypatch.setattr(core.evaluate, "containing", lambda texts, items, key: (sought.setdefault(key, texts), containing(texts, items, key))[1])
    _, qrels, norms = core._targets(spark, SF)
    assert 0 < sought["pos"].count() < core._index(spark, SF).texts.count()
    want = core._qrels(spark, SF).collect()
    assert want and sorted(map(tuple, qrels.collect())) == sorted(map(tuple, want))
    places = core._index(spark, SF).meta.select("n", core.P.document_of(core.F.col("pos")).alias("of"))
    assert places.where("n <> of").isEmpty() and norms.count()
