"""Every query against its SQL over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from halyard.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        names = rel.columns
        assert sorted(names) == cols
        assert rows == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    if name.startswith("recall_at_10"):
        assert float(rows[0][cols.index("recall")]) >= 0.9


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
