"""Every registered query against DuckDB, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, records):
    show = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x)[:26]
    return sorted(repr([show(float(r[k]) if isinstance(r[k], int) and not isinstance(r[k], bool) else r[k]) for k in cols]) for r in records)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    df = entry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    got = [r.asDict() for r in df.collect()]
    assert rows(cols, got) == rows(cols, want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
