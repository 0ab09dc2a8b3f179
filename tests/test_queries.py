"""Every registered query against its SQL, over the smallest tables."""

from collections import Counter

import duckdb
import pytest

from chronolex.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    return con


def levelled(row):
    return tuple("null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    rows = [levelled([r[c] for c in columns]) for r in df.collect()]
    if name not in registry.ORACLE:
        assert rows
        return
    answer = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert Counter(rows) == Counter(levelled([r[names.index(c)] for c in columns]) for r in answer.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
