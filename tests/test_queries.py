"""Every query of the catalogue against its oracle in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from heddle.plans import catalogue


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tiny}/{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, tiny, oracle, name):
    df = catalogue.QUERIES[name](spark, tiny)
    found = df.collect()
    if name in catalogue.ORACLES:
        result = oracle.execute(catalogue.ORACLES[name])
        assert rows(df.columns, found) == rows([d[0] for d in result.description], result.fetchall())
    else:
        assert found
