"""Each query against its SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from proofline.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    names = sorted(found.columns)
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = Counter(tuple(canonical(row[columns.index(n)]) for n in names) for row in result.fetchall())
    assert Counter(tuple(canonical(row[n]) for n in names) for row in found.collect()) == want
