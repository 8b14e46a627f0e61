"""Every registered query against its DuckDB SQL at sf0.01 (the correctness gate)."""

import os

import pytest

import __spark_entry__ as entry_mod
from conftest import SF001
from oracle_harness import compare, duck

from segmint.plans.oracle import oracle_sql
from segmint.plans.queries import QUERIES

SQL = oracle_sql()      # the text operators have tests of their own

pytestmark = pytest.mark.skipif(not os.path.exists(SF001), reason="test data missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF001), con.sql(SQL[name]).df())
    assert res["columns_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["match"], res


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "ArrayType(DoubleType(), False)": "DOUBLE[]", "TimestampNTZType()": "TIMESTAMP", "DateType()": "DATE"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_column_types_match_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    ours = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in df.schema.fields}
    rel = con.sql(SQL[name])
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert ours == theirs


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(SQL) <= set(entry_mod.oracle_sql())


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 + 6 * 3
    assert len(df.columns) == 2 + 17
    assert df.columns[:2] == ["row_order", "row_label"]
