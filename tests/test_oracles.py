"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tarnflow import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (pd.Timestamp, np.datetime64)) or type(value).__name__ in ("date", "datetime"):
        return str(pd.Timestamp(value))
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.number)) or type(value).__name__ == "Decimal":
        return round(float(value), 5) + 0.0
    return str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sql, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), sql.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-5 * max(1, abs(w)))


def test_lines_without_a_day_have_rows(spark, tmp_path):
    con, at = duckdb.connect(), "TIMESTAMP '2024-01-01'"
    con.execute(f"create table orders as select CAST(i AS BIGINT) AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, {at} + to_days(CAST(i * 7 % 90 AS INT)) AS o_orderdate, '1-URGENT' AS o_orderpriority from range(60) r(i)")
    con.execute(f"""create table lineitem as select i % 70 AS l_orderkey, CAST(1 + i // 70 AS INT) AS l_linenumber, CASE WHEN i % 41 = 0 THEN NULL ELSE (i + i // 9) % 4 END AS l_suppkey, 100.0::DOUBLE + i % 13 AS l_extendedprice,
        {at} + to_days(CAST(i % 80 AS INT)) AS l_shipdate from range(280) r(i)""")
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = registry.QUERIES["ev_peer_relative"](spark, str(tmp_path)).toPandas()
    a, b = rows(got), rows(con.execute(registry.ORACLES["ev_peer_relative"]).df())
    assert len(got) == 280 and 40 <= got["relative"].isna().sum() < 280  # ten orders are missing, with four lines each
    assert len(a) == len(b) and all(v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-5 * max(1, abs(w))) for x, y in zip(a, b, strict=True) for v, w in zip(x, y, strict=True))
    assert (got["relative"] != got["relative_p0_p60"]).any() and (got["change_p0_p20"].abs() > 0).any()


def test_names():
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150
