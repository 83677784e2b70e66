"""Every query with an oracle text: Spark vs DuckDB on the same Parquet tables (sf0.001).

``model_coverage`` fits two tree models; ``test_backtest`` covers it on small series, ``tools/check_oracle.py`` at sf0.01.
"""

import duckdb
import pytest

import __spark_entry__ as E
from ledgerlake.sources.tables import TABLES

from conftest import SF_SMALL

HEAVY = {"model_coverage"}
NAMES = sorted(k for k in E.oracle_sql() if k not in HEAVY)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(df):
    import datetime
    import pandas as pd
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        out = []
        for v in r:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
                out.append(None)
            elif isinstance(v, (datetime.date, pd.Timestamp)):
                out.append(pd.Timestamp(v).isoformat())
            elif hasattr(v, "item"):
                out.append(repr(v.item()))
            else:
                out.append(repr(v))
        rows.append(tuple("∅" if x is None else x for x in out))
    return sorted(rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert _canon(sp) == _canon(dd)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"segment", "risk_level", "customers", "revenue"}


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
