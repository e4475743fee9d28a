"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from larkspur.plans.catalog import QUERIES, SQL

UNORDERED = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", UNORDERED)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        made = con.execute(SQL[name])
        assert got == rows([c[0] for c in made.description], made.fetchall())
    else:
        assert got[1] or name in ("irr_band_gate",)
