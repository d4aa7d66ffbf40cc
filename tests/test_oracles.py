"""Every query of the engine against its SQL, at the smallest scale, on whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from pagemill.plans import catalogue

DIR = Path("/root/testdata/sf0.001")


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    return x


def rows(frame, columns):
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(DIR)).toPandas()
    if name not in catalogue.ORACLES:
        assert len(found) > 0
        return
    wanted = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found, sorted(found.columns)) == rows(wanted, sorted(found.columns))
