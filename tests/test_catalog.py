"""Each query of the catalog that has SQL gives the rows that DuckDB gives; the others give rows of one schema."""

import math

import duckdb
import pytest

from tests.conftest import SF
from textloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.6f}"
        return str(v)

    return sorted([one(v) for v in r] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(columns).collect()
    if name in catalog.ORACLE:
        found = duck.sql(catalog.ORACLE[name])
        assert sorted(found.columns) == columns
        assert plain(rows) == plain(found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_uncovered_takes_every_region(spark, monkeypatch):
    from textloom.operators import layout

    taken, uncovered = [], layout.uncovered
    monkeypatch.setattr(layout, "uncovered", lambda *sides: (taken.extend(sides), uncovered(*sides))[1])
    rows = catalog.QUERIES["jon4_uncovered"](spark, SF).collect()
    regions = layout.line_regions(catalog.documents(spark, SF)).select("doc_id", "region_idx")
    sides = [side.select("doc_id", "region_idx") for side in taken]
    assert sides[0].unionByName(sides[1]).exceptAll(regions).isEmpty() and regions.exceptAll(sides[0].unionByName(sides[1])).isEmpty()
    assert all(side.count() for side in sides) and rows
