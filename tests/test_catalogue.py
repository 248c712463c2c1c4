"""Every registered query against its SQL, at the smallest scale."""

import math

import pytest

from docloom.plans import load_catalogue

CATALOGUE = load_catalogue()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list | tuple) else str(v) if hasattr(v, "year") else v


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOGUE.QUERIES))
def test_query(spark, sf, con, name):
    df = CATALOGUE.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in CATALOGUE.ORACLES:
        assert got
        return
    cursor = con.execute(CATALOGUE.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
