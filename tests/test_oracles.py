"""Every engine query beside its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from folioflow.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        out.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    rel = db.sql(catalog.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
