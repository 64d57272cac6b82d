import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tessera import registry
from tessera.sources.tables import TABLES

registry.load_plans()
SF = Path("/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in sorted(v.items())})
    return str(bytes(v) if isinstance(v, bytearray) else v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, str(SF))
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    res = con.execute(registry.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted([norm(r[names.index(c)]) for c in order] for r in res.fetchall())
    have = sorted([norm(r[c]) for c in order] for r in got)
    assert len(have) == len(want)
    assert have == want
