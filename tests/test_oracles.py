"""The core's queries against their SQL on the smallest tables."""

import importlib
import math
import os
import pkgutil
from pathlib import Path

import duckdb
import pytest

import folioscope.queries as core

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
MODULES = [m.name for m in pkgutil.iter_modules(core.__path__)]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("module", MODULES)
def test_against_sql(spark, module):
    m = importlib.import_module(f"folioscope.queries.{module}")
    con = duckdb.connect()
    con.sql("SET enable_progress_bar = false")
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wrong = []
    for name, sql in m.ORACLES.items():
        df, rel = m.QUERIES[name](spark, str(FOLDER)), con.sql(sql)
        columns = sorted(df.columns)
        if sorted(rel.columns) != columns:
            wrong.append((name, columns, rel.columns))
            continue
        got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
        places = [rel.columns.index(c) for c in columns]
        want = sorted(repr(tuple(plain(r[i]) for i in places)) for r in rel.fetchall())
        if got != want:
            wrong.append((name, len(got), len(want)))
    assert not wrong
