"""Every query that has SQL, against that SQL in DuckDB; every other one runs."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tessera import plans  # noqa: E402
from tessera.plans.registry import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        res = con.execute(ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_expanded_segments_are_not_broadcast(spark):
    """The estimate of expanded segments is their file's size, so a plan must not broadcast them (or anything else by that estimate)."""
    assert "Broadcast" not in QUERIES["scalar_reference_identity"](spark, SF)._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_draws_do_not_travel_with_clusters(spark):
    """Orders are dealt by cluster once; the thirty draws of each are no rows of a shuffle."""
    plan = QUERIES["agg_complexity_bootstrap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("o_custkey" in line for line in dealt) and not any("o_custkey" in line and "draw" in line for line in dealt)
