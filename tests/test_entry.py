"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    frame = frame.where(frame.notna(), None)
    one = lambda v: repr(float(v)) if isinstance(v, float) else repr(int(v)) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 and got["run_slot" if "run_slot" in got else got.columns[0]].notna().all()


def test_verified_energies(spark):
    assert all(abs(r["difference"]) < 1e-6 for r in registry.QUERIES["verify_annealing_energy"](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
