"""Every registered query with SQL gives the SQL's rows; those without give rows."""

import pytest

from tests.conftest import rows_of
from trailframe.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["val17_verdicts", "val17_verdicts_whole"])
def test_verdicts_with_a_lap_of_one_event(name, spark, tmp_path):
    """A lap that ends as it starts is a finding of the laps, which the SQL of val17_verdicts does not have."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (i * i) AS ts, i % 2 AS user_id, 'view' AS event_type, (10.5 + i)::DOUBLE AS value FROM range(1, 26) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = rows_of(QUERIES[name](spark, str(tmp_path)).toPandas()), rows_of(con.execute(ORACLES[name]).df())
    assert got == want
    assert len(got) == 2
