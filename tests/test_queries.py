from __future__ import annotations

import pytest

from tensorloom import queries as core
from tests.compare import database, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert not differences(core.QUERIES[name](spark, sf_dir).toPandas(), con.execute(core.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_other_queries_run(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert core.entry(spark, sf_dir).count() == 1


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


WHOLE = ["apply_axis", "slice_assign", "index_fill", "broadcast_column", "transpose", "reshape", "roll", "upsample"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tensor_queries_leave_no_row_out(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for query in (f"{name}_embeddings", f"{name}_all_embeddings"):
        assert n > 100 and core.QUERIES[query](spark, sf_dir).count() == n * (128 if name == "upsample" else 64)


def test_unwrap_of_jumps_by_half_a_period(spark, tmp_path):
    """Jumps of half a period that rounding makes a little less: query and SQL decide alike."""
    import pandas as pd

    jumps = [0.0, 5.65, 20.65, 10.06, 25.06, 63.13, 126.13, 3.13, 0.13]
    pd.DataFrame({"event_id": range(len(jumps)), "value": jumps}).to_parquet(tmp_path / "events.parquet")
    want = database(str(tmp_path)).execute(core.ORACLE["unwrap_events"]).df()
    assert not differences(core.QUERIES["unwrap_events"](spark, str(tmp_path)).toPandas(), want)
