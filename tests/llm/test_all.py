from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tensorloom.llm.queries import ORACLE, QUERIES
from tests.compare import database, differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_missing_and_repeated_ids_and_clashing_columns(spark, odd_dir, name):
    assert QUERIES[name](spark, odd_dir).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("where", ["edge", "given"])
def test_sql(spark, edge_dir, sf_dir, name, where):
    d = edge_dir if where == "edge" else sf_dir
    assert not differences(QUERIES[name](spark, d).toPandas(), database(d).execute(ORACLE[name]).df())


def test_all_are_registered():
    names = set(entry.queries())
    assert {"pipeline", *QUERIES} <= names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
