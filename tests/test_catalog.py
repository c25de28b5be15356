"""Every query with SQL, compared with DuckDB on the smallest scale."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from incidentia.catalog.oracle import all_oracles
from incidentia.catalog.queries import all_queries
from incidentia.operators import models as MO

SF = "/root/testdata/sf0.001"
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(all_queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got = all_queries()[name](spark, SF)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(columns, result.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")
def test_a_model_that_learned_nothing_fails_its_query(spark, monkeypatch):
    def untrained(train, *_):
        labels = sorted(r[0] for r in train.select("label").distinct().collect())
        n = len(labels)
        head = MO._logistic(train.sparkSession, np.zeros((n, 64)), np.zeros(n), n)
        return MO.EmbeddingModel(MO.LinearHead(labels, [head]))

    monkeypatch.setattr(MO, "fit_embedding_model", untrained)
    judged = all_queries()["embedding_head"](spark, SF).select("beats_majority").distinct()
    assert [r[0] for r in judged.collect()] == [False]
