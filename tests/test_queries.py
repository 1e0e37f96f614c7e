"""Every registered query against its SQL twin, over the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, db, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    ours = sorted(map(tuple, frame.select(columns).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    theirs = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b or a == pytest.approx(b, abs=2e-5)


def test_report_rounds_as_its_sql(spark, db):
    """Means that lie between two texts, as 9 of 32 queries do: SQL rounds the number itself, not its shortest digits."""
    values = [9 / 32, 13 / 32, 61 / 160, 1 / 160, 0.00015, 0.00005, 0.00035, 0.1, 0.0, 1.0]
    found = metrics.report(spark.createDataFrame(list(enumerate(values)), "k bigint, recall double").withColumn("map", F.col("recall")), "dev")
    want = db.execute("SELECT printf('dev recall@%d: %.2f%% map@%d: %.4f', k, x * 100, k, x) FROM (SELECT unnest(range(10)) AS k, unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert sorted(r.line for r in found.collect()) == sorted(line for (line,) in want)
    assert {"dev recall@0: 28.12% map@0: 0.2812", "dev recall@5: 0.01% map@5: 0.0001"} <= {line for (line,) in want}
