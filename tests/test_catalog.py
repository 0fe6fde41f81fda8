"""Each reference query against its DuckDB SQL on the smallest tables, and edge cases of the line rules."""

import glob
import math
import os

import duckdb
import pytest

from folioweave import catalog
from folioweave.operators import text as T
from folioweave.streaming import state as X

SF = "/root/testdata/sf0.001"


def flat(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(flat, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(flat, r)) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want


def test_line_index_edges(spark):
    rows = [(1, "a\r\nb\rc\n"), (2, ""), (3, None)]
    got = sorted(map(tuple, T.line_index(spark.createDataFrame(rows, "doc_id long, body string")).collect()))
    assert got == [(1, 1, "a", 0, 1, 3), (1, 2, "b", 3, 4, 5), (1, 3, "c", 5, 6, 7), (1, 4, "", 7, 7, 7), (2, 1, "", 0, 0, 0)]


def test_single_long_line_stands_alone(spark):
    body = "x" * 20 + "\n" + "y" * 3 + "\n" + "z" * 3
    lines = T.line_index(spark.createDataFrame([(1, body)], "doc_id long, body string"))
    assert sorted((r["first_line"], r["last_line"]) for r in T.source_units(lines, 200, 10).collect()) == [(1, 1), (2, 3)]


def test_hourly_activity_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = X.hourly_activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, X.hourly_activity(events).collect()))
