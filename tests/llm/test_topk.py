"""Exact top-k: own rows, repeated ids, edges, the SQL on made tables, and how much is left out."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folioweave.llm import queries, topk
from folioweave.session import prepare

DDL = "vec_id long, embedding array<double>"


def brute(rows, k, is_query=lambda i: i % 20 == 0):
    sound = [(n, i, np.floor(64 * np.array(v, float))) for n, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, i, v in sound:
        if is_query(i):
            best = sorted((-int(v @ c), j) for m, j, c in sound if m != n and len(c) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def made(rng, n=400, width=8, skew=1.0):
    return [(i, [float(x) for x in rng.normal(size=width) * rng.lognormal(sigma=skew)]) for i in range(n)]


def test_rows_that_share_an_id_are_each_others_candidates(spark):
    prepare(spark)
    rows = made(np.random.default_rng(1), 90) + [(20, [2.0**35, 1.0] + [0.0] * 6), (20, [1.0] * 8), (40, None), (60, [None] * 8), (80, [float("inf")] * 8), (0, []), (1, []), (200, [1.0]), (None, [1.0] * 8), (100, [-1.0] * 8), (100, [-1.0] * 8)]
    for blocks in ((3, 20), (1000, 1000), (7, 1)):
        got = topk.top_k(spark.createDataFrame(rows, DDL), F.col("id") % 20 == 0, query_block=blocks[0], candidate_block=blocks[1])
        assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_sql_agrees_on_repeated_ids_and_edges(spark, tmp_path):
    prepare(spark)
    rows = made(np.random.default_rng(2), 120) + [(20, [1.0] * 8), (20, [1.0] * 8), (0, []), (60, []), (7, None), (140, [1.0])]
    df = spark.createDataFrame(rows, DDL).withColumn("row", F.lit("clash")).withColumn("id", F.lit(None).cast("int"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, queries.op8_exact_top_k(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP8_SQL).fetchall()) == brute(rows, 20)


def test_empty_tables_and_tables_without_queries(spark):
    prepare(spark)
    assert topk.top_k(spark.createDataFrame([], DDL), F.col("id") % 20 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, None)], DDL), F.col("id") % 20 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], DDL), F.col("id") % 20 == 0).collect() == []


def test_skewed_lengths_leave_out_most_products(spark):
    prepare(spark)
    rows = made(np.random.default_rng(3), 3000, skew=1.5)
    df = spark.createDataFrame(rows, DDL)
    found = topk.found_rows(df, F.col("id") % 20 == 0, query_block=40, candidate_block=200)
    products = found.agg(F.sum("products")).first()[0]
    assert products < 0.5 * 150 * 3000
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0, query_block=40, candidate_block=200).collect())) == brute(rows, 20)


def test_both_ways_of_pruning_and_both_ways_of_multiplying():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 12)) * np.array([30] * 4 + [1] * 8)
    c = np.floor(np.concatenate([base + rng.normal(size=base.shape), rng.normal(size=(1500, 12)) * 5]))
    q = np.floor(base)
    ids, rows = np.arange(len(c)) // 2, np.arange(len(c))
    for floor in (np.full(len(q), -np.inf), np.sort(q @ c.T, axis=1)[:, -5]):
        best, n = topk.search_cell(-1 - np.arange(len(q)), q, rows, ids, c, 5, floor)
        got = pd.DataFrame({"q": best.query, "s": best.score, "i": best.id}).groupby("q")[["s", "i"]].apply(lambda t: list(map(tuple, t.to_numpy().tolist()))).to_dict()
        want = {i: [(s, float(j)) for s, j in sorted(((float(v @ x), int(j)) for x, j in zip(c, ids, strict=True)), key=lambda t: (-t[0], t[1]))[:5]] for i, v in enumerate(q)}
        assert got == want and n < q.shape[0] * c.shape[0]


def test_ties_go_to_the_smaller_id(spark):
    prepare(spark)
    rows = [(i, [1.0, 0.0]) for i in range(600)] + [(20, [0.5, 0.0])] * 3
    for blocks in ((4, 50), (5000, 20_000)):
        got = topk.top_k(spark.createDataFrame(rows, DDL), F.col("id") % 20 == 0, k=3, query_block=blocks[0], candidate_block=blocks[1])
        assert sorted(map(tuple, got.collect())) == brute(rows, 3)
