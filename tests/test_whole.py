"""Whole jobs: nothing is cut from a user's log, a book's lines or a text's secrets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from folioweave import catalog
from folioweave.streaming import state as X


def events_of(spark, n=600):
    rng = random.Random(4)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(20_000)), 1 if rng.random() < 0.8 else rng.randrange(2, 5), '{"k": %d}' % rng.randrange(100) if i % 50 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, props string")


def test_selection_history_goes_on_over_days_and_slices(spark):
    rows, events = events_of(spark)
    versions, want = {}, {}
    for i, ts, user, props in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = props is not None and int(props[6:-1]) % 5 == versions.get(user, 0) % 5
        versions[user] = versions.get(user, 0) + hit
        n, accepted, _ = want.get((user, str(ts.date())), (0, 0, 0))
        want[user, str(ts.date())] = (n + 1, accepted + hit, versions[user])
    for slice_rows in (50_000, 40):
        got = X.selection_history(events, slice_rows=slice_rows).collect()
        assert {(r["user_id"], r["day"]): (r["n_events"], r["accepted"], r["version"]) for r in got} == want and len(got) == len(want)


def test_selection_stream_by_user_equals_history(spark, tmp_path):
    _, events = events_of(spark, 300)
    events.where("props IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    q = X.selection_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), by_day=False).writeStream.format("memory").queryName("history").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("history").groupBy("user_id").agg(F.sum(F.col("accepted").cast("long")), F.max("version"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, X.selection_history(batch).groupBy("user_id").agg(F.sum("accepted"), F.max("version")).collect()))


def test_contents_queries_find_lines_of_a_book_itself(spark, tmp_path):
    long = "Ein sehr langer Titel eines Kapitels mit vielen Worten"
    text = f"Anfang\n{long} ..... 12\n{long} und mehr ..... 345\n第一章 海 第二章 山\n第三章 " + "x" * 240 + " 第四章 y"
    spark.createDataFrame([(2, text), (5, "no such lines")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path))
    items = run("toc_items_whole").collect()
    assert {r["doc_id"] for r in items} == {2} and f"{long} ..... 12" in {r["item"] for r in items}
    assert f"{long} und mehr...345" in {r["entry"] for r in run("contents_entries_whole").collect()}
    assert f"{long} und mehr...345" in {r["entry"] for r in run("contents_block_whole").collect()}
    assert {(r["doc_id"], r["block"]): r["matches"] for r in run("contents_vote_whole").collect()}[2, 0] >= 2
    found = {r["entry"] for r in run("compact_toc_whole").collect() if r["line_no"] % 2 == 0}
    assert found == {"第一章 海", "第二章 山"}
