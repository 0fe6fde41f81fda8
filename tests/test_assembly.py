"""Assembly, review and payload operators: edge cases, brute-force folds, and streams against their batch twins."""

import codecs
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import assembly as A
from folioweave.operators import review as V
from folioweave.session import prepare
from folioweave.sources import payloads as P
from folioweave.streaming import state as X

SEGMENT = "doc_id long, ord long, line_no long, type string, text string, page long, x1 int, y1 int, x2 int, y2 int, page_width int, page_height int"
BLOCK = "doc_id long, ord long, line_no long, page long, kind string, text string, caption string"


def test_decoding_order_and_errors(spark):
    t = "héllo 中文"
    cases = [(t.encode(), t, "utf-8"), (codecs.BOM_UTF8 + t.encode(), t, "utf-8-sig"), (t.encode("utf-16"), t, "utf-16"), (t.encode("utf-32"), t, "utf-32"), ("中文字".encode("gb18030"), "中文字", "gb18030"), (b"", "", "utf-8"), (b"a\0b", None, "utf-8"), (b"\xff", None, None), (None, None, None)]
    df = prepare(spark).createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, raw binary")
    got = {r["i"]: r["d"] for r in df.select("i", P.decoded(F.col("raw")).alias("d")).collect()}
    assert [(got[i]["text"], got[i]["encoding"]) for i in range(len(cases))] == [c[1:] for c in cases]
    assert [got[i]["error"] for i in (6, 7, 8)] == ["nul", "undecodable", "missing"]


def test_canonical_json_and_unsafe_keys(spark):
    rows = ['{"b": [1, {"X-Api-Key": 1}], "a": "é"}', "[]", "{", None, '{"a": NaN}', "null", '{"path": {"Set-Cookie": 2}}']
    df = prepare(spark).createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, p string")
    got = [tuple(r["c"]) for r in df.select("i", P.canonical_json(F.col("p")).alias("c")).orderBy("i").collect()]
    assert got == [('{"a":"é","b":[1,{"X-Api-Key":1}]}', ["X-Api-Key"]), ("[]", []), (None, []), (None, []), (None, []), ("null", []), ('{"path":{"Set-Cookie":2}}', ["Set-Cookie", "path"])]


def test_unpacked_payloads(spark):
    body = json.dumps({"a": 1}).encode()
    rows = [(0, body, None), (1, gzip.compress(body), "GZIP"), (2, body, "gzip"), (3, body, "zip"), (4, None, "gzip"), (5, gzip.compress(body)[:-4], "gz")]
    got = prepare(spark).createDataFrame(rows, "i long, raw binary, how string").select("i", P.unpacked(F.col("raw"), F.col("how")).alias("d")).orderBy("i").collect()
    assert [r["d"] and bytes(r["d"]) for r in got] == [body, body, None, None, None, None]


def test_puts_are_create_only(spark):
    ref = ["src_" + str(i) * 32 for i in range(4)]
    schema = "ref string, content binary, expected_size long, expected_sha string"
    old = spark.createDataFrame([(ref[0], b"a", None, None), (ref[1], b"b", None, None)], schema)
    new = spark.createDataFrame([(ref[0], b"a", 1, None), (ref[1], b"c", None, None), (ref[2], b"d", None, None), (ref[3], b"e", 2, None), (ref[0] + "0", b"a", None, None), (None, b"a", None, None)], schema)
    assert sorted((str(r["ref"]), r["outcome"]) for r in P.put_outcome(old, new).collect()) == sorted([(ref[0], "same"), (ref[1], "exists"), (ref[2], "stored"), (ref[3], "mismatch"), (ref[0] + "0", "bad_reference"), ("None", "bad_reference")])


def test_contents_entries(spark):
    want = {"第 一 章": "第 一 章", "目　录": "目录", "三章": "三章", "杂": "", "甲乙丙丁戊（１２）": "甲乙丙丁戊...（１２）", "One ....... 12": "One...12", "Two   7": "Two...7", "Three - 9": "Three...9", "plain text": "plain text", "": ""}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["e"] for r in df.select("t", A.contents_entry(A.strip(F.col("t"))).alias("e")).collect()} == want


def test_inline_noise_goes_only_between_structured_lines(spark):
    def block(k, lines):
        return [(1, k, i, t) for i, t in enumerate(lines)]

    rows = block(1, ["1章", "四字杂音", "2章"]) + block(2, ["plain words", "四字杂音", "2章"]) + block(3, ["1章", "四字杂音", "plain"]) + block(4, ["1章", "x y", "四字杂音", "2章"]) + block(5, ["", None]) + block(6, ["1章", "x y", "四字杂音", "四字杂音", "2章"])
    got = {}
    for r in A.contents_block(spark.createDataFrame(rows, "doc_id long, block long, line_no long, text string")).orderBy("block", "entry_no").collect():
        got.setdefault(r["block"], []).append(r["entry"])
    assert got == {1: ["1章", "2章"], 2: ["plain words", "四字杂音", "2章"], 3: ["1章", "四字杂音", "plain"], 4: ["1章", "x y", "2章"], 6: ["1章", "x y", "四字杂音", "四字杂音", "2章"]}


def test_output_lines(spark):
    def seg(i, kind, text, page=0, y1=0, y2=20):
        return (1, i, i, kind, text, page, 10, y1, 500, y2, 600, 1000)

    rows = [seg(0, "title", "Head"), seg(1, "text", "a long first line of pros-", 0, 850, 900), seg(2, "text", "e goes on here", 1, 50, 70), seg(3, "text", "and stays in it", 1, 70, 90), seg(4, "image", "", 1, 90, 95), seg(5, "text", "other text.", 1, 95, 110), seg(6, "text", "new one\nsecond part", 1, 110, 130), seg(7, "text", None, 1, 130, 140)]
    got = [(r["kind"], r["text"]) for r in A.output_lines(spark.createDataFrame(rows, SEGMENT)).orderBy("out_no").collect()]
    assert got == [("title", "Head"), ("text", "a long first line of prose goes on here and stays in it"), ("text", "other text."), ("text", "new one"), ("text", "second part")]


@pytest.mark.parametrize("seed", range(3))
def test_cross_page_merges_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, page = [], 0
    for i in range(150):
        page += rng.random() < 0.4
        rows.append((1, i, i, page, rng.choice(["text", "text", "table", "table"]), rng.choice(["ends.", "goes on", "Capital", "中文", ""]), rng.choice(["", "", None, "cap"])))
    texts, tables = [], []
    for _, _, i, p, kind, t, c in rows:
        last = texts[-1] if texts else None
        if last and last["kind"] == kind == "text" and last["page"] != p and last["text"] and t and last["text"][-1] not in "。！？.!?…" and (t[0].islower() or t[0] == "中"):
            last["text"] += ("" if last["text"][-1] in "中文" and t[0] == "中" else " ") + t
            last["n"] += 1
        else:
            texts.append({"kind": kind, "page": p, "text": t, "n": 1, "head": i})
        last = tables[-1] if tables else None
        if last and last["kind"] == kind == "table" and last["page"] != p and not c:
            last["caption"] = f"{last['caption']} [continued from p{last['page']} to p{p}]".strip()
            last["n"], last["next"] = last["n"] + 1, i
        else:
            tables.append({"kind": kind, "page": p, "caption": c or "", "n": 1, "head": i})
    df = spark.createDataFrame(rows, BLOCK)
    assert sorted((r["head"], r["n_parts"], r["text"]) for r in A.cross_page_text(df).collect()) == [(x["head"], x["n"], x["text"]) for x in texts if x["n"] > 1]
    assert sorted((r["head"], r["n_parts"], r["caption"], r["continuation"]) for r in A.cross_page_tables(df).collect()) == [(x["head"], x["n"], x["caption"], x["next"]) for x in tables if x["n"] > 1]


def test_consensus_equals_a_replay(spark):
    rng = random.Random(4)
    rows = [(d, f"c{c:02}", k + 1, 1000 * d + 10 * c + k, rng.choice(["accept", "revise"]), rng.choice([0.8, 0.9, 0.95, None])) for d in range(4) for c in range(12) for k in range(rng.randint(1, 4))]
    want = []
    for d in range(4):
        calls = 6
        for c in range(12):
            votes = [r for r in rows if r[:2] == (d, f"c{c:02}")][:3]
            ok = [r[4] == "accept" and (r[5] or 0) >= 0.9 for r in votes]
            used = 1
            while not ok[0] and used < 3 and calls and sum(ok[:used]) == used - 1:
                calls -= 1
                if used == len(votes):
                    break
                used += 1
            accepted = ok[0] or (used == 3 and sum(ok[:3]) >= 2)
            fit = [v for v, o in zip(votes[:used], ok, strict=False) if o == accepted]
            want.append((d, f"c{c:02}", used, accepted, max(fit, key=lambda v: -1 if v[5] is None else v[5])[3]))
    got = V.consensus(spark.createDataFrame(rows, "doc_id long, crop string, vote_no int, vote_id long, decision string, confidence double"))
    assert sorted((r["doc_id"], r["crop"], r["n_votes"], r["accepted"], r["chosen"]) for r in got.collect()) == want


def test_empty_tables(spark):
    assert A.output_lines(spark.createDataFrame([], SEGMENT)).count() == 0
    blocks = spark.createDataFrame([], BLOCK)
    assert A.cross_page_text(blocks).count() == A.cross_page_tables(blocks).count() == 0
    assert V.dark_peaks(spark.createDataFrame([("x", None), ("x", 300)], "image string, gray int")).count() == 0
    assert V.page_summary(spark.createDataFrame([(1, None, 3)], "doc_id long, page long, expected int")).count() == 0


def test_streams_equal_their_batch_twins(spark, tmp_path):
    prepare(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.agg(F.percentile_approx(F.col("ts").cast("long"), 0.5)).first()[0]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}.c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    for cond in (F.col("ts").cast("long") < middle, F.col("ts").cast("long") >= middle):
        events.where(cond).write.mode("append").parquet(str(tmp_path / "in"))
        steps, versions = run(X.run_transitions_stream(source), "steps"), run(X.selection_stream(source), "versions")
    cols = ["event_id", "user_id", "before", "status", "allowed"]
    assert sorted(map(tuple, steps.select(cols).collect())) == sorted(map(tuple, X.run_transitions(events).select(cols).collect()))
    last = versions.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_events"), F.max("version").alias("version"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, X.selection_replay(events).collect()))
