"""Depths of any tree, cycles, texts that share an id, running titles, open lists, whole selection logs, operations in order."""

import random

from pyspark.sql import functions as F

from folioweave.operators import graph as G
from folioweave.operators import patches as Z
from folioweave.operators import reader as D
from folioweave.operators import text as T
from folioweave.session import prepare
from folioweave.streaming import state as X

NODES = "doc_id long, node string, parent_node string"


def test_depths_of_long_chains_and_cycles(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "d", "a"), (2, "e", None), (2, "f", "gone"), (3, "s", "s")]
    got = {(r["doc_id"], r["node"]): r["depth"] for r in G.depths(spark.createDataFrame(rows, NODES)).collect()}
    assert all(got[1, f"n{i}"] == i for i in range(40))
    assert [got[2, x] for x in "abcdef"] == [None] * 4 + [0, 0] and got[3, "s"] is None
    assert G.depths(spark.createDataFrame([], NODES)).collect() == []


def test_texts_that_share_an_id_keep_their_offsets(spark):
    rows = [(1, "ab\ncd"), (1, "\r\n\rx\n"), (1, None), (None, "z")]
    got = sorted(map(tuple, T.line_index(spark.createDataFrame(rows, "doc_id long, body string")).select(F.coalesce("doc_id", F.lit(-1)), "line_no", "text", "start", "stop", "sep_end").collect()))
    assert got == sorted([(1, 1, "ab", 0, 2, 3), (1, 2, "cd", 3, 5, 5), (1, 1, "", 0, 0, 2), (1, 2, "", 2, 2, 3), (1, 3, "x", 3, 4, 5), (1, 4, "", 5, 5, 5), (-1, 1, "z", 0, 1, 1)])
    rng = random.Random(2)
    body = "".join(rng.choices(["a", "bc", "\n", "\r\n", "\r", "日"], k=5000))
    lines = T.line_index(spark.createDataFrame([(1, body)], "doc_id long, body string")).orderBy("line_no").collect()
    assert lines[-1]["sep_end"] == len(body) and all(body[r["start"] : r["stop"]] == r["text"] for r in lines) and all(a["sep_end"] == b["start"] for a, b in zip(lines, lines[1:], strict=False))


def test_a_title_stays_and_tabs_are_stripped(spark):
    rows = [(1, n, text, kind, True, None) for n, text, kind in ((1, "Head\t", "paragraph"), (3, "　Head", "heading"), (5, "Head", "title"), (9, "Head ", "unknown"), (11, "other", "paragraph"))]
    got = {r["line_no"]: r["kind"] for r in T.demoted(spark.createDataFrame(rows, "doc_id long, line_no long, text string, kind string, starts_new boolean, level int")).collect()}
    assert got == {1: "header", 3: "header", 5: "title", 9: "header", 11: "paragraph"}


def test_items_hang_on_open_lists(spark):
    kinds = [("heading", None), ("list", None), ("list_item", None), ("paragraph", None), ("list_item", None), ("heading", 3), ("heading", 2), ("list", None), ("list_item", None)]
    groups = spark.createDataFrame([(1, i + 1, k, v) for i, (k, v) in enumerate(kinds)], "doc_id long, group_no long, kind string, level int")
    tree = T.heading_tree(groups)
    assert [r["parent"] for r in tree.orderBy("group_no").collect()] == [None, 1, 2, 1, 1, 1, 1, 7, 8]
    assert [tuple(r) for r in G.preorder(tree).orderBy("group_no").select("depth", "node_order").collect()] == [(0, 0), (1, 1), (2, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 7), (3, 8)]


def test_selection_events_carry_versions_over_days_and_ranges(spark):
    prepare(spark)
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), f"2024-01-{1 + i // 40:02} 00:{i % 60:02}:00", None if i % 50 == 7 else f'{{"k": {rng.randrange(20)}}}') for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, props string").withColumn("ts", F.to_timestamp("ts"))
    version, want = {}, []
    for i, user, _, props in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = props is not None and int(props[6:-1]) % 5 == version.get(user, 0) % 5
        version[user] = version.get(user, 0) + hit
        want.append((i, user, hit, version[user]))
    for size in (10, 50_000):
        assert sorted(map(tuple, X.selection_events(events, slice_rows=size).collect())) == sorted(want)


def test_a_contents_level_waits_for_its_reclassification(spark):
    nodes = spark.createDataFrame([(1, "a", "unknown", None, None, None, "complete", None)], "doc_id long, node string, kind string, level int, parent_node string, text string, state string, ocr double")
    ops = spark.createDataFrame([(1, "a", 0, "set_toc_level", None, 2, None, 0.9), (1, "a", 1, "reclassify_node", "list_item", None, None, 0.95), (1, "a", 2, "set_parent", "a", None, None, 0.99)], "doc_id long, node string, pos long, op string, value string, level int, original string, confidence double")
    row = Z.applied(nodes, Z.ordered(ops, Z.unresolved(nodes))).first()
    assert (row["kind"], row["toc_level"], row["parent_node"]) == ("list_item", 2, None)
    assert [(x["op"], x["outcome"]) for x in row["log"]] == [("reclassify_node", "applied"), ("set_toc_level", "applied"), ("set_parent", "own_parent")]


def test_poll_times_stop_before_the_deadline():
    assert D.poll_times(2, 1.5, 10, 20) == [0, 2, 5, 9.5, 16.25]
    assert D.poll_times(2, 1.5, 10, 1800, most=2) == [0, 2]
