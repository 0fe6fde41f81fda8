"""Edge cases of the refinement operators that the driver's tables do not hold."""

from folioweave.operators import refine as R


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_outline_windows_overlap_and_end_with_the_last_heading(spark):
    heads = spark.createDataFrame([(1, i, "heading", 2) for i in range(1, 231)] + [(2, 1, "paragraph", None)], "doc_id long, line_no long, kind string, level int")
    got = {}
    for r in R.outline_windows(heads).collect():
        got.setdefault(r["w"], []).append(r["line_no"])
    assert {w: (min(x), max(x), len(x)) for w, x in got.items()} == {0: (1, 120, 120), 1: (101, 220, 120), 2: (201, 230, 30)}


def test_outline_vote_ties_go_to_the_earliest_window(spark):
    votes = spark.createDataFrame([(1, 5, 3, 0), (1, 5, 2, 1), (1, 6, 1, 1), (1, 6, 4, 2), (1, 6, 4, 3)], "doc_id long, line_no long, level int, w long")
    assert rows(R.outline_vote(votes), "line_no") == [(1, 5, 3, 1), (1, 6, 4, 2)]


def test_compact_toc_takes_marked_lines_only(spark):
    lines = [(1, 1, "第1章 甲 第2章 乙"), (1, 2, "甲 第1章 第2章"), (1, 3, "第1章 only"), (1, 4, "第1章 " + "x" * 130 + " 第2章"), (1, 5, None), (1, 6, "")]
    got = rows(R.compact_toc(spark.createDataFrame(lines, "doc_id long, line_no long, text string")), "line_no", "entry_no")
    assert got == [(1, 1, 1, 0, 5, "第1章 甲"), (1, 1, 2, 6, 11, "第2章 乙")]


def test_paragraphs_join_wrapped_lines(spark):
    text = ["one hy-", "phen", ", two", "甲", "乙 end.", "new", "", None, "last-"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no long, text string")
    assert rows(R.paragraphs(lines), "para") == [(1, 1, "one hyphen, two甲乙 end."), (1, 2, "new"), (1, 3, "last-")]


def test_safe_choice_keeps_raw_where_much_is_lost(spark):
    texts = spark.createDataFrame([(1, "abcdefgh", "abcde"), (2, "abcdefgh", "abcdef"), (3, "甲乙丙丁abcd", "甲乙abcdxx"), (4, "", "")], "doc_id long, a string, b string")
    assert [r["chosen"] for r in R.safe_choice(texts, "a", "b").orderBy("doc_id").collect()] == ["raw", "normalized", "raw", "normalized"]


def test_orphan_captions_become_paragraphs(spark):
    blocks = [(1, 1, 0, 0, "caption", "a"), (1, 2, 0, 1, "figure", "f"), (1, 3, 0, 2, "caption", "b"), (1, 4, 0, 3, "caption", "c"), (1, 5, 1, 4, "caption", "d")]
    df = spark.createDataFrame([(*b, 0.1 * b[1], 0.0, 1.0, 0.5) for b in blocks], "doc_id long, line_no long, page long, ord long, kind string, text string, l double, top double, r double, bottom double")
    assert [(r["line_no"], r["kind"], r["caption"]) for r in R.caption_absorb(df).orderBy("line_no").collect()] == [(1, "paragraph", ""), (2, "figure", "b c"), (5, "paragraph", "")]


def test_duplicate_visuals_prefer_containment_then_order(spark):
    box = "doc_id long, page long, kind string, id string, ord long, l double, top double, r double, bottom double"
    native = spark.createDataFrame([(1, 0, "figure", "n1", 2, 0.0, 0.0, 1.0, 1.0), (1, 0, "figure", "n0", 1, 0.0, 0.0, 1.0, 1.0), (1, 0, "table", "t", 0, 0.0, 0.0, 1.0, 1.0)], box)
    cands = spark.createDataFrame([(1, 0, "figure", "c", 5, 0.0, 0.0, 1.0, 0.9), (1, 0, "figure", "small", 6, 0.0, 0.0, 0.5, 0.5), (1, 1, "figure", "far", 7, 0.0, 0.0, 1.0, 1.0)], box)
    assert rows(R.duplicate_visuals(native, cands), "id") == [(1, "c", "n0")]
