"""Host verdicts by a plain count, both ways of joining, the rows law through the query, buckets by all columns."""

import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folioweave.llm import quality_rules, queries, sharding
from folioweave.session import prepare

DDL = "doc_id long, source string, text string"


def hosts():
    """A bad large host, a good one, one-document hosts and a host without a name."""
    plain, marked = "word{} " * 60, "word{}# " * 60
    make = lambda pattern: pattern.format(*range(60))
    rows = [(i, "bad", make(marked if i % 5 else plain)) for i in range(40)] + [(100 + i, "good", make(plain)) for i in range(60)]
    rows += [(500 + i, "good", make(plain)) for i in range(90)]
    rows += [(200 + i, f"one{i}", make(marked if i == 3 else plain)) for i in range(30)] + [(300, None, make(plain)), (301, None, None), (301, None, "x y")]
    return rows + [(400, "good", make(marked))]


def plainly(rows):
    r, by = quality_rules.Rules(), defaultdict(list)
    facts = [(i, host, quality_rules.text_facts(t)) for i, host, t in rows]
    fails = lambda f: (100 * f[2] > r.strict_symbols_pct * f[0], 100 * f[3] > r.strict_dup_lines_pct * f[5], 100 * f[4] > r.strict_repeat_pct * f[0])
    for _, host, f in facts:
        by[host].append(fails(f))
    suspect = dict.fromkeys(by, False)
    for k in range(3):
        # The analysis of variance over documents, written out: sums of squares between and within hosts.
        every = [x[k] for v in by.values() for x in v]
        n, h, mean = len(every), len(by), sum(every) / len(every)
        rate = {host: sum(x[k] for x in v) / len(v) for host, v in by.items()}
        between = sum((rate[host] - mean) ** 2 for host, v in by.items() for _ in v) / (h - 1)
        within = sum((x[k] - rate[host]) ** 2 for host, v in by.items() for x in v) / (n - h)
        size = (n - sum(len(v) ** 2 for v in by.values()) / n) / (h - 1)
        rho = (between - within) / (between + (size - 1) * within) if between > within else 0
        strength = 1e6 if rho <= 0 else min(1e6, max(2, 1 / rho - 1))
        for host, v in by.items():
            suspect[host] |= (sum(x[k] for x in v) + mean * strength) / (len(v) + strength) > r.suspect_rate
    kept = []
    for i, host, f in facts:
        base = f[0] < r.min_words or 100 * f[4] > r.max_repeat_pct * f[0]
        lenient = 100 * f[2] > r.lenient_symbols_pct * f[0] or 100 * f[3] > r.lenient_dup_lines_pct * f[5]
        kept.append((i, not base and not lenient and not (suspect[host] and any(fails(f)))))
    return kept, suspect


def test_host_verdicts_by_a_plain_count_and_by_either_join(spark, monkeypatch):
    prepare(spark)
    rows = hosts()
    # The symbol share of marked texts is under the lenient limit.
    rows = [(i, h, t and t.replace("#", "", 48)) for i, h, t in rows]
    want, suspect = plainly(rows)
    assert suspect["bad"] and not suspect["good"] and not suspect["one3"]
    df = spark.createDataFrame(rows, DDL).withColumn("facts", F.lit(1)).withColumn("host_key", F.lit("clash"))
    for most in (quality_rules.MOST_BROADCAST, -1):
        monkeypatch.setattr(quality_rules, "MOST_BROADCAST", most)
        got = quality_rules.judge(df)
        assert sorted((r["doc_id"], r["kept"]) for r in got.collect()) == sorted(want)


def test_quality_sql_on_made_hosts(spark, tmp_path):
    prepare(spark)
    rows = [(i, h, t and t.replace("#", "", 48)) for i, h, t in hosts()]
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP1_SQL})").fetchall())


@pytest.mark.parametrize("most", [sharding.MOST_BROADCAST, -1])
def test_rows_law_sizes_and_checksums_through_the_query(spark, tmp_path, monkeypatch, most):
    prepare(spark)
    monkeypatch.setattr(sharding, "MOST_BROADCAST", most)
    texts = [None, "", "ä日本", "same", "same", "x" * 50_000] + ["same"] * 80 + [f"t{i}" for i in range(37)]
    spark.createDataFrame([(None if i == 9 else i, "s", t) for i, t in enumerate(texts)], DDL).withColumn("shard", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_sharding(spark, str(tmp_path)).collect()
    raw = [(t or "").encode() for t in texts]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(None if i == 9 else i), len(b) + 16, zlib.crc32(b)) for i, b in enumerate(raw))
    assert {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_buckets_follow_the_bytes_of_all_columns(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, "s" * 500, "t", [b"x" * 300], {"a": "b" * 200}) for i in range(200)], DDL + ", blobs array<binary>, tags map<string,string>")
    mixed = sharding.shuffled(df, bucket_bytes=20_000)
    sizes = [r["count"] for r in mixed.groupBy("bucket").count().collect()]
    assert sum(sizes) == 200 and len(sizes) >= 9 and max(sizes) < 60
