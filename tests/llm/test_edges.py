"""Edges of the operators through Spark: empty tables, clashing columns, random texts, long runs, labels of one class."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioweave.llm import bpe, packing, quality_classifier, queries, secrets, simhash, toxicity
from folioweave.session import prepare, table

DDL = "doc_id long, text string, score string, predicted int, secrets int, fp int, row int, key int, block int, part int"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5, 6, 7) for i, t in texts], DDL)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_toxicity", "op4_bpe", "op5_secret_scans", "op6_packing", "op7_simhash", "op9_sharding", "op10_quality_classifier"])
def test_queries_on_an_empty_table_and_on_empty_texts(spark, tmp_path, name):
    docs_of(spark, []).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    docs_of(spark, [(1, None), (2, ""), (2, ""), (None, " \n ")]).withColumn("source", F.lit(None).cast("string")).write.parquet(str(tmp_path / "bare" / "documents.parquet"))
    for folder in ("none", "bare"):
        spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / folder / "labels.parquet"))
    run = queries.queries()[name]
    assert run(spark, str(tmp_path / "none")).collect() == []
    got = run(spark, str(tmp_path / "bare")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "None"]
    if "score" in got[0]:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def random_texts(n=300):
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "apikey", "API-KEY", "secret", '"', "'", " ", "  ", ":", "=", "\t", "\n", "AKIA", "akia", "é", "日", "deadbeef0123456789", "DEADBEEF", "x" * 11, "Zq9XkT2mWv7RbN4pLs8Y", "a/b+c=", ".", "-", "_", "0123456789", "ABCDEFGHIJ"]
    return [(i, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(n)]


def test_secrets_through_spark_against_the_written_patterns(spark, tmp_path):
    texts = [*random_texts(), (900, None), (901, "token=" + "a" * 200_000), (901, "token=" + "a" * 200_000)]
    df = docs_of(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = (("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    model = secrets.train()
    got = {}
    for r in queries.op5_secret_scans(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    masked = {}
    for r in secrets.masked(df).collect():
        masked.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        base = [(m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= least]
        base.sort()
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        for r in got[i]:
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == k for x in base) for k, *_ in kinds)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            spans = [s.split(":") for s in r["spans"].split(",") if s]
            assert [":".join(s) for s in spans if s[0] != "markov"] == [s for s in joined.split(",") if s]
            free = set(range(len(t or ""))) - {k for a, _, _, b in base for k in range(a, b)}
            for _, a, b in (s for s in spans if s[0] == "markov"):
                assert set(range(int(a), int(b))) <= free and model.ratio(t[int(a) : int(b)]) > model.limit
        for r in masked[i]:
            assert list(r.asDict()) == df.columns and r["text"] == secrets.mask(t, model) and r["score"] == "s"
    assert len(got[901]) == len(masked[901]) == 2
    found, name = secrets.with_spans(df)
    assert name == "secrets_" and found.columns == [*df.columns, "secrets_"]


def test_long_runs_of_close_fingerprints_are_split(spark):
    prepare(spark)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(250)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(simhash.signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    def groups(pairs):
        root = {x: x for x in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}
    want = groups([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    for long_run in (1, 5, simhash.LONG_RUN):
        found = [(r["a"], r["b"]) for r in simhash.links(df, long_run).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found) and groups(found) == want
    assert all(len(simhash.half_masks(c)) == 20 for c in simhash.CHOICES)


def test_tokenizers_on_random_texts_and_clashing_columns(spark):
    texts = [*random_texts(60), (70, "word" * 40_000), (71, "a" * 100 + " " + "b" * 300), (72, None)]
    df = docs_of(spark, texts)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["key"]: (r["ids"], r["decoded"]) for r in bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.json"), block_chars=2_000).collect()}
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, tok.decode(ids, skip_special_tokens=False))
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, whole = Tokenizer.from_file(path), {}
    for r in packing.pack(df, path, group_pieces=7).collect():
        whole.setdefault(r["key"], []).append((r["start"], r["ids"]))
    for i, t in texts:
        assert [x for _, ids in sorted(whole[i]) for x in ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    encoder = packing.encoder_of(path)
    assert max(map(len, encoder.cache), default=0) <= encoder.CACHED_CHARS


def test_quality_scores_by_plain_compression_and_labels_of_one_class(spark):
    prepare(spark)
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = quality_classifier.fit(docs, labels, ~toxicity.held_out("doc_id", 3, 1))
    df = docs.limit(40).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ä" * 5_000)], "doc_id long, text string")).withColumn("score", F.lit("s")).withColumn("PREDICTED", F.lit(0))
    got = quality_classifier.score(df, model)
    assert got.columns[-2:] == ["score_", "predicted_"]
    sizes = {}
    for name, data in (("good", model.good), ("bad", model.bad)):
        sizes[name] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in got.collect():
        raw = (r["text"] or "").encode()
        good, bad = (sum(len(c.compress(raw[a : a + 2048])) for a in range(0, len(raw), 2048)) for c in (sizes["good"], sizes["bad"]))
        diff, share = ((bad - good) / (bad + good), (bad + good) / (2 * len(raw))) if raw else (0.0, 1.0)
        log = np.log(max(share, 1e-3))
        z = np.dot(model.curve, [1, 10 * diff, 20 * diff * share, log, log * log])
        assert r["score_"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30)))) and r["predicted_"] == int(r["score_"] >= 0.5)
    for y in (0, 1):
        one = quality_classifier.fit(docs, labels.withColumn("quality", F.lit(y)), F.lit(True))
        assert {r["predicted"] for r in quality_classifier.score(docs, one).collect()} == {y}
    assert quality_classifier.fit(docs, labels.limit(0), F.lit(True)).curve[0] == 0.0
