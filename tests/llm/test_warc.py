"""WARC archives with damage, orphans and clashing columns."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from folioweave.llm import queries, warc
from folioweave.session import prepare

DDL = "page_id long, url string, html string, payload int, id string, sha long"


def archive(spark, folder, n=12):
    prepare(spark)
    rng = random.Random(3)
    rows = [(i, f"u{i}", "".join(rng.choices("abcdefghijklmnop<>", k=900)), 1, "x", 2) for i in range(n)]
    files = warc.write(spark.createDataFrame(rows, DDL).coalesce(1), str(folder)).collect()
    assert len(files) == 1 and files[0]["records"] == n
    return Path(files[0]["path"].removeprefix("file:"))


def starts(path):
    return [at for at, data in warc.members(str(path), 0, 1 << 40) if data is not None]


@pytest.mark.parametrize("split", [150, 4000, 1 << 20])
def test_damage_is_never_passed_over(spark, tmp_path, split):
    path = archive(spark, tmp_path / "a")
    places, whole = starts(path), path.read_bytes()
    ends = [*places[1:], len(whole)]
    for name, change in (("body", lambda b, a, e: b[: a + 300] + bytes(x ^ 255 for x in b[a + 300 : a + 304]) + b[a + 304 :]), ("head", lambda b, a, e: b[: a + 2] + b"\0" + b[a + 3 :]), ("trailer", lambda b, a, e: b[: e - 6] + bytes(x ^ 255 for x in b[e - 6 : e - 4]) + b[e - 4 :])):
        for k in (0, 5, 11):
            path.write_bytes(change(whole, places[k], ends[k]))
            got = warc.read_folder(spark, str(tmp_path / "a"), split, damaged="row")
            kinds = [r["record_type"] for r in got.collect()]
            assert kinds.count("response") >= 11 - (k == 5 and name == "trailer") and kinds.count("damaged") == 1, (name, k)
            with pytest.raises(PythonException, match="damaged record"):
                warc.read_folder(spark, str(tmp_path / "a"), split).collect()
    for cut in (20, len(whole) - places[9]):
        path.write_bytes(whole[:-cut])
        kinds = [r["record_type"] for r in warc.read_folder(spark, str(tmp_path / "a"), split, damaged="row").collect()]
        assert "damaged" in kinds and kinds.count("response") == (11 if cut == 20 else 9)
    path.write_bytes(whole)
    assert warc.read_folder(spark, str(tmp_path / "a"), split).count() == 12


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    path = archive(spark, tmp_path / "a")
    shutil.copy(path, path.with_name("part-orphan.warc.gz"))
    assert warc.read_folder(spark, str(tmp_path / "a")).count() == 12
    assert warc.read_folder(spark, str(tmp_path / "a"), manifest=False).count() == 24
    with pytest.raises(ValueError, match="fail or row"):
        warc.read_folder(spark, str(tmp_path / "a"), damaged="skip")


def test_query_with_clashing_columns_and_an_empty_table(spark, tmp_path):
    prepare(spark)
    rows = [(1, "u", "same", 1, "x", 2), (3, "v", "same", 1, "x", 2), (2, None, None, None, None, None)]
    spark.createDataFrame(rows, DDL).withColumn("refers_to", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in queries.op3_warc(spark, str(tmp_path)).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 3 and got[1]["payload_bytes"] == 4 and got[2]["payload_bytes"] == 0
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert queries.op3_warc(spark, str(tmp_path / "none")).count() == 0
