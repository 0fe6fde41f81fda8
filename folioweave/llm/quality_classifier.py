"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained from labelled texts. A text is cut into stretches, each stretch is compressed with either
dictionary; the sums give the normalised difference (bad - good) / (bad + good) and the share (bad + good) / 2 of the
text's own size. A logistic curve over the difference and the share's logarithm, fitted on labelled texts that the
dictionaries have not seen, calibrates the score to a probability; the share tells how much a difference says, as in texts
of repeated words either dictionary leaves next to nothing.

Defined cases: a null or empty text has a difference of zero and a share of one; null labels, and labels of ids that no
document has, are ignored; an id labelled twice has its largest label; with labels of one class only, each text scores
that class's share (one half without any); repeated rows score alike; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.toxicity import labelled_sample, logistic
from folioweave.session import fresh

STRETCH = 2048
LEVEL = 3
MEASURES = ("difference", "share")


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]


class Meter:
    """Compressors with the dictionaries loaded once; measures texts."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(data: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(data) if data else None
            if held:
                held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = (compressor(x).compress for x in (good, bad))

    def measures(self, text: str | None) -> tuple[float, float]:
        data = (text or "").encode()
        if not data:
            return 0.0, 1.0
        parts = [data[i : i + STRETCH] for i in range(0, len(data), STRETCH)]
        good, bad = (sum(len(f(p)) for p in parts) for f in (self.good, self.bad))
        return (bad - good) / (bad + good), (bad + good) / (2 * len(data))


def expand(x: np.ndarray) -> np.ndarray:
    """What the curve is over: the difference by compressed and by own size, scaled as the ridge expects, the share's
    logarithm and its square."""
    log = np.log(np.maximum(x[:, 1], 1e-3))
    return np.column_stack([10 * x[:, 0], 20 * x[:, 0] * x[:, 1], log, log**2])


def fit(docs: DataFrame, labels: DataFrame, train: Column, target: str = "quality", sample_rows: int = 8_000, dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, text: str = "text", key: str = "doc_id") -> Model:
    """Learn from the labelled rows that the column ``train`` (over ``labels``) allows.

    Bounds: ``sample_rows`` labelled texts; of a half of them, stretches of ``sample_bytes`` in all for each class, drawn
    by a hash from all stretches of the whole texts, reach the driver, where a dictionary of ``dictionary_bytes`` is
    trained; of the other half, three numbers each.
    """
    sample = labelled_sample(docs, labels, target, train, sample_rows, text, key).withColumn("half", F.pmod(F.xxhash64(F.lit(3), key), F.lit(2)))
    share = sample.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    if share is None or share in (0.0, 1.0):
        p = 0.5 if share is None else share
        return Model(b"", b"", (float(np.clip(np.log(max(p, 1e-4) / max(1 - p, 1e-4)), -9, 9)), 0.0, 0.0, 0.0, 0.0))
    dictionaries = {}
    for good in (True, False):
        some = sample.where((F.col("y") > 0) == F.lit(good)).where("half = 0").select(key, F.col("text").cast("binary").alias("data")).where(F.length("data") > 0)
        # Each text's stretches, the last of full size too, are put in a seeded order; first ones come first, so that long
        # texts do not crowd others out.
        last = F.greatest(F.lit(1), F.length("data") - STRETCH + 1)
        mixed = F.array_sort(F.transform(F.sequence(F.lit(1), F.length("data"), F.lit(STRETCH)), lambda at: F.struct(F.xxhash64(F.lit(5), F.col(key), at).alias("draw"), F.least(at, last).alias("at"))))
        parts = some.select(key, "data", F.posexplode(mixed).alias("turn", "x")).select(key, "turn", "x.draw", F.expr(f"substring(data, x.at, {STRETCH})").alias("part"))
        rows = [bytes(r["part"]) for r in parts.orderBy("turn", "draw", key).limit(max(1, sample_bytes // STRETCH)).collect()]
        dictionaries[good] = train_dictionary(rows, dictionary_bytes)
    good, bad = dictionaries[True], dictionaries[False]

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meter = Meter(good, bad)
        for part in parts:
            yield pd.DataFrame([(int(y > 0), *meter.measures(t)) for y, t in zip(part["y"], part["text"], strict=True)], columns=["y", *MEASURES])

    seen = np.array(sample.where("half = 1").mapInPandas(measure, "y int, " + ", ".join(f"{m} double" for m in MEASURES)).collect(), dtype=float)
    if not len(seen) or seen[:, 0].min() == seen[:, 0].max():
        return Model(good, bad, (0.0, 5.0, 0.0, 0.0, 0.0))
    return Model(good, bad, tuple(map(float, logistic(expand(seen[:, 1:]), seen[:, 0], ridge=0.1))))


def train_dictionary(rows: list[bytes], size: int) -> bytes:
    """A trained dictionary, or with too few samples for training their own bytes."""
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(rows)[-size:]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with two more last columns, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    name, verdict = fresh(docs, "score"), fresh(docs, "predicted")

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        meter, b = Meter(model.good, model.bad), np.array(model.curve)
        for batch in texts:
            x = expand(np.array([meter.measures(t) for t in batch], float).reshape(-1, 2))
            yield pd.Series(1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30))))

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(scores, "double")(F.col(f"`{text}`"))).withColumn(verdict, (F.col(name) >= 0.5).cast("int"))
