"""Session helpers: shipping the package, the shared scratch folder, durable intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bounds of one Arrow batch, and so of what a Python worker holds at a time beside one row: texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready: executors can import this package, Arrow batches are bounded.

    The bounds hold for the session's later queries too, as plans are run after this returns; bounds that the session
    has set itself are kept.
    """
    own = dict(spark.conf.getAll)
    for name, value in BATCHES.items():
        if name not in own:
            spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        out = os.path.join(tempfile.mkdtemp(prefix="folioweave-"), "folioweave.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
        spark.sparkContext.addPyFile(out)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one if the driver is the only
    machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioweave-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors (the files are committed by task) and lets later reads
    prune columns, which a checkpoint does not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
