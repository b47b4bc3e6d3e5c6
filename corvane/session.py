"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ARROW_BYTES = 16 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor, once per application, and bound the size of Arrow batches.

    The zip is served by the driver, so executors need no shared folder for it. Batches are bounded by bytes, since
    ten thousand long texts would be too much for a Python worker.
    """
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647")
    if not size.isdigit() or int(size) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane_pkg.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.join(root.name, p.relative_to(root)))
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return set_dir or f"file://{tempfile.gettempdir()}/corvane-checkpoint-{os.getuid()}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder, so that lost executors cost no data."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/corvane-{uuid.uuid4().hex[:8]}")
    return df.checkpoint(eager)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed_once(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """df with these columns, each computed exactly once per row.

    The optimizer copies a column's expression into every filter and expression above it; for costly ones that
    repeats the work many times over. A generator that yields one row is a step it doesn't copy through.
    """
    replaced = {k.lower() for k in named}
    keep = [c for c in df.columns if c.lower() not in replaced]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in named.items()]))))


def spread(df: DataFrame, mb_per_core: int = 2) -> DataFrame:
    """df over all cores where the scan of a small input would leave most of them idle. Larger inputs come in enough splits and aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))  # files as they lie, before columns are pruned
    return df.repartition(cores) if size <= mb_per_core * cores << 20 else df
