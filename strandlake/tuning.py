"""How work is dealt to tasks, what they share, and how plans are cut."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as there are cores, if its input has fewer splits: for steps that make much of few bytes.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by `key` over the session's number of shuffle partitions, none of which is merged away for being small: for groups
    that take long to work on although they have few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir does not name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so that neither a second reader nor a lost executor computes it again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their path has it. Operators with Python functions need it there."""
    context = spark.sparkContext
    if str(ROOT) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(":")) or getattr(context, "_strandlake", False):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "strandlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "strandlake").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(path)
    context._strandlake = True
