"""Phase segments along a sample's variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(df: DataFrame, by: list[str], order: list[str], kind: str = "kind", ps: str = "ps") -> DataFrame:
    """`df` with breaks (whether a new segment begins before the row) and segment (from 0).

    An implicitly phased row goes with any phase and leaves it as it is, so the state before a row is the last phase that is not
    implicit. Two rows continue a phase if both are phased globally, or both locally in one set; whatever follows no phase at all
    begins nothing new.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    told = F.when(F.col(kind) != "implicit", F.struct(F.col(kind).alias("kind"), F.col(ps).alias("ps")))
    before = F.last(told, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = ((F.col("__p.kind") == "global") & (F.col(kind) == "global")) | ((F.col("__p.kind") == "local") & (F.col(kind) == "local") & F.col("__p.ps").eqNullSafe(F.col(ps)))
    out = df.withColumn("__p", before).withColumn("breaks", (F.col(kind) != "implicit") & F.col("__p").isNotNull() & ~goes_on)
    return out.withColumn("segment", F.sum(F.col("breaks").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__p")
