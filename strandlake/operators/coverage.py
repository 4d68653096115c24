"""Depth of coverage: weighted means, normalised by contig and GC content, and samples of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.variants import autosome, main_contig


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))


def global_mean(df: DataFrame, value: str = "mean", weight: str = "len") -> DataFrame:
    return df.agg(weighted_mean(value, weight).alias("mean_coverage"))


def normalised(df: DataFrame, by: list[str], value: str = "mean", weight: str = "len") -> DataFrame:
    """By group: weighted mean over that of all rows, and the number of rows."""
    groups = df.groupBy(*by).agg(weighted_mean(value, weight).alias("__m"), F.count(F.lit(1)).alias("windows"))
    return groups.join(F.broadcast(global_mean(df, value, weight))).select(*by, F.try_divide("__m", "mean_coverage").alias("norm_coverage"), "windows")


def gc_bin(gc: str) -> Column:
    """Percent of GC, rounded half to even."""
    return F.bround(F.col(gc) * 100, 0).cast("int")


def by_contig(depth: DataFrame) -> DataFrame:
    return normalised(depth.withColumn("len", F.col("end") - F.col("start")), ["contig"])


def by_gc(depth: DataFrame) -> DataFrame:
    """Of autosomes, against the mean of all contigs."""
    depth = depth.withColumn("len", F.col("end") - F.col("start"))
    groups = depth.where(autosome("contig")).withColumn("gc_bin", gc_bin("gc")).groupBy("gc_bin").agg(weighted_mean("mean", "len").alias("__m"), F.count(F.lit(1)).alias("windows"))
    return groups.join(F.broadcast(global_mean(depth))).select("gc_bin", F.try_divide("__m", "mean_coverage").alias("norm_coverage"), "windows")


def aligned_norm(windows: DataFrame) -> DataFrame:
    """By contig: mean of norm_coverage weighted by the bases that are neither N nor unknown; windows without any are dropped."""
    w = windows.withColumn("aligned", F.col("seq_len") - F.col("n_bases") - F.col("other_bases")).where("aligned <> 0")
    return w.groupBy("contig").agg(weighted_mean("norm_coverage", "aligned").alias("norm_coverage"))


def order_key(key: Column, seed: int) -> Column:
    """A pseudo-random order of integer keys that any SQL engine can repeat."""
    return F.pmod(key * 1103515245 + (12345 + seed), F.lit(2147483648))


def stratified(df: DataFrame, group: str, key: str, n: int, least: int, seed: int = 0) -> DataFrame:
    """About `n` rows over all in the order of a hash of `key`, but `least` of each group (or all it has).

    The n-th key in that order is a top-n, rows up to it stay, and small groups are filled up by a top-k in each group; Spark limits both
    in every task before it shuffles.
    """
    rows = df.withColumn("__o", order_key(F.col(key), seed))
    bar = rows.orderBy("__o").limit(n).agg(F.max("__o")).first()[0]
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__o", key))).where(F.col("__r") <= least).drop("__r")
    return rows.where(F.col("__o") <= F.lit(bar)).union(first.where(F.col("__o") > F.lit(bar))).drop("__o")


def main_contigs(df: DataFrame) -> DataFrame:
    return df.where(main_contig("contig"))


def downsample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Keeps all rows of a share of the keys (a pair of reads stays together)."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def augmented_coverage(key: Column, coverage: Column, seed: int = 0) -> Column:
    """A coverage between half of `coverage` and all of it, fixed by the key."""
    return coverage * (0.5 + 0.5 * order_key(key, seed) / 2147483648.0)
