"""Concordance of predicted genotypes with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    """a / b, and 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def contingency(df: DataFrame, by: list[str] | None = None, ranks: str = "ranks", prediction: str = "prediction") -> DataFrame:
    """correct, total, tp, fn, fp, tn. `ranks`: label ranks by genotype (0 for wrong), `prediction`: the genotype chosen, from 0.

    Ranks 1 and 2 (the same alleles in another phase) are correct; any rank agrees in presence. A truth whose first rank is 0 is not
    the reference.
    """
    got = F.get(F.col(ranks), F.col(prediction))
    nonref, present = F.get(F.col(ranks), F.lit(0)) == 0, F.coalesce(got != 0, F.lit(False))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return df.groupBy(*(by or [])).agg(
        n(F.coalesce(got.isin(1, 2), F.lit(False))).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        n(present & nonref).alias("tp"),
        n(~present & nonref).alias("fn"),
        n(~present & ~nonref).alias("fp"),
        n(present & ~nonref).alias("tn"),
    )


def rates(table: DataFrame) -> DataFrame:
    """Adds concordance, and of the non-reference calls concordance, precision, recall and F1; each 0 where it has no rows."""
    c = F.col
    return (
        table.withColumn("concordance", _share(c("correct"), c("total")))
        .withColumn("nonref_concordance", _share(c("tp") + c("tn"), c("total")))
        .withColumn("precision", _share(c("tp"), c("tp") + c("fp")))
        .withColumn("recall", _share(c("tp"), c("tp") + c("fn")))
        .withColumn("f1", _share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")))
    )


def label_ranks(n: Column, label: Column) -> Column:
    """Ranks where only the true genotype is known: 1 for it, 3 for others but the first if it is not the first, else 0."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == label, 1).when((label > 0) & (i > 0), 3).otherwise(0))


def worst(df: DataFrame, loss: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest loss; ties go to the smaller key. Spark keeps k rows in each task."""
    return df.orderBy(F.desc(loss), key).limit(k)
