"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per partition, find the frequent digests. Their winners are counted exactly and
broadcast, so that rows of frequent digests are settled on the map side; the other digests, none of which can have
more than two (k + 1)-ths of the rows, take an ordinary shuffle.

Bound of the broadcast: a summary of n_p rows errs by n_p / (k + 1) at most and never counts a digest too high.
Added over partitions, estimates sum to n at most, so at most k + 1 digests reach n / (k + 1).

Defined cases: a null text counts as the empty text; a null id ranks below every other; of rows that agree in text and
id one stays (the one last by row key); an empty table gives an empty table; extra columns are ignored and may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, place, small_batches, text_or_empty
from .rows import PLACE, located, remaining

#: Counters of a Misra-Gries summary.
COUNTERS = 1024


def shrink(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """The merge step of Misra-Gries summaries: at most `k` counters stay, each less by the (k + 1)-th largest count."""
    if len(counts) <= k:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    least = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return {d: c - least for d, c in counts.items() if c > least}


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Digests whose Misra-Gries estimate reaches n / (k + 1): every one with 2n / (k + 1) rows or more, k + 1 in all at most."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        n = 0
        for b in batches:
            n += b.num_rows
            for x in b.column(0).value_counts().to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = shrink(counts, k)
        # The row without a digest carries the rows read.
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], names=["digest", "n"])

    summed = digests.select("digest").mapInArrow(summarise, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    summed = cut(summed)
    total = summed.where("digest is null").select(F.col("n").alias("total"))
    return summed.where("digest is not null").join(F.broadcast(total), F.col("n") * (k + 1) >= F.col("total")).select("digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_bytes.

    keep_id is the largest id among equal texts; `kept` marks exactly one row of each group.
    """
    return decided(pick(df, doc_id=id_col, text=text_col).withColumn("row_key", F.monotonically_increasing_id()), k).drop("row_key")


def decided(df: DataFrame, k: int) -> DataFrame:
    """`df`: doc_id, text and row_key, which tells rows apart and has an order. The columns of `exact_dedup`, and row_key."""
    small_batches(df.sparkSession)
    text = text_or_empty()
    rows = cut(df.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("text_bytes"), "row_key"))
    rank = F.max(F.struct("doc_id", "row_key"))
    heavy = frequent(rows, k).withColumnRenamed("digest", "hd")
    # k + 1 rows at most: the verified winners, with exact counts.
    heavy = cut(rows.join(F.broadcast(heavy), F.col("digest") == F.col("hd")).groupBy("digest").agg(rank.alias("best"), F.count(F.lit(1)).alias("group_size")))
    winners = F.broadcast(heavy.select(F.col("digest").alias("hd"), "best", "group_size"))
    settled = rows.join(winners, F.col("digest") == F.col("hd")).drop("hd")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(rank.alias("best"), F.count(F.lit(1)).alias("group_size"))
    shuffled = rest.join(groups, "digest")
    return settled.select(*shuffled.columns).union(shuffled).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_key") == F.col("best.row_key")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_bytes",
        "row_key",
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """The rows of `df` that stay, with all their columns; no text is shuffled if `df` is a scan of files.

    Rows that agree in id and text are one document: one of them stays.
    """
    full, in_files = located(df)
    rows = full.select(F.col(f"c{place(df, id_col)}").alias("doc_id"), F.col(f"c{place(df, text_col)}").alias("text"), F.struct(*PLACE).alias("row_key"))
    return remaining(full, decided(rows, k).where("NOT kept").select("row_key.*"), in_files).toDF(*df.columns)
