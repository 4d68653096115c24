"""Packing rows of different sizes into batches of bounded size, in order.

Greedy packing looks at one row after another, so it is done shard by shard: a shard is a run of rows that one task packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def greedy(df: DataFrame, shard: str, order: str, size: str, limit: int) -> DataFrame:
    """(shard, order, size, batch, begin): a row goes to the current batch if it fits, else a new one begins. A row over the limit is an error.

    A shard's rows are sorted in one task, which may spill, and go through the packer one Arrow batch after the other: only the current
    batch's number and fill are held.
    """
    rows = df.select(shard, F.col(order).cast("bigint").alias(order), F.col(size).cast("bigint").alias(size))
    kind = rows.schema[shard].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, used, begun = None, 0, 0, False
        for b in batches:
            numbers, begins = [], []
            for s, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or s != now:
                    now, batch, used, begun = s, 0, 0, True
                if z > limit:
                    raise ValueError(f"a row of {z} is larger than a batch of {limit}")
                if used + z > limit:
                    batch, used = batch + 1, 0
                numbers.append(batch)
                begins.append(used)
                used += z
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int32()), pa.array(begins, pa.int64())], names=[shard, order, size, "batch", "begin"])

    return rows.repartition(shard).sortWithinPartitions(shard, order).mapInArrow(pack, f"`{shard}` {kind}, `{order}` bigint, `{size}` bigint, batch int, begin bigint")


def offsets(packed: DataFrame, shard: str, order: str, support: str) -> DataFrame:
    """Adds offset: where a row's support begins in its batch, and support_end."""
    w = Window.partitionBy(shard, "batch").orderBy(order)
    end = F.sum(support).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return packed.withColumn("support_end", end).withColumn("offset", end - F.col(support))


def repeated_labels(ranks, replicates: int):
    """Each rank once for each replicate."""
    return F.flatten(F.transform(ranks, lambda r: F.array_repeat(r, replicates)))


def batch_labels(packed: DataFrame, shard: str, order: str, labels: str, limit: int, pad: bool = True, padding: int = -100) -> DataFrame:
    """(shard, batch, labels): a batch's labels one after the other, padded to `limit`; more of them are an error."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(labels).alias("l")))), lambda x: x["l"]))
    out = packed.groupBy(shard, "batch").agg(joined.alias("labels"))
    out = out.withColumn("labels", F.when(F.size("labels") > limit, F.raise_error(F.lit(f"a batch has more than {limit} labels"))).otherwise(F.col("labels")))
    return out.withColumn("labels", F.concat("labels", F.array_repeat(F.lit(padding), F.lit(limit) - F.size("labels")))) if pad else out


def shuffled(df: DataFrame, key: str, seed: int, shards: int) -> DataFrame:
    """Rows dealt to shards by the first 32 bits of a digest, each shard in the order of the rest of it: a shuffle that a restart repeats.

    Adds shard and order, the digest by which a shard is sorted; rows alike in it are in order of the key.
    """
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = df.withColumn("order", F.substring(digest, 9, 24)).withColumn("shard", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "order", key)


def shard_lengths(df: DataFrame, shard: str, order: str, length: str) -> DataFrame:
    """(shard, samples, lengths): the lengths of a shard's rows in order."""
    return df.groupBy(shard).agg(F.count(F.lit(1)).alias("samples"), F.transform(F.array_sort(F.collect_list(F.struct(order, length))), lambda x: x[length]).alias("lengths"))


def expanded(queries: DataFrame, supports: DataFrame, by: list[str], metric: Column) -> DataFrame:
    """(by, index, metric): each query beside every one of its supports, a ragged row for each query.

    `queries`: by and query; `supports`: by, index and support; `metric` is of the columns query and support.
    """
    return supports.join(queries, by).select(*by, "index", metric.alias("metric"))
