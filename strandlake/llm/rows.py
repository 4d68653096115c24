"""Decisions brought back to rows by their place in the files they are read from, so that deciding on a text never shuffles it.

A decision is made on narrow rows that carry the place. The places that it names, and a number for each, are written to the shared
folder by file, and each task of the scan looks up the places of the files that it reads.

A table that is not a plain scan of files has no such places; it is first written to the shared folder with a number for each row, and
decisions are joined by that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .common import cut, numbered, shared_dir, small_batches

#: Folders of the places; a file's places are in one of them.
FOLDERS = 512
PLACE = ["at_file", "at_row"]


def located(df: DataFrame) -> tuple[DataFrame, bool]:
    """`df` with columns c0, c1 and so on, and its rows' places: at_file and at_row. Whether these are places in files.

    at_file is the 64-bit hash of the file's path: two files of a million share one with a probability of 3e-8.
    """
    plain = numbered(df)
    if scanned(plain):
        try:
            return plain.select("*", F.xxhash64("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row")), True
        except AnalysisException:
            pass
    return cut(plain.select("*", F.lit(0).cast("bigint").alias("at_file"), F.monotonically_increasing_id().alias("at_row"))), False


def scanned(df: DataFrame) -> bool:
    """Whether `df` is one scan with nothing but projections and filters above it, so that a place stands for one row."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation"))


def told(full: DataFrame, places: DataFrame, in_files: bool) -> DataFrame:
    """`full` (of `located`) with named and number: whether a row's place is among `places` (at_file, at_row, number), and its number."""
    if not in_files:
        known = places.select(*PLACE, "number", F.lit(True).alias("found"))
        return full.join(known, PLACE, "left").withColumn("named", F.col("found").isNotNull()).drop("found")
    return looked_up(full, places, lambda b, named, number: pa.RecordBatch.from_arrays([*b.columns, pa.array(named), number], names=[*b.schema.names, "named", "number"]), ", named boolean, number bigint")


def remaining(full: DataFrame, gone: DataFrame, in_files: bool) -> DataFrame:
    """The rows of `full` (of `located`) that are not at `gone` (at_file, at_row), without their places."""
    gone = gone.withColumn("number", F.lit(None).cast("bigint"))
    if not in_files:
        return told(full, gone, False).where("NOT named").drop(*PLACE, "named", "number")
    return looked_up(full, gone, lambda b, named, _: b.filter(pa.array(~named)), "").drop(*PLACE)


def looked_up(full: DataFrame, places: DataFrame, made: Callable[[pa.RecordBatch, np.ndarray, pa.Array], pa.RecordBatch], more: str) -> DataFrame:
    """What `made` returns of `full`'s batches, of which rows are named, and their numbers; `more`: its columns after those of `full`."""
    small_batches(full.sparkSession)
    folder = f"{shared_dir(full.sparkSession)}/places-{uuid.uuid4().hex}"
    by_file = places.select(*PLACE, F.col("number").cast("bigint").alias("number"), F.pmod("at_file", F.lit(FOLDERS)).alias("folder"))
    by_file.repartition("folder").sortWithinPartitions("folder", *PLACE).write.partitionBy("folder").parquet(folder)
    at_file, at_row = (full.columns.index(c) for c in PLACE)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows, numbers = None, np.array([], np.int64), pa.array([], pa.int64())
        for b in batches:
            files, at = b.column(at_file).to_numpy(), b.column(at_row).to_numpy()
            hit = np.zeros(len(files), bool)
            number = pa.nulls(len(files), pa.int64())
            for f in np.unique(files):
                if f != file:
                    file, (rows, numbers) = f, named_rows(folder, int(f))
                if len(rows):
                    to = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
                    own = (files == f) & (rows[to] == at)
                    hit |= own
                    number = pc.if_else(pa.array(own), numbers.take(pa.array(to)), number)
            yield made(b, hit, number)

    ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in full.schema)
    return full.mapInArrow(look, ddl + more)


def named_rows(folder: str, file: int) -> tuple[np.ndarray, pa.Array]:
    """The rows of `file` that are named, in order, and their numbers."""
    parts = storage.tables(f"{folder}/folder={file % FOLDERS}", ["at_row", "number"], ("at_file", "=", file))
    if not parts:
        return np.array([], np.int64), pa.array([], pa.int64())
    found = pa.concat_tables(parts).sort_by("at_row").combine_chunks()
    return found.column("at_row").to_numpy(), pa.concat_arrays([pa.array([], pa.int64()), *found.column("number").chunks])
