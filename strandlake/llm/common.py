"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tuning import cut, shared_dir, ship  # noqa: F401

#: Words are maximal runs of other characters than these six.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(df: DataFrame, name: str) -> int:
    """Where the column `name` stands: the first of exactly that name, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name} in {df.columns}")
    return alike[0]


def numbered(df: DataFrame) -> DataFrame:
    """`df` with its columns named c0, c1 and so on, whatever they are called."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the given names; others may have any name, twice or in another case too."""
    return numbered(df).select(*[F.col(f"c{place(df, c)}").alias(k) for k, c in columns.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


#: Bytes of an Arrow batch between the JVM and Python; both sides hold a few of them for each task.
BATCH_BYTES = 8 << 20
#: Rows that a scan decodes at once: a column of texts is held whole for as many rows.
SCAN_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound what this session holds of a scan and of an Arrow batch: texts are long, and a count of rows says little about their size."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        now = spark.conf.get(name).lower().rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))


def map_texts(df: DataFrame, keep: list[str], text_col: str, schema: str, work: Callable[[list[str]], dict[str, Iterable]], block_bytes: int = 0) -> DataFrame:
    """Rows of `keep` plus the columns that `work` makes of a list of texts (null text: None).

    `work` returns one list per new column of the DDL `schema`. It gets the texts of one Arrow batch, or of as many as make
    `block_bytes` bytes; that is the unit of memory. Texts are never joined or cut.
    """
    small_batches(df.sparkSession)
    made = [f.strip().split()[0] for f in schema.split(",")]
    kinds = [f.strip().split()[1] for f in schema.split(",")]
    types = df.select(*[F.col(f"`{k}`") for k in keep]).schema
    columns = keep if text_col in keep else [*keep, text_col]
    at = columns.index(text_col)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in types] + [schema])

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work([t for b in held for t in b.column(at).to_pylist()])
        new = [x if isinstance(x, pa.Array) else pa.array(x, type=ARROW[t]) for x, t in zip((out[m] for m in made), kinds, strict=True)]
        row = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [x.slice(row, b.num_rows) for x in new], names=keep + made)
            row += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(at).nbytes
            if held and size >= block_bytes:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return df.select(*[F.col(f"`{k}`") for k in columns]).mapInArrow(run, ddl)


class Table:
    """A fixed map from non-negative 64-bit to 32-bit numbers for lookups by whole arrays (open addressing, a quarter full at most)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.absent = np.int32(absent)
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, absent, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.key[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.key[at[put]], self.value[at[put]] = keys[put], values[put]
            todo = todo[self.key[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.key[at]
        out = np.where(found == keys, self.value[at], self.absent)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
