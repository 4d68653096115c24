"""Small text tables: depth, coverage statistics, k-mer counts and histograms, sample statistics, shards of examples."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Sample

#: A GC bin counts with so many windows and no larger an error.
LEAST_WINDOWS = 100
MOST_ERROR = 0.01


def depth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, start bigint, end bigint, mean double, gc double, cpg double, masked double")


def covstats(spark: SparkSession, path: str) -> DataFrame:
    """The table of insert sizes and coverage, column names from its first line."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="kmer string, cnt bigint")


def kmer_length(counts: DataFrame) -> int | None:
    """The one length of a table's k-mers, None for an empty table; several are an error."""
    r = counts.agg(F.min(F.length("kmer")).alias("a"), F.max(F.length("kmer")).alias("b")).first()
    if r["a"] != r["b"]:
        raise ValueError("k-mers of several lengths")
    return r["a"]


def histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="cnt bigint, freq bigint")


def _gc(stats: dict) -> dict[int, float]:
    counts, errors = stats.get("gc_bin_count") or {}, stats.get("gc_normalized_coverage_error") or {}
    good = lambda k: counts.get(k, 0) >= LEAST_WINDOWS and errors.get(k, 0.0) <= MOST_ERROR
    return {round(float(k) * 100): v for k, v in (stats.get("gc_normalized_coverage") or {}).items() if not counts or good(k)}


def sample_of(text: str) -> Sample:
    """The sample that a JSON text describes; GC bins with few windows or a large error are left out."""
    s = json.loads(text)
    return Sample(
        s["sample"],
        int(s["read_length"]),
        float(s["mean_insert_size"]),
        float(s["std_insert_size"]),
        float(s["mean_coverage"]),
        s.get("sequencer", "HS25"),
        s.get("kmer_coverage"),
        dict(s.get("chrom_normalized_coverage") or {}),
        _gc(s),
        {int(k): float(v) for k, v in (s.get("hist_insert_size") or {}).items()},
    )


def load_sample(spark: SparkSession, path: str) -> Sample:
    return sample_of("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def sample_json(s: Sample) -> str:
    """What `sample_of` reads; GC bins are written as fractions."""
    return json.dumps(
        {
            "sample": s.name,
            "sequencer": s.sequencer,
            "read_length": s.read_length,
            "mean_insert_size": s.mean_insert,
            "std_insert_size": s.sd_insert,
            "mean_coverage": s.mean_coverage,
            "kmer_coverage": s.kmer_coverage,
            "chrom_normalized_coverage": s.chrom_coverage,
            "gc_normalized_coverage": {f"{k / 100:.2f}": v for k, v in s.gc_coverage.items()},
            "hist_insert_size": {str(k): v for k, v in s.insert_histogram.items()},
        }
    )


def tar_examples(spark: SparkSession, path: str) -> DataFrame:
    """(key, fields map<string,binary>) of tar shards: files of one name without its endings make one example."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found: dict[str, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as t:
                    for m in t:
                        if m.isfile():
                            folder, _, base = m.name.rpartition("/")
                            key, _, ending = base.partition(".")
                            found.setdefault(f"{folder}/{key}" if folder else key, {})[ending] = t.extractfile(m).read()  # type: ignore[union-attr]
                kind = pa.map_(pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([list(x.items()) for x in found.values()], kind)], names=["key", "fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "key string, fields map<string,binary>")


def write_examples(df: DataFrame, path: str, rows_a_file: int = 10_000) -> None:
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
