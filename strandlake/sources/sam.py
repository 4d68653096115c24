"""SAM text as the table of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, contig, pos (zero-based), mapq, cigar, rnext, pnext, tlen, seq, qual (array of numbers), tags (map)."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0)).select(c.alias("c"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    quality = F.when(at(11) != "*", F.transform(F.split(at(11), ""), lambda x: F.ascii(x) - 33))
    tags = F.map_from_entries(F.transform(F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    return rows.select(
        at(1).alias("qname"),
        at(2).try_cast("int").alias("flag"),
        F.when(at(3) != "*", at(3)).alias("contig"),
        (at(4).try_cast("bigint") - 1).alias("pos"),
        at(5).try_cast("int").alias("mapq"),
        at(6).alias("cigar"),
        F.when(at(7) == "=", at(3)).when(at(7) != "*", at(7)).alias("rnext"),
        (at(8).try_cast("bigint") - 1).alias("pnext"),
        at(9).try_cast("int").alias("tlen"),
        at(10).alias("seq"),
        quality.alias("qual"),
        tags.alias("tags"),
    )


def sample_name(spark: SparkSession, path: str) -> str:
    """The one sample of the read groups; none or several are an error."""
    rows = spark.read.text(path).where(F.startswith("value", F.lit("@RG"))).select(F.regexp_extract("value", "\tSM:([^\t]+)", 1).alias("s")).distinct().limit(2).collect()
    if len(rows) != 1 or not rows[0]["s"]:
        raise ValueError(f"expected one sample in the read groups, found {[r['s'] for r in rows]}")
    return rows[0]["s"]
