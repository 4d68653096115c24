"""Aligned reads: filters, pairing, pileups and images.

Reads are rows of (qname, flag, contig, pos, mapq, cigar, rnext, pnext, tlen, seq, qual array<int>, tags map<string,string>), pos
zero-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Pileup
from ..functions import alignment, intervals, pixels, sequences
from .intervals import overlap_join


#: Parts that a region's reads are dealt to before they are capped.
PARTS = 16


def primary(df: DataFrame) -> DataFrame:
    """Mapped, primary records that are neither duplicates nor failed."""
    return df.where(F.col("flag").bitwiseAND(alignment.SKIP_FLAGS) == 0)


def with_region(df: DataFrame) -> DataFrame:
    """Adds ops, start and end (with clipped bases), ref_end, and whether the read is reversed or properly paired."""
    df = df.withColumn("ops", alignment.parse_cigar("cigar"))
    start, end = alignment.read_region("pos", F.col("ops"))
    df = df.withColumn("start", start.cast("bigint")).withColumn("end", end.cast("bigint"))
    df = df.withColumn("ref_end", (F.col("pos") + alignment.total(F.col("ops"), "MDN=X")).cast("bigint"))
    return df.withColumn("reverse", F.col("flag").bitwiseAND(0x10) != 0).withColumn("proper", F.col("flag").bitwiseAND(0x2) != 0)


def fragments(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, qname, n_reads, read1, read2): a pair's reads in the order of their positions.

    Only the first two reads of a name count: Spark keeps two of each in a task before it shuffles them, and counts apart, so a name
    with very many records never meets in one task.
    """
    keys = [*(by or []), "qname"]
    columns = [c for c in reads.columns if c not in keys]
    kept = reads.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "flag"))).where("__r <= 2")
    nth = lambda i: F.first(F.when(F.col("__r") == i, F.struct(*columns)), ignorenulls=True).alias(f"read{i}")
    return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads")).join(kept.groupBy(*keys).agg(nth(1), nth(2)), keys)


def insert_sizes(pairs: DataFrame, mean: float, sd: float) -> DataFrame:
    """Properly paired fragments with insert size, its z-score, the fragment's region and the gap between the reads."""
    p = pairs.where("read2 IS NOT NULL AND read1.proper AND read2.proper")
    size = F.abs(F.col("read1.tlen"))
    return p.select("*", size.alias("insert_size"), alignment.insert_zscore(size, F.lit(mean), F.lit(sd)).alias("zscore"), F.col("read1.pos").alias("fragment_start"), F.col("read2.ref_end").alias("fragment_end"), F.col("read1.ref_end").alias("gap_start"), F.col("read2.pos").alias("gap_end"))


def straddles(left: tuple[Column, Column], right: tuple[Column, Column], pos1: Column, pos2: Column, min_aligned: int = 3) -> Column:
    """Whether a proper pair's reads begin in two regions, each far enough from its end."""
    return (left[0] <= pos1) & (pos1 < left[1] - min_aligned) & (right[0] <= pos2) & (pos2 < right[1] - min_aligned)


def overlaps_region(df: DataFrame, start: str, end: str, region_start: str, region_end: str, least: int = 3) -> DataFrame:
    return df.where(intervals.overlap_length(start, end, region_start, region_end) >= least)


def capped(reads: DataFrame, by: list[str], most: Column, key: str = "qname", seed: int = 0) -> DataFrame:
    """`most` reads of each region at most, chosen by a hash, in the order of their starts (column row_order).

    A region's reads are dealt to PARTS parts first, each of which keeps as many as the region may: a deep region meets in one task with no
    more than PARTS times its cap.
    """
    order = (F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"), F.col("start").cast("string"))), key, "start")
    kept = reads.withColumn("__p", F.pmod(F.xxhash64(key, "start"), F.lit(PARTS)))
    for keys in ([*by, "__p"], by):
        kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")
    kept = kept.drop("__p")
    return kept.withColumn("row_order", F.row_number().over(Window.partitionBy(*by).orderBy("start", key)) - 1)


def max_reads(length: Column, height: int, read_length: int) -> Column:
    return F.floor(length * height / read_length)


def columns(reads: DataFrame, region_start: str = "region_start", region_end: str = "region_end", reference: str | None = None) -> DataFrame:
    """One row for each column of a region that a read covers: col, base, quality, kind.

    `kind` is aligned, or with `reference` (the region's sequence) match or mismatch, or soft_clip. Deletions and skips show nothing.
    """
    pieces = reads.withColumn("__s", F.explode(alignment.slices("pos", F.col("ops"), region_start, region_end)))
    pieces = pieces.where(F.col("__s.op").isin("M", "=", "X", "S"))
    cells = pieces.select("*", F.explode(F.sequence(F.col("__s.from"), F.col("__s.to") - 1)).alias("col"))
    at = (F.col("__s.read_from") + F.col("col") - F.col("__s.from") + 1).cast("int")
    cells = cells.withColumn("base", F.substring(F.col("seq"), at, F.lit(1))).withColumn("quality", F.try_element_at("qual", at))
    refined = F.lit("aligned")
    if reference:
        refined = F.when(sequences.iupac_match("base", F.substring(F.col(reference), (F.col("col") + 1).cast("int"), F.lit(1))), "match").otherwise("mismatch")
    kind = F.when(F.col("__s.op") == "S", "soft_clip").when(F.col("__s.op") == "=", "match").when(F.col("__s.op") == "X", "mismatch").otherwise(refined)
    return cells.withColumn("kind", kind).drop("__s")


def slots(cells: DataFrame, by: list[str], height: int) -> DataFrame:
    """Adds row: the next free row of a column in the order of reads; what is too much overwrites the last row."""
    order = Window.partitionBy(*by, "col").orderBy("row_order")
    rows = cells.withColumn("row", F.least(F.row_number().over(order) - 1, F.lit(height - 1)))
    last = rows.groupBy(*by, "col", "row").agg(F.max("row_order").alias("__last"))
    return rows.join(last, [*by, "col", "row"]).where("row_order = __last").drop("__last")


def image(cells: DataFrame, by: list[str], p: Pileup = Pileup()) -> DataFrame:
    """(by, row, col, channels): the eight channels' values of every set pixel.

    Needs kind, zscore, mapq, reverse, quality, phase, ref_quality, alt_quality, read_ref_quality, read_alt_quality; absent columns are
    null.
    """
    for c, t in (("zscore", "double"), ("mapq", "int"), ("reverse", "boolean"), ("quality", "int"), ("phase", "int"), ("ref_quality", "double"), ("alt_quality", "double"), ("read_ref_quality", "double"), ("read_alt_quality", "double")):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(None).cast(t))
    values = [
        pixels.aligned("kind", p),
        pixels.zscore("zscore", p),
        pixels.mapping_quality("mapq", p),
        pixels.strand("reverse", p),
        pixels.quality("quality", p.max_base_quality),
        pixels.phase("phase"),
        pixels.allele("ref_quality", "alt_quality", p),
        pixels.allele("read_ref_quality", "read_alt_quality", p),
    ]
    placed = slots(cells, by, p.height)
    return placed.select(*by, "row", "col", F.array(*[F.floor(v.cast("double")).cast("int") for v in values]).alias("channels"))


def select_channels(img: DataFrame, channels: tuple[int, ...]) -> DataFrame:
    return img.withColumn("channels", F.array(*[F.element_at("channels", c + 1) for c in channels]))


def resize(img: DataFrame, by: list[str], from_size: tuple[str, str], to_size: tuple[int, int]) -> DataFrame:
    """Bilinear resize to (height, width), cell centres at half steps: each target cell is the weighted mean of the four source cells
    about its centre, rounded half to even; beyond the edge the edge's cell counts, and cells that are not set are 0. Cells without any
    set source cell are left out.

    A source cell is dealt to the target cells that it takes part in, so the work follows the set cells.
    """
    h, w = from_size

    def shares(at: str, size: str, to: int) -> Column:
        """(cell, weight) of the target cells along one axis that source cell `at` takes part in."""
        n = F.col(size)
        first = F.greatest(F.lit(0), F.floor((F.col(at) - 0.5) * to / n - 0.5).cast("int") - 1)
        last = F.least(F.lit(to - 1), F.ceil((F.col(at) + 1.5) * to / n - 0.5).cast("int") + 1)

        def weight(t: Column) -> Column:
            place = F.least(F.greatest((t + 0.5) * n / to - 0.5, F.lit(0.0)), (n - 1).cast("double"))
            return F.greatest(F.lit(0.0), 1 - F.abs(place - F.col(at)))

        return F.filter(F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("cell"), weight(t).alias("weight"))), lambda x: x["weight"] > 0)

    cells = img.select(*by, "channels", F.explode(shares("row", h, to_size[0])).alias("r"), "col", w)
    cells = cells.select(*by, "channels", "r", F.explode(shares("col", w, to_size[1])).alias("c"))
    parts = cells.select(*by, F.col("r.cell").alias("row"), F.col("c.cell").alias("col"), F.posexplode("channels").alias("channel", "value"), (F.col("r.weight") * F.col("c.weight")).alias("weight"))
    # Nulls of a channel count as 0.
    sums = parts.groupBy(*by, "row", "col", "channel").agg(F.bround(F.sum(F.coalesce("value", F.lit(0)) * F.col("weight")), 0).cast("int").alias("value"))
    return sums.groupBy(*by, "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("channels"))


def allele_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, ref_quality, alt_quality, alt, assignment) from (by, allele, score): each allele's log-sum over alignments against all, and the
    best ALT; of equal ones the later."""
    summed = scores.groupBy(*by, "allele").agg(F.max("score").alias("__m"), F.collect_list("score").alias("__s"))
    summed = summed.withColumn("log_sum", F.col("__m") + F.log10(F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("__m")))))
    both = summed.groupBy(*by).agg(F.max(F.when(F.col("allele") == 0, F.col("log_sum"))).alias("ref"), F.max(F.when(F.col("allele") > 0, F.struct(F.col("log_sum").alias("s"), "allele"))).alias("best"), F.max("log_sum").alias("m"), F.collect_list("log_sum").alias("all"))
    total = F.col("m") + F.log10(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("m"))))
    both = both.withColumn("t", total)
    q = both.select(*by, alignment.probability_to_phred(F.col("ref") - F.col("t")).alias("ref_quality"), alignment.probability_to_phred(F.col("best.s") - F.col("t")).alias("alt_quality"), F.col("best.allele").alias("alt"))
    return q.withColumn("assignment", alignment.allele_assignment("ref_quality", "alt_quality"))


def best_pairs(candidates: DataFrame, by: list[str], mean: float, sd: float) -> DataFrame:
    """The best alignment pair of each fragment and allele, (by, allele, score), from candidates of either read: (by, allele, read, pos, ref_end,
    reverse, score). Candidates are combined within a fragment only."""
    a = candidates.where("read = 1").select(*by, "allele", F.col("pos").alias("p1"), F.col("ref_end").alias("e1"), F.col("reverse").alias("v1"), F.col("score").alias("s1"))
    b = candidates.where("read = 2").select(*by, "allele", F.col("pos").alias("p2"), F.col("ref_end").alias("e2"), F.col("reverse").alias("v2"), F.col("score").alias("s2"))
    pairs = a.join(b, [*by, "allele"])
    size = F.greatest("e1", "e2") - F.least("p1", "p2")
    good = (F.col("v1") != F.col("v2")) & (F.when(F.col("v1"), F.col("p2") <= F.col("p1")).otherwise(F.col("p1") <= F.col("p2")))
    density = alignment.insert_density(size, F.lit(None).cast("map<bigint,double>"), F.lit(mean), F.lit(sd))
    return pairs.select(*by, "allele", alignment.pair_score("s1", "s2", density, good).alias("score"))


def in_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """`reads` (of `with_region`) of each region that they overlap, with region, region_start and region_end.

    `regions`: (region, contig, start, end).
    """
    a = regions.select("contig", "region", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    names = [c for c in reads.columns if c not in ("contig", "start", "end")]
    b = reads.select("contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"), *names)
    pairs = overlap_join(a, b)
    return pairs.select("region", F.col("l_start").alias("region_start"), F.col("l_end").alias("region_end"), "contig", F.col("r_start").alias("start"), F.col("r_end").alias("end"), *names)


def clipped_inserts(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, qname, start, end): the part of each fragment's gap between its reads that lies in a region.

    `pairs`: of `insert_sizes`, with contig.
    """
    a = regions.select("contig", "region", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = pairs.where("gap_start < gap_end").select("contig", "qname", F.col("gap_start").alias("r_start"), F.col("gap_end").alias("r_end"))
    start, end = intervals.intersection("l_start", "l_end", "r_start", "r_end")
    return overlap_join(a, b).select("region", "qname", start.alias("start"), end.alias("end"))


def region_images(reads: DataFrame, regions: DataFrame, mean: float, sd: float, p: Pileup = Pileup(), read_length: int = 150, size: tuple[int, int] | None = None) -> DataFrame:
    """(region, row, col, channels): from reads as they are read to one image for each region, of `size` (height, width) if it is given.

    Regions are (region, contig, start, end, sequence). Reads of a region are capped by its width, shown against its sequence, and beside
    their pair's insert size; every step is keyed by region, and a region with more reads than its cap drops reads by the cap alone.
    """
    whole = with_region(primary(reads))
    pairs = insert_sizes(fragments(whole), mean, sd).select("qname", "zscore")
    shown = in_regions(whole, regions).join(pairs, "qname", "left").join(regions.select("region", F.upper("sequence").alias("sequence")), "region")
    shown = capped(shown, ["region"], max_reads(F.col("region_end") - F.col("region_start"), p.height, read_length))
    img = image(columns(shown, reference="sequence"), ["region"], p)
    if size is None:
        return img
    wide = regions.select("region", F.lit(p.height).alias("__h"), (F.col("end") - F.col("start")).cast("int").alias("__w"))
    return resize(img.join(wide, "region"), ["region"], ("__h", "__w"), size)
