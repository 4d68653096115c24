"""CIGAR strings and alignment scores as expressions.

Parsed CIGARs are arrays of struct(op, n). Scores are log10 probabilities with base qualities scaled by a quarter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import C, col
from .sequences import iupac_match

#: Operations that advance along the reference window, along the read, and that align bases.
ON_REFERENCE = "MDNS=X"
ON_READ = "MIS=X"
ALIGNED = "M=X"
GAP = -1.0
QUALITY_SCALE = 0.25
MAX_PHRED = 40.0

#: Flag bits of records that are no primary, passing, mapped alignment.
SKIP_FLAGS = 0xF04


def parse_cigar(cigar: C) -> Column:
    ops = F.regexp_extract_all(col(cigar), F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(ops, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^([0-9]+)", 1).cast("int").alias("n")))


def in_set(op: Column, ops: str) -> Column:
    return op.isin(*ops)


def total(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda acc, x: acc + F.when(in_set(x["op"], ops), x["n"]).otherwise(0))


def read_region(pos: C, cigar: Column) -> tuple[Column, Column]:
    """The window interval of a read: a leading soft clip moves its start back, soft clips count as bases."""
    first = F.element_at(cigar, 1)
    start = col(pos) - F.when(first["op"] == "S", first["n"]).otherwise(0)
    return start, start + total(cigar, ON_REFERENCE)


def slices(pos: C, cigar: Column, region_start: C, region_end: C) -> Column:
    """Array of (op, from, to, read_from): columns of the region that each operation covers, and the read's offset there.

    One pass over the operations carries the places in the reference and in the read.
    """
    start, _ = read_region(pos, cigar)
    init = F.struct(start.cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("read"), F.array().cast("array<struct<op:string,from:bigint,to:bigint,read_from:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        moves, reads = in_set(x["op"], ON_REFERENCE), in_set(x["op"], ON_READ)
        lo, hi = F.greatest(acc["at"], col(region_start)), F.least(acc["at"] + x["n"], col(region_end))
        piece = F.struct(
            x["op"].alias("op"),
            (lo - col(region_start)).cast("bigint").alias("from"),
            (hi - col(region_start)).cast("bigint").alias("to"),
            (acc["read"] + F.when(reads, lo - acc["at"]).otherwise(0)).cast("bigint").alias("read_from"),
        )
        return F.struct(
            (acc["at"] + F.when(moves, x["n"]).otherwise(0)).cast("bigint").alias("at"),
            (acc["read"] + F.when(reads, x["n"]).otherwise(0)).cast("bigint").alias("read"),
            F.when(moves & (hi > lo), F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(cigar, init, step, lambda acc: acc["out"])


def phred_to_probability(q: C) -> Column:
    return F.pow(F.lit(10.0), -col(q) / 10.0)


def probability_to_phred(log10_p: C, most: float = MAX_PHRED) -> Column:
    """Quality of a log10 probability; exactly 0 gives the cap."""
    return F.when(col(log10_p) == 0, F.lit(most)).when(col(log10_p).isNotNull(), F.least(F.lit(most), -10.0 * F.log10(F.lit(1.0) - F.pow(F.lit(10.0), col(log10_p)))))


def base_score(base: C, reference: C, quality: C) -> Column:
    """log10 probability of one aligned base."""
    q = col(quality) * QUALITY_SCALE
    return F.when(iupac_match(base, reference), F.log10(F.lit(1.0) - phred_to_probability(q))).otherwise(-q / 10.0)


def max_score(qualities: C) -> Column:
    """The score of a read that matches in every base."""
    return F.aggregate(col(qualities), F.lit(0.0), lambda acc, q: acc + F.log10(F.lit(1.0) - phred_to_probability(q * QUALITY_SCALE)))


def alignment_score(seq: C, qualities: C, reference: C, pos: C, cigar: Column) -> Column:
    """log10 probability of a read under an alignment: one pass over the operations.

    Soft clips and mismatches cost their base's quality, an insertion one gap besides for each base, a deletion one gap for each
    base. `pos` is where the first base lies in `reference`, soft clips included.
    """
    init = F.struct(F.lit(0).cast("bigint").alias("read"), col(pos).cast("bigint").alias("at"), F.lit(0.0).alias("score"))

    def bases(acc: Column, n: Column, score) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")), F.lit(0.0), lambda s, i: s + score((acc["read"] + i).cast("int"), (acc["at"] + i).cast("int")))

    quality = lambda i: F.element_at(col(qualities), i)

    def step(acc: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        aligned = bases(acc, n, lambda i, j: base_score(F.substring(col(seq), i, F.lit(1)), F.substring(col(reference), j, F.lit(1)), quality(i)))
        clipped = bases(acc, n, lambda i, j: -quality(i) * QUALITY_SCALE / 10.0)
        gained = F.when(in_set(op, ALIGNED), aligned).when(op == "S", clipped).when(op == "I", clipped + n * GAP).when(op == "D", n * GAP).otherwise(F.raise_error(F.concat(F.lit("no score for operation "), op)))
        return F.struct(
            (acc["read"] + F.when(in_set(op, ON_READ), n).otherwise(0)).cast("bigint").alias("read"),
            (acc["at"] + F.when(in_set(op, ON_REFERENCE), n).otherwise(0)).cast("bigint").alias("at"),
            (acc["score"] + gained.cast("double")).alias("score"),
        )

    return F.aggregate(col(cigar) if isinstance(cigar, str) else cigar, init, step, lambda acc: acc["score"])


def insert_density(size: C, table: Column, mean: C, sd: C) -> Column:
    """Density of an insert size: the table's, else the normal one."""
    z = (col(size) - col(mean)) / col(sd)
    return F.coalesce(F.try_element_at(table, col(size)), F.exp(-0.5 * z * z) * 0.3989422804014327 / col(sd))


def insert_zscore(size: C, mean: C, sd: C, delta: int = 0) -> Column:
    return (col(size) + delta - col(mean)) / col(sd)


def pair_score(left: C, right: C, density: C, concordant: C) -> Column:
    """Score of two aligned reads: their sum and the insert's log10 density, or -10 if the pair is discordant."""
    return col(left) + col(right) + F.when(col(concordant), F.log10(col(density))).otherwise(-10.0)


def allele_assignment(ref_quality: C, alt_quality: C, delta: float = 1.0) -> Column:
    d = col(alt_quality) - col(ref_quality)
    return F.when(d > delta, "alt").when(d < -delta, "ref").otherwise("ambiguous")


def relative_quality(score: C, other: C) -> Column:
    """Relative phred quality of one of two log10 scores, between 0 and 40.

    The scores are normalised by a natural log-sum-exp although they are base 10: that is what results are compared with.
    """
    m = F.when(col(score).isNotNull() & col(other).isNotNull(), F.greatest(col(score), col(other)))
    norm = m + F.ln(F.exp(col(score) - m) + F.exp(col(other) - m))
    p = F.pow(F.lit(10.0), col(score) - norm)
    return F.when(p >= 1, F.lit(MAX_PHRED)).when(p.isNotNull(), F.least(F.lit(MAX_PHRED), F.greatest(F.lit(0.0), -10.0 * F.log10(F.lit(1.0) - p))))
