"""Variant records as expressions: identity, allele normalisation, size and filter predicates.

A record has contig, pos (zero-based), ref, and alts, an array of sequences in which `*` is the allele of an overlapping
deletion and has no sequence of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import C, col

STAR = "*"


def variant_id(contig: C, pos: C, ref: C, alts: C) -> Column:
    """SHA-1 of contig, one-based position, REF and the ALTs but `*`, upper-cased, each on a line."""
    lines = F.concat(F.array(col(contig), (col(pos) + 1).cast("string"), F.upper(col(ref))), F.transform(F.filter(col(alts), lambda a: a != STAR), F.upper))
    return F.sha1(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def require_sequences(alts: C) -> Column:
    """The ALTs, or an error if one is symbolic."""
    symbolic = F.exists(col(alts), lambda a: a.rlike(r"[<>\[\]]"))
    return F.when(symbolic, F.raise_error(F.lit("symbolic alleles are not supported"))).otherwise(col(alts))


def _first_difference(a: Column, b: Column, most: Column) -> Column:
    """Equal leading characters of a and b, `most` at most."""
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    other = F.filter(steps, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.array_min(other) - 1, most)


def right_padding(ref: C, alt: C) -> Column:
    """Equal trailing bases; only where both alleles are longer than one base, of which one stays."""
    r, a = col(ref), col(alt)
    most = F.greatest(F.lit(0), F.least(F.length(r), F.length(a)) - 1)
    return F.when((F.length(r) > 1) & (F.length(a) > 1), _first_difference(F.reverse(r), F.reverse(a), most)).otherwise(0)


def left_padding(ref: C, alt: C, right: Column) -> Column:
    """Equal leading bases of what the right padding leaves."""
    r, a = col(ref), col(alt)
    return _first_difference(r, a, F.least(F.length(r), F.length(a)) - right)


def allele(pos: C, ref: C, alt: C) -> Column:
    """struct(start, end, seq, change): the reference interval that an allele replaces, its sequence there, and its change of
    length; null for `*`."""
    p, r, a = col(pos), F.upper(col(ref)), F.upper(col(alt))
    right = right_padding(r, a)
    left = left_padding(r, a, right)
    return F.when(
        a != STAR,
        F.struct(
            (p + left).alias("start"),
            (p + F.length(r) - right).alias("end"),
            F.substring(a, left + 1, F.length(a) - left - right).alias("seq"),
            (F.length(a) - F.length(r)).alias("change"),
            left.alias("left"),
            right.alias("right"),
        ),
    )


def alleles(pos: C, ref: C, alts: C) -> Column:
    return F.transform(col(alts), lambda a: allele(pos, ref, a))


def reference_region(pos: C, ref: C, of: Column) -> Column:
    """struct(start, end): REF without the least padding of any allele; all of REF if every allele is `*`. `of`: alleles()."""
    known = F.filter(of, lambda a: a.isNotNull())
    return F.struct(
        (col(pos) + F.coalesce(F.array_min(F.transform(known, lambda a: a["left"])), F.lit(0))).alias("start"),
        (col(pos) + F.length(col(ref)) - F.coalesce(F.array_min(F.transform(known, lambda a: a["right"])), F.lit(0))).alias("end"),
    )


def length_change(ref: C, alt: C) -> Column:
    return F.when(col(alt) != STAR, F.length(col(alt)) - F.length(col(ref)))


def is_sv(ref: C, alts: C, least: int = 50) -> Column:
    """Whether any allele changes the length by `least` or more; `*` changes nothing."""
    return F.exists(col(alts), lambda a: F.coalesce(F.abs(length_change(ref, a)) >= least, F.lit(False)))


def star_only(alts: C) -> Column:
    return F.forall(col(alts), lambda a: a == STAR)


def is_filtered(filters: C) -> Column:
    """Any filter but PASS; none at all is not filtered."""
    return F.exists(F.coalesce(col(filters), F.array().cast("array<string>")), lambda f: f != "PASS")


def has_passing_genotype(samples: C) -> Column:
    """Over samples of struct(gt, ft): without FT, or FT that begins with PASS, or no FT value but a called allele."""
    called = lambda s: F.exists(s["gt"], lambda g: g.isNotNull())
    has_ft = F.exists(col(samples), lambda s: s["ft"].isNotNull())
    return ~has_ft | F.exists(col(samples), lambda s: F.startswith(F.coalesce(s["ft"], F.lit("")), F.lit("PASS")) | ((F.coalesce(s["ft"], F.lit(".")) == ".") & called(s)))


def updated_filters(filters: C, samples: C) -> Column:
    """PASS where a sample passes, else as it is."""
    return F.when(has_passing_genotype(samples), F.array(F.lit("PASS"))).otherwise(col(filters))


def main_contig(contig: C) -> Column:
    return col(contig).rlike(r"^(?:chr)?(?:\d{1,2}|[XY])\z")


def autosome(contig: C) -> Column:
    return col(contig).rlike(r"^(?:chr)?\d{1,2}\z")


def touches_edge(s: C, e: C, region_start: C, region_end: C) -> Column:
    """Whether a record reaches a region's first or last base, or lies beyond: it cannot be a bubble inside."""
    return (col(s) <= col(region_start)) | (col(e) >= col(region_end))


def alt_path_name(id_: C, number: C) -> Column:
    return F.concat(F.lit("_alt_"), col(id_), F.lit("_"), col(number).cast("string"))


def parse_alt_path(name: C) -> Column:
    """struct(variant_id, allele) of a path name, null for other paths."""
    pattern = r"_([^_]+)_([0-9]+)$"
    return F.when(col(name).rlike(pattern), F.struct(F.regexp_extract(col(name), pattern, 1).alias("variant_id"), F.regexp_extract(col(name), pattern, 2).cast("int").alias("allele")))


def file_format(path: C) -> Column:
    """The writer's format by a file's ending."""
    p = col(path)
    return F.when(p.endswith(".vcf.gz"), "z").when(p.endswith(".bcf"), "b").when(p.endswith(".vcf"), "v")
