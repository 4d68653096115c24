"""Pixel values of a pileup image's channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Pileup
from .intervals import C, col

MOST = 254.0


def _clip(x: Column) -> Column:
    return F.least(F.lit(MOST), F.greatest(F.lit(1.0), x))


def aligned(kind: C, p: Pileup) -> Column:
    """`kind`: aligned, match, mismatch, soft_clip or insert."""
    k = col(kind)
    return (
        F.when(k == "aligned", p.aligned_pixel)
        .when(k == "match", p.match_pixel if p.render_snv else p.aligned_pixel)
        .when(k == "mismatch", p.mismatch_pixel if p.render_snv else p.aligned_pixel)
        .when(k == "soft_clip", p.soft_clip_pixel)
        .when(k == "insert", p.insert_pixel)
    )


def zscore(z: C, p: Pileup) -> Column:
    return F.when(col(z).isNull(), 0.0).otherwise(_clip(p.insert_mean_pixel + col(z) * p.insert_sd_pixel))


def allele(ref_quality: C, alt_quality: C, p: Pileup) -> Column:
    r, a = F.nanvl(col(ref_quality), F.lit(None)), F.nanvl(col(alt_quality), F.lit(None))
    return F.when(r.isNull() | a.isNull(), 0.0).otherwise(_clip((a - r) / p.max_allele_quality * p.allele_range + p.ambiguous_pixel))


def strand(reverse: C, p: Pileup) -> Column:
    return F.when(col(reverse), p.negative_pixel).when(~col(reverse), p.positive_pixel).otherwise(0)


def quality(q: C, most: float) -> Column:
    return F.when(col(q).isNull(), 0.0).otherwise(F.least(col(q) / most, F.lit(1.0)) * MOST)


def mapping_quality(q: C, p: Pileup) -> Column:
    if not p.discrete_mapq:
        return quality(q, p.max_mapq)
    return F.when(col(q).isNull(), 0.0).when(col(q) == 0, float(p.mapq0_pixel)).otherwise(F.least(col(q) / p.max_mapq * 127 + 128, F.lit(MOST)))


def phase(haplotype: C) -> Column:
    return F.when(col(haplotype).isNull(), 0.0).otherwise(col(haplotype) / 2.0 * MOST)
