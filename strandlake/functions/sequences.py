"""Bases, k-mers and IUPAC codes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import C, col

#: The IUPAC nucleotide codes and the bases that each stands for.
IUPAC = {
    "A": "A",
    "C": "C",
    "G": "G",
    "T": "T",
    "R": "AG",
    "Y": "CT",
    "S": "CG",
    "W": "AT",
    "K": "GT",
    "M": "AC",
    "B": "CGT",
    "D": "AGT",
    "H": "ACT",
    "V": "ACG",
    "N": "ACGTN",
}


def valid_bases(seq: C) -> Column:
    return col(seq).rlike(r"^[ACGTN]+\z")


def reverse_complement(seq: C) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer: C) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(col(kmer), reverse_complement(kmer))


def kmers(seq: C, k: int) -> Column:
    """All contiguous substrings of length `k`, in order; empty if the text is shorter."""
    n = F.length(col(seq)) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(col(seq), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def chunks(seq: C, k: int, size: int) -> Column:
    """The text in pieces of `size` starting places, each with the k - 1 characters after it, so that every k-mer lies whole in one piece.

    Substrings are counted from a text's beginning, and a row for each k-mer carries its piece along: cutting a text into long pieces
    and those into short ones keeps the work of its k-mers linear in its length.
    """
    places = F.length(col(seq)) - (k - 1)
    steps = F.when(places > 0, F.sequence(F.lit(0), F.floor((places - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.substring(col(seq), i * size + 1, F.lit(size + k - 1)))


def iupac_match(base: C, code: C) -> Column:
    """Whether the upper-case base is one that the code stands for; null for an unknown code."""
    table = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    return F.contains(F.element_at(table, F.upper(col(code))), F.upper(col(base)))
