"""Half-open, zero-based intervals as expressions over columns. A zero-length interval marks an insertion point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlaps(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Touching intervals do not overlap; nor do two equal intervals of length zero."""
    return (col(s1) < col(e2)) & (col(s2) < col(e1))


def overlaps_or_equal(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Where equal insertion points must collide."""
    return overlaps(s1, e1, s2, e2) | ((col(s1) == col(s2)) & (col(e1) == col(e2)))


def overlap_length(s1: C, e1: C, s2: C, e2: C) -> Column:
    return F.greatest(F.lit(0), F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)))


def intersection(s1: C, e1: C, s2: C, e2: C) -> tuple[Column, Column]:
    """Start and end; an empty interval at the larger start if they do not meet."""
    start = F.greatest(col(s1), col(s2))
    return start, F.greatest(start, F.least(col(e1), col(e2)))


def union(s1: C, e1: C, s2: C, e2: C) -> tuple[Column, Column]:
    return F.least(col(s1), col(s2)), F.greatest(col(e1), col(e2))


def contains(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Whether the second interval lies in the first."""
    return (col(s1) <= col(s2)) & (col(e2) <= col(e1))


def expand(s: C, e: C, left: int, right: int | None = None) -> tuple[Column, Column]:
    """Wider by `left` and `right`; a start never falls below 0."""
    return F.greatest(F.lit(0), col(s) - left), col(e) + (left if right is None else right)


def center(s: C, e: C) -> Column:
    return F.floor((col(s) + col(e)) / 2).cast("bigint")


def windows(s: C, e: C, size: int) -> Column:
    """An array of (start, end) windows of `size` from the start on; the last may be shorter. Empty for length zero."""
    starts = F.when(col(e) > col(s), F.sequence(col(s), col(e) - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda x: F.struct(x.alias("start"), F.least(x + size, col(e)).alias("end")))


def literal(contig: C, s: C, e: C) -> Column:
    """The one-based, closed form `contig:start-end`."""
    return F.concat(col(contig), F.lit(":"), (col(s) + 1).cast("string"), F.lit("-"), col(e).cast("string"))


def slug(contig: C, s: C, e: C) -> Column:
    return F.concat_ws("_", col(contig), col(s).cast("string"), col(e).cast("string"))


def parse_literal(x: C) -> Column:
    """struct(contig, start, end) of `contig:start-end`; null if it is not of that form."""
    pattern = r"^(.+):([0-9,]+)-([0-9,]+)$"
    part = lambda i: F.regexp_extract(col(x), pattern, i)
    number = lambda i: F.regexp_replace(part(i), ",", "").cast("bigint")
    return F.when(col(x).rlike(pattern), F.struct(part(1).alias("contig"), (number(2) - 1).alias("start"), number(3).alias("end")))


def parse_slug(x: C) -> Column:
    """struct(contig, start, end), read from the right, so that a contig may hold underscores."""
    pattern = r"^(.+)_([0-9]+)_([0-9]+)$"
    part = lambda i: F.regexp_extract(col(x), pattern, i)
    return F.when(col(x).rlike(pattern), F.struct(part(1).alias("contig"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end")))


def image_region(s: C, e: C, width: int, padding: int) -> tuple[Column, Column]:
    """Padded to `width`, by `padding` at least; an odd base goes to the left."""
    spare = F.lit(width) - (col(e) - col(s))
    left, right = F.greatest(F.floor((spare + 1) / 2), F.lit(padding)), F.greatest(F.floor(spare / 2), F.lit(padding))
    return F.greatest(F.lit(0), col(s) - left).cast("bigint"), (col(e) + right).cast("bigint")
