"""The aligner against brute force, and fragments against two alleles."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.operators import realign
from strandlake.operators.realign import CLIP, EXTEND, MATCH, MISMATCH, OPEN, align


def cost(read: str, ref: str, pos: int, cigar: str) -> int:
    """What an alignment scores, read off its CIGAR."""
    i, j, total = 0, pos, 0
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", cigar)]
    for n, op in ops:
        if op == "S":
            total += CLIP
            i += n
        elif op == "M":
            total += sum(MATCH if read[i + k] == ref[j + k] else MISMATCH for k in range(n))
            i, j = i + n, j + n
        elif op == "I":
            total += OPEN + n * EXTEND
            i += n
        else:
            total += OPEN + n * EXTEND
            j += n
    assert i == len(read)
    return total


def slow(read: str, ref: str) -> int:
    """The best score by recursion over all alignments."""
    from functools import lru_cache

    n, m = len(read), len(ref)

    @lru_cache(None)
    def go(i: int, j: int, state: str) -> int:
        out = 0 if i == n else CLIP
        if i < n and j < m:
            out = max(out, (MATCH if read[i] == ref[j] else MISMATCH) + go(i + 1, j + 1, "M"))
        if i < n and state != "D":
            out = max(out, EXTEND + (0 if state == "I" else OPEN) + go(i + 1, j, "I"))
        if j < m:
            out = max(out, EXTEND + (0 if state == "D" else OPEN) + go(i, j + 1, "D"))
        return out

    return max(max((CLIP if i else 0) + go(i, j, "M") for i in range(n) for j in range(m + 1)), 0)


@pytest.mark.parametrize("seed", range(40))
def test_align(seed):
    r = random.Random(seed)
    ref = "".join(r.choice("ACGT") for _ in range(40))
    at = r.randint(0, 15)
    read = list(ref[at : at + 20])
    for _ in range(r.randint(0, 2)):
        k = r.randrange(1, len(read) - 1)
        read[k : k + r.randint(0, 2)] = [r.choice("ACGT") for _ in range(r.randint(0, 2))]
    read = "".join(read)
    score, pos, cigar = align(read, ref)
    assert score == slow(read, ref)
    if score:
        assert cost(read, ref, pos, cigar) == score


def test_align_of_nothing():
    assert align("", "ACGT") == (0, 0, "") and align("ACG", "") == (0, 0, "3S")
    assert align("AAAA", "CCCCCCC")[2] == "4S"


def test_fragments_go_to_their_allele(spark):
    r = random.Random(3)
    left, right, gone = ("".join(r.choice("ACGT") for _ in range(n)) for n in (300, 300, 120))
    alleles = [(0, left + gone + right), (1, left + right)]
    flip = realign.reverse_complement
    rows = []
    for name, seq in (("ref", alleles[0][1]), ("alt", alleles[1][1])):
        one, two = seq[230:330], flip(seq[380:480])
        rows += [(name, 1, one, [40] * 100), (name, 2, two, [40] * 100)]
    reads = spark.createDataFrame(rows, "fragment string, read int, seq string, qual array<int>")
    table = spark.createDataFrame(alleles, "allele int, sequence string")
    got = {x.fragment: x for x in realign.realign(reads.join(F.broadcast(table)), 250.0, 50.0).collect()}
    assert got["ref"].assignment == "ref" and got["alt"].assignment == "alt" and got["alt"].alt == 1
    assert got["ref"].ref_quality > 20 and got["alt"].alt_quality > 20
