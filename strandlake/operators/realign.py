"""Reads against the alleles of a variant: alignment, scores, and which allele a fragment comes from.

The aligner is an exact gapped one over whole alleles (affine gaps, soft clips at a price), not a seed-and-extend mapper, so its
alignments can differ from such a mapper's where a read fits about equally well in several places. Scores follow from alignments by
the expressions of `functions.alignment`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment
from . import reads
from .region_graph import reverse_complement

#: Scores of a match, a mismatch, opening a gap, each gapped base, and a clipped end.
MATCH, MISMATCH, OPEN, EXTEND, CLIP = 1, -4, -6, -1, -5
NEVER = -(1 << 29)


def align(read: str, reference: str) -> tuple[int, int, str]:
    """(score, first aligned position, CIGAR) of the best alignment of a read inside a reference; `0` and a CIGAR of one soft clip if no
    base aligns.

    A row of the table is one base of the read against all positions. Deletions along a row are a running maximum.
    """
    n, m = len(read), len(reference)
    if not n or not m:
        return 0, 0, f"{n}S" if n else ""
    ref = np.frombuffer(reference.encode(), np.uint8)
    places = np.arange(m + 1)
    diagonal = np.zeros((n + 1, m + 1), np.int32)
    start = lambda i: 0 if i == 0 else CLIP
    best = np.full((n + 1, m + 1), NEVER, np.int64)
    insert = np.full((n + 1, m + 1), NEVER, np.int64)
    delete = np.full((n + 1, m + 1), NEVER, np.int64)
    best[0] = start(0)
    end, top = (0, 0), NEVER
    for i in range(1, n + 1):
        base = ord(read[i - 1])
        came = np.maximum(best[i - 1, :-1], start(i - 1))
        diagonal[i, 1:] = np.where((ref == base) | (ref == 78), MATCH, MISMATCH)
        row = np.full(m + 1, NEVER, np.int64)
        row[1:] = came + diagonal[i, 1:]
        insert[i] = np.maximum(best[i - 1] + OPEN, insert[i - 1]) + EXTEND
        row = np.maximum(row, insert[i])
        # delete[j] = max over k < j of row[k] + OPEN + (j - k) * EXTEND
        run = np.maximum.accumulate(row - places * EXTEND)
        delete[i, 1:] = run[:-1] + OPEN + places[1:] * EXTEND
        best[i] = np.maximum(row, delete[i])
        j = int(best[i].argmax())
        score = int(best[i, j]) + (0 if i == n else CLIP)
        if score >= top:
            top, end = score, (i, j)
    if top <= 0:
        return 0, 0, f"{n}S"
    i, j = end
    ops: list[tuple[str, int]] = [("S", n - i)] if i < n else []
    state = "M"
    while True:
        if state == "M":
            if best[i, j] == insert[i, j]:
                state = "I"
            elif best[i, j] == delete[i, j]:
                state = "D"
            else:
                ops.append(("M", 1))
                came, i, j = int(best[i, j] - diagonal[i, j]), i - 1, j - 1
                if came == start(i) and best[i, j] <= came:
                    break
            continue
        if state == "I":
            ops.append(("I", 1))
            state = "I" if i > 1 and insert[i, j] == insert[i - 1, j] + EXTEND else "M"
            i -= 1
        else:
            ops.append(("D", 1))
            state = "D" if delete[i, j] == delete[i, j - 1] + EXTEND and delete[i, j - 1] > NEVER // 2 and delete[i, j] != best[i, j - 1] + OPEN + EXTEND else "M"
            j -= 1
        if i == 0:
            break
    if i:
        ops.append(("S", i))
    packed: list[list] = []
    for op, k in reversed(ops):
        if packed and packed[-1][0] == op:
            packed[-1][1] += k
        else:
            packed.append([op, k])
    return top, j, "".join(f"{k}{op}" for op, k in packed)


CANDIDATES = "fragment string, read int, allele int, pos bigint, cigar string, reverse boolean, seq string, qual array<int>, sequence string"


def candidates(rows: DataFrame) -> DataFrame:
    """Each row (fragment, read, seq, qual, allele, sequence) with its best alignment to the allele's sequence, on either strand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                fit = []
                for reverse in (False, True):
                    seq = reverse_complement(r["seq"]) if reverse else r["seq"]
                    fit.append((align(seq, r["sequence"]), reverse, seq, r["qual"][::-1] if reverse else r["qual"]))
                (_, pos, cigar), reverse, seq, qual = max(fit, key=lambda x: (x[0][0], not x[1]))
                out.append({**r, "pos": pos, "cigar": cigar, "reverse": reverse, "seq": seq, "qual": qual})
            fields = [("fragment", pa.string()), ("read", pa.int32()), ("allele", pa.int32()), ("pos", pa.int64()), ("cigar", pa.string()), ("reverse", pa.bool_()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("sequence", pa.string())]
            yield from pa.Table.from_pylist(out, schema=pa.schema(fields)).to_batches()

    return rows.select("fragment", "read", "seq", "qual", "allele", "sequence").mapInArrow(run, CANDIDATES)


def scored(aligned: DataFrame) -> DataFrame:
    """Candidates with ops, ref_end and score. A clipped end that would lie outside the sequence scores as it does inside."""
    out = aligned.withColumn("ops", alignment.parse_cigar("cigar"))
    begin, _ = alignment.read_region("pos", F.col("ops"))
    out = out.withColumn("ref_end", F.col("pos") + alignment.total(F.col("ops"), "MDN=X"))
    return out.withColumn("score", alignment.alignment_score("seq", "qual", "sequence", begin, F.col("ops")))


def realign(rows: DataFrame, mean: float, sd: float) -> DataFrame:
    """(fragment, ref_quality, alt_quality, alt, assignment) of read pairs against alleles, of which 0 is REF."""
    found = scored(candidates(rows))
    return reads.allele_scores(reads.best_pairs(found, ["fragment"], mean, sd), ["fragment"])
