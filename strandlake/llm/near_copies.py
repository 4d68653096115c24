"""Near copies by SimHash: texts whose distinct five-word shingles have a similarity (Jaccard) of 0.8 or more.

This is the operator of `simhash` at its general setting. At that similarity a 64-bit fingerprint differs in some ten bits, which is
beyond any ball; so a text has many short fingerprints, each over bits of its own, and meets its copies in one of them: every short
fingerprint emits all variants within one bit, the variants meet in a shuffle, and texts that share one are linked if their 64-bit
fingerprints are close. `shape` chooses the bits by the number of texts, so that few others meet by chance, and as many fingerprints as
give RECALL at exactly the similarity asked for (more above it); at any size of the table the recall is the same.

Links make families. Within a family, links are verified on the whole sets of shingles (64-bit hashes): every pair that is not already
connected is compared, by a list of the family's texts for each shingle, and what is returned are the components of pairs of that
similarity. A family of more than A_TASK shingles is cut into blocks, and each two blocks meet in a task of their own.

Defined cases: null text counts as empty; texts without words have no shingles and no links; texts of fewer words than a shingle are one
shingle; a null id ranks after all others; of rows alike in id and text one stays; an empty table gives an empty result; extra columns
are kept. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tuning import by_key
from .common import cut, map_texts, place, text_or_empty
from .components import components
from .rows import PLACE, located, remaining, told
from .simhash import linked, shingle_hashes

SIMILAR = 0.8
SHINGLE = 5
#: Share of the pairs of similarity SIMILAR that meet.
RECALL = 0.99
#: Bits of a short fingerprint over those of the number of texts, and least of them; texts for each value of the first bits, by which
#: buckets are dealt out, and least of those.
MORE_BITS = 8
LEAST_BITS = 24
A_BUCKET = 16384
FIRST_BITS = 6
#: Of 64 bits, those in which texts of one family differ at most (unrelated texts: with a probability of 0.002).
CLOSE = 20
#: Shingles of one task's texts.
A_TASK = 250_000
#: Texts, and hashes, whose bits are counted at once.
TEXTS, HASHES = 1024, 16384

_LANES = np.uint64(0x0101010101010101)


def shape(texts: int) -> tuple[int, int]:
    """Bits of a short fingerprint, and how many of them, for so many texts."""
    bits = max(LEAST_BITS, max(texts, 1).bit_length() + MORE_BITS)
    # The angle of two sets of equal size; sets of other sizes are closer.
    differ = acos(2 * SIMILAR / (1 + SIMILAR)) / pi
    meet = sum(comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(3))
    return bits, ceil(log(1 - RECALL) / log(1 - meet))


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit hashes of each hash."""
    z = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def signatures(sets: list[np.ndarray], words: int) -> np.ndarray:
    """For each set the bits, `words` times 64, that are set in over half of its hashes."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    # A byte counts to 255: sums are of so many hashes of one set at most.
    pieces = -(-size // 255)
    owner = np.repeat(np.arange(len(sets)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(size) - size)[owner] + 255 * number
    counts = np.zeros((len(sets), words, 8, 8), np.int64)
    edge = np.append(begin, len(flat))
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + HASHES, side="right")) - 1)
        z = mixed(flat[edge[i] : edge[j]], words)
        own, first = np.unique(owner[i:j], return_index=True)
        for bit in range(8):
            sums = np.add.reduceat((z >> np.uint64(bit)) & _LANES, begin[i:j] - edge[i], axis=0)
            counts[own, :, :, bit] += np.add.reduceat(sums.view(np.uint8).reshape(j - i, words, 8), first, axis=0, dtype=np.int64)
        i = j
    return (2 * counts > size[:, None, None, None]).reshape(len(sets), words * 64)


def numbers(bits: np.ndarray) -> np.ndarray:
    """The numbers that the bits of the last axis stand for."""
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(bits.shape[-1], dtype=np.uint64))


def prints(texts: list[str | None], bits: int, tables: int) -> dict[str, pa.Array]:
    """n (distinct shingles), check (64 bits) and prints (`tables` short fingerprints) of each text."""
    n, check, short = [], [], []
    for i in range(0, len(texts), TEXTS):
        sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts[i : i + TEXTS]]
        found = signatures(sets, 1 + ceil(bits * tables / 64))
        n += [len(x) for x in sets]
        check.append(numbers(found[:, :64]))
        short.append(numbers(found[:, 64 : 64 + bits * tables].reshape(len(sets), tables, bits)).ravel())
    whole = lambda x: np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64)
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * tables
    return {"n": pa.array(n, pa.int64()), "check": pa.array(whole(check)), "prints": pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole(short)))}


def thinned(links: DataFrame) -> DataFrame:
    """`links` (a, b), a < b, that connect the same nodes: each node's smaller neighbours, of which it has one for each of its buckets at
    most, are linked with the smallest of them."""
    links = cut(links.distinct())
    near = links.groupBy("b").agg(F.collect_set("a").alias("others")).select("b", F.array_min("others").alias("a"), "others")
    return cut(near.select("a", F.explode(F.concat("others", F.array("b"))).alias("b")).where("a <> b").distinct())


def exact_links(node: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all texts of similarity SIMILAR or more.

    Once the largest component of the first few texts is known, only texts outside of it are compared with all others: no pair of texts
    in two components is left out.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    owner = np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    s, owner = flat[order], owner[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    starts = np.append(np.flatnonzero(new), len(s))
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    of_text = np.append(np.cumsum(size) - size, len(flat))
    root = np.arange(m)
    found: list[tuple[int, int]] = []

    def compare(x: int) -> None:
        g = group[of_text[x] : of_text[x + 1]]
        count = starts[g + 1] - starts[g]
        at = np.repeat(starts[g] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        common = np.bincount(owner[at], minlength=m)
        near = np.flatnonzero((9 * common >= 4 * (size[x] + size)) & (root != root[x]))
        if len(near):
            labels, one = np.unique(root[near], return_index=True)
            found.extend((int(node[x]), y) for y in node[near[one]].tolist())
            root[np.isin(root, labels)] = root[x]

    first = min(m, 8)
    for x in range(first):
        compare(x)
    largest = np.bincount(root).argmax() if m else 0
    member = int(np.flatnonzero(root == largest)[0]) if m else 0
    for x in range(first, m):
        if root[x] != root[member]:
            compare(x)
    return found


def in_tasks(sets: DataFrame) -> DataFrame:
    """`sets`: family, node, hashes (binary). Verified links (a, b) within families."""
    blocks = sets.groupBy("family").agg(F.ceil(F.sum(F.octet_length("hashes")) / F.lit(8 * A_TASK // 2)).alias("blocks")).withColumnRenamed("family", "f")
    own = F.when(F.col("blocks") <= 2, 0).otherwise(F.pmod(F.xxhash64("node"), "blocks"))
    dealt = sets.join(blocks, F.col("family") == F.col("f")).withColumn("own", own.cast("bigint"))
    others = F.when(F.col("blocks") <= 2, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: j != F.col("own")))
    dealt = dealt.select("family", "own", F.explode(others).alias("other"), "node", "hashes")
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "hashes")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held = None, [], []

        def out() -> pa.RecordBatch:
            pairs = np.array(exact_links(np.array(nodes, np.int64), held), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            for k, node, hashes in zip(keys, b.column(3).to_pylist(), b.column(4), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield out()
                    key, nodes, held = k, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    held.append(np.frombuffer(hashes.as_buffer(), np.int64))
        if len(nodes) > 1:
            yield out()

    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node").mapInArrow(verify, "a bigint, b bigint")


def near_copies(full: DataFrame, in_files: bool) -> DataFrame:
    """`full`: doc_id, at_file, at_row (of `located`) and text. Without text, with node, the text's hash, and root, its component (null: none)."""
    texts = full.select("doc_id", *PLACE, F.xxhash64(text_or_empty()).alias("node"), "text")
    n = full.count()
    bits, tables = shape(n)
    known = cut(map_texts(texts, ["doc_id", *PLACE, "node"], "text", "n bigint, check bigint, prints array<bigint>", lambda t: prints(t, bits, tables)))
    # As many tasks as partitions, however few bytes there are: each row turns into many.
    classes = by_key(known.where("n > 0"), "node").groupBy("node").agg(F.first("check").alias("check"), F.first("prints").alias("prints"))
    short = classes.select(F.posexplode("prints").alias("t", "fp"), "node", "check")
    first = max(FIRST_BITS, (n // A_BUCKET).bit_length())
    family = cut(components(thinned(linked(short, first, 1, bits, CLOSE, stars=True))).select(F.col("node").alias("k"), F.col("root").alias("family")))
    members = cut(known.select(*PLACE, "node").join(family, F.col("node") == F.col("k")).select(*PLACE, "family"))
    # The texts of families, read once more; a family is known by the hash of its least text.
    some = told(full.select(*PLACE, "text"), members.withColumnRenamed("family", "number"), in_files).where("named")
    some = cut(some.select(F.xxhash64(text_or_empty()).alias("node"), F.col("number").alias("family"), "text"))

    def hashes(values: list[str | None]) -> dict[str, pa.Array]:
        return {"hashes": pa.array([np.unique(shingle_hashes(t, SHINGLE)).tobytes() for t in values], pa.binary())}

    sets = cut(map_texts(some, ["family", "node"], "text", "hashes binary", hashes))
    found = components(cut(in_tasks(sets))).withColumnRenamed("node", "k")
    return known.select("doc_id", *PLACE, "node").join(found, F.col("node") == F.col("k"), "left").select("doc_id", *PLACE, "node", "root")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay: of each component of near copies, and of equal texts, the document with the smallest id."""
    full, in_files = located(df)
    rows = full.select(F.col(f"c{place(df, id_col)}").alias("doc_id"), *PLACE, F.col(f"c{place(df, text_col)}").alias("text"))
    found = cut(near_copies(rows, in_files).select("doc_id", *PLACE, F.coalesce("root", "node").alias("root"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *PLACE).alias("rank")))
    least = found.groupBy("root").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("root").alias("r"), "least")
    gone = found.join(least, (F.col("root") == F.col("r")) & (F.col("rank") != F.col("least")))
    return remaining(full, gone.select(*PLACE), in_files).toDF(*df.columns)
