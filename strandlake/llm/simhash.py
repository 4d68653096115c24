"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a value within distance 2 of both. So every distinct fingerprint emits all
variants within half the radius, variants meet in a shuffle, and fingerprints that share one are verified and linked.

A fingerprint has 2081 variants, so they are shuffled packed: the key is a variant's first `bits` bits, one row stands for
all variants of a fingerprint with that beginning, and the receiving task unpacks and sorts them. With 10 bits that is 56
rows instead of 2081. `bits` follows the number of fingerprints, which bounds a bucket; a bucket that is crowded all the
same is split by further bits in the task.

Within a bucket, links that close no new component are left out, so groups never turn into all their pairs: a bucket gives
fewer links than it has rows, every one of them verified.

Defined cases: null text counts as empty; texts without words have fingerprint zero, which links like any other; repeated
rows share a component; a null id is never the smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, pick, place
from .components import components
from .rows import PLACE, located, remaining

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints for each value of the bucket's bits, about; and the least bits, so that buckets spread over tasks.
A_BUCKET = 512
LEAST_BITS = 10
MOST_BITS = 30
#: Rows of a bucket beyond which it is dealt out by so many more bits.
CROWDED = 1_000_000
DEEPER = 4
#: Bits of a key that hold the first bits of a variant; the depth and the table stand above them.
BEGIN = 40
#: Links of a task that are thinned together.
PENDING = 500_000
#: Rows of a variant's group that each row is compared with in any case.
NEXT = 7
#: Variants that are unpacked at once.
UNPACKED = 2_000_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hash of each word shingle of `text`, A-Z lower-cased; of all words together if they are no more than `size`."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    shingles = [joined[a:b] for a, b in zip(starts, ends, strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of `text`, A-Z lower-cased; zero without words."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """The columns `keep` and fp, the fingerprint of the column text as a signed 64-bit number."""

    def work(texts: list[str | None]) -> dict[str, np.ndarray]:
        return {"fp": pa.array(np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts)).view(np.int64))}

    return map_texts(df, keep, "text", "fp bigint", work)


def flips(lo: int, hi: int, most: int) -> list[int]:
    """Numbers with `most` one bits at most, all of them among bits lo to hi - 1."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(lo, hi), k)]


class Buckets:
    """Links among the rows of buckets: (first bits of a variant, fingerprint of `width` bits, the document's node, 64 bits to verify by).

    Rows that share a variant are linked if their 64 bits differ in `most` places at most.
    """

    def __init__(self, bits: int, half: int = RADIUS // 2, width: int = 64, most: int = RADIUS):
        self.bits, self.half, self.width, self.most = bits, half, width, most
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def mask(self, bits: int, left: int) -> np.ndarray:
        """All changes of `left` bits at most below the first `bits`."""
        if (bits, left) not in self.masks:
            self.masks[bits, left] = np.array(flips(0, self.width - bits, left), np.uint64)
        return self.masks[bits, left]

    def left(self, begin: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
        """Changes that remain after those in the first bits."""
        return self.half - np.bitwise_count(begin ^ (fp >> np.uint64(self.width - bits))).astype(np.int64)

    def links(self, begin: np.ndarray, fp: np.ndarray, node: np.ndarray | None = None, check: np.ndarray | None = None, bits: int | None = None) -> set[tuple[int, int]]:
        """Verified links of rows that are whole buckets; they connect what shares a variant. A fingerprint is its own node if none is given."""
        bits = bits or self.bits
        node, check = fp if node is None else node, fp if check is None else check
        left = self.left(begin, fp, bits)
        n = sum(int((left == k).sum()) * len(self.mask(bits, k)) for k in range(self.half + 1))
        if n > UNPACKED and bits <= self.width - 8 and len(fp) > 1:
            return self.split(begin, fp, node, check, left, bits)
        below = np.uint64(self.width - bits)
        low = np.uint64((1 << (self.width - bits)) - 1)
        variants, rows = [], []
        for k in range(self.half + 1):
            at = np.flatnonzero(left == k)
            if len(at):
                mask = self.mask(bits, k)
                base = (begin[at] << below) | (fp[at] & low)
                variants.append((base[:, None] ^ mask[None, :]).ravel())
                rows.append((at, len(mask)))
        v, row = self.shared(np.concatenate(variants), np.concatenate([np.repeat(at, m) for at, m in rows]))
        found: list[np.ndarray] = []
        apart = np.zeros(len(v), bool)
        # Each row is compared with those next to it in its variant's group.
        for step in range(1, NEXT + 1):
            same = np.flatnonzero(v[step:] == v[:-step])
            if not len(same):
                break
            a, b = row[same], row[same + step]
            near = np.bitwise_count(check[a] ^ check[b]) <= self.most
            apart[same[~near]] = True
            one, two = node[a[near]], node[b[near]]
            differ = one != two
            found.append(np.stack([np.minimum(one, two)[differ], np.maximum(one, two)[differ]], axis=1))
            if not apart.any():
                break
        else:
            # Larger groups with rows that are apart: each of their rows is compared until what is left is apart.
            starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]])
            odd = np.flatnonzero((np.diff(starts) > NEXT + 1) & (np.add.reduceat(apart, starts[:-1]) > 0))
            found += [np.array(sorted(self.connected(np.unique(row[starts[g] : starts[g + 1]]), node, check)), np.uint64).reshape(-1, 2) for g in odd.tolist()]
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *found]), axis=0)
        return set(forest(map(tuple, pairs.tolist())))

    def shared(self, variant: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of variants and their rows those whose variant occurs twice or more, in order of the variant."""
        if self.width <= 32 and len(variant) and int(row.max()) < 1 << 32:
            both = np.sort((variant << np.uint64(32)) | row.astype(np.uint64))
            v = both >> np.uint64(32)
            twice = np.zeros(len(v), bool)
            twice[1:] = v[1:] == v[:-1]
            twice[:-1] |= twice[1:]
            return v[twice], (both[twice] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = np.sort(variant)
        more = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(more):
            return variant[:0], row[:0]
        hit = np.flatnonzero(more[np.minimum(np.searchsorted(more, variant), len(more) - 1)] == variant)
        order = hit[np.argsort(variant[hit], kind="stable")]
        return variant[order], row[order]

    def connected(self, rows: np.ndarray, node: np.ndarray, check: np.ndarray) -> set[tuple[int, int]]:
        """Links that connect all of `rows` that are near."""
        found: set[tuple[int, int]] = set()
        while len(rows) > 1:
            front, rows = [int(rows[0])], rows[1:]
            while front and len(rows):
                x = front.pop()
                near = np.bitwise_count(check[rows] ^ check[x]) <= self.most
                found.update((min(p), max(p)) for y in node[rows[near]].tolist() if (p := (y, int(node[x])))[0] != p[1])
                front += rows[near].tolist()
                rows = rows[~near]
        return found

    def split(self, begin: np.ndarray, fp: np.ndarray, node: np.ndarray, check: np.ndarray, left: np.ndarray, bits: int) -> set[tuple[int, int]]:
        """The same, a few more first bits at a time: one sub-bucket is unpacked at once."""
        more = min(4, self.width - bits)
        after = bits + more
        own = (fp >> np.uint64(self.width - after)) & np.uint64((1 << more) - 1)
        found: set[tuple[int, int]] = set()
        for value in range(1 << more):
            cost = np.bitwise_count(own ^ np.uint64(value)).astype(np.int64)
            at = np.flatnonzero(cost <= left)
            if len(at) < 2:
                continue
            deeper = (begin[at] << np.uint64(more)) | np.uint64(value)
            # Buckets that were read together are told apart again, so that a sub-bucket is whole.
            order = np.argsort(deeper, kind="stable")
            edges = np.flatnonzero(np.diff(deeper[order])) + 1
            for part in batches_of(order, edges) if len(edges) else [order]:
                found |= self.links(deeper[part], fp[at][part], node[at][part], check[at][part], after)
        return set(forest(found))


def batches_of(order: np.ndarray, edges: np.ndarray, rows: int = 4096) -> Iterator[np.ndarray]:
    """Runs of whole groups, of about `rows` rows; `edges` are where groups begin in `order`."""
    begin = 0
    for e in [*edges.tolist(), len(order)]:
        if e - begin >= rows or e == len(order):
            yield order[begin:e]
            begin = e


def forest(pairs) -> Iterator[tuple[int, int]]:
    """Those of `pairs` that join two components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
            yield a, b


def star(pairs) -> Iterator[tuple[int, int]]:
    """(the smallest node, node) of every node of the components of `pairs` but the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            parent[max(x, y)] = min(x, y)
    for x in list(parent):
        if (least := find(x)) != x:
            yield least, x


def linked(rows: DataFrame, bits: int, half: int, width: int, most: int, stars: bool = False) -> DataFrame:
    """`rows`: t, fp, a fingerprint of `width` bits in table t, and node and check, which are fp if left out. Links (a, b) between nodes.

    With `stars`, each node of a task's components is linked with the component's smallest node, which connects the same nodes with fewer
    different links.

    A bucket (t, first bits) with more than CROWDED rows is dealt out again by DEEPER more bits, and so on: as a variant's group among
    distinct fingerprints is no larger than the ball, a family of near fingerprints spreads over tasks.
    """
    begins = F.array(*[F.lit(m).cast("bigint") for m in flips(0, bits, half)])
    with_others = ["fp", *(c for c in ("node", "check") if c in rows.columns)]
    packed = rows.select("t", *with_others, F.explode(begins).alias("m"))
    packed = packed.select(F.lit(bits).alias("depth"), "t", F.shiftrightunsigned("fp", width - bits).bitwiseXOR(F.col("m")).alias("begin"), *with_others)
    whole = packed.where("false")
    depth = bits
    while depth + DEEPER <= min(width - 8, BEGIN):
        crowded = packed.groupBy("t", "begin").count().where(F.col("count") > CROWDED).select("t", "begin")
        if not crowded.take(1):
            break
        # One of CROWDED rows at most is a bucket's.
        crowded = F.broadcast(cut(crowded))
        whole = whole.union(packed.join(crowded, ["t", "begin"], "left_anti").select(*whole.columns))
        left = half - F.bit_count(F.col("begin").bitwiseXOR(F.shiftrightunsigned("fp", width - depth)))
        deeper = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(m.bit_count()).alias("k")) for m in flips(0, DEEPER, half)])
        own = F.shiftrightunsigned("fp", width - depth - DEEPER).bitwiseAND(F.lit((1 << DEEPER) - 1))
        again = packed.join(crowded, ["t", "begin"]).select("*", left.alias("left"), F.explode(deeper).alias("d")).where("d.k <= left")
        depth += DEEPER
        again = again.withColumn("begin", F.col("begin") * (1 << DEEPER) + own.bitwiseXOR(F.col("d.m")))
        packed = cut(again.select(F.lit(depth).alias("depth"), "t", "begin", *with_others))
    key = F.shiftleft(F.col("depth").cast("bigint"), 56) + F.shiftleft(F.col("t").cast("bigint"), BEGIN) + F.col("begin")
    keyed = whole.union(packed).select(key.alias("key"), *with_others)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Buckets(bits, half, width, most)
        room = 40_000
        held = np.zeros((len(with_others) + 1, 0), np.uint64)

        pending: set[tuple[int, int]] = set()

        def batch_of(pairs) -> pa.RecordBatch:
            pairs = np.array(sorted(pairs), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = pending if stars else set()
            # A begin tells buckets apart only at one depth of one table.
            table = rows[0] >> np.uint64(BEGIN)
            for part in np.split(rows, np.flatnonzero(table[1:] != table[:-1]) + 1, axis=1):
                begin, depth = part[0] & np.uint64((1 << BEGIN) - 1), int(part[0, 0]) >> 56
                others = part[1:] if len(part) > 2 else part[[1, 1, 1]]
                for some in batches_of(np.arange(part.shape[1]), np.flatnonzero(np.diff(begin)) + 1, 8192):
                    found.update(work.links(begin[some], *others[:, some], bits=depth))
                    if stars and len(found) > PENDING:
                        fewer = set(star(found))
                        found.clear()
                        if len(fewer) > PENDING // 2:
                            yield batch_of(fewer)
                        else:
                            found.update(fewer)
            if not stars:
                yield batch_of(found)

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().view(np.uint64) for c in batch.columns])], axis=1)
            if held.shape[1] >= room:
                # The last bucket may go on in the next batch.
                whole = int(np.searchsorted(held[0], held[0, -1]))
                if whole:
                    yield from out(held[:, :whole])
                    held = held[:, whole:]
                room = max(40_000, 2 * held.shape[1])
        if held.shape[1]:
            yield from out(held)
        if pending:
            yield batch_of(star(pending))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(unpack, "a bigint, b bigint")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`fps`: distinct fingerprints (fp). Links (a, b) that connect all of them at distance `radius` or less; it is even."""
    if radius % 2:
        raise ValueError(f"half of the radius {radius} is no number of bits")
    bits = min(MOST_BITS, max(LEAST_BITS, (max(fps.count(), 1) // A_BUCKET).bit_length()))
    return linked(fps.select(F.lit(0).alias("t"), "fp"), bits, radius // 2, 64, radius)


def grouped(rows: DataFrame, radius: int) -> DataFrame:
    """`rows`: doc_id and fp among others. With component_id, the smallest doc_id reachable by links."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(cut(links(classes.select("fp"), radius)))
    roots = classes.join(found, classes["fp"] == found["node"]).select("fp", "root", "least")
    joined = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # Classes of one document without links are components of their own and need no join.
    alone = classes.join(joined, "fp", "left_anti").where("n > 1").select("fp", F.col("least").alias("component_id"))
    named = joined.union(alone).withColumnRenamed("fp", "f")
    return rows.join(named, rows["fp"] == named["f"], "left").drop("f").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of `df`: doc_id, fp and component_id."""
    return grouped(cut(fingerprints(pick(df, doc_id=id_col, text=text_col), ["doc_id"])), radius)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `df` that stay: of each component one, of its smallest id; with all their columns."""
    full, in_files = located(df)
    rows = full.select(F.col(f"c{place(df, id_col)}").alias("doc_id"), *PLACE, F.col(f"c{place(df, text_col)}").alias("text"))
    found = cut(grouped(cut(fingerprints(rows, ["doc_id", *PLACE])), radius))
    ids = found.where("doc_id <=> component_id AND component_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct(*PLACE)).alias("first")).withColumnRenamed("component_id", "c")
    gone = found.join(ids, F.col("component_id") == F.col("c")).where((F.col("first.at_file") != F.col("at_file")) | (F.col("first.at_row") != F.col("at_row")))
    return remaining(full, gone.select(*PLACE), in_files).toDF(*df.columns)
