"""Byte-level BPE by corpus-level merge replay.

Each block of documents is laid out by its distinct words (matches of the pattern) and kept as a file in the shared folder. The words
of all blocks are dealt to shares by a hash, so that every distinct word of the corpus is merged once, in the replay of its share; the
ids go back to the blocks, which put their texts together.

A replay lays its words out as a linked list of tokens. An inverted index from a pair's rank to the places where the pair stands
applies every merge in rank order over all words, and only the neighbours of merged places are looked up again. A merge of a lower
rank can arise after a higher one only through a second way to split a token; words where that happens are merged one at a time
with a heap.

What is shuffled are each block's distinct words and their ids, packed in a row for each block and share; no text is. A block's file is
named by its task, its number and its contents, and put in place whole: a task that is run again writes the same files.

Defined cases: null text counts as empty, with no ids; texts of any length are encoded whole; repeated rows are encoded
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import storage
from .common import Table, cut, pick, shared_dir, small_batches
from .rows import scanned

NO_RANK = np.int32(2**31 - 1)
#: Bytes of text in a block, and of words that are replayed together: the units of memory.
BLOCK_BYTES = 8_000_000
#: Shares of the corpus's words: half as many as the scan has tasks, within these bounds.
LEAST_SHARES, MOST_SHARES = 16, 4096
WORDS = ["file", "length", "share", "words", "sizes"]


class Codec:
    """Encoder and decoder of a file of ranks (`base64(token) rank` lines)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.findall = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.numbers = [str(r) for r in range(size)]
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the ranks lack a single byte")
        self.size = size
        pairs = {self.ranks[t[:i]] * size + self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pairs = pairs
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.table = Table(keys, values, NO_RANK)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; NO_RANK if it is no token."""
        return self.table[left.astype(np.int64) * self.size + right]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none of them empty), one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        n = int(ends[-1])
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - size] = -1
        alive = np.ones(n, bool)
        current = np.full(n, NO_RANK, np.int32)
        inside = np.flatnonzero(after >= 0)
        current[inside] = self.rank(token[inside], token[inside + 1])
        places = inside[current[inside] != NO_RANK].astype(np.int32)
        places = places[np.argsort(current[places], kind="stable")]
        ranks, starts = np.unique(current[places], return_index=True)
        del inside
        bounds = [*starts.tolist(), len(places)]
        heap = ranks.tolist()
        first = dict(zip(heap, zip(bounds, bounds[1:], strict=False), strict=True))
        later: dict[int, list[int]] = defaultdict(list)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            at = places[slice(*first.pop(r, (0, 0)))]
            if more := later.pop(r, None):
                at = np.unique(np.concatenate([at, np.array(more, np.int32)]))
            at = at[current[at] == r]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (meets := right[:-1] == at[1:]).any():
                # Places that overlap: from the left, every second one of a run.
                begins = np.concatenate([[True], ~meets])
                where = np.arange(len(at))
                at = at[(where - where[begins][np.cumsum(begins) - 1]) % 2 == 0]
                right = after[at]
            beyond = after[right]
            has = np.flatnonzero(beyond >= 0)
            # Merging from the left meets the old right neighbour first.
            early = self.rank(np.full(len(has), r, np.int32), token[beyond[has]]) < r
            if early.any():
                odd.update(word[at[has[early]]].tolist())
            token[at] = r
            after[at] = beyond
            before[beyond[has]] = at[has]
            alive[right] = False
            current[right] = NO_RANK
            new = np.full(len(at), NO_RANK, np.int32)
            new[has] = self.rank(token[at[has]], token[beyond[has]])
            current[at] = new
            left = before[at]
            left = left[left >= 0]
            beside = self.rank(token[left], token[after[left]])
            current[left] = beside
            changed, fresh = np.concatenate([at, left]), np.concatenate([new, beside])
            if (low := fresh < r).any():
                odd.update(word[changed[low]].tolist())
                fresh = np.where(low, NO_RANK, fresh)
                current[changed[low]] = NO_RANK
            keep = fresh != NO_RANK
            for q, p in zip(fresh[keep].tolist(), changed[keep].tolist(), strict=True):
                if q not in later and q not in first:
                    heapq.heappush(heap, q)
                later[q].append(p)
        ids, count = token[alive], np.bincount(word[alive], minlength=len(words))
        if odd:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for w in odd:
                parts[w] = np.array(self.merge_one(words[w]), np.int32)
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, count

    def merge_one(self, word: bytes) -> list[int]:
        """The ids of one word: the lowest rank first, from the left."""
        token = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get, size = self.pairs.get, self.size
        heap = [(r, i) for i in range(n - 1) if (r := get(token[i] * size + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if token[i] < 0 or (j := after[i]) < 0 or get(token[i] * size + token[j]) != r:
                continue
            token[i], token[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := get(r * size + token[k])) is not None:
                    heapq.heappush(heap, (q, i))
            if (h := before[i]) >= 0 and (q := get(token[h] * size + r)) is not None:
                heapq.heappush(heap, (q, h))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        rest = whole < 0
        ids, count = self.replay([w for w, r in zip(words, rest.tolist(), strict=True) if r])
        size = np.ones(len(words), np.int64)
        size[rest] = count
        out = np.empty(int(size.sum()), np.int32)
        within = np.repeat(rest, size)
        out[within], out[~within] = ids, whole[~rest]
        return out, size

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Block:
    """Some documents by their distinct words, which stand in the order of the shares that they are dealt to."""

    def __init__(self, c: Codec, texts: list[str | None], shares: int):
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        found = [np.fromiter(map(known.__getitem__, c.findall(t or "")), np.int32) for t in texts]
        words = [w.encode() for w in known]
        del known
        share = np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(shares)
        order = np.argsort(share, kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        self.texts = [place[x] for x in found]
        words = [words[i] for i in order.tolist()]
        size = np.fromiter(map(len, words), np.int32, len(words))
        bounds = np.searchsorted(share[order], np.arange(shares + 1))
        self.dealt = [(k, zstandard.compress(b"".join(words[i:j])), packed(size[i:j])) for k, (i, j) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)) if i < j or not k]

    def file(self, keys: pa.Array) -> bytes:
        """The documents' keys and words."""
        out = io.BytesIO()
        table = pa.table({"key": keys, "at": lists(self.texts)})
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return out.getvalue()


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest takes, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return kind.char.encode() + zstandard.compress(values.astype(kind).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), data[:1].decode())


def cut_up(data: bytes, sizes: bytes) -> list[bytes]:
    plain, ends = zstandard.decompress(data), np.cumsum(unpacked(sizes), dtype=np.int64).tolist()
    return [plain[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class Vocabulary:
    """The ids of all words of a share, each merged once, in the replay of the batch where it is met first."""

    def __init__(self, c: Codec):
        self.codec = c
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.size = np.zeros(0, np.int64)

    def add(self, words) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        ids, size = self.codec.encode_words(new)
        self.size = np.concatenate([self.size, size])
        self.ids.append(ids)

    def settle(self) -> None:
        self.ids = [np.concatenate([np.zeros(0, np.int32), *self.ids])]
        self.begin = np.cumsum(self.size) - self.size

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        return self.ids[0][np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size


def replayed(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, made: Callable[[Codec, list, np.ndarray, np.ndarray], list]) -> DataFrame:
    """doc_id and the columns of `schema`, which `made` returns for the documents of a block.

    `made` gets the codec, each document's words by their number, and the words' ids, one after the other, and how many each has.
    """
    small_batches(df.sparkSession)
    rows = pick(df, doc_id=id_col, text=text_col)
    if not scanned(rows):
        # A task that is run again has to make the same blocks: its rows must come in the same order.
        rows = cut(rows)
    folder = f"{shared_dir(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    shares = min(MOST_SHARES, max(LEAST_SHARES, rows.rdd.getNumPartitions() // 2))
    key = rows.schema["doc_id"].dataType.simpleString()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, made_so_far = 0, 0
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
            if held and (b is None or size >= BLOCK_BYTES):
                block = Block(codec(path, pattern), [t for x in held for t in x.column(1).to_pylist()], shares)
                data = block.file(pa.concat_arrays([x.column(0) for x in held]))
                name = f"{folder}/{TaskContext.get().partitionId()}-{made_so_far}-{hashlib.sha1(data).hexdigest()}"
                made_so_far += 1
                storage.put(name, data)
                share, words, sizes = zip(*block.dealt, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(share)), pa.array([len(data)] * len(share), pa.int64()), pa.array(share, pa.int32()), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], names=WORDS)
                held, size = [], 0

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(codec(path, pattern))
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
            if held and (b is None or sum(x.nbytes for x in held) >= BLOCK_BYTES):
                for x in held:
                    vocabulary.add(w for data, sizes in zip(x.column(3).to_pylist(), x.column(4).to_pylist(), strict=True) for w in cut_up(data, sizes))
                vocabulary.settle()
                for x in held:
                    found = [vocabulary.of(cut_up(data, sizes)) for data, sizes in zip(x.column(3).to_pylist(), x.column(4).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array([packed(i) for i, _ in found], pa.binary()), pa.array([packed(n) for _, n in found], pa.binary())], names=WORDS)
                held = []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        now: tuple[str, int] | None = None
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            documents = pa.ipc.open_stream(storage.read(now[0], 0, now[1])).read_all().combine_chunks()
            columns = made(c, pieces(documents.column("at")), np.concatenate(ids), np.concatenate(sizes))
            if documents.num_rows:
                yield pa.RecordBatch.from_arrays([documents.column("key").chunk(0), *columns], names=["doc_id", *(f.split()[0] for f in schema.split(", "))])

        for b in batches:
            for name, length, i, n in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if now is not None and now[0] != name:
                    yield from out()
                    ids, sizes = [], []
                now = (name, length)
                ids.append(unpacked(i).astype(np.int32))
                sizes.append(unpacked(n).astype(np.int64))
        if now is not None:
            yield from out()

    words = rows.mapInArrow(lay_out, "file string, length bigint, share int, words binary, sizes binary")
    merged = words.repartition("share").mapInArrow(replay, "file string, length bigint, share int, ids binary, sizes binary")
    return merged.repartition("file").sortWithinPartitions("file", "share").mapInArrow(finish, f"doc_id {key}, {schema}")


def pieces(column: pa.ChunkedArray) -> list[np.ndarray]:
    if not len(column):
        return []
    chunk = column.chunk(0)
    values, offsets = chunk.flatten().to_numpy(), chunk.offsets.to_numpy()
    return np.split(values, (offsets[1:-1] - offsets[0]))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the array of each text's token ids."""

    def made(c: Codec, documents: list, ids: np.ndarray, size: np.ndarray) -> list:
        ends = np.cumsum(size).tolist()
        word = [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return [pa.array([np.concatenate([np.zeros(0, np.int32), *[word[w] for w in d.tolist()]]).astype(np.int64) for d in documents], pa.list_(pa.int64()))]

    return replayed(df, path, pattern, id_col, text_col, "ids array<bigint>", made)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes that the ids decode to)."""

    def made(c: Codec, documents: list, ids: np.ndarray, size: np.ndarray) -> list:
        ends = np.cumsum(size).tolist()
        spans = list(zip([0, *ends], ends, strict=False))
        numbers = list(map(c.numbers.__getitem__, ids.tolist()))
        listed = [",".join(numbers[i:j]) for i, j in spans]
        del numbers
        tokens = list(map(c.tokens.__getitem__, ids.tolist()))
        plain = [b"".join(tokens[i:j]) for i, j in spans]
        del tokens, spans
        sha = lambda x: hashlib.sha256(x).hexdigest()
        n, by_ids, by_text = [], [], []
        for d in documents:
            words = d.tolist()
            n.append(int(size[d].sum()))
            by_ids.append(sha(",".join([listed[w] for w in words]).encode()))
            by_text.append(sha(b"".join([plain[w] for w in words])))
        return [pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())]

    return replayed(df, path, pattern, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", made)
