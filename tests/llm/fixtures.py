"""Small documents with every odd case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows() -> list[tuple]:
    out = []
    words = ["thand", "erin", "oneth", "there", "tion", "ofand", "wasble", "nting", "hered", "inand", "edly", "arest"]
    for i in range(60):
        text = ". ".join(" ".join(words[(i * 7 + j * (1 + i % 5) + j * j) % 12] for j in range(k, k + 9)) for k in range(0, 9 * (1 + i % 8), 9))
        out.append((i, text, "en" if i % 2 else "fr", f"src{i % 4}", len(text)))
    near = " ".join(f"w{j}" for j in range(2500))
    out += [(100 + i, f"{near} end{i}", "en", "src1", 1) for i in range(4)]
    out += [(200 + i, "the very same words stand here again and again", "en", None, 2) for i in range(7)]
    out += [
        (300, None, None, None, None),
        (301, "", "en", "src0", 0),
        (302, " \n\t ", "de", "src0", 3),
        (303, "1234 !!! \U0001f600", None, "src2", 9),
        (304, "Ärger über größe\n" * 3, "de", "src2", 50),
        (305, "lorem " * 30000, "en", "src3", 180000),
        (306, "a" * 20000, "en", "src3", 20000),
        (None, "a row without an id", "en", "src0", 5),
        (307, "same row twice, all columns alike", "en", "src1", 7),
        (307, "same row twice, all columns alike", "en", "src1", 7),
        (308, "mail a.b@mail.example.com or +1 (555) 123-4567 at 10.0.0.255 pay 4539578763621486.", "en", "src0", 8),
        (309, "A, B.\r\nA, B.\x0bx\x0cy # * $ % & | < >\n\n A, B.", "en", "src0", 8),
    ]
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(doc_id, folds: int, out: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == out


def simhash(text: str | None) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(ids: list, prints: list[int], distance: int = 4) -> list:
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least: dict = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
