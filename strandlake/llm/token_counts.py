"""Token counts with a whole-token shortcut.

Offline, from the vocabulary alone: (1) which of its strings encode alone as one token; (2) that no merged piece holds a
line feed, or a word-start mark after another character. By (2) merges never cross those places, so a text is cut there
into pre-tokens whose counts add up. A pre-token that (1) lists counts one; only the others are merged, once for each
distinct string of a worker's bounded table. For a model where (2) fails, whole texts go to the library.

Defined cases: null text counts as empty and has no tokens; texts of any length are cut, never shortened; repeated rows
count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pick

MARK = "▁"
#: Distinct pre-tokens that a worker remembers, and the longest of them.
REMEMBERED = 400_000
LONGEST = 64
_RUNS = re.compile(r" *[^ ]+| +")


class Shortcut:
    """Exact token counts for one sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.line_feed = len(m.encode("a\n")) - len(m.encode("a"))
        self.start = len(m.encode("\n")) - self.line_feed
        self.separable = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and m.encode("\n", out_type=str)[0] == MARK
        marked = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
        bare = [p for p in pieces if MARK not in p]
        alone = m.encode(marked)
        self.marked = _Counts(self._marked, {p: 1 for p, ids in zip(marked, alone, strict=True) if len(ids) == 1})
        alone = m.encode(["\n" + p for p in bare])
        self.bare = _Counts(self._bare, {p: 1 for p, ids in zip(bare, alone, strict=True) if len(ids) - self.start - self.line_feed == 1})

    def _marked(self, unit: str) -> int:
        """Tokens of the start mark and `unit`; the library puts the mark."""
        return len(self.model.encode(unit))

    def _bare(self, unit: str) -> int:
        """Tokens of `unit` without a mark: what it adds after a line feed."""
        return len(self.model.encode("\n" + unit)) - self.start - self.line_feed

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.model.encode(text))
        lines = (" " + text.replace(MARK, " ")).split("\n")
        n = self.line_feed * (len(lines) - 1)
        marked, bare = self.marked, self.bare
        for line in lines:
            if "  " not in line and line[-1:] != " ":
                first, *words = line.split(" ")
                n += (bare[first] if first else 0) + sum(map(marked.__getitem__, words))
                continue
            for run in _RUNS.findall(line):
                # After a line feed the run keeps its marks as they are.
                n += marked[run[1:]] if run[0] == " " and run[1:2] not in (" ", "") else bare[run]
        return n


class _Counts(dict):
    """Counts by pre-token: the proven ones, and as many more as the bound allows."""

    def __init__(self, count, proven: dict[str, int]):
        super().__init__(proven)
        self.proven, self.one = proven, count

    def __missing__(self, unit: str) -> int:
        n = self.one(unit)
        if len(unit) <= LONGEST:
            if len(self) >= len(self.proven) + REMEMBERED:
                self.clear()
                self.update(self.proven)
            self[unit] = n
        return n


@lru_cache(maxsize=4)
def shortcut(path: str) -> Shortcut:
    return Shortcut(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. `path`: a sentencepiece model that every executor has at that place."""

    def work(texts: list[str | None]) -> dict[str, list]:
        count = shortcut(path).count
        return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": [count(t or "") for t in texts]}

    out = map_texts(pick(df, doc_id=id_col, text=text_col), ["doc_id"], "text", "n_bytes bigint, n_tokens bigint", work)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
