"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match from any place of a word, so a word falls
greedily into the fewest phrases that occur in that language's text. Phrases times the bits that point at one (log2 of the
text's length), for each letter parsed, estimate the cross entropy; the language with the least wins.

Words are parsed with their borders and apart from each other, so each distinct word of a block is parsed once, in all
languages at the same time, with array operations.

The automata are fitted on a bounded sample of labelled rows, each of them whole: of each language up to DOCS_A_LANGUAGE documents in
the order of a hash, while they fit in its share of SAMPLE_CHARS characters; one in any case. Documents of more than an eighth of the share
come after all others. The LANGUAGES languages with most rows are learned. Every text is predicted whole.

Defined cases: null text, or text without a letter, gives `und` with score 0, as does any text if there is nothing to
learn from; words of any length are parsed whole; ties go to the language first in code point order; repeated rows are predicted each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, crc_fold, map_texts, pick

DOCS_A_LANGUAGE = 48
SAMPLE_CHARS = 800_000
LANGUAGES = 1000
#: Bytes of text whose distinct words are parsed together: the unit of memory.
BLOCK_BYTES = 10_000_000
#: How sharply differences of entropy turn into the score.
SHARPNESS = 8.0
UNKNOWN = "und"

letters = regex.compile(r"\p{L}+").findall


def automaton(text: str) -> list[dict[str, int]]:
    """The transitions of the suffix automaton of `text`; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Languages:
    """The automata of all languages in one table of transitions."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        """`samples`: (language, text), in order of the language."""
        texts = [f" {' '.join(letters(t.lower()))} " for _, t in samples]
        self.names = [n for n, _ in samples]
        self.bits = np.log2(np.array([max(2, len(t)) for t in texts], float))
        alphabet = sorted(set("".join(texts)))
        # Codes from 2 on; 0 stands for no letter of any sample, 1 for the border.
        code = {c: i + 2 for i, c in enumerate(alphabet)}
        code[" "] = 1
        self.codes = np.zeros(0x110000, np.int64)
        for c, i in code.items():
            self.codes[ord(c)] = i
        self.width = len(alphabet) + 2
        keys, values, self.roots = [], [], []
        first = 1  # state 0 stands for no match
        for t in texts:
            moves = automaton(t)
            self.roots.append(first)
            for s, to in enumerate(moves):
                keys += [(first + s) * self.width + code[c] for c in to]
                values += [first + n for n in to.values()]
            first += len(moves)
        self.moves = Table(np.array(keys, np.int64), np.array(values, np.int32), 0)

    def phrases(self, words: list[str]) -> np.ndarray:
        """Phrases of each word, with its borders, by language."""
        if not words:
            return np.zeros((0, len(self.names)), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        order = np.argsort(-size, kind="stable")
        joined = "".join([f" {w} " for w in words])
        codes = self.codes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        roots = np.array(self.roots, np.int64)
        state = np.tile(roots, (len(words), 1))
        count = np.ones(state.shape, np.int64)
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))  # words longer than t
            c = codes[begin[:n] + t][:, None]
            to = self.moves[(state[:n] * self.width + c).ravel()].reshape(n, -1)
            stuck = to == 0
            if stuck.any():
                # A new phrase begins at this letter; a letter that the text lacks is a phrase of its own.
                count[:n] += stuck & (state[:n] != roots)
                again = self.moves[(roots[None, :] * self.width + c).ravel()].reshape(n, -1)
                to = np.where(stuck, again, to)
                lacks = to == 0
                count[:n] += lacks
                to = np.where(lacks, roots[None, :], to)
            state[:n] = to
        count -= (state == roots) & (size[:, None] > 0)
        out = np.empty_like(count)
        out[order] = count
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its cross entropy by language (0 without letters)."""
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        where = [np.fromiter(map(known.__getitem__, t.lower().split()), np.int64) for t in texts]
        pieces, owner = [], []
        for i, token in enumerate(known):
            for run in letters(token):
                pieces.append(run)
                owner.append(i)
        owners = np.array(owner, np.int64)
        size = np.bincount(owners, weights=[len(p) for p in pieces], minlength=len(known)) if pieces else np.zeros(len(known))
        found = self.phrases(pieces)
        by_token = np.stack([np.bincount(owners, weights=found[:, k], minlength=len(known)) if pieces else np.zeros(len(known)) for k in range(len(self.names))], axis=1)
        n = np.array([size[w].sum() for w in where])
        phrases = np.stack([by_token[w].sum(axis=0) for w in where])
        return n, phrases * self.bits / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"lang_pred": [], "score": []}
        n, h = self.entropies([t or "" for t in texts])
        share = np.exp(-SHARPNESS * (h - h.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        for k, best, s in zip(n.tolist(), h.argmin(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
            out["lang_pred"].append(self.names[best] if k else UNKNOWN)
            out["score"].append(s if k else 0.0)
        return out


@lru_cache(maxsize=2)
def languages(samples: tuple[tuple[str, str], ...]) -> Languages:
    return Languages(samples)


def sample(df: DataFrame, learn) -> tuple[tuple[str, str], ...]:
    """Bounded labelled text of each language. One count for each language sets a bar on a hash, which few rows pass."""
    text = F.col("text")
    able = df.where(learn & F.col("lang").isNotNull() & text.rlike(r"\p{L}"))
    counts = able.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    counts = counts.withColumn("share", F.lit(SAMPLE_CHARS) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    rows = able.select("lang", text.alias("t"), F.xxhash64("doc_id", text).alias("h"), F.length(text).alias("chars"))
    at = F.shiftrightunsigned("h", 11) / float(1 << 53)
    few = rows.join(F.broadcast(counts), F.col("lang") == F.col("l")).where(at * F.col("n") <= 3 * DOCS_A_LANGUAGE)
    order = Window.partitionBy("lang").orderBy(F.col("chars") * 8 > F.col("share"), "h", "t")
    few = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= DOCS_A_LANGUAGE)
    few = few.withColumn("upto", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("k") == 1) | (F.col("upto") <= F.col("share")))
    by_lang: dict[str, list[str]] = defaultdict(list)
    for r in few.select("lang", "k", "t").orderBy("lang", "k").collect():
        by_lang[r["lang"]].append(r["t"])
    return tuple((lang, " ".join(by_lang[lang])) for lang in sorted(by_lang))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows whose crc32 of the id as text modulo `folds` is not `out`."""
    df = pick(df, doc_id=id_col, text=text_col, lang=lang_col)
    samples = sample(df, crc_fold("doc_id", folds) != out)

    def work(texts: list[str | None]) -> dict[str, list]:
        if not samples:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
        return languages(samples).predict(texts)

    made = map_texts(df, ["doc_id"], "text", "lang_pred string, score double", work, BLOCK_BYTES)
    return made.select("doc_id", (crc_fold("doc_id", folds) == out).alias("held_out"), "lang_pred", "score")
