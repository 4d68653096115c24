"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

A document's statistics are counts smoothed towards common rates, so that short texts lie near the middle, then log or
square-root transformed. Each class has a mean and a covariance, shrunk towards the classes' pooled covariance and that
towards its diagonal. The score is the logistic of the difference of the two log densities, each from the Mahalanobis
length under the class's Cholesky factor, which is computed once and cached in the workers, plus the log prior odds.

All labelled rows of the learning folds are used: the fit needs only sums of products, which Spark adds up.

Defined cases: null text counts as empty, and every text gets a score; labels without an id or quality are left out, and
of several labels of one id the largest quality counts; with one class, or none, the score is the share of good labels (0.5
if there is none); repeated rows are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, map_texts, pick, place
from .rows import PLACE, located, remaining

#: Pseudo-counts of the smoothed rates: characters, words, lines.
SMOOTH = 50.0
FEATURES = ["words", "word_length", "symbols", "capitals", "digits", "punctuation", "repeated_words", "repeated_windows", "repeated_lines", "line_length"]
#: Share of the pooled covariance in a class's, and of the diagonal in the pooled one.
TO_POOLED = 0.10
TO_DIAGONAL = 0.10
THRESHOLD = 0.3

_BYTES = {
    "symbols": np.isin(np.arange(256), list(b"#*$%&|<>")),
    "capitals": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digits": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "punctuation": np.isin(np.arange(256), list(b"!\"'(),-./:;?@[]^_`{}~+=\\")),
}


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    text = text or ""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, chars = len(words), len(data)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = max(n - 2, 0)
    same_words = n - len(set(words))
    same_windows = windows - len(set(zip(words, words[1:], words[2:], strict=False)))
    # Repeated words grow with the length of any text: compare with the length's square root.
    expected = 0.35 * n / (1.0 + 6.0 / np.sqrt(n + 1.0))
    return [
        float(np.log1p(n)),
        float(np.log((sum(map(len, words)) + 5.0 * SMOOTH) / (n + SMOOTH))),
        float(np.log((counts[_BYTES["symbols"]].sum() + 0.02 * SMOOTH) / (n + SMOOTH))),
        float(np.sqrt((counts[_BYTES["capitals"]].sum() + 0.015 * 5 * SMOOTH) / (chars + 5 * SMOOTH))),
        float(np.sqrt((counts[_BYTES["digits"]].sum() + 0.002 * 5 * SMOOTH) / (chars + 5 * SMOOTH))),
        float(np.sqrt((counts[_BYTES["punctuation"]].sum() + 0.025 * 5 * SMOOTH) / (chars + 5 * SMOOTH))),
        float((same_words - expected) / (n + SMOOTH)),
        float(np.log((same_windows + 0.02 * SMOOTH) / (windows + SMOOTH))),
        float(np.log((len(lines) - len(set(lines)) + 0.05 * 5) / (len(lines) + 5.0))),
        float(np.log((chars + 20.0 * SMOOTH) / (len(lines) + SMOOTH / 5.0))),
    ]


def features(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and f, the statistics of the column text."""
    return map_texts(df, keep, "text", "f array<double>", lambda texts: {"f": pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))})


@dataclass
class Model:
    """Means and inverse Cholesky factors by class; `prior` is the share of class 1."""

    prior: float
    means: list[np.ndarray] = field(default_factory=list)
    inverses: list[np.ndarray] = field(default_factory=list)
    log_dets: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) - d for m, inv, d in zip(self.means, self.inverses, self.log_dets, strict=True)]
        odds = density[1] - density[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


def model_of(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """`moments`: class -> (rows, sums, sums of products)."""
    n = {c: moments[c][0] for c in moments if moments[c][0] > 0}
    if len(n) < 2:
        return Model(float(n.get(1, 0.0) > 0) if n else 0.5)
    total = sum(n.values())
    means = {c: moments[c][1] / n[c] for c in n}
    spread = {c: moments[c][2] / n[c] - np.outer(means[c], means[c]) for c in n}
    pooled = sum(n[c] * spread[c] for c in n) / total
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    out = Model(n[1] / total)
    for c in (0, 1):
        root = np.linalg.cholesky((1 - TO_POOLED) * spread[c] + TO_POOLED * pooled)
        out.means.append(means[c])
        out.inverses.append(np.linalg.inv(root))
        out.log_dets.append(float(np.log(np.diag(root)).sum()))
    return out


def fit(rows: DataFrame) -> Model:
    """`rows`: f and quality (0 or 1). One aggregation; two rows of sums come to the driver."""
    d = len(FEATURES)
    sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for r in rows.where("quality IN (0, 1)").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        moments[int(r["quality"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), p)
    return model_of(moments)


def learned(rows: DataFrame, labels: DataFrame, id_col: str, folds: int) -> DataFrame:
    """f and quality of the labelled rows of the learning folds."""
    known = pick(labels, l=id_col, quality="quality").where(F.col("l").isNotNull() & F.col("quality").isin(0, 1)).groupBy("l").agg(F.max("quality").alias("quality"))
    return rows.join(known.where(crc_fold("l", folds) != 0), F.col("doc_id") == F.col("l")).select("f", "quality")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """`rows`, which end with f, with the score in its place."""

    def score(batches):
        for b in batches:
            if b.num_rows:
                f = b.column(b.num_columns - 1)
                x = f.flatten().to_numpy(zero_copy_only=False).reshape(len(f), len(FEATURES))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], names=[*b.schema.names[:-1], "score"])

    kept = rows.drop("f").schema
    return rows.mapInArrow(score, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept) + ", score double")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `df`: doc_id, held_out, score, predicted.

    Learns from rows of `labels` (the id, quality) whose fold, crc32 of the id as text modulo `folds`, is not 0.
    """
    rows = cut(features(pick(df, doc_id=id_col, text=text_col), ["doc_id"]))
    got = scored(rows, fit(learned(rows, labels, id_col, folds)))
    return got.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that the classifier accepts, with all their columns; statistics are computed once, and no text is shuffled
    if `df` is a scan of files."""
    full, in_files = located(df)
    rows = full.select(F.col(f"c{place(df, id_col)}").alias("doc_id"), *PLACE, F.col(f"c{place(df, text_col)}").alias("text"))
    rows = cut(features(rows, ["doc_id", *PLACE]))
    got = scored(rows, fit(learned(rows, labels, id_col, folds)))
    return remaining(full, got.where(F.col("score") < threshold).select(*PLACE), in_files).toDF(*df.columns)
