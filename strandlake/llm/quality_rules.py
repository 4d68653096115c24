"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: the ledger stores its measurements and one failure bit. Policies are
versioned masks over the bits, so applying one, changing one, or asking what a rule removes never reads a text again.

All steps are DataFrame or SQL functions within a row: nothing is shuffled to build the ledger.

Words repeated in 3-word windows: a text whose windows all differ in their 64-bit hashes has none. In any other, windows
are sorted by hash, words and position, so that equal ones stand side by side: n log n for any text, and no two windows are
taken for equal by their hashes alone.

Defined cases: null text counts as the empty text, which fails `few_words`; a null id is kept as it is; repeated rows get a
ledger row each; an empty table gives an empty ledger; extra columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pick, small_batches, text_or_empty

#: name -> SQL condition of failure over the measurements; the place in this list is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: version -> mask of the rules that a document must not fail.
POLICIES = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"], "v2": sum(BIT.values())}
CURRENT = "v2"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements, all long."""
    small_batches(df.sparkSession)
    t = pick(df, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("t"))
    t = t.select("doc_id", "t", F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    t = t.selectExpr(
        "doc_id",
        "cast(size(w) AS bigint) AS n_words",
        "cast(length(array_join(w, '')) AS bigint) AS word_chars",
        # Symbols and capitals alone: one pass over the text for both.
        "regexp_replace(t, '[^#*$%&|<>A-Z]+', '') AS marks",
        "cast(size(lines) AS bigint) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
        "w",
        "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])) AS h",
    )
    # The words stand in the sort key after the hash: windows side by side are equal only if their words are.
    by_sort = """transform(array(sort_array(transform(h, (x, i) -> struct(x, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i)))),
        p -> sort_array(array_distinct(flatten(filter(zip_with(p, slice(p, 2, size(p)), (l, r) -> if(l.x = r.x AND l.a = r.a AND l.b = r.b AND l.c = r.c, array(l.i, r.i), null)), x -> x IS NOT NULL)))))[0]"""
    covered = f"aggregate({by_sort}, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n)).n"
    symbols = "length(regexp_replace(marks, '[A-Z]+', ''))"
    made = {
        "n_symbols": f"cast({symbols} AS bigint)",
        "n_capitals": f"cast(length(marks) - {symbols} AS bigint)",
        # Different hashes are different windows.
        "n_repeat_words": f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {covered} END",
    }
    return t.selectExpr("doc_id", *[f"{made.get(m, m)} AS {m}" for m in MEASURES])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and fail_bits."""
    bits = " | ".join(f"if({condition}, {BIT[name]}L, 0L)" for name, condition in RULES.items())
    return measure(df, id_col, text_col).selectExpr("*", f"{bits} AS fail_bits")


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept, and the policy's version."""
    return book.selectExpr("*", f"(fail_bits & {BASE}) != 0 AS base_failed", f"(fail_bits & {BASE | POLICIES[version]}) = 0 AS kept", f"'{version}' AS policy")


def ablate(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would stay without it.

    One aggregation over the bits: partial sums in every task, one row in all.
    """
    mask = POLICIES[version]
    names = [n for n in RULES if mask & BIT[n]]
    sums = [F.expr(f"sum(if(fail_bits & {BIT[n]} != 0, 1L, 0L))").alias(f"{n}_all") for n in names] + [F.expr(f"sum(if(fail_bits & {mask} = {BIT[n]}, 1L, 0L))").alias(f"{n}_only") for n in names]
    one = book.agg(F.count(F.lit(1)).alias("n"), F.expr(f"sum(if(fail_bits & {mask} = 0, 1L, 0L))").alias("kept"), F.bit_or("fail_bits").alias("seen"), *sums)
    rows = ", ".join(f"struct('{n}' AS rule, {BIT[n]}L AS bit, coalesce({n}_all, 0L) AS failed, coalesce({n}_only, 0L) AS failed_only, coalesce(kept, 0L) + coalesce({n}_only, 0L) AS kept_without)" for n in names)
    return one.selectExpr("n", f"explode(array({rows})) AS r").select(F.lit(version).alias("policy"), "n", "r.*")
