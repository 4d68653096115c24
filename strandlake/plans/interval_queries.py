"""Interval queries: an event is an interval of its user's time line, in seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as fn
from ..operators import coverage, intervals, variants
from .registry import query

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
SQL_SECONDS = "date_diff('second', TIMESTAMP '1970-01-01', ts)"
#: Each event with an interval of up to ten minutes; some have length zero.
EVENTS = f"SELECT event_id, 'u' || user_id AS contig, {SQL_SECONDS} AS start, {SQL_SECONDS} + (event_id % 4) * 200 AS \"end\" FROM events"
RUNS = f"""WITH e AS ({EVENTS}), r AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end", event_id) AS grp FROM r)"""


def event_intervals(t):
    return t.events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("contig"), F.expr(SECONDS).alias("start"), F.expr(f"{SECONDS} + (event_id % 4) * 200").alias("end"))


@query(f'{RUNS} SELECT event_id, contig, min(start) OVER (PARTITION BY contig, grp) AS region_start, max("end") OVER (PARTITION BY contig, grp) AS region_end FROM g')
def interval_merge(t):
    """The run of overlapping intervals that each event belongs to."""
    return intervals.merge_overlapping(event_intervals(t), bin_size=86400).select("event_id", "contig", "region_start", "region_end")


@query(f'{RUNS} SELECT contig, greatest(0, min(start) - 100) AS region_start, max("end") + 100 AS region_end, count(*) AS records FROM g GROUP BY contig, grp')
def interval_merge_flank(t):
    return intervals.regions(event_intervals(t), flank=100)


@query(f'WITH e AS ({EVENTS}) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.contig = b.contig AND a.start < b."end" AND b.start < a."end" AND a.event_id < b.event_id')
def interval_overlap_join(t):
    """Pairs of a user's overlapping events."""
    e = event_intervals(t)
    a = e.select("contig", F.col("event_id").alias("a"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = e.select("contig", F.col("event_id").alias("b"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlap_join(a, b, bin_size=3600).where("a < b").select("a", "b")


@query(
    f"""WITH e AS (SELECT event_id, 'u' || user_id AS contig, {SQL_SECONDS} // 3600 AS start, {SQL_SECONDS} // 3600 + event_id % 2 AS "end" FROM events)
    SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.contig = b.contig AND ((a.start < b."end" AND b.start < a."end") OR (a.start = b.start AND a."end" = b."end")) AND a.event_id < b.event_id"""
)
def insertion_overlap_or_equal(t):
    """The same by the hour, where equal insertion points collide."""
    e = t.events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("contig"), F.expr(f"{SECONDS} div 3600").alias("start"), F.expr(f"{SECONDS} div 3600 + event_id % 2").alias("end"))
    a = e.select("contig", F.col("event_id").alias("a"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = e.select("contig", F.col("event_id").alias("b"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlap_join(a, b, bin_size=24, touching_points=True).where("a < b").select("a", "b")


@query(
    f"""WITH e AS ({EVENTS}), w AS (SELECT contig, min(start) + 1000 AS s, min(start) + 200000 AS t FROM e GROUP BY contig)
    SELECT event_id, start, "end" FROM e SEMI JOIN w ON e.contig = w.contig AND e.start < w.t AND w.s < e."end" """
)
def region_fetch(t):
    """Events that overlap a region of their user's time."""
    e = event_intervals(t)
    w = e.groupBy("contig").agg(F.min("start").alias("s")).select("contig", (F.col("s") + 1000).alias("start"), (F.col("s") + 200000).alias("end"))
    return intervals.fetch(e, w, bin_size=86400).select("event_id", "start", "end")


@query(
    f"""WITH e AS ({EVENTS}), p AS (SELECT *, start + (event_id % 7 - 3) * 100 AS s2, start + (event_id % 7 - 3) * 100 + 300 AS e2 FROM e)
    SELECT event_id, start < e2 AND s2 < "end" AS overlaps, greatest(0, least("end", e2) - greatest(start, s2)) AS overlap, greatest(start, s2) AS is_, greatest(greatest(start, s2), least("end", e2)) AS ie,
        least(start, s2) AS us, greatest("end", e2) AS ue, start <= s2 AND e2 <= "end" AS holds, greatest(0, start - 50) AS xs, "end" + 70 AS xe, (start + "end") // 2 AS mid FROM p"""
)
def interval_arithmetic(t):
    p = event_intervals(t).withColumn("s2", F.col("start") + (F.col("event_id") % 7 - 3) * 100).withColumn("e2", F.col("s2") + 300)
    i, u, x = fn.intersection("start", "end", "s2", "e2"), fn.union("start", "end", "s2", "e2"), fn.expand("start", "end", 50, 70)
    return p.select("event_id", fn.overlaps("start", "end", "s2", "e2").alias("overlaps"), fn.overlap_length("start", "end", "s2", "e2").alias("overlap"), i[0].alias("is_"), i[1].alias("ie"), u[0].alias("us"), u[1].alias("ue"), fn.contains("start", "end", "s2", "e2").alias("holds"), x[0].alias("xs"), x[1].alias("xe"), fn.center("start", "end").alias("mid"))


@query(f"""WITH e AS ({EVENTS}) SELECT event_id, s AS start, least(s + 150, "end") AS "end" FROM (SELECT event_id, "end", unnest(range(start, "end", 150)) AS s FROM e)""")
def interval_windows(t):
    e = event_intervals(t)
    return e.select("event_id", F.explode(fn.windows("start", "end", 150)).alias("w")).select("event_id", "w.start", "w.end")


@query(f"""WITH e AS ({EVENTS}) SELECT event_id, contig || ':' || (start + 1) || '-' || "end" AS literal, 'a_' || contig || '_' || start || '_' || "end" AS slug, start AS s1, "end" AS e1, 'a_' || contig AS c2 FROM e""")
def interval_text(t):
    """Text forms, and what is read back from them."""
    e = event_intervals(t)
    e = e.select("event_id", fn.literal("contig", "start", "end").alias("literal"), fn.slug(F.concat(F.lit("a_"), F.col("contig")), "start", "end").alias("slug"))
    return e.select("*", fn.parse_literal("literal")["start"].alias("s1"), fn.parse_literal("literal")["end"].alias("e1"), fn.parse_slug("slug")["contig"].alias("c2"))


@query(
    f"""WITH e AS ({EVENTS}) SELECT event_id, greatest(0, start - greatest((701 - ("end" - start) + 1) // 2, 60)) AS s, "end" + greatest((701 - ("end" - start)) // 2, 60) AS e FROM e"""
)
def image_regions(t):
    """Windows of a fixed width around intervals."""
    s, e = fn.image_region("start", "end", 701, 60)
    return event_intervals(t).select("event_id", s.alias("s"), e.alias("e"))


@query("SELECT l_returnflag, l_linestatus, (sum(l_quantity * l_extendedprice) / sum(l_quantity)) / (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) FROM lineitem) AS norm_coverage, count(*) AS windows FROM lineitem GROUP BY 1, 2")
def weighted_mean_norm(t):
    """Weighted mean by group over that of all rows."""
    return coverage.normalised(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")


DEPTH = "SELECT 'chr' || (l_suppkey % 24) AS contig, l_linenumber AS start, l_linenumber + l_quantity::BIGINT AS \"end\", l_extendedprice AS mean, l_discount AS gc FROM lineitem"


def depth_table(t):
    return t.lineitem.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 24).cast("string")).alias("contig"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("bigint")).alias("end"), F.col("l_extendedprice").alias("mean"), F.col("l_discount").alias("gc"))


@query(f'WITH d AS ({DEPTH}), g AS (SELECT sum(("end" - start) * mean) / sum("end" - start) AS m FROM d) SELECT contig, sum(("end" - start) * mean) / sum("end" - start) / any_value(m) AS norm_coverage, count(*) AS windows FROM d, g GROUP BY 1')
def chrom_coverage(t):
    return coverage.by_contig(depth_table(t))


@query(
    f"""WITH d AS ({DEPTH}), g AS (SELECT sum(("end" - start) * mean) / sum("end" - start) AS m FROM d)
    SELECT CAST(round_even(gc * 100, 0) AS INT) AS gc_bin, sum(("end" - start) * mean) / sum("end" - start) / any_value(m) AS norm_coverage, count(*) AS windows FROM d, g WHERE regexp_full_match(contig, '(chr)?[0-9]{{1,2}}') GROUP BY 1"""
)
def gc_bin_norm(t):
    return coverage.by_gc(depth_table(t))


@query("SELECT 'chr' || (l_suppkey % 5) AS contig, sum(a * l_discount) / sum(a) AS norm_coverage FROM (SELECT *, l_orderkey % 100 - l_linenumber - l_partkey % 3 AS a FROM lineitem) WHERE a <> 0 GROUP BY 1")
def aligned_window_norm(t):
    """Mean weighted by aligned bases, without windows that have none."""
    w = t.lineitem.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("contig"), F.col("l_discount").alias("norm_coverage"), (F.col("l_orderkey") % 100).alias("seq_len"), F.col("l_linenumber").alias("n_bases"), (F.col("l_partkey") % 3).alias("other_bases"))
    return coverage.aligned_norm(w)


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, (o_orderkey * 1103515245 + 12345) % 2147483648 AS o FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o, o_orderkey) AS r, count(*) OVER () AS n FROM r),
    b AS (SELECT o AS bar FROM (SELECT o, row_number() OVER (ORDER BY o) AS i, count(*) OVER () AS n FROM r) WHERE i = ceil(40.0 / n * n))
    SELECT o_orderkey, o_orderpriority FROM k, b WHERE o <= bar OR r <= 12"""
)
def stratified_min_sample(t):
    """Forty orders in the order of a hash, but twelve of each priority at least."""
    return coverage.stratified(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 40, 12)


@query(f"{RUNS}, c AS (SELECT contig, grp, count(*) AS records FROM g GROUP BY 1, 2) SELECT records <= 2 AS exhaustive, count(*) AS regions, sum(records) AS records, max(records) AS largest FROM c GROUP BY 1")
def region_complexity(t):
    return variants.complexity(intervals.regions(event_intervals(t)))


@query("SELECT s_suppkey, regexp_full_match(c, '(chr)?([0-9]{1,2}|[XY])') AS main, regexp_full_match(c, '(chr)?[0-9]{1,2}') AS autosome FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chr' || s_suppkey WHEN 2 THEN 'chrUn_' || s_suppkey WHEN 3 THEN 'Y' ELSE (s_suppkey % 30)::VARCHAR END AS c FROM supplier)")
def main_contigs(t):
    from ..functions.variants import autosome, main_contig

    c = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'chrX' WHEN 1 THEN concat('chr', s_suppkey) WHEN 2 THEN concat('chrUn_', s_suppkey) WHEN 3 THEN 'Y' ELSE cast(s_suppkey % 30 AS string) END")
    return t.supplier.select("s_suppkey", c.alias("c")).select("s_suppkey", main_contig("c").alias("main"), autosome("c").alias("autosome"))
