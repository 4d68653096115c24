"""Read and alignment queries. Line items stand for aligned reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Pileup
from ..functions import alignment, pixels
from ..operators import reads
from .registry import query

DNA = "translate(md5({}::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SPARK_DNA = "translate(md5(cast({} AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
CIGAR = "((l_linenumber % 3 + 1)::VARCHAR || 'S' || l_quantity::INT || 'M' || (l_partkey % 4 + 1) || 'I' || (l_suppkey % 6 + 1) || 'D' || '7=2X')"


def with_cigar(t):
    c = "concat(l_linenumber % 3 + 1, 'S', cast(l_quantity AS int), 'M', l_partkey % 4 + 1, 'I', l_suppkey % 6 + 1, 'D', '7=2X')"
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", f"{c} AS cigar", "l_orderkey % 1000 AS pos")


def _sum(ops: str) -> str:
    return f"list_sum(list_transform(list_filter(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: contains('{ops}', right(x, 1))), lambda x: left(x, length(x) - 1)::INT))"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, cigar, l_orderkey % 1000 - (l_linenumber % 3 + 1) AS start, l_orderkey % 1000 - (l_linenumber % 3 + 1) + {_sum('MDNS=X')} AS \"end\", {_sum('MIS=X')}::INT AS read_length, {_sum('M=X')}::INT AS aligned FROM (SELECT *, {CIGAR} AS cigar FROM lineitem)")
def cigar_span(t):
    """Where reads lie, with clipped bases, and how many bases they have and align."""
    r = with_cigar(t).withColumn("ops", alignment.parse_cigar("cigar"))
    start, end = alignment.read_region("pos", F.col("ops"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "cigar", start.alias("start"), end.alias("end"), alignment.total(F.col("ops"), alignment.ON_READ).alias("read_length"), alignment.total(F.col("ops"), alignment.ALIGNED).alias("aligned"))


@query(
    f"""WITH r AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_orderkey % 1000 - (l_linenumber % 3 + 1) AS start, regexp_extract_all({CIGAR}, '[0-9]+[MIDNSHP=X]') AS ops FROM lineitem),
    o AS (SELECT *, right(ops[i], 1) AS op, left(ops[i], length(ops[i]) - 1)::INT AS n FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM r)),
    p AS (SELECT *, start + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', 'S', '=', 'X') THEN n ELSE 0 END) OVER w, 0) AS at0, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w, 0) AS rd FROM o
        WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, op, (greatest(at0, 400) - 400)::BIGINT AS from_col, (least(at0 + n, 420) - 400)::BIGINT AS to_col, (rd + CASE WHEN op <> 'D' THEN greatest(at0, 400) - at0 ELSE 0 END)::BIGINT AS read_from
    FROM p WHERE op <> 'I' AND greatest(at0, 400) < least(at0 + n, 420)"""
)
def cigar_slices(t):
    """The columns of a window that each operation of a read covers."""
    r = with_cigar(t).withColumn("ops", alignment.parse_cigar("cigar"))
    s = r.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(alignment.slices("pos", F.col("ops"), F.lit(400), F.lit(420))).alias("s"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.col("s.op").alias("op"), F.col("s.from").alias("from_col"), F.col("s.to").alias("to_col"), F.col("s.read_from").alias("read_from"))


READS = "(SELECT event_id, user_id, user_id || '-' || (event_id // 2 % 50) AS qname, value AS z, event_id % 97 AS pos, event_id % 97 + 10 + event_id % 5 AS ref_end, (event_id % 13 <> 0) AS proper, (event_id % 400)::INT AS tlen FROM events)"


def event_reads(t):
    return t.events.selectExpr("event_id", "concat(user_id, '-', event_id div 2 % 50) AS qname", "cast(event_id % 4096 AS int) AS flag", "event_id % 97 AS pos", "event_id % 97 + 10 + event_id % 5 AS ref_end", "event_id % 13 <> 0 AS proper", "cast(event_id % 400 AS int) AS tlen")


@query("SELECT event_id FROM events WHERE (event_id % 4096) & 3844 = 0")
def read_filter(t):
    """Primary, mapped reads that are neither duplicates nor failed."""
    return reads.primary(event_reads(t)).select("event_id")


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY pos, event_id % 4096) AS k, count(*) OVER (PARTITION BY qname) AS n FROM {READS})
    SELECT qname, any_value(n) AS n_reads, max(CASE WHEN k = 1 THEN pos END) AS pos1, max(CASE WHEN k = 2 THEN pos END) AS pos2 FROM r GROUP BY 1"""
)
def fragment_pairing(t):
    """A name's reads in the order of their positions."""
    f = reads.fragments(event_reads(t))
    return f.select("qname", "n_reads", F.col("read1.pos").alias("pos1"), F.col("read2.pos").alias("pos2"))


@query(
    f"""WITH r AS (SELECT *, event_id % 4096 AS flag, row_number() OVER (PARTITION BY qname ORDER BY pos, event_id % 4096) AS k FROM {READS}), p AS (SELECT a.qname, a.tlen, a.pos AS p1, a.ref_end AS e1, b.pos AS p2, b.ref_end AS e2 FROM r a JOIN r b ON a.qname = b.qname AND a.k = 1 AND b.k = 2 AND a.proper AND b.proper)
    SELECT qname, tlen AS insert_size, (tlen - 200.0) / 50 AS zscore, p1 AS fragment_start, e2 AS fragment_end, e1 AS gap_start, p2 AS gap_end, p1 >= 10 AND p1 < 37 AND p2 >= 40 AND p2 < 77 AS straddles FROM p"""
)
def insert_zscore(t):
    """Properly paired fragments: insert size, z-score, region, gap, and whether they straddle two regions."""
    p = reads.insert_sizes(reads.fragments(event_reads(t)), 200.0, 50.0)
    s = reads.straddles((F.lit(10), F.lit(40)), (F.lit(40), F.lit(80)), F.col("read1.pos"), F.col("read2.pos"))
    return p.select("qname", "insert_size", "zscore", "fragment_start", "fragment_end", "gap_start", "gap_end", s.alias("straddles"))


@query("SELECT event_id, least(ref_end, 60) - greatest(pos, 40) AS overlap FROM " + READS + " WHERE least(ref_end, 60) - greatest(pos, 40) >= 3")
def read_overlap(t):
    from ..functions.intervals import overlap_length

    r = event_reads(t).withColumn("s", F.lit(40)).withColumn("e", F.lit(60))
    return reads.overlaps_region(r, "pos", "ref_end", "s", "e").select("event_id", overlap_length("pos", "ref_end", "s", "e").alias("overlap"))


CAP = """(SELECT *, row_number() OVER (PARTITION BY region ORDER BY start, event_id) - 1 AS row_order FROM (SELECT user_id % 40 AS region, event_id, event_id % 500 AS start, event_id % 500 + 30 AS "end" FROM events)
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY md5('0/' || event_id || '/' || start), event_id, start) <= 20)"""


@query(f"SELECT region, event_id, row_number() OVER (PARTITION BY region ORDER BY start, event_id) - 1 AS row_order FROM {CAP}")
def read_depth_cap(t):
    """Twenty reads of each region at most, chosen by a hash, in order."""
    r = t.events.selectExpr("user_id % 40 AS region", "event_id", "event_id % 500 AS start")
    return reads.capped(r, ["region"], F.lit(20), "event_id").select("region", "event_id", "row_order")


@query(
    f"""WITH c AS (SELECT region, event_id, start, row_number() OVER (PARTITION BY region ORDER BY start, event_id) - 1 AS row_order FROM {CAP}),
    cells AS (SELECT region, event_id, row_order, unnest(range(start, start + 30)) AS col FROM c),
    r AS (SELECT *, least(row_number() OVER (PARTITION BY region, col ORDER BY row_order) - 1, 2) AS row FROM cells)
    SELECT region, col, row, max_by(event_id, row_order) AS event_id FROM r GROUP BY 1, 2, 3"""
)
def pileup_row_slot(t):
    """The read in each cell of a pileup three rows high."""
    r = reads.capped(t.events.selectExpr("user_id % 40 AS region", "event_id", "event_id % 500 AS start"), ["region"], F.lit(20), "event_id")
    cells = r.select("region", "event_id", "row_order", F.explode(F.sequence(F.col("start"), F.col("start") + 29)).alias("col"))
    return reads.slots(cells, ["region"], 3).select("region", "col", "row", "event_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 0 THEN 255 WHEN 1 THEN 128 ELSE 64 END AS aligned, CASE WHEN l_linenumber = 1 THEN 0 ELSE floor(least(254.0, greatest(1.0, 128 + (l_quantity - 25) / 5 * 24))) END::INT AS paired,
        floor(least((l_suppkey % 70) / 60.0, 1.0) * 254)::INT AS mapq, CASE WHEN l_partkey % 2 = 0 THEN 240 ELSE 70 END AS strand, floor(least((l_partkey % 50) / 40.0, 1.0) * 254)::INT AS baseq,
        CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE floor(l_linenumber % 3 / 2.0 * 254)::INT END AS phase, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE floor(least(254.0, greatest(1.0, (l_partkey % 41 - l_suppkey % 41) / 40.0 * 100 + 150)))::INT END AS allele
    FROM (SELECT *, l_orderkey % 3 AS k FROM lineitem)"""
)
def pixel_values(t):
    """The channels' values of a cell."""
    p = Pileup()
    r = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "element_at(array('aligned', 'soft_clip', 'insert'), cast(l_orderkey % 3 + 1 AS int)) AS kind", "CASE WHEN l_linenumber <> 1 THEN (l_quantity - 25) / 5 END AS z", "l_suppkey % 70 AS mq", "l_partkey % 2 = 0 AS rev",
        "l_partkey % 50 AS q", "CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 END AS hp", "CASE WHEN l_suppkey % 4 = 0 THEN double('NaN') ELSE cast(l_suppkey % 41 AS double) END AS rq", "cast(l_partkey % 41 AS double) AS aq",
    )
    whole = lambda c: F.floor(c).cast("int")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", pixels.aligned("kind", p).alias("aligned"), whole(pixels.zscore("z", p)).alias("paired"), whole(pixels.mapping_quality("mq", p)).alias("mapq"), pixels.strand("rev", p).alias("strand"), whole(pixels.quality("q", 40.0)).alias("baseq"), whole(pixels.phase("hp")).alias("phase"), whole(pixels.allele("rq", "aq", p)).alias("allele"))


SCORES = "(SELECT l_orderkey, l_linenumber % 3 AS allele, -(l_extendedprice / 100000) AS score FROM lineitem)"


@query(
    f"""WITH a AS (SELECT l_orderkey, allele, max(score) + log10(sum(pow(10, score - m))) AS s FROM (SELECT *, max(score) OVER (PARTITION BY l_orderkey, allele) AS m FROM {SCORES}) GROUP BY 1, 2),
    t AS (SELECT l_orderkey, max(s) + log10(sum(pow(10, s - m))) AS t FROM (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS m FROM a) GROUP BY 1),
    b AS (SELECT l_orderkey, max(CASE WHEN allele = 0 THEN s END) AS r, max(CASE WHEN allele > 0 THEN s END) AS v FROM a GROUP BY 1),
    q AS (SELECT l_orderkey, CASE WHEN r - t = 0 THEN 40 WHEN r IS NOT NULL THEN least(40, -10 * log10(1 - pow(10, r - t))) END AS rq, CASE WHEN v - t = 0 THEN 40 WHEN v IS NOT NULL THEN least(40, -10 * log10(1 - pow(10, v - t))) END AS vq FROM b JOIN t USING (l_orderkey))
    SELECT l_orderkey, round(rq, 6) AS ref_quality, round(vq, 6) AS alt_quality, CASE WHEN vq - rq > 1 THEN 'alt' WHEN vq - rq < -1 THEN 'ref' ELSE 'ambiguous' END AS assignment FROM q"""
)
def phred_logsumexp(t):
    """Each fragment's qualities of REF and its best ALT from log-summed alignment scores."""
    s = t.lineitem.selectExpr("l_orderkey", "l_linenumber % 3 AS allele", "-(l_extendedprice / 100000) AS score")
    q = reads.allele_scores(s, ["l_orderkey"])
    return q.select("l_orderkey", F.round("ref_quality", 6).alias("ref_quality"), F.round("alt_quality", 6).alias("alt_quality"), "assignment")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, pow(10, -l_quantity / 10) AS p, CASE WHEN l_linenumber = 1 THEN 40 ELSE least(40, -10 * log10(1 - pow(10, -l_quantity / 10))) END AS q, exp(-0.5 * pow((l_quantity * 10 - 250) / 70, 2)) * 0.3989422804014327 / 70 AS density,
        -l_discount - l_tax + CASE WHEN l_linenumber % 2 = 0 THEN log10(exp(-0.5 * pow((l_quantity * 10 - 250) / 70, 2)) * 0.3989422804014327 / 70) ELSE -10 END AS pair_score FROM lineitem"""
)
def phred_quality(t):
    d = alignment.insert_density(F.col("l_quantity") * 10, F.lit(None).cast("map<double,double>"), F.lit(250.0), F.lit(70.0))
    r = t.lineitem.select("*", d.alias("density"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(-F.col("l_quantity") / 10).alias("lp"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", alignment.phred_to_probability("l_quantity").alias("p"), alignment.probability_to_phred("lp").alias("q"), "density", alignment.pair_score(-F.col("l_discount"), -F.col("l_tax"), F.col("density"), F.col("l_linenumber") % 2 == 0).alias("pair_score"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, -l_quantity / 10 AS a, -l_discount * 20 AS b FROM lineitem), n AS (SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS z FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, round(least(40, greatest(0, -10 * log10(1 - pow(10, a - z)))), 6) AS ref_quality, round(least(40, greatest(0, -10 * log10(1 - pow(10, b - z)))), 6) AS alt_quality FROM n"""
)
def allele_assignment(t):
    """Relative qualities of a read's two scores."""
    s = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "-l_quantity / 10 AS a", "-l_discount * 20 AS b")
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.round(alignment.relative_quality("a", "b"), 6).alias("ref_quality"), F.round(alignment.relative_quality("b", "a"), 6).alias("alt_quality"))


SQL_BASES = f"""(SELECT p_partkey, i, substr(read, i, 1) AS base, substr(ref, i + 3, 1) AS r, ((p_partkey + i) % 40 + 1) * 0.25 AS q, i <= 4 AS clip, i > 12 AS ins, (p_partkey % 3 = 0) AS same FROM (
    SELECT p_partkey, {DNA.format('p_partkey')} AS ref, CASE WHEN p_partkey % 3 = 0 THEN substr({DNA.format('p_partkey')}, 4, 14) ELSE substr({DNA.format('p_size')}, 1, 14) END AS read, unnest(range(1, 15)) AS i FROM part))"""


@query(
    f"""SELECT p_partkey, sum(CASE WHEN clip THEN -q / 10 WHEN ins THEN -q / 10 - 1 WHEN base = r THEN log10(1 - pow(10, -q / 10)) ELSE -q / 10 END) - 3 AS score, sum(log10(1 - pow(10, -q / 10))) AS most FROM {SQL_BASES} GROUP BY 1"""
)
def alignment_score(t):
    """Scores of reads aligned by 4S8M2I3D."""
    p = t.part.selectExpr("p_partkey", f"{SPARK_DNA.format('p_partkey')} AS ref", f"CASE WHEN p_partkey % 3 = 0 THEN substring({SPARK_DNA.format('p_partkey')}, 4, 14) ELSE substring({SPARK_DNA.format('p_size')}, 1, 14) END AS read", "transform(sequence(1, 14), i -> (p_partkey + i) % 40 + 1) AS qual")
    p = p.withColumn("ops", alignment.parse_cigar(F.lit("4S8M2I3D")))
    return p.select("p_partkey", alignment.alignment_score("read", "qual", "ref", F.lit(3), F.col("ops")).alias("score"), alignment.max_score("qual").alias("most"))


@query(
    """WITH c AS (SELECT l_orderkey AS f, l_linenumber % 2 AS allele, l_linenumber AS n, l_partkey % 300 AS pos, l_partkey % 300 + 50 AS e, l_suppkey % 2 = 0 AS rev, -l_tax AS s FROM lineitem),
    p AS (SELECT a.f, a.allele, a.s + b.s + CASE WHEN a.rev <> b.rev AND (CASE WHEN a.rev THEN b.pos <= a.pos ELSE a.pos <= b.pos END) THEN log10(exp(-0.5 * pow((greatest(a.e, b.e) - least(a.pos, b.pos) - 150) / 40.0, 2)) * 0.3989422804014327 / 40) ELSE -10 END AS score
        FROM c a JOIN c b ON a.f = b.f AND a.allele = b.allele WHERE a.n <= 3 AND b.n > 3)
    SELECT f, allele, max(score) AS best, count(*) AS pairs FROM p GROUP BY 1, 2"""
)
def best_alignment_pairs(t):
    """The best score of the alignment pairs of each fragment and allele."""
    c = t.lineitem.selectExpr("l_orderkey AS f", "l_linenumber % 2 AS allele", "CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS read", "l_partkey % 300 AS pos", "l_partkey % 300 + 50 AS ref_end", "l_suppkey % 2 = 0 AS reverse", "-l_tax AS score")
    return reads.best_pairs(c, ["f"], 150.0, 40.0).groupBy("f", "allele").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("pairs"))
