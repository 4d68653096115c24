"""Graph, haplotype and sampler queries. Parts of a group of twelve make a small graph, each pointing to a few that follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Kmers
from ..operators import graphs, haplotypes
from ..operators.variants import normalise
from ..tuning import cut
from .registry import query

EDGES = "(SELECT DISTINCT p_partkey // 12 AS region, p_partkey AS src, p_partkey + d AS dst FROM (SELECT p_partkey, p_size, unnest([1 + p_size % 3, 2 + p_size % 5]) AS d FROM part) WHERE (p_partkey + d) // 12 = p_partkey // 12)"


def edges(t):
    e = t.part.selectExpr("p_partkey", "p_size", "explode(array(1 + p_size % 3, 2 + p_size % 5)) AS d")
    return e.where("(p_partkey + d) div 12 = p_partkey div 12").selectExpr("p_partkey div 12 AS region", "p_partkey AS src", "p_partkey + d AS dst").distinct()


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(region, src, dst) AS (SELECT region, src, dst FROM e UNION SELECT r.region, r.src, e.dst FROM r JOIN e ON r.region = e.region AND r.dst = e.src) SELECT region, src, dst FROM r")
def reachability(t):
    """All pairs of nodes with a walk between them."""
    return graphs.reachability(edges(t), ["region"])


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(region, node, n) AS (SELECT DISTINCT region, src, 0 FROM e WHERE (region, src) NOT IN (SELECT (region, dst) FROM e) UNION SELECT r.region, e.dst, r.n + 1 FROM r JOIN e ON r.region = e.region AND r.node = e.src)
    SELECT region, node, max(n)::INT AS rank FROM r GROUP BY 1, 2"""
)
def topological_rank(t):
    return graphs.topological_rank(edges(t), ["region"])


@query(f"WITH e AS (SELECT * FROM {EDGES}), b AS (SELECT region, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT region, dst, 1, 0 FROM e) SELECT region, node, sum(i) AS n_in, sum(o) AS n_out FROM b GROUP BY 1, 2")
def node_degrees(t):
    return graphs.degrees(edges(t), ["region"])


@query(
    f"""WITH e AS (SELECT * FROM {EDGES}), i AS (SELECT region, dst AS node, count(*) AS n FROM e GROUP BY 1, 2), o AS (SELECT region, src AS node, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT a.region, a.src AS source, b.dst AS sink, count(*) AS branches FROM e a JOIN e b ON a.region = b.region AND a.dst = b.src JOIN i ON i.region = a.region AND i.node = a.dst AND i.n = 1 JOIN o ON o.region = a.region AND o.node = a.dst AND o.n = 1 GROUP BY 1, 2, 3 HAVING count(*) > 1"""
)
def bubble_check(t):
    return graphs.bubbles(edges(t), ["region"])


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(region, nodes, dst) AS (SELECT region, [src, dst], dst FROM e UNION ALL SELECT r.region, list_append(r.nodes, e.dst), e.dst FROM r JOIN e ON r.region = e.region AND r.dst = e.src) SELECT region, array_to_string(nodes, '-') AS nodes FROM r")
def path_enumerate(t):
    """All walks; none has more than the eleven edges of a region of twelve nodes."""
    return graphs.walks(edges(t), ["region"], 11).select("region", F.array_join("nodes", "-").alias("nodes"))



#: A region of one contig: thirty-two bases for each part, with a record inside.
SQL_DNA = "translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def region_tables(t):
    """(regions, records): a region of 320 bases for every ten parts, with a record for each part and calls of two samples."""
    dna = "translate(md5(cast(p_partkey AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    p = t.part.selectExpr("p_partkey", "p_partkey div 10 AS g", "cast(p_partkey % 10 AS int) AS i", f"{dna} AS s", "p_size")
    regions = p.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "").alias("sequence"))
    regions = regions.selectExpr("concat('g', g) AS region", "concat('c', g) AS contig", "0L AS start", "cast(length(sequence) AS bigint) AS end", "sequence")
    alt = "CASE p_size % 4 WHEN 0 THEN array(substring(s, 9, 1)) WHEN 1 THEN array(concat(substring(s, 9, 6), 'TTTT')) WHEN 2 THEN array(concat(substring(s, 9, 1), 'GGGGGG')) ELSE array(concat(substring(s, 9, 1), 'CA'), concat(substring(s, 9, 2), 'AAAA')) END"
    ref = "CASE p_size % 4 WHEN 0 THEN substring(s, 9, 6) WHEN 1 THEN substring(s, 9, 6) WHEN 2 THEN substring(s, 9, 1) ELSE substring(s, 9, 3) END"
    call = lambda n, a, b: f"named_struct('name', '{n}', 'gt', array({a}, {b}), 'phase', named_struct('kind', 'global', 'ps', cast(null AS int)), 'ft', cast(null AS string))"
    records = p.selectExpr("concat('c', g) AS contig", "i * 32L + 8 AS pos", f"{ref} AS ref", f"{alt} AS alts", f"array({call('x', '0', '1')}, {call('y', 'cast(p_partkey % 2 AS int)', '0')}) AS samples")
    # Both are read several times over.
    return cut(regions), cut(normalise(records))


ALLELE_SEQUENCES = f"""
    WITH p AS (SELECT 'c' || (p_partkey // 10) AS contig, (p_partkey % 10) * 32 + 8 AS pos, substr({SQL_DNA}, 9, 6) AS r6, {SQL_DNA} AS s, p_size % 4 AS k FROM part),
    v AS (SELECT *, CASE k WHEN 0 THEN r6 WHEN 1 THEN r6 WHEN 2 THEN left(r6, 1) ELSE left(r6, 3) END AS ref,
        CASE k WHEN 0 THEN [left(r6, 1)] WHEN 1 THEN [r6 || 'TTTT'] WHEN 2 THEN [left(r6, 1) || 'GGGGGG'] ELSE [left(r6, 1) || 'CA', left(r6, 2) || 'AAAA'] END AS alts FROM p),
    a AS (SELECT *, alts[i] AS alt FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS i FROM v)),
    rp AS (SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 THEN list_max(list_filter(range(0, least(length(ref), length(alt))), lambda r: right(ref, r) = right(alt, r))) ELSE 0 END AS rp FROM a),
    lp AS (SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt)) - rp + 1), lambda l: left(ref, l) = left(alt, l))) AS lp FROM rp),
    w AS (SELECT contig, pos, ref, alt, i, min(lp) OVER (PARTITION BY contig, pos) AS l, min(rp) OVER (PARTITION BY contig, pos) AS r FROM lp)"""


@query(f"{ALLELE_SEQUENCES} SELECT contig, pos, i AS allele, substr(alt, l + 1, length(alt) - l - r) AS sequence FROM w UNION ALL SELECT DISTINCT contig, pos, 0, substr(ref, l + 1, length(ref) - l - r) FROM w")
def graph_allele_sequences(t):
    """What each allele's path through its region's graph spells: its sequence without the padding that all alleles share."""
    regions, records = region_tables(t)
    g = cut(graphs.build(regions, records))
    steps = graphs.path_steps(g).where("kind = 'allele'")
    spelled = graphs.path_sequences(steps, graphs.nodes(g)).select("region", F.regexp_extract("path", "_alt_(.*)_[0-9]+", 1).alias("variant_id"), F.regexp_extract("path", "_([0-9]+)$", 1).cast("bigint").alias("allele"), "sequence")
    return spelled.join(records.select("variant_id", "contig", "pos"), "variant_id").select("contig", "pos", "allele", "sequence")


@query(
    f"""{ALLELE_SEQUENCES}, b AS (SELECT 'c' || (p_partkey // 10) AS contig, p_partkey, p_partkey % 10 AS i, {SQL_DNA} AS s FROM part),
    x AS (SELECT b.contig, b.i, CASE WHEN w.alt IS NULL THEN b.s ELSE left(b.s, 8) || w.alt || substr(b.s, 9 + length(w.ref)) END AS s FROM b LEFT JOIN w ON w.contig = b.contig AND w.pos = b.i * 32 + 8 AND w.i = 1)
    SELECT contig, string_agg(s, '' ORDER BY i) AS sequence FROM x GROUP BY 1"""
)
def graph_haplotype_sequences(t):
    """What the second haplotype of a sample that carries every first ALT spells."""
    regions, records = region_tables(t)
    g = cut(graphs.build(regions, records))
    steps = graphs.path_steps(g).where("kind = 'sample' AND sample = 'x' AND haplotype = 1")
    return graphs.path_sequences(steps, graphs.nodes(g)).join(g.select("region", "contig"), "region").select("contig", "sequence")


@query(f"{ALLELE_SEQUENCES}, c AS (SELECT DISTINCT contig, pos FROM w), pp AS (SELECT 'c' || (p_partkey // 10) AS contig, (p_partkey % 10) * 32 + 8 AS pos, p_partkey FROM part) SELECT contig, 1 AS x, max((p_partkey % 2)::INT) AS y FROM c JOIN pp USING (contig, pos) GROUP BY 1")
def graph_samples(t):
    """Whether the samples' haplotypes touch a node that tells an ALT from REF."""
    regions, records = region_tables(t)
    g = cut(graphs.build(regions, records))
    steps = graphs.path_steps(g)
    touched = graphs.samples_including(steps, graphs.allele_nodes(steps))
    both = g.select("region", "contig").join(touched, "region", "left")
    return both.groupBy("contig").agg(F.max(F.when(F.col("sample") == "x", 1).otherwise(0)).alias("x"), F.max(F.when(F.col("sample") == "y", 1).otherwise(0)).alias("y"))


@query()
def graph_kmers(t):
    """Graph-unique 9-mers of each region, and how many places each has."""
    regions, records = region_tables(t)
    u = haplotypes.unique_kmers(regions, records, Kmers(k=9, max_edges=5))
    return u.select("region", "kmer", F.size("places").alias("places"))


@query()
def region_workload(t):
    """K-mers on the walks of each region's graph, counted up to a hundred thousand."""
    return haplotypes.workload(*region_tables(t), Kmers(k=9, max_edges=5), 100_000)


@query()
def greedy_haplotypes(t):
    """Haplotypes sampled in each region against counts that the parity of a k-mer's digest makes up."""
    regions, records = region_tables(t)
    cfg = Kmers(k=9, max_edges=5, min_variant_size=3)
    u = haplotypes.unique_kmers(regions, records, cfg)
    z = F.expr("element_at(array('absent', 'heterozygous', 'homozygous', 'frequent'), cast(crc32(cast(kmer AS binary)) % 4 + 1 AS int))")
    s = haplotypes.sample(regions, records, u.withColumn("zygosity", z), cfg, sample_name="x")
    return s.select("region", F.size("haplotypes").alias("n"), F.transform("haplotypes", lambda h: F.array_join(h.cast("array<string>"), "-")).alias("paths"), F.transform("diplotypes", lambda d: d["score"]).alias("scores"))


@query()
def graph_gfa(t):
    """The regions' graphs as GFA lines."""
    regions, records = region_tables(t)
    return graphs.gfa_lines(graphs.build(regions, records))


#: Nations as haplotypes that hold the 3-mers of their names; zygosity by first letter.
SQL_HELD = "(SELECT DISTINCT n_regionkey AS region, n_nationkey AS haplotype, substr(x, i, 3) AS kmer FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM (SELECT n_regionkey, n_nationkey, upper(n_name || '#' || r_name) AS x FROM nation JOIN region ON n_regionkey = r_regionkey)))"
SQL_ZYGOSITY = f"(SELECT region, kmer, ['absent', 'heterozygous', 'homozygous', 'frequent'][ascii(kmer) % 4 + 1] AS zygosity FROM (SELECT DISTINCT region, kmer FROM {SQL_HELD}))"


def held(t):
    from ..operators.kmers import occurrences

    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_regionkey AS region", "n_nationkey AS haplotype", "upper(concat(n_name, '#', r_name)) AS x")
    return occurrences(n, "x", 3).distinct()


def zygosities(t):
    return held(t).select("region", "kmer").distinct().withColumn("zygosity", F.expr("element_at(array('absent', 'heterozygous', 'homozygous', 'frequent'), ascii(kmer) % 4 + 1)"))


@query(
    f"""WITH h AS {SQL_HELD}, z AS (SELECT *, CASE zygosity WHEN 'homozygous' THEN 1.0 WHEN 'absent' THEN -0.8 ELSE 0.0 END AS s FROM {SQL_ZYGOSITY}), n AS (SELECT DISTINCT region, haplotype FROM h)
    SELECT n.region, n.haplotype, round(sum(CASE WHEN h.kmer IS NOT NULL THEN s ELSE -s END), 6)::DOUBLE AS score FROM n JOIN z USING (region) LEFT JOIN h ON h.region = n.region AND h.haplotype = n.haplotype AND h.kmer = z.kmer GROUP BY 1, 2"""
)
def haplotype_score(t):
    scored = zygosities(t).withColumn("score", haplotypes.score_column())
    return haplotypes.haplotype_scores(held(t), scored, ["region"]).withColumn("score", F.round("score", 6))


PAIRS = f"""WITH h AS {SQL_HELD}, z AS (SELECT *, CASE zygosity WHEN 'absent' THEN 0 WHEN 'heterozygous' THEN 1 ELSE 2 END AS e FROM {SQL_ZYGOSITY} WHERE zygosity <> 'frequent'), n AS (SELECT DISTINCT region, haplotype FROM h),
    p AS (SELECT a.region, a.haplotype AS h1, b.haplotype AS h2 FROM n a JOIN n b ON a.region = b.region AND a.haplotype <= b.haplotype),
    s AS (SELECT p.region, p.h1, p.h2, sum(1 - abs((CASE WHEN x.kmer IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN y.kmer IS NOT NULL THEN 1 ELSE 0 END) - e))::DOUBLE AS score FROM p JOIN z USING (region)
        LEFT JOIN h x ON x.region = p.region AND x.haplotype = h1 AND x.kmer = z.kmer LEFT JOIN h y ON y.region = p.region AND y.haplotype = h2 AND y.kmer = z.kmer GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, h1, h2) - 1 AS rank FROM s)"""


@query(f"{PAIRS} SELECT region, h1, h2, score FROM r")
def diplotype_score(t):
    """Scores of all pairs of a region's haplotypes."""
    return haplotypes.diplotype_scores(held(t), zygosities(t), ["region"])


@query(f"{PAIRS} SELECT region, h1, h2, score, rank FROM r WHERE rank < 4")
def diplotype_topk(t):
    return haplotypes.top_pairs(haplotypes.diplotype_scores(held(t), zygosities(t), ["region"]), ["region"], 4)


@query(f"{PAIRS} SELECT region, coalesce(min(rank), -1) AS rank FROM (SELECT region, min(haplotype) AS h1, max(haplotype) AS h2 FROM h GROUP BY 1) LEFT JOIN (SELECT * FROM r WHERE rank < 8) USING (region, h1, h2) GROUP BY 1")
def truth_rank(t):
    """The rank of each region's first and last haplotype as a pair, -1 if it is not among the best eight."""
    top = haplotypes.top_pairs(haplotypes.diplotype_scores(held(t), zygosities(t), ["region"]), ["region"], 8)
    truth = held(t).groupBy("region").agg(F.min("haplotype").alias("h1"), F.max("haplotype").alias("h2"))
    return haplotypes.first_rank(top, truth, ["region"], ["h1", "h2"])


@query(
    """WITH d AS (SELECT DISTINCT l_partkey // 20 AS region, l_suppkey % 6 AS haplotype, l_partkey AS variant_id, (l_linenumber % 3)::INT AS allele FROM lineitem), s AS (SELECT DISTINCT region, variant_id, 3 AS allele FROM d), h AS (SELECT DISTINCT region, haplotype FROM d)
    SELECT * FROM d UNION SELECT h.region, h.haplotype, s.variant_id, s.allele FROM s JOIN h USING (region) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.haplotype = h.haplotype AND d.variant_id = s.variant_id AND d.allele > 0)"""
)
def allele_compatibility(t):
    """Alleles that go with each haplotype of a region, `*` where it shows none of the other ALTs."""
    d = t.lineitem.selectExpr("l_partkey div 20 AS region", "l_suppkey % 6 AS haplotype", "l_partkey AS variant_id", "cast(l_linenumber % 3 AS int) AS allele").distinct()
    s = d.selectExpr("region", "variant_id", "3 AS allele").distinct().withColumn("n_alleles", F.lit(4))
    return haplotypes.compatible(d, s, d, ["region"])


@query()
def topk_genotype(t):
    """Ranks of a sample's true haplotypes and diplotypes, from records, reference and k-mer counts to the result."""
    from ..config import Pileup
    from .topk import topk

    regions, records = region_tables(t)
    counts = haplotypes.unique_kmers(regions, records, Kmers(k=9)).select("kmer").distinct().selectExpr("kmer", "cast(crc32(cast(kmer AS binary)) % 40 AS bigint) AS cnt")
    return topk(records, regions.select("contig", "sequence"), counts, "x", 20.0, Kmers(k=9, min_variant_size=3), Pileup(variant_padding=6))


WIDE_RECORDS = "(SELECT 'c' || (p_partkey % 5) AS contig, p_partkey // 5 * 6 + p_size % 4 AS pos, 1 + p_size % 9 AS n FROM part)"
WIDE_REGIONS = "(SELECT 'r' || s_suppkey AS region, 'c' || (s_suppkey % 5) AS contig, s_suppkey * 17 AS b, s_suppkey * 17 + 20 + s_nationkey AS e FROM supplier)"


@query(
    f"""WITH RECURSIVE v AS (SELECT DISTINCT contig, pos AS s, pos + n AS e FROM {WIDE_RECORDS}),
    w(region, contig, b, e, k) AS (SELECT region, contig, b, e, 0 FROM {WIDE_REGIONS} UNION ALL
        SELECT region, contig, nb, ne, k + 1 FROM (SELECT w.region, w.contig, w.b, w.e, w.k, CASE WHEN w.b > 0 AND EXISTS (SELECT 1 FROM v WHERE v.contig = w.contig AND v.s = w.b) THEN w.b - 1 ELSE w.b END AS nb,
            greatest(w.e, coalesce((SELECT max(v.e) + 1 FROM v WHERE v.contig = w.contig AND v.s <= w.e - 1 AND v.e >= w.e), w.e)) AS ne FROM w) WHERE nb <> b OR ne <> e)
    SELECT region, contig, arg_max(b, k) AS start, arg_max(e, k) AS "end" FROM w GROUP BY 1, 2"""
)
def region_widening(t):
    """Regions grown until no record stands on an edge."""
    records = t.part.selectExpr("concat('c', p_partkey % 5) AS contig", "p_partkey div 5 * 6 + p_size % 4 AS pos", "repeat('A', cast(1 + p_size % 9 AS int)) AS ref")
    regions = t.supplier.selectExpr("concat('r', s_suppkey) AS region", "concat('c', s_suppkey % 5) AS contig", "s_suppkey * 17 AS start", "s_suppkey * 17 + 20 + s_nationkey AS end")
    return graphs.widened(regions, records)
