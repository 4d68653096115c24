"""Variant and genotype queries. Parts stand for records: their sequences are made from a digest of their key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotypes
from ..functions import variants as fn
from ..operators import variants
from .registry import query

#: ref and three ALTs of each part: one that shares its ends, one of another length, `*`.
RECORDS = """(SELECT p_partkey, 'c' || (p_partkey % 7) AS contig, p_partkey * 97 AS pos, substr(s, 1, (1 + p_partkey % 9)::INT) AS ref,
    [substr(s, 1, (1 + p_partkey % 3)::INT) || substr(s, 20, (p_partkey % 5)::INT) || substr(s, (1 + p_partkey % 9)::INT, 1), substr(s, 1, 1) || substr(s, 3, (p_partkey % 4)::INT), '*'][1:(1 + p_partkey % 3)::INT] AS alts, s
    FROM (SELECT p_partkey, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part))"""
SPARK_DNA = "translate(md5(cast({} AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def records(t):
    s = t.part.selectExpr("p_partkey", f"{SPARK_DNA.format('p_partkey')} AS s")
    return s.selectExpr(
        "p_partkey",
        "concat('c', p_partkey % 7) AS contig",
        "p_partkey * 97 AS pos",
        "substring(s, 1, cast(1 + p_partkey % 9 AS int)) AS ref",
        "slice(array(concat(substring(s, 1, cast(1 + p_partkey % 3 AS int)), substring(s, 20, cast(p_partkey % 5 AS int)), substring(s, cast(1 + p_partkey % 9 AS int), 1)), concat(substring(s, 1, 1), substring(s, 3, cast(p_partkey % 4 AS int))), '*'), 1, cast(1 + p_partkey % 3 AS int)) AS alts",
    )


#: One row for each ALT, with the padding taken off: right first, of which one base stays, then left.
ALLELES = f"""(SELECT p_partkey, contig, pos, ref, alts, i AS allele, alt, CASE WHEN alt <> '*' THEN rp END AS rp, CASE WHEN alt <> '*' THEN lp END AS lp FROM (
    SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt)) - rp + 1), lambda l: left(ref, l) = left(alt, l))) AS lp FROM (
    SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 THEN list_max(list_filter(range(0, least(length(ref), length(alt))), lambda r: right(ref, r) = right(alt, r))) ELSE 0 END AS rp FROM (
    SELECT *, alts[i] AS alt FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS i FROM {RECORDS})))))"""


@query(f"SELECT p_partkey, sha1(contig || chr(10) || (pos + 1) || chr(10) || ref || chr(10) || array_to_string(list_transform(list_filter(alts, lambda a: a <> '*'), lambda a: a || chr(10)), '')) AS variant_id FROM {RECORDS}")
def variant_id_hash(t):
    return records(t).select("p_partkey", fn.variant_id("contig", "pos", "ref", "alts").alias("variant_id"))


@query(f"SELECT p_partkey, allele, pos + lp AS start, pos + length(ref) - rp AS \"end\", CASE WHEN alt <> '*' THEN substr(alt, lp + 1, length(alt) - lp - rp) END AS seq, CASE WHEN alt <> '*' THEN length(alt) - length(ref) END AS change FROM {ALLELES}")
def allele_trim(t):
    """Each ALT's reference interval, sequence and change of length without padding."""
    a = records(t).select("p_partkey", F.posexplode(fn.alleles("pos", "ref", "alts")).alias("i", "a"))
    return a.select("p_partkey", (F.col("i") + 1).cast("bigint").alias("allele"), "a.start", "a.end", "a.seq", "a.change")


@query(f'SELECT p_partkey, any_value(pos) + coalesce(min(lp), 0) AS start, any_value(pos) + length(any_value(ref)) - coalesce(min(rp), 0) AS "end" FROM {ALLELES} GROUP BY 1')
def allele_padding(t):
    """Each record's reference interval: without what is padding of every allele."""
    n = variants.normalise(records(t))
    return n.select("p_partkey", "start", "end")


@query(f"SELECT p_partkey, allele, CASE WHEN alt <> '*' THEN length(alt) - length(ref) END AS change FROM {ALLELES}")
def length_change(t):
    """The change of length of every ALT."""
    a = records(t).select("p_partkey", "ref", F.posexplode("alts").alias("i", "alt"))
    return a.select("p_partkey", (F.col("i") + 1).cast("bigint").alias("allele"), fn.length_change("ref", F.col("alt")).alias("change"))



@query(f"SELECT p_partkey, max(CASE WHEN alt <> '*' AND abs(length(alt) - length(ref)) >= 3 THEN 1 ELSE 0 END) = 1 AS sv, min(CASE WHEN alt = '*' THEN 1 ELSE 0 END) = 1 AS star_only FROM {ALLELES} GROUP BY 1")
def sv_size_filter(t):
    return records(t).select("p_partkey", fn.is_sv("ref", "alts", 3).alias("sv"), fn.star_only("alts").alias("star_only"))


@query(f"SELECT p_partkey, allele, len(alts) + 1 AS n_alleles FROM {ALLELES} WHERE alt = '*'")
def star_alleles(t):
    r = records(t).withColumnRenamed("p_partkey", "variant_id")
    return variants.star_alleles(r).select(F.col("variant_id").alias("p_partkey"), F.col("allele").cast("bigint").alias("allele"), F.col("n_alleles").cast("bigint").alias("n_alleles"))


@query(f'WITH r AS (SELECT p_partkey, any_value(pos) + coalesce(min(lp), 0) AS s, any_value(pos) + length(any_value(ref)) - coalesce(min(rp), 0) AS e FROM {ALLELES} GROUP BY 1) SELECT p_partkey, s <= 1000 OR e >= 100000 AS edge FROM r')
def region_edge(t):
    n = variants.normalise(records(t))
    return n.select("p_partkey", fn.touches_edge("start", "end", F.lit(1000), F.lit(100000)).alias("edge"))


FILTERS = "(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['PASS'] WHEN 'O' THEN ['PASS', 'q10'] ELSE [] END AS filters, o_custkey % 4 AS a, o_orderkey % 5 AS b FROM orders)"


def calls(t):
    """Orders as records with two samples each, some with a filter of their own."""
    o = t.orders.selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'F' THEN array('PASS') WHEN 'O' THEN array('PASS', 'q10') ELSE cast(array() AS array<string>) END AS filters", "o_custkey % 4 AS a", "o_orderkey % 5 AS b")
    one = lambda n, x: f"named_struct('name', '{n}', 'gt', CASE {x} WHEN 0 THEN array(cast(null AS int), cast(null AS int)) WHEN 1 THEN array(0, 1) ELSE array(0, 0) END, 'ft', CASE {x} WHEN 0 THEN '.' WHEN 1 THEN 'PASS' WHEN 2 THEN 'low' WHEN 3 THEN cast(null AS string) ELSE '.' END)"
    return o.selectExpr("o_orderkey", "filters", "a", "b", f"array({one('x', 'a')}, {one('y', 'b')}) AS samples")


_FT = "CASE {0} WHEN 0 THEN '.' WHEN 1 THEN 'PASS' WHEN 2 THEN 'low' WHEN 3 THEN NULL ELSE '.' END"
_OK = f"(coalesce({{0}}, '') LIKE 'PASS%' OR (coalesce({{0}}, '.') = '.' AND {{1}} <> 0))"
PASSING = f"(SELECT *, (fa IS NULL AND fb IS NULL) OR {_OK.format('fa', 'a')} OR {_OK.format('fb', 'b')} AS passing FROM (SELECT *, {_FT.format('a')} AS fa, {_FT.format('b')} AS fb FROM {FILTERS}))"


@query(f"SELECT o_orderkey, len(list_filter(filters, lambda f: f <> 'PASS')) > 0 AS filtered FROM {FILTERS}")
def filter_pass(t):
    return calls(t).select("o_orderkey", fn.is_filtered("filters").alias("filtered"))


@query(f"SELECT o_orderkey, passing, array_to_string(CASE WHEN passing THEN ['PASS'] ELSE filters END, ';') AS filters FROM {PASSING}")
def update_filter(t):
    c = calls(t).withColumn("passing", fn.has_passing_genotype("samples"))
    return variants.update_filter(c).select("o_orderkey", "passing", F.array_join("filters", ";").alias("filters"))


@query(f"SELECT o_orderkey, a <> 0 AND b <> 0 AS complete, a = 1 AS nonref_x, CASE WHEN b = 1 THEN 1 WHEN b <> 0 THEN 0 END AS second_y FROM {FILTERS}")
def genotype_predicates(t):
    s = variants.subset(calls(t), ["y", "x"])
    y, x = F.col("samples")[0]["gt"], F.col("samples")[1]["gt"]
    return s.select("o_orderkey", (genotypes.complete(x) & genotypes.complete(y)).alias("complete"), genotypes.non_reference(x).alias("nonref_x"), y[1].alias("second_y"))


@query("SELECT n_nationkey, a, b, (a + b * (b + 1) / 2)::BIGINT AS idx, (n * (n + 1) / 2)::BIGINT AS n_genotypes FROM (SELECT n_nationkey, n_nationkey % 4 + 1 AS n, unnest(range(0, n_nationkey % 4 + 1)) AS b FROM nation) t, LATERAL (SELECT unnest(range(0, b + 1)) AS a)")
def genotype_enumerate(t):
    """Genotypes of a nation's number of alleles, and the place of each."""
    n = t.nation.select("n_nationkey", (F.col("n_nationkey") % 4 + 1).alias("n"))
    g = n.select("n_nationkey", "n", F.posexplode(genotypes.enumerate_all("n")).alias("at", "g"))
    return g.select("n_nationkey", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"), genotypes.index(F.col("g")[1], F.col("g")[0]).alias("idx"), genotypes.count("n").alias("n_genotypes"))


GT = "(SELECT l_orderkey, l_linenumber, (l_partkey % 3)::INT AS a, (l_suppkey % 3)::INT AS b, l_linenumber % 3 AS m, CASE WHEN l_linenumber % 2 = 0 THEN (l_orderkey % 4)::INT END AS ps FROM lineitem)"


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN m = 2 THEN NULL ELSE b END AS second, CASE WHEN m = 0 THEN (CASE WHEN ps IS NOT NULL THEN 'local' ELSE 'global' END) WHEN m = 1 AND a = b THEN 'implicit' ELSE 'unphased' END AS kind, CASE WHEN m = 0 THEN ps END AS ps FROM {GT}"""
)
def genotype_parse_phase(t):
    """Allele numbers and phase from text: phased, unphased, or with a missing allele."""
    g = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "concat(l_partkey % 3, CASE l_linenumber % 3 WHEN 0 THEN '|' ELSE '/' END, CASE l_linenumber % 3 WHEN 2 THEN '.' ELSE cast(l_suppkey % 3 AS string) END) AS gt", "CASE WHEN l_linenumber % 2 = 0 THEN cast(l_orderkey % 4 AS int) END AS ps")
    p = genotypes.phase("gt", "ps")
    return g.select("l_orderkey", "l_linenumber", genotypes.parse("gt")[1].alias("second"), p["kind"].alias("kind"), p["ps"].alias("ps"))


@query("SELECT l_orderkey, l_linenumber, ((l_partkey % 3) * 4 + l_suppkey % 4) * 5 + l_orderkey % 5 AS place FROM lineitem")
def label_ravel(t):
    c = F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 4, F.col("l_orderkey") % 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", genotypes.ravel(c, F.array(F.lit(3), F.lit(4), F.lit(5))).alias("place"))


@query(
    """WITH g AS (SELECT o_orderkey, (o_custkey % 4)::INT AS truth, [[0], [(o_orderkey % 2)::INT, 1], [1, (o_orderkey % 2)::INT], [2]] AS p FROM orders)
    SELECT o_orderkey, i, CASE WHEN i = truth THEN 1 WHEN list_sort(list_distinct(p[i + 1])) = list_sort(list_distinct(p[truth + 1])) THEN 2 WHEN truth > 0 AND i > 0 THEN 3 ELSE 0 END AS rank FROM (SELECT *, unnest(range(0, 4)) AS i FROM g)"""
)
def label_rank(t):
    """Ranks of four candidate genotypes by the paths that they share with the true one."""
    g = t.orders.selectExpr("o_orderkey", "cast(o_custkey % 4 AS int) AS truth", "array(array(0), array(cast(o_orderkey % 2 AS int), 1), array(1, cast(o_orderkey % 2 AS int)), array(2)) AS p")
    r = g.select("o_orderkey", F.posexplode(genotypes.label_ranks("p", "truth")).alias("i", "rank"))
    return r.select("o_orderkey", F.col("i").cast("bigint").alias("i"), "rank")


@query("WITH u AS (SELECT 'v' || p_partkey AS variant_id, p_size AS k, 0 AS src FROM part UNION ALL SELECT 'v' || (p_partkey + 100), p_size, 1 FROM part) SELECT variant_id, k FROM u WHERE src = 0 OR variant_id NOT IN (SELECT variant_id FROM u WHERE src = 0)")
def variant_concat(t):
    """Records of two tables, the first one's where both have one."""
    first = t.part.selectExpr("concat('v', p_partkey) AS variant_id", "p_size AS k")
    second = t.part.selectExpr("concat('v', p_partkey + 100) AS variant_id", "p_size AS k")
    return variants.concat(first, second).select("variant_id", "k")


@query("SELECT p_partkey, max(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 3 END)::INT AS h0, max(CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey % 3 END)::INT AS h1 FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def genotype_by_haplotype(t):
    """Alleles by haplotype of each record; null where a haplotype says nothing."""
    d = t.lineitem.selectExpr("l_partkey AS variant_id", "l_linenumber % 2 AS haplotype", "cast(l_suppkey % 3 AS int) AS allele")
    g = variants.genotype_by_haplotype(d)
    return variants.predictions_to_records(t.part.selectExpr("p_partkey AS variant_id"), g).select(F.col("variant_id").alias("p_partkey"), F.col("gt")[0].alias("h0"), F.col("gt")[1].alias("h1"))


@query(
    """WITH c AS (SELECT l_suppkey % 20 AS region, o_custkey AS sample, max(CASE WHEN l_returnflag = 'R' AND l_linenumber > 5 THEN 1 ELSE 0 END) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    every AS (SELECT * FROM (SELECT DISTINCT l_suppkey % 20 AS region FROM lineitem), (SELECT DISTINCT o_custkey AS sample FROM orders))
    SELECT region, sample, f IS NOT NULL AS positive FROM every LEFT JOIN c USING (region, sample) WHERE coalesce(f, 0) = 0"""
)
def sample_split(t):
    """Samples that a region can be trained on: without structural alleles, or with none that is filtered."""
    touched = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("l_suppkey % 20 AS region", "o_custkey AS sample", "l_returnflag = 'R' AND l_linenumber > 5 AS filtered")
    return variants.split_samples(touched, t.orders.selectExpr("o_custkey AS sample"), t.lineitem.selectExpr("l_suppkey % 20 AS region"))


@query(
    """WITH c AS (SELECT l_suppkey % 20 AS region, o_custkey AS sample, max(CASE WHEN l_returnflag = 'R' AND l_linenumber > 5 THEN 1 ELSE 0 END) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    every AS (SELECT * FROM (SELECT DISTINCT l_suppkey % 20 AS region FROM lineitem), (SELECT DISTINCT o_custkey AS sample FROM orders))
    SELECT sample, count(*) AS regions, sum(CASE WHEN f IS NOT NULL THEN 1 ELSE 0 END) AS positive, sum(CASE WHEN f IS NULL THEN 1 ELSE 0 END) AS negative FROM every LEFT JOIN c USING (region, sample) WHERE coalesce(f, 0) = 0 GROUP BY 1"""
)
def positive_negative_samples(t):
    touched = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("l_suppkey % 20 AS region", "o_custkey AS sample", "l_returnflag = 'R' AND l_linenumber > 5 AS filtered")
    s = variants.split_samples(touched, t.orders.selectExpr("o_custkey AS sample"), t.lineitem.selectExpr("l_suppkey % 20 AS region"))
    return s.groupBy("sample").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.col("positive").cast("int")).alias("positive"), F.sum((~F.col("positive")).cast("int")).alias("negative"))


#: Four samples of every order, a record for each of its lines: a call is missing, carries the first ALT, or carries none.
MATCH_CALLS = """(SELECT l_orderkey AS region, l_linenumber AS variant_id, j AS place, CASE WHEN k = 0 THEN NULL WHEN k < 3 THEN 1 ELSE 0 END AS a FROM (
    SELECT l_orderkey, l_linenumber, j, (l_orderkey * 7 + l_linenumber * (j % 2) + j * 5) % 11 + CASE WHEN j >= 2 THEN 3 ELSE 0 END AS k FROM lineitem, (SELECT unnest(range(0, 4)) AS j)))"""
MATCHED = f"""
    WITH o AS (SELECT region, place, count(*) AS records, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS n_nonref, count(a) AS n_complete FROM {MATCH_CALLS} GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN n_nonref < records THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY place) AS blocked FROM o WHERE n_nonref BETWEEN 1 AND 2 WINDOW w AS (PARTITION BY region ORDER BY place)),
    r AS (SELECT region, place AS control, row_number() OVER (PARTITION BY region ORDER BY (place * 1103515245 + 12345) % 2147483648, place) AS k FROM o WHERE n_nonref = 0 AND n_complete = records),
    m AS (SELECT o.region, o.place, o.records, o.n_nonref, r.control FROM o LEFT JOIN c ON c.region = o.region AND c.place = o.place AND c.blocked = 0 LEFT JOIN r ON r.region = c.region AND r.k = c.k WHERE o.n_nonref > 0)"""


def matched(t):
    k = "(l_orderkey * 7 + l_linenumber * (j % 2) + j * 5) % 11 + CASE WHEN j >= 2 THEN 3 ELSE 0 END"
    c = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "explode(sequence(0L, 3L)) AS j").selectExpr("l_orderkey AS region", "l_linenumber AS variant_id", "concat('s', j) AS sample", "j AS place", f"{k} AS k")
    return variants.case_matching(c.withColumn("gt", F.expr("CASE WHEN k = 0 THEN array(0, cast(null AS int)) WHEN k < 3 THEN array(0, 1) ELSE array(0, 0) END")))


@query(f"{MATCHED} SELECT region, 's' || place AS sample, records, n_nonref, 's' || control AS control FROM m")
def case_matching(t):
    """For each sample that carries an order's variants one that carries none."""
    return matched(t).select("region", "sample", "records", "n_nonref", "control")


@query(
    f"""{MATCHED}, a AS (SELECT place AS s, sum(CASE WHEN n_nonref <= 2 THEN n_nonref ELSE 0 END) AS nonref_records, sum(CASE WHEN control IS NOT NULL THEN n_nonref ELSE 0 END) AS matching_ref_records, sum(CASE WHEN n_nonref > 2 THEN 1 ELSE 0 END) AS dropped_regions FROM m GROUP BY 1),
    b AS (SELECT control AS s, sum(n_nonref) AS ref_records FROM m WHERE control IS NOT NULL GROUP BY 1)
    SELECT 's' || s AS sample, coalesce(nonref_records, 0) AS nonref_records, coalesce(matching_ref_records, 0) AS matching_ref_records, coalesce(ref_records, 0) AS ref_records, coalesce(dropped_regions, 0) AS dropped_regions FROM a FULL JOIN b USING (s)"""
)
def match_counters(t):
    """What case matching gave and took, sample by sample."""
    return variants.match_counters(matched(t))


PRODUCT = """(SELECT p_partkey // 6 AS region, p_partkey // 3 % 2 AS copy, p_partkey % 3 AS idx, list_sort(list_distinct(CASE p_partkey % 3 WHEN 0 THEN ['r'] WHEN 1 THEN ['a' || (p_size % 2)] ELSE ['a0', 'a' || (p_size % 3)] END)) AS paths, p_partkey % 3 = p_partkey // 6 % 3 AS truth FROM part)"""


@query(
    f"""WITH b AS {PRODUCT}, n AS (SELECT region, count(*) AS n FROM b WHERE copy = 1 GROUP BY 1),
    p AS (SELECT x.region, x.idx * n.n + y.idx AS genotype, x.idx AS first, y.idx AS second, list_sort(list_distinct(list_concat(x.paths, y.paths))) AS paths, x.truth AND y.truth AS truth FROM b x JOIN b y ON x.region = y.region AND x.copy = 0 AND y.copy = 1 JOIN n ON n.region = x.region),
    t AS (SELECT region, genotype AS tg, paths AS tp FROM p WHERE truth)
    SELECT region, genotype, first, second, CASE WHEN truth THEN 1 WHEN paths = tp THEN 2 WHEN tg > 0 AND genotype > 0 THEN 3 ELSE 0 END AS rank FROM p JOIN t USING (region)"""
)
def genotype_product(t):
    """The genotypes over two backgrounds of three haplotypes each, ranked against the true pair."""
    paths = "CASE p_partkey % 3 WHEN 0 THEN array('r') WHEN 1 THEN array(concat('a', p_size % 2)) ELSE array('a0', concat('a', p_size % 3)) END"
    b = t.part.selectExpr("p_partkey div 6 AS region", "p_partkey div 3 % 2 AS copy", "p_partkey % 3 AS idx", f"array_distinct({paths}) AS paths", "p_partkey % 3 = p_partkey div 6 % 3 AS truth")
    return variants.genotype_product(b)


@query(
    f"""SELECT contig || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || array_to_string(alts, ',') || chr(9) || (p_partkey % 60) || chr(9) || 'PASS' || chr(9) || 'K=' || p_partkey || chr(9) || 'GT' || chr(9) || '0|' || (p_partkey % 2) AS line FROM {RECORDS}"""
)
def vcf_lines(t):
    """Records as lines of a VCF with one sample."""
    from ..sources import vcf

    r = records(t).selectExpr(
        "contig", "pos", "cast(null AS string) AS id", "ref", "alts", "cast(p_partkey % 60 AS double) AS qual", "array('PASS') AS filters", "map('K', cast(p_partkey AS string)) AS info",
        "array(named_struct('name', 's', 'gt', array(0, cast(p_partkey % 2 AS int)), 'phase', named_struct('kind', 'global', 'ps', cast(null AS int)), 'ft', cast(null AS string))) AS samples",
    )
    return vcf.lines(r, ["s"]).select("line")


@query("SELECT path, CASE WHEN path LIKE '%.vcf.gz' THEN 'z' WHEN path LIKE '%.bcf' THEN 'b' WHEN path LIKE '%.vcf' THEN 'v' END AS format, regexp_extract(path, '_([^_]+)_([0-9]+)$', 1) AS id FROM (SELECT unnest(['a.vcf', 'a.vcf.gz', 'b.bcf', '_alt_' || s_suppkey || '_' || s_suppkey % 3]) AS path FROM supplier) ")
def path_names(t):
    """Formats by a file's ending, and variants by a path's name."""
    p = t.supplier.select(F.explode(F.array(F.lit("a.vcf"), F.lit("a.vcf.gz"), F.lit("b.bcf"), fn.alt_path_name(F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3))).alias("path"))
    return p.select("path", fn.file_format("path").alias("format"), F.coalesce(fn.parse_alt_path("path")["variant_id"], F.lit("")).alias("id"))


#: Each order's lines are a sample's records: their phase by line number.
PHASES = "(SELECT l_orderkey, l_linenumber, CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'unphased' WHEN 1 THEN 'global' WHEN 2 THEN 'local' ELSE 'implicit' END AS kind, CASE WHEN (l_partkey + l_linenumber) % 4 = 2 THEN (l_suppkey % 2)::INT END AS ps, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"


@query(
    f"""WITH p AS {PHASES}, q AS (SELECT *, last_value(CASE WHEN kind <> 'implicit' THEN kind || coalesce(ps::VARCHAR, '') END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
    b AS (SELECT *, kind <> 'implicit' AND before IS NOT NULL AND NOT (before = kind || coalesce(ps::VARCHAR, '') AND kind IN ('global', 'local')) AS breaks FROM q)
    SELECT l_orderkey, l_linenumber, kind, breaks, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS segment FROM b"""
)
def phase_segments(t):
    from ..operators import phasing

    p = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'unphased' WHEN 1 THEN 'global' WHEN 2 THEN 'local' ELSE 'implicit' END AS kind", "CASE WHEN (l_partkey + l_linenumber) % 4 = 2 THEN cast(l_suppkey % 2 AS int) END AS ps")
    return phasing.segments(p, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "kind", "breaks", "segment")
