"""Tables of variant records: (contig, pos, id, ref, alts, qual, filters, info, samples)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genotypes, variants
from .coverage import order_key


def normalise(df: DataFrame) -> DataFrame:
    """`df` with variant_id, start and end of the reference interval, and alleles."""
    df = df.withColumn("alts", variants.require_sequences("alts"))
    df = df.withColumn("variant_id", variants.variant_id("contig", "pos", "ref", "alts")).withColumn("alleles", variants.alleles("pos", "ref", "alts"))
    region = variants.reference_region("pos", "ref", F.col("alleles"))
    return df.withColumn("__r", region).withColumn("start", F.col("__r.start")).withColumn("end", F.col("__r.end")).drop("__r")


def update_filter(df: DataFrame) -> DataFrame:
    return df.withColumn("filters", variants.updated_filters("filters", "samples"))


def structural(df: DataFrame, least: int = 50) -> DataFrame:
    return df.where(variants.is_sv("ref", "alts", least))


def inside(df: DataFrame, region_start: str, region_end: str) -> DataFrame:
    """Records strictly inside a region, without those whose only allele is `*`."""
    return df.where(~variants.touches_edge("start", "end", region_start, region_end) & ~variants.star_only("alts"))


def subset(df: DataFrame, names: list[str]) -> DataFrame:
    """Records with the given samples only, in the given order."""
    return df.withColumn("samples", F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.element_at(F.filter("samples", lambda s: s["name"] == n), 1)))


def sample_calls(df: DataFrame) -> DataFrame:
    """One row for each record and sample: the record's columns and name, gt, kind, ps, ft."""
    rows = df.select(*[c for c in df.columns if c != "samples"], F.posexplode("samples").alias("sample_at", "s"))
    return rows.select(*[c for c in rows.columns if c != "s"], F.col("s.name").alias("sample"), F.col("s.gt").alias("gt"), F.col("s.phase.kind").alias("kind"), F.col("s.phase.ps").alias("ps"), F.col("s.ft").alias("ft"))


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of both, one of each identity: the first table's where both have it."""
    a, b = first.withColumn("__from", F.lit(0)), second.withColumn("__from", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.join(both.groupBy("variant_id").agg(F.min("__from").alias("__first")), "variant_id").where("__from = __first").drop("__from", "__first").dropDuplicates(["variant_id"])


def sample_matching(first: list[str], second: list[str]) -> str:
    """How the samples of a second table relate to the first's: equal, subset, partial or none."""
    a, b = set(first), set(second)
    return "equal" if a == b else "subset" if b >= a else "partial" if a & b else "none"


def with_samples(df: DataFrame, names: list[str]) -> DataFrame:
    """Records with exactly the samples `names`; one that a record lacks has no call."""
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))

    def one(n):
        found = F.try_element_at(F.filter("samples", lambda s: s["name"] == n), F.lit(1))
        return F.struct(n.alias("name"), F.coalesce(found["gt"], none).alias("gt"), found["phase"].alias("phase"), found["ft"].alias("ft"))

    return df.withColumn("samples", F.transform(F.array(*[F.lit(n) for n in names]), lambda n: one(n)))


def star_alleles(df: DataFrame) -> DataFrame:
    """(variant_id, allele, n_alleles) of every `*`."""
    return df.select("variant_id", F.posexplode("alts").alias("i", "alt"), F.size("alts").alias("n")).where("alt = '*'").select("variant_id", (F.col("i") + 1).alias("allele"), (F.col("n") + 1).alias("n_alleles"))


def predictions_to_records(records: DataFrame, predicted: DataFrame) -> DataFrame:
    """Records with the genotype that is predicted for them, (variant_id, gt); others are dropped."""
    return records.join(predicted, "variant_id")


def genotype_by_haplotype(decoded: DataFrame, ploidy: int = 2) -> DataFrame:
    """From (variant_id, haplotype, allele), the array of alleles by haplotype; null where a haplotype says nothing."""
    return decoded.groupBy("variant_id").agg(*[F.max(F.when(F.col("haplotype") == h, F.col("allele"))).alias(f"h{h}") for h in range(ploidy)]).select("variant_id", F.array(*[f"h{h}" for h in range(ploidy)]).alias("gt"))


def split_samples(touched: DataFrame, samples: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, sample, positive): samples that a region's training set can use.

    `touched`: (region, sample, filtered), one row for each structural allele that a sample carries. Positive samples carry an allele
    and none that is filtered; negative ones carry none.
    """
    carried = touched.groupBy("region", "sample").agg(F.max(F.col("filtered").cast("int")).alias("__f"))
    every = regions.select("region").distinct().join(samples.select("sample").distinct())
    return every.join(carried, ["region", "sample"], "left").where("__f IS NULL OR __f = 0").select("region", "sample", F.col("__f").isNotNull().alias("positive"))


def case_matching(calls: DataFrame, most: int = 2, seed: int = 0) -> DataFrame:
    """(region, sample, place, records, n_nonref, control): for each sample that carries a region's variants, a sample that carries none.

    `calls`: (region, variant_id, sample, place, gt), `place` being the sample's number. A case carries 1 to `most` of a region's records;
    more leave `control` null and count as dropped. Cases are served in order of their place, each with the next sample without any
    variant and with complete calls, in the order of a hash and without replacement. A case that does not carry all of a region's
    records can't be matched and uses up the region's controls.
    """
    one = calls.groupBy("region", "sample", "place").agg(F.count(F.lit(1)).alias("records"), F.sum(genotypes.non_reference("gt").cast("int")).alias("n_nonref"), F.sum(genotypes.complete("gt").cast("int")).alias("n_complete"))
    cases = one.where("n_nonref > 0")
    served = cases.where(F.col("n_nonref") <= most)
    in_order = Window.partitionBy("region").orderBy("place")
    blocked = F.max((F.col("n_nonref") < F.col("records")).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    served = served.select("region", "place", F.row_number().over(in_order).alias("__k"), blocked.alias("__blocked")).where("NOT __blocked")
    chosen = Window.partitionBy("region").orderBy(order_key(F.col("place"), seed), "place")
    controls = one.where("n_nonref = 0 AND n_complete = records").select("region", F.col("sample").alias("control"), F.row_number().over(chosen).alias("__k"))
    matched = served.join(controls, ["region", "__k"]).select("region", "place", "control")
    return cases.join(matched, ["region", "place"], "left").select("region", "sample", "place", "records", "n_nonref", "control")


def match_counters(matched: DataFrame, most: int = 2) -> DataFrame:
    """(sample, nonref_records, matching_ref_records, ref_records, dropped_regions) of what `case_matching` returns."""
    kept = F.col("n_nonref") <= most
    own = matched.groupBy("sample").agg(
        F.sum(F.when(kept, F.col("n_nonref")).otherwise(0)).alias("nonref_records"),
        F.sum(F.when(F.col("control").isNotNull(), F.col("n_nonref")).otherwise(0)).alias("matching_ref_records"),
        F.sum((~kept).cast("int")).alias("dropped_regions"),
    )
    given = matched.where("control IS NOT NULL").groupBy(F.col("control").alias("sample")).agg(F.sum("n_nonref").alias("ref_records"))
    both = own.join(given, "sample", "full")
    return both.select("sample", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("nonref_records", "matching_ref_records", "ref_records", "dropped_regions")])


def genotype_product(backgrounds: DataFrame) -> DataFrame:
    """(region, genotype, first, second, rank): every pair of a haplotype of the first background with one of the second.

    `backgrounds`: (region, copy, idx, paths, truth): the haplotypes that are possible on a sample's copy 0 and 1, numbered from 0, the
    inference paths of each, and whether it is the true one. The rank is 1 for the true pair, 2 for the same paths in another phase, 3 for
    any other but the first if the true pair is not the first, else 0. Pairs are made within a region.
    """
    side = lambda c, x: backgrounds.where(F.col("copy") == c).select("region", F.col("idx").alias(f"i{x}"), F.col("paths").alias(f"p{x}"), F.col("truth").alias(f"t{x}"))
    size = backgrounds.where("copy = 1").groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    pairs = side(0, "a").join(side(1, "b"), "region").join(size, "region")
    together = F.array_sort(F.array_union("pa", "pb"))
    pairs = pairs.select("region", (F.col("ia") * F.col("n") + F.col("ib")).cast("bigint").alias("genotype"), F.col("ia").alias("first"), F.col("ib").alias("second"), together.alias("paths"), (F.col("ta") & F.col("tb")).alias("truth"))
    true = pairs.where("truth").select("region", F.col("genotype").alias("true_genotype"), F.col("paths").alias("true_paths"))
    rank = F.when(F.col("truth"), 1).when(F.col("paths") == F.col("true_paths"), 2).when((F.col("true_genotype") > 0) & (F.col("genotype") > 0), 3).otherwise(0)
    return pairs.join(true, "region").select("region", "genotype", "first", "second", rank.alias("rank"))


def complexity(df: DataFrame, most: int = 2) -> DataFrame:
    """Regions of `records` in two classes, with counts: those small enough to enumerate, and the others."""
    return df.withColumn("exhaustive", F.col("records") <= most).groupBy("exhaustive").agg(F.count(F.lit(1)).alias("regions"), F.sum("records").alias("records"), F.max("records").alias("largest"))


complete_calls = genotypes.complete
