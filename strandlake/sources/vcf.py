"""VCF text as tables, and back. Lines are parsed and written by expressions; only the header is looked at in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotypes
from ..operators.variants import normalise, predictions_to_records

FIXED = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def detect_format(path: str) -> str:
    """`vcf` or `bcf` by the file's ending; anything else is an error."""
    for ending, kind in ((".vcf.gz", "vcf"), (".vcf.bgz", "vcf"), (".vcf", "vcf"), (".bcf", "bcf")):
        if path.endswith(ending):
            return kind
    raise ValueError(f"unknown variant file format: {path}")


def header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines, in order."""
    if detect_format(path) == "bcf":
        raise NotImplementedError("BCF is not read here: convert it to VCF")
    lines = spark.read.text(path)
    return [r["value"] for r in lines.where(F.startswith("value", F.lit("##"))).collect()] + [r["value"] for r in lines.where(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()]


def sample_names(lines: list[str]) -> list[str]:
    return lines[-1].split("\t")[len(FIXED) :]


def contigs(lines: list[str]) -> list[str]:
    return [x.split("ID=")[1].split(",")[0].rstrip(">") for x in lines if x.startswith("##contig=<")]


def subset_header(lines: list[str], names: list[str]) -> list[str]:
    return [*lines[:-1], "\t".join([*lines[-1].split("\t")[: len(FIXED)], *names])]


def read(spark: SparkSession, path: str, samples: list[str] | None = None, normalised: bool = True) -> DataFrame:
    """Records: contig, pos (zero-based), id, ref, alts, qual, filters, info, samples; normalised records have variant_id, alleles, start and
    end besides. Columns that are not asked for are never parsed."""
    names = sample_names(header(spark, path))
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)).select(cells.alias("c"), F.split(F.try_element_at(cells, F.lit(9)), ":").alias("format"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    known = lambda x: F.when(x != ".", x)
    wanted = [(n, names.index(n)) for n in (samples if samples is not None else names)]

    def one(name: str, i: int):
        values = F.split(at(len(FIXED) + 1 + i), ":")
        get = lambda key: F.try_element_at(values, F.nullif(F.array_position(F.col("format"), key).cast("int"), F.lit(0)))
        gt, ps = get("GT"), get("PS").try_cast("int")
        return F.struct(F.lit(name).alias("name"), genotypes.parse(gt).alias("gt"), genotypes.phase(gt, ps).alias("phase"), get("FT").alias("ft"))

    called = F.array(*[one(n, i) for n, i in wanted]) if wanted else F.array().cast("array<struct<name:string,gt:array<int>,phase:struct<kind:string,ps:int>,ft:string>>")
    out = rows.select(
        at(1).alias("contig"),
        (at(2).try_cast("bigint") - 1).alias("pos"),
        known(at(3)).alias("id"),
        F.upper(at(4)).alias("ref"),
        F.when(at(5) == ".", F.array().cast("array<string>")).otherwise(F.split(at(5), ",")).alias("alts"),
        at(6).try_cast("double").alias("qual"),
        F.when(at(7) == ".", F.array().cast("array<string>")).otherwise(F.split(at(7), ";")).alias("filters"),
        F.when(at(8) != ".", F.str_to_map(at(8), F.lit(";"), F.lit("="))).alias("info"),
        called.alias("samples"),
    )
    return normalise(out) if normalised else out


def info_subset(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("info", F.map_filter("info", lambda k, _: k.isin(*keys)))


def flags(lines: list[str]) -> list[str]:
    """INFO keys that the header says have no value."""
    return [x.split("ID=")[1].split(",")[0] for x in lines if x.startswith("##INFO=<") and "Number=0," in x]


def with_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` whose INFO has the given keys without a value, as ill-formed files may give them one."""
    return df.withColumn("info", F.transform_values("info", lambda k, v: F.when(~k.isin(*keys), v))) if keys else df


def _number(x, alternative: str = "."):
    return F.coalesce(x.cast("string"), F.lit(alternative))


def _has_filter(df: DataFrame) -> bool:
    return "ft" in df.select(F.explode("samples").alias("s")).select("s.*").columns if "samples" in df.columns else False


def genotype_text(gt, phase):
    """`0|1` for phased calls, else `0/1`."""
    numbers = F.transform(gt, lambda a: _number(a))
    phased = phase["kind"].isin("local", "global")
    return F.when(gt.isNull(), "./.").when(phased, F.array_join(numbers, "|")).otherwise(F.array_join(numbers, "/"))


def lines(df: DataFrame, names: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """(contig, pos, line) of records. FORMAT has PS if any call of a record is phased within a set, and FT if any has a filter.

    `extra`: FORMAT keys besides these, with the columns that hold a map by sample name.
    """
    extra = extra or {}
    with_set = F.exists("samples", lambda s: F.coalesce(s["phase"]["kind"] == "local", F.lit(False)))
    filtered = F.exists("samples", lambda s: s["ft"].isNotNull()) if _has_filter(df) else F.lit(False)
    keys = F.concat_ws(":", F.lit("GT"), F.when(with_set, "PS"), F.when(filtered, "FT"), *map(F.lit, extra))

    def cell(name: str):
        s = F.element_at(F.filter("samples", lambda x: x["name"] == name), 1)
        own = F.when(s["phase"]["kind"] == "local", s["phase"]["ps"])
        ft = s["ft"] if _has_filter(df) else F.lit(None).cast("string")
        # concat_ws leaves out the keys that the record lacks, which are null here.
        return F.concat_ws(":", genotype_text(s["gt"], s["phase"]), F.when(with_set, _number(own)), F.when(filtered, _number(ft)), *[F.coalesce(F.try_element_at(F.col(c), F.lit(name)).cast("string"), F.lit(".")) for c in extra.values()])

    info = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("info", F.create_map().cast("map<string,string>")))), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    alts = F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ","))
    filters = F.when(F.size("filters") == 0, ".").otherwise(F.array_join("filters", ";"))
    qual = F.when(F.col("qual").isNull(), ".").when(F.col("qual") == F.floor("qual"), F.col("qual").cast("bigint").cast("string")).otherwise(F.col("qual").cast("string"))
    fields = ["contig", (F.col("pos") + 1).cast("string"), F.coalesce("id", F.lit(".")), "ref", alts, qual, filters, F.when(info == "", ".").otherwise(info), *([keys, *map(cell, names)] if names else [])]
    return df.select("contig", "pos", F.concat_ws("\t", *fields).alias("line"))


def write(df: DataFrame, path: str, head: list[str], names: list[str] | None = None, extra: dict[str, str] | None = None) -> None:
    """Sorted VCF text under `path`: parts in the order of the header's contigs and positions, the header first."""
    spark = df.sparkSession
    names = sample_names(head) if names is None else names
    head = subset_header(head, names)
    rank = F.create_map(*[x for i, c in enumerate(contigs(head)) for x in (F.lit(c), F.lit(i))]) if contigs(head) else None
    place = F.coalesce(F.try_element_at(rank, F.col("contig")), F.lit(1 << 30)) if rank is not None else F.lit(1 << 30)
    body = lines(df, names, extra).select(place.alias("a"), F.col("contig").alias("b"), F.col("pos").alias("c"), "line")
    first = spark.createDataFrame([(-1, "", i, x) for i, x in enumerate(head)], "a int, b string, c bigint, line string")
    first.union(body).orderBy("a", "b", "c", "line").select("line").write.text(path)


def prediction_header(lines: list[str], sample: str) -> list[str]:
    """The header's lines but those of FORMAT, whose fields a prediction replaces, for one sample."""
    kept = [x for x in lines[:-1] if not x.startswith("##FORMAT=")]
    own = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=MT,Number=.,Type=Float,Description="Metric between real and simulated data">']
    return [*kept, *own, *subset_header(lines, [sample])[-1:]]


def write_predictions(records: DataFrame, predicted: DataFrame, path: str, head: list[str], sample: str) -> None:
    """A VCF of the predicted genotypes of one sample: the records that have one, with GT and MT, the metrics to four decimals.

    `predicted`: (variant_id, gt, metrics array<double>); an allele that is not known is null.
    """
    known = predictions_to_records(records.drop("samples"), predicted)
    call = F.struct(F.lit(sample).alias("name"), "gt", F.struct(F.lit("unphased").alias("kind"), F.lit(None).cast("int").alias("ps")).alias("phase"), F.lit(None).cast("string").alias("ft"))
    listed = F.array_join(F.transform("metrics", lambda m: F.coalesce(F.round(m, 4).cast("string"), F.lit("."))), ",")
    rows = known.withColumn("samples", F.array(call)).withColumn("mt", F.create_map(F.lit(sample), F.when(F.size("metrics") > 0, listed).otherwise(".")))
    write(rows, path, prediction_header(head, sample), [sample], {"MT": "mt"})


def write_by_sample(df: DataFrame, path: str, head: list[str], chosen: DataFrame) -> None:
    """A folder `sample=NAME` for each sample of `chosen` (sample, variant_id): its records with its call alone, sorted within. INFO keys that
    have no value by the header lose one that a record gives them.

    A sample's header stands in `header` beside the parts.
    """
    names = sample_names(head)
    rows = with_flags(df, flags(head)).join(chosen, "variant_id")
    one = F.filter("samples", lambda s: s["name"] == F.col("sample"))
    text = lines(rows.withColumn("samples", F.transform(one, lambda s: F.struct(F.lit("one").alias("name"), s["gt"].alias("gt"), s["phase"].alias("phase"), s["ft"].alias("ft")))).withColumn("id", F.concat_ws("\x01", "sample", F.coalesce("id", F.lit(".")))), ["one"])
    parts = text.select(F.regexp_extract("line", "\t([^\t\x01]*)\x01", 1).alias("sample"), "contig", "pos", F.regexp_replace("line", "\t[^\t\x01]*\x01", "\t").alias("line"))
    parts.repartition("sample", "contig").sortWithinPartitions("sample", "contig", "pos").select("sample", "line").write.partitionBy("sample").text(path)
    heads = df.sparkSession.createDataFrame([(n, "\n".join(subset_header(head, [n]))) for n in names], "sample string, value string")
    heads.write.mode("overwrite").partitionBy("sample").text(f"{path}-header")
