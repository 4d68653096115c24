"""Reads, coverage, text tables, vectors, packing, and streams on small literal cases."""

from __future__ import annotations

import io
import json
import math
import random
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake import tuning
from strandlake.config import Pileup, Sample
from strandlake.functions import alignment, genotypes, intervals, variants
from strandlake.operators import coverage, embeddings, kmers, metrics, packing, reads
from strandlake.operators import intervals as interval_operators
from strandlake.operators import variants as variant_operators
from strandlake.sources import fasta, sam, tables
from strandlake.streaming import intervals as streams

SAM = "\n".join(
    [
        "@HD\tVN:1.6",
        "@RG\tID:r\tSM:one",
        "p\t99\tc\t11\t60\t2S8M\t=\t41\t40\tAACCGGTTAC\tIIIIIIIIII\tHP:i:1",
        "p\t147\tc\t41\t60\t10M\t=\t11\t-40\tACGTACGTAC\t??????????\tHP:i:1",
        "q\t1024\tc\t15\t60\t10M\t*\t0\t0\tACGTACGTAC\t*",
        "r\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII",
        "s\t0\tc\t12\t30\t4M2D3M1I2M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII",
    ]
)


@pytest.fixture(scope="module")
def sam_reads(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "in.sam"
    path.write_text(SAM + "\n")
    assert sam.sample_name(spark, str(path)) == "one"
    return sam.read(spark, str(path)).cache()


def test_sam(sam_reads):
    rows = {(r.qname, r.flag): r for r in sam_reads.collect()}
    assert rows["p", 99].pos == 10 and rows["p", 99].qual == [40] * 10 and rows["p", 99].tags == {"HP": "1"} and rows["p", 99].rnext == "c"
    assert rows["r", 4].contig is None
    assert {r.qname for r in reads.primary(sam_reads).collect()} == {"p", "s"}


def test_sample_name_must_be_one(spark, tmp_path):
    (tmp_path / "two.sam").write_text("@RG\tID:a\tSM:x\n@RG\tID:b\tSM:y\n")
    with pytest.raises(ValueError):
        sam.sample_name(spark, str(tmp_path / "two.sam"))


def test_fragments_and_inserts(sam_reads):
    r = reads.with_region(reads.primary(sam_reads))
    f = {x.qname: x for x in reads.fragments(r).collect()}
    assert f["p"].n_reads == 2 and f["p"].read1.pos == 10 and f["p"].read2.pos == 40 and f["s"].read2 is None
    i = reads.insert_sizes(reads.fragments(r), 30.0, 5.0).first()
    assert (i.insert_size, i.zscore, i.fragment_start, i.fragment_end, i.gap_start, i.gap_end) == (40, 2.0, 10, 50, 18, 40)


def test_columns_and_image(sam_reads):
    region = reads.with_region(reads.primary(sam_reads)).withColumn("region_start", F.lit(5)).withColumn("region_end", F.lit(25)).withColumn("ref", F.lit("ACGTACGTACGTACGTACGT"))
    capped = reads.capped(region.withColumn("region", F.lit("r")), ["region"], reads.max_reads(F.lit(20), 3, 10))
    cells = reads.columns(capped, reference="ref").cache()
    s = {c.col: c for c in cells.where("qname = 's'").collect()}
    assert sorted(s) == [6, 7, 8, 9, 12, 13, 14, 15, 16]  # two deleted columns; an inserted base shows nothing
    assert s[15].base == "A" and s[6].kind == ("match" if s[6].base == "ACGTACGTACGTACGTACGT"[6] else "mismatch")
    p = {c.col: c for c in cells.where("qname = 'p' AND flag = 99").collect()}
    assert [p[i].kind for i in (3, 4)] == ["soft_clip"] * 2 and p[5].base == "C"
    img = reads.image(cells.withColumn("reverse", F.col("reverse")), ["region"], Pileup(height=3))
    rows = {(r.row, r.col): r.channels for r in img.collect()}
    assert max(k[0] for k in rows) <= 2 and rows[0, 3][0] == 128 and len(rows[0, 3]) == 8 and rows[0, 3][3] == 70
    assert reads.select_channels(img, (0, 3)).first().channels in [[v[0], v[3]] for v in rows.values()]
    small = reads.resize(img.withColumn("h", F.lit(3)).withColumn("w", F.lit(20)), ["region"], ("h", "w"), (3, 10))
    assert {(r.row, r.col) for r in small.collect()} <= {(r, c) for r in range(3) for c in range(10)}


def test_slots_overwrite_the_last_row(spark):
    cells = spark.createDataFrame([("r", 0, i) for i in range(5)], "region string, col int, row_order int")
    assert {(r.row, r.row_order) for r in reads.slots(cells, ["region"], 3).collect()} == {(0, 0), (1, 1), (2, 4)}


def test_alignment_scores(spark):
    df = spark.createDataFrame([("ACGT", [40, 20, 40, 8], "ACCTG", "4M"), ("ACGT", [40, 20, 40, 8], "ACCTG", "2M1I1M"), ("ACGT", [40, 20, 40, 8], "ACCTG", "1S2M1D1M")], "seq string, q array<int>, ref string, cigar string")
    got = [r[0] for r in df.select(alignment.alignment_score("seq", "q", "ref", F.lit(0), alignment.parse_cigar("cigar"))).collect()]
    ok = lambda q: math.log10(1 - 10 ** (-q / 40))
    bad = lambda q: -q / 40
    assert got[0] == pytest.approx(ok(40) + ok(20) + bad(40) + ok(8))
    assert got[1] == pytest.approx(ok(40) + ok(20) + bad(40) - 1 + bad(8))
    assert got[2] == pytest.approx(bad(40) + ok(20) + bad(40) - 1 + bad(8))


@pytest.mark.parametrize(
    "freq,want",
    [
        ({i: int(1e6 * math.exp(-((i - 30) ** 2) / 20)) + 1 for i in range(2, 61)}, 30),
        ({i: int(1e6 * math.exp(-((i - 15) ** 2) / 8)) + int(9e5 * math.exp(-((i - 30) ** 2) / 20)) + int(5e5 * math.exp(-((i - 45) ** 2) / 20)) + 1 for i in range(2, 61)}, 30),
        ({5: 100, 6: 10, 7: 30, 8: 30, 20: 90, 30: 20}, 7),
        ({4: 10}, 4),
    ],
)
def test_coverage_estimate(spark, freq, want):
    hist = spark.createDataFrame(list(freq.items()), "cnt bigint, freq bigint")
    assert kmers.estimate_coverage(hist).first()["coverage"] == want


def test_coverage_estimate_of_nothing(spark):
    assert kmers.estimate_coverage(spark.createDataFrame([], "cnt bigint, freq bigint")).count() == 0


def test_kmers_of_long_texts_are_whole(spark):
    r = random.Random(1)
    text = "".join(r.choice("ACGT") for _ in range(5000))
    got = {x.kmer: x.cnt for x in kmers.count(spark.createDataFrame([(text,), (None,), ("AC",)], "t string"), "t", 6, 1).collect()}
    assert got == Counter(text[i : i + 6] for i in range(len(text) - 5))


def test_classify_checks_coverage(spark):
    t = spark.createDataFrame([("AAA", 30), ("AAC", 1)], "kmer string, cnt bigint")
    w = spark.createDataFrame([("AAA",), ("AAC",), ("GGG",)], "kmer string")
    assert {r.kmer: r.zygosity for r in kmers.classify(w, t, 30.0).collect()} == {"AAA": "homozygous", "AAC": "absent", "GGG": "absent"}
    with pytest.raises(ValueError):
        kmers.classify(w, t, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_merge_against_a_sweep(spark, seed):
    r = random.Random(seed)
    rows = [("c%d" % r.randint(0, 1), s := r.randint(0, 300), s + r.choice([0, 0, 1, 5, 40])) for _ in range(150)]
    got = interval_operators.merge_overlapping(spark.createDataFrame(rows, "contig string, start int, end int"), bin_size=16).collect()
    want: Counter = Counter()
    for c in {x[0] for x in rows}:
        run: list = []
        runs = []
        for _, s, e in sorted(x for x in rows if x[0] == c):
            if run and s < max(x[1] for x in run):
                run.append((s, e))
            else:
                run = [(s, e)]
                runs.append(run)
        for x in runs:
            for s, e in x:
                want[c, s, e, x[0][0], max(y[1] for y in x)] += 1
    assert Counter((x.contig, x.start, x.end, x.region_start, x.region_end) for x in got) == want


def test_overlap_join_against_all_pairs(spark):
    r = random.Random(5)
    a = [("c", s := r.randint(0, 200), s + r.choice([0, 3, 70])) for _ in range(60)]
    b = [("c", s := r.randint(0, 200), s + r.choice([0, 3, 70])) for _ in range(60)]
    x, y = spark.createDataFrame(a, "contig string, l_start int, l_end int"), spark.createDataFrame(b, "contig string, r_start int, r_end int")
    got = Counter((p.l_start, p.l_end, p.r_start, p.r_end) for p in interval_operators.overlap_join(x, y, bin_size=16, touching_points=True).collect())
    assert got == Counter((p[1], p[2], q[1], q[2]) for p in a for q in b if (p[1] < q[2] and q[1] < p[2]) or p[1:] == q[1:])


def test_allele_regions(spark):
    #: Zero-based position, REF, ALT, and the interval and sequence without padding.
    cases = [(9, "CTTTTT", "C", 10, 15, ""), (9, "CTTTTT", "CTTTT", 13, 14, ""), (4, "A", "ATTT", 5, 5, "TTT"), (4, "AC", "GC", 4, 5, "G"), (4, "A", "AA", 5, 5, "A"), (0, "ACG", "ACG", 1, 1, "")]
    df = spark.createDataFrame([c[:3] for c in cases], "pos bigint, ref string, alt string")
    for r, c in zip(df.select("*", variants.allele("pos", "ref", "alt").alias("a")).collect(), cases, strict=True):
        if c[1] != c[2] and not (c[1].startswith("CTTT") and len(c[2]) > 1):
            assert (r.a.start, r.a.end, r.a.seq) == c[3:]
        assert r.ref[: r.a.start - r.pos] + r.a.seq + r.ref[r.a.end - r.pos :] == r.alt
    assert df.select(variants.allele(F.lit(1), F.lit("AC"), F.lit("*")).alias("a")).first().a is None


def test_genotypes(spark):
    df = spark.createDataFrame([("0/1", None), ("1|0", 7), ("1|1", None), ("2/2", None), ("1", None), ("./.", None)], "gt string, ps int")
    got = df.select(genotypes.parse("gt").alias("g"), genotypes.phase("gt", "ps").alias("p"), genotypes.complete(genotypes.parse("gt")).alias("c")).collect()
    assert [r.p.kind for r in got] == ["unphased", "local", "global", "implicit", "global", "implicit"] and got[5].g == [None, None] and not got[5].c
    with pytest.raises(Exception, match="ploidy"):
        spark.createDataFrame([("0/1/1/1",)], "gt string").select(genotypes.parse("gt")).collect()
    assert spark.range(1).select(genotypes.count(F.lit(3), 1)).first()[0] == 3
    assert spark.range(1).select(genotypes.enumerate_all(F.lit(3))).first()[0] == [[0, 0], [0, 1], [1, 1], [0, 2], [1, 2], [2, 2]]


def test_interval_text_of_contigs_with_underscores(spark):
    r = spark.range(1).select(intervals.parse_slug(F.lit("HLA_1_x_5_9")).alias("s"), intervals.parse_literal(F.lit("chr1:1,001-2,000")).alias("l"), intervals.parse_slug(F.lit("x")).alias("n")).first()
    assert (r.s.contig, r.s.start, r.s.end) == ("HLA_1_x", 5, 9) and (r.l.start, r.l.end) == (1000, 2000) and r.n is None


def test_metrics(spark):
    #: Four examples, and their concordance, non-reference concordance, precision, recall and F1.
    df = spark.createDataFrame([([1, 0, 0], 0), ([0, 1, 3], 1), ([0, 3, 1], 2), ([1, 0, 0], 1)], "ranks array<int>, prediction int")
    r = metrics.rates(metrics.contingency(df)).first()
    assert (r.concordance, r.nonref_concordance, r.precision, r.recall, r.f1) == (0.75, 0.75, pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    r = metrics.rates(metrics.contingency(df.limit(0))).first()
    assert (r.concordance, r.precision, r.f1) == (0.0, 0.0, 0.0)


def test_packing(spark):
    df = spark.createDataFrame([("a", i, z) for i, z in enumerate([3, 4, 4, 8, 1, 1])], "shard string, i int, z int")
    got = [(r.i, r.batch, r.begin) for r in packing.greedy(df, "shard", "i", "z", 8).orderBy("i").collect()]
    assert got == [(0, 0, 0), (1, 0, 3), (2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 3, 1)]
    with pytest.raises(Exception, match="larger than a batch"):
        packing.greedy(df, "shard", "i", "z", 7).collect()
    labels = spark.range(1).select(packing.repeated_labels(F.array(F.lit(0), F.lit(3), F.lit(1)), 2)).first()[0]
    assert labels == [0, 0, 3, 3, 1, 1]


def test_codes(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1])], "id int, vector array<float>")
    codes = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "code int, code_vector array<float>")
    a = embeddings.assign(v, codes)
    assert {r.id: r.code for r in a.collect()} == {0: 0, 1: 1, 2: 1}
    one = embeddings.update_codes(a, codes, 2)
    two = embeddings.update_codes(a, one, 2)
    assert two.count() == 2 and embeddings.perplexity(a).first().perplexity == pytest.approx(math.exp(-(1 / 3) * math.log(1 / 3) - (2 / 3) * math.log(2 / 3)))
    assert {r.id: r.code for r in embeddings.assign(v, codes, most_codes=1).collect()} == {0: 0, 1: 1, 2: 1}


def test_text_tables(spark, tmp_path):
    (tmp_path / "d.bed").write_text("chr1\t0\t100\t30.0\t0.4\t0\t0\nchrX\t0\t50\t10.0\t0.4\t0\t0\nchrUn\t0\t50\t10.0\t0.4\t0\t0\n")
    d = tables.depth(spark, str(tmp_path / "d.bed"))
    assert coverage.main_contigs(d).count() == 2
    (tmp_path / "k.txt").write_text("ACG 3\nCCC 9\n")
    k = tables.kmer_counts(spark, str(tmp_path / "k.txt"))
    assert tables.kmer_length(k) == 3 and tables.kmer_length(k.limit(0)) is None
    with pytest.raises(ValueError):
        tables.kmer_length(k.union(spark.createDataFrame([("A", 1)], k.schema)))
    (tmp_path / "h.tsv").write_text("2\t10\n3\t20\n")
    assert tables.histogram(spark, str(tmp_path / "h.tsv")).count() == 2
    (tmp_path / "c.tsv").write_text("coverage\tinsert_mean\n30.5\t400\n")
    assert tables.covstats(spark, str(tmp_path / "c.tsv")).first()["coverage"] == 30.5


def test_sample_statistics(spark, tmp_path):
    stats = {"sample": "s", "read_length": 250, "mean_insert_size": 400.5, "std_insert_size": 50, "mean_coverage": 30, "chrom_normalized_coverage": {"chrX": 0.5}, "gc_normalized_coverage": {"0.29": 1.1, "0.41": 0.9, "0.57": 2}, "gc_bin_count": {"0.29": 500, "0.41": 99, "0.57": 500}, "gc_normalized_coverage_error": {"0.57": 0.5}, "hist_insert_size": {"400": 0.2}}
    (tmp_path / "s.json").write_text(json.dumps(stats, indent=1))
    s = tables.load_sample(spark, str(tmp_path / "s.json"))
    assert s.gc_coverage == {29: 1.1} and s.contig_coverage("chrX") == 15 and s.contig_coverage("chr1") == 30 and s.simulated_read_length() == 150
    again = tables.sample_of(tables.sample_json(s))
    assert again == s and isinstance(again, Sample)
    with pytest.raises(ValueError):
        Pileup(channels=(0, 8))


def test_tar_examples(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for name, data in [("a.image.npy", b"1"), ("a.label.cls", b"2"), ("x/b.image.npy", b"3")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = {r["key"]: {k: bytes(v) for k, v in r["fields"].items()} for r in tables.tar_examples(spark, str(tmp_path / "s.tar")).collect()}
    assert got == {"a": {"image.npy": b"1", "label.cls": b"2"}, "x/b": {"image.npy": b"3"}}
    tables.write_examples(tables.tar_examples(spark, str(tmp_path / "s.tar")), str(tmp_path / "out"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nacgt\nAC\n>two\nGGGG\n")
    f = fasta.read(spark, str(tmp_path / "r.fa"))
    assert {r.contig: r.sequence for r in f.collect()} == {"one": "ACGTAC", "two": "GGGG"}
    w = fasta.fetch(f, spark.createDataFrame([("one", 2, 5), ("two", 3, 9)], "contig string, start int, end int"))
    assert {r.contig: r.sequence for r in w.collect()} == {"one": "GTA", "two": "G"}
    fasta.write(f, str(tmp_path / "out"))
    assert {r.contig: r.sequence for r in fasta.read(spark, str(tmp_path / "out")).collect()} == {"one": "ACGTAC", "two": "GGGG"}


def test_sample_matching():
    m = variant_operators.sample_matching
    assert (m(["a"], ["a"]), m(["a"], ["b", "a"]), m(["a", "b"], ["b"]), m(["a"], ["b"])) == ("equal", "subset", "partial", "none")


def test_down_sampling_keeps_pairs(spark):
    df = spark.createDataFrame([(f"q{i // 2}", i) for i in range(2000)], "qname string, i int")
    kept = coverage.downsample(df, "qname", 0.3).groupBy("qname").count().collect()
    assert all(r["count"] == 2 for r in kept) and 200 < len(kept) < 400
    low, high = spark.range(500).select(coverage.augmented_coverage(F.col("id"), F.lit(30.0)).alias("c")).agg(F.min("c"), F.max("c")).first()
    assert 15 <= low < 17 and 28 < high <= 30


def test_streams(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:05:00"), (1, "2026-01-01 00:15:00"), (2, "2026-01-01 00:00:30"), (1, "2026-01-01 02:00:00"), (2, "2026-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "u bigint, t string").withColumn("t", F.col("t").cast("timestamp"))
    (tmp_path / "in").mkdir()
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(9, "2026-01-02 00:00:00")], "u bigint, t string").withColumn("t", F.col("t").cast("timestamp"))

    def run(build, name):
        source = spark.readStream.schema("u bigint, t timestamp").parquet(str(tmp_path / "in"))
        q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    counts = run(lambda s: streams.window_counts(s, "t", ["u"], "10 minutes"), "counts")
    assert sum(r.n for r in counts if r.u == 1) == 4
    sessions = run(lambda s: streams.session_counts(s, "t", ["u"], "10 minutes"), "sessions")
    assert sorted(r.n for r in sessions if r.u == 1) == [1, 3]  # touching sessions are one
    runs = run(lambda s: streams.runs(s, "u", "t", 600), "runs")
    assert sorted(r.n for r in runs if r.u == 1) == [1, 1, 2]  # touching intervals are not
    assert all(r.run_end - r.run_start >= 600 for r in runs)


def test_spread_leaves_large_inputs(spark):
    assert tuning.spread(spark.range(100).repartition(9)).rdd.getNumPartitions() == 9
    assert tuning.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
