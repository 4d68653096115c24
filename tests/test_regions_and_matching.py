"""Widening, tiles, ranks, packing errors, resizing and matching against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import Pileup
from strandlake.operators import embeddings, graphs, packing, reads, variants
from strandlake.sources import fasta, vcf


def test_rank_of_a_long_chain_and_of_a_cycle(spark):
    chain = spark.createDataFrame([("r", i, i + 1) for i in range(21)] + [("r", 0, 5), ("q", 1, 2)], "region string, src bigint, dst bigint")
    got = {(r.region, r.node): r["rank"] for r in graphs.topological_rank(chain, ["region"]).collect()}
    assert got == {("r", i): i for i in range(22)} | {("q", 1): 0, ("q", 2): 1}
    assert {(r.src, r.dst) for r in graphs.reachability(chain.where("region = 'r'"), ["region"]).collect()} == {(i, j) for i in range(22) for j in range(i + 1, 22)}
    with pytest.raises(ValueError):
        graphs.topological_rank(chain.union(spark.createDataFrame([("r", 21, 20)], chain.schema)), ["region"])
    assert graphs.topological_rank(chain.where("false"), ["region"]).count() == 0


def test_widening(spark):
    records = spark.createDataFrame([("c", 10, "AC"), ("c", 9, "A"), ("c", 18, "ACG"), ("c", 21, "A"), ("d", 0, "A")], "contig string, pos bigint, ref string")
    regions = spark.createDataFrame([("a", "c", 10, 20), ("b", "c", 30, 40), ("z", "d", 0, 5)], "region string, contig string, start bigint, end bigint")
    got = {r.region: (r.start, r.end) for r in graphs.widened(regions, records).collect()}
    # 10 moves to 9, where another record begins, and to 8; 20 to 22, where one ends, and to 23; a start of 0 stays.
    assert got == {"a": (8, 23), "b": (30, 40), "z": (0, 5)}


def test_tiles(spark):
    r = random.Random(2)
    whole = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("one", 1000), ("two", 64), ("three", 1))}
    df = spark.createDataFrame(list(whole.items()), "contig string, sequence string")
    made = {(t.contig, t.tile): t.sequence for t in fasta.tiles(df, 64).collect()}
    assert {c: "".join(made[k] for k in sorted(made) if k[0] == c) for c in whole} == whole and {len(v) for k, v in made.items() if k[0] == "two"} == {64}
    wanted = [(c, a, b) for c, s in whole.items() for a, b in [(0, len(s)), (0, 0), (len(s) // 2, len(s) + 50)]] + [("one", a, a + n) for a in (0, 63, 64, 65, 500) for n in (1, 64, 200)]
    regions = spark.createDataFrame(wanted, "contig string, start bigint, end bigint")
    for source in (df, fasta.tiles(df, 64)):
        got = sorted((x.contig, x.start, x.end, x.sequence) for x in fasta.fetch(source, regions, 64).collect())
        assert got == sorted((c, a, b, whole[c][a:b]) for c, a, b in wanted)


def test_packing_errors(spark):
    df = spark.createDataFrame([("s", i, 3) for i in range(5)], "shard string, o bigint, z bigint")
    with pytest.raises(Exception, match="larger than a batch"):
        packing.greedy(df, "shard", "o", "z", 2).collect()
    one = packing.greedy(df, "shard", "o", "z", 100).withColumn("l", F.array(F.lit(1)))
    assert packing.batch_labels(one, "shard", "o", "l", 5).first().labels == [1] * 5
    with pytest.raises(Exception, match="more than 4 labels"):
        packing.batch_labels(one, "shard", "o", "l", 4).collect()
    nulls = spark.createDataFrame([(None, 1, 3), (None, 2, 3), ("a", 1, 3)], "shard string, o bigint, z bigint")
    assert sorted((r.shard or "", r.batch, r.begin) for r in packing.greedy(nulls, "shard", "o", "z", 5).collect()) == [("", 0, 0), ("", 1, 0), ("a", 0, 0)]


def bilinear(cells: dict, h: int, w: int, to: tuple[int, int]) -> dict:
    out = {}
    for i in range(to[0]):
        for j in range(to[1]):
            y, x = min(max((i + 0.5) * h / to[0] - 0.5, 0), h - 1), min(max((j + 0.5) * w / to[1] - 0.5, 0), w - 1)
            r, c = int(y), int(x)
            near = [((r, c), (1 - y + r) * (1 - x + c)), ((r + 1, c), (y - r) * (1 - x + c)), ((r, c + 1), (1 - y + r) * (x - c)), ((r + 1, c + 1), (y - r) * (x - c))]
            near = [(k, f) for k, f in near if f > 0]
            if any(k in cells for k, _ in near):
                out[i, j] = sum(cells.get(k, 0) * f for k, f in near)
    return out


@pytest.mark.parametrize("to", [(3, 10), (9, 31), (4, 7), (1, 1)])
def test_bilinear_resize(spark, to):
    r = random.Random(3)
    cells = {(i, j): r.randrange(256) for i in range(5) for j in range(12) if r.random() < 0.6}
    img = spark.createDataFrame([("a", i, j, [v, 2 * v], 5, 12) for (i, j), v in cells.items()], "region string, row int, col int, channels array<int>, h int, w int")
    got = {(x.row, x.col): x.channels for x in reads.resize(img, ["region"], ("h", "w"), to).collect()}
    want = bilinear(cells, 5, 12, to)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k]) <= 0.5 + 1e-9 and abs(got[k][1] - 2 * want[k]) <= 0.5 + 1e-9 for k in want)


def test_codes_in_blocks(spark):
    r = random.Random(4)
    vecs = [(i, [r.random() for _ in range(4)]) for i in range(50)]
    codes = [(i, [round(r.random(), 1) for _ in range(4)]) for i in range(23)]
    df, book = spark.createDataFrame(vecs, "id int, vector array<double>"), spark.createDataFrame(codes, "code int, code_vector array<double>")
    one = {(x.id, x.code, round(x.distance, 9)) for x in embeddings.assign(df, book).collect()}
    assert one == {(x.id, x.code, round(x.distance, 9)) for x in embeddings.assign(df, book, most_codes=5).collect()}
    for i, code, d in one:
        best = min((sum((a - b) ** 2 for a, b in zip(vecs[i][1], v, strict=True)), c) for c, v in codes)
        assert code == best[1] and abs(d - best[0]) < 1e-8


def test_queries_in_blocks(spark):
    df = spark.range(40).selectExpr("id AS s", "id * 2 AS b")
    queries = spark.range(9).selectExpr("id AS q", "id * 3 AS a")
    for block in (100, 2):
        got = sorted(map(tuple, embeddings.beside(df, queries, "s", "q", block).collect()))
        assert got == sorted((q, 3 * q, s, 2 * s) for q in range(9) for s in range(40))


def test_local_phase_and_filters_survive(spark, tmp_path):
    head = ["##fileformat=VCFv4.2", "##contig=<ID=c>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty"]
    body = ["c\t5\t.\tA\tC\t.\t.\t.\tGT:PS:FT\t0|1:7:PASS\t1|1:.:.", "c\t9\t.\tA\tC\t.\t.\t.\tGT\t0/1\t0|1", "c\t12\t.\tA\tC\t.\t.\t.\tGT:FT\t0/1:low\t0/0:."]
    (tmp_path / "a.vcf").write_text("\n".join([*head, *body]) + "\n")
    first = vcf.read(spark, str(tmp_path / "a.vcf"))
    vcf.write(first, str(tmp_path / "b.vcf"), head)
    again = vcf.read(spark, str(tmp_path / "b.vcf"))
    key = lambda df: sorted(str((r.contig, r.pos, r.samples)) for r in df.collect())
    assert key(first) == key(again)
    lines = {r.value.split("\t")[1]: r.value.split("\t")[8:] for r in spark.read.text(str(tmp_path / "b.vcf")).collect() if not r.value.startswith("#")}
    assert lines["5"][:2] == ["GT:PS:FT", "0|1:7:PASS"] and lines["9"] == ["GT", "0/1", "0|1"] and lines["12"] == ["GT:FT", "0/1:low", "0/0:."]


def slow_matching(records: dict, most: int) -> dict:
    """region -> {(sample): control} by the words of the docstring."""
    out = {}
    for region, calls in records.items():
        n = len(next(iter(calls.values())))
        carries = {s: sum(all(a is not None for a in g) and any(a > 0 for a in g) for g in gts) for s, gts in calls.items()}
        free = sorted((s for s in calls if not carries[s]), key=lambda s: ((s * 1103515245 + 12345) % 2**31, s))
        for s in sorted(calls):
            if not carries[s]:
                continue
            out[region, s] = None
            if carries[s] > most:
                continue
            if carries[s] < n:
                free = []
            while free:
                c = free.pop(0)
                if all(a is not None for g in calls[c] for a in g):
                    out[region, s] = c
                    break
    return out


def test_case_matching(spark):
    r = random.Random(6)
    records = {g: {s: [r.choice([[0, 0], [0, 0], [0, 1], [0, None]]) for _ in range(n)] for s in range(8)} for g, n in ((g, r.choice([1, 1, 2, 3])) for g in range(60))}
    rows = [(f"g{g}", f"v{i}", f"s{s}", s, gt) for g, calls in records.items() for s, gts in calls.items() for i, gt in enumerate(gts)]
    df = spark.createDataFrame(rows, "region string, variant_id string, sample string, place bigint, gt array<int>")
    matched = variants.case_matching(df)
    got = {(x.region, x.sample): x.control for x in matched.collect()}
    want = slow_matching(records, 2)
    assert got == {(f"g{g}", f"s{s}"): None if c is None else f"s{c}" for (g, s), c in want.items()} and any(got.values())
    c = {x.sample: x for x in variants.match_counters(matched).collect()}
    assert sum(x.matching_ref_records for x in c.values()) == sum(x.ref_records for x in c.values()) > 0


def test_region_images(spark):
    rows = [("p", 99, "c", 10, 60, "10M", "=", 30, 30, "ACGTACGTAC", [30] * 10, {}), ("p", 147, "c", 30, 60, "10M", "=", 10, -30, "ACGTACGTAC", [30] * 10, {}), ("q", 0, "c", 200, 60, "10M", "*", 0, 0, "ACGTACGTAC", [30] * 10, {})]
    df = spark.createDataFrame(rows, "qname string, flag int, contig string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen int, seq string, qual array<int>, tags map<string,string>")
    regions = spark.createDataFrame([("r", "c", 5, 45, "ACGT" * 10), ("s", "c", 300, 340, "ACGT" * 10)], "region string, contig string, start bigint, end bigint, sequence string")
    whole = reads.with_region(reads.primary(df))
    assert {(x.region, x.qname) for x in reads.in_regions(whole, regions).collect()} == {("r", "p")}
    pairs = reads.insert_sizes(reads.fragments(whole), 30.0, 5.0).withColumn("contig", F.lit("c"))
    assert [(x.region, x.start, x.end) for x in reads.clipped_inserts(pairs, regions).collect()] == [("r", 20, 30)]
    img = reads.region_images(df, regions, 30.0, 5.0, Pileup(height=4), read_length=10).collect()
    assert {x.region for x in img} == {"r"} and {x.col for x in img} == set(range(5, 15)) | set(range(25, 35))
    small = reads.region_images(df, regions, 30.0, 5.0, Pileup(height=4), read_length=10, size=(2, 8)).collect()
    assert {(x.row, x.col) for x in small} <= {(a, b) for a in range(2) for b in range(8)} and all(len(x.channels) == 8 for x in small)


HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=c>", '##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="x">', '##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="y">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="z">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty"]


def records_of(spark, tmp_path):
    body = ["c\t5\t.\tA\tC\t7\tPASS\tIMPRECISE=1;SVLEN=3\tGT\t0|1\t0/0", "c\t9\t.\tA\t*\t.\t.\tSVLEN=1\tGT\t0/1\t./1", "c\t12\t.\tACG\tA\t.\t.\t.\tGT\t0/1\t0/0"]
    (tmp_path / "a.vcf").write_text("\n".join([*HEAD, *body]) + "\n")
    return vcf.read(spark, str(tmp_path / "a.vcf"))


def test_predictions_as_vcf(spark, tmp_path):
    records = records_of(spark, tmp_path)
    ids = {r.pos: r.variant_id for r in records.collect()}
    predicted = spark.createDataFrame([(ids[4], [0, 1], [0.123456, 2.0]), (ids[11], [None, 1], [])], "variant_id string, gt array<int>, metrics array<double>")
    vcf.write_predictions(records, predicted, str(tmp_path / "p.vcf"), HEAD, "new")
    lines = [r.value for r in spark.read.text(str(tmp_path / "p.vcf")).collect()]
    assert not any("ID=DP" in x for x in lines) and sum(x.startswith("##FORMAT") for x in lines) == 2
    assert [x for x in lines if x.startswith("#CHROM")] == ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tnew"]
    assert [x.split("\t")[1:2] + x.split("\t")[8:] for x in lines if not x.startswith("#")] == [["5", "GT:MT", "0/1:0.1235,2.0"], ["12", "GT:MT", "./1:."]]


def test_flags_and_subsets_of_info(spark, tmp_path):
    records = records_of(spark, tmp_path)
    assert vcf.flags(HEAD) == ["IMPRECISE"]
    fixed = {r.pos: r.info for r in vcf.with_flags(records, vcf.flags(HEAD)).collect()}
    assert fixed[4] == {"IMPRECISE": None, "SVLEN": "3"} and fixed[11] is None
    assert {r.pos: r.info for r in vcf.info_subset(records, ["SVLEN"]).collect()} == {4: {"SVLEN": "3"}, 8: {"SVLEN": "1"}, 11: None}
    assert "IMPRECISE;SVLEN=3" in vcf.lines(vcf.with_flags(records, ["IMPRECISE"]), ["x"]).where("pos = 4").first().line


def test_records_inside_a_region_and_calls(spark, tmp_path):
    records = records_of(spark, tmp_path).withColumn("b", F.lit(3)).withColumn("e", F.lit(30))
    assert {r.pos for r in variants.inside(records, "b", "e").collect()} == {4, 11}  # `*` alone is left out
    assert {r.pos for r in variants.inside(records.withColumn("e", F.lit(14)), "b", "e").collect()} == {4}
    calls = {(r.pos, r.sample): (r.gt, r.kind, r.sample_at) for r in variants.sample_calls(records).collect()}
    assert calls[4, "x"] == ([0, 1], "global", 0) and calls[8, "y"][0] == [None, 1] and calls[11, "y"] == ([0, 0], "implicit", 1)
    wide = variants.with_samples(records, ["z", "x"]).where("pos = 4").first().samples
    assert [(s.name, s.gt) for s in wide] == [("z", [None, None]), ("x", [0, 1])]


def test_gfa_holds_the_graph(spark):
    from strandlake.plans import driver, graph_queries
    from strandlake.plans.registry import Tables
    from strandlake.tuning import cut

    folder = "/root/testdata/sf0.001"
    g = cut(graphs.build(*graph_queries.region_tables(Tables(spark, folder))))
    lines = [(r.region, r.line.split("\t")) for r in driver.QUERIES["graph_gfa"](spark, folder).collect()]
    assert {(r, int(x[1]), x[2]) for r, x in lines if x[0] == "S"} == {(n.region, n.node, n.seq or "*") for n in graphs.nodes(g).collect()}
    assert {(r, int(x[1]), int(x[3])) for r, x in lines if x[0] == "L"} == {(e.region, e.src, e.dst) for e in graphs.edges(g).collect()}
    steps: dict = {}
    for s in graphs.path_steps(g).orderBy("region", "path", "step").collect():
        steps.setdefault((s.region, s.path), []).append(f"{s.node}+")
    assert {(r, x[1]): x[2].split(",") for r, x in lines if x[0] == "P" and x[2]} == steps
    assert all(x[2:] == ["+", x[3], "+", "0M"] for _, x in lines if x[0] == "L")


def test_workload_of_regions(spark):
    from strandlake.config import Kmers
    from strandlake.operators import haplotypes
    from strandlake.operators.region_graph import RegionGraph
    from strandlake.plans import graph_queries
    from strandlake.plans.registry import Tables

    regions, records = graph_queries.region_tables(Tables(spark, "/root/testdata/sf0.001"))
    cfg = Kmers(k=9, max_edges=5)
    whole = {r.region: (r.walks, r.within) for r in haplotypes.workload(regions, records, cfg, 100_000).collect()}
    assert len(whole) == regions.count() and all(n > 300 and ok for n, ok in whole.values())
    least = min(n for n, _ in whole.values())
    cut_off = {r.region: (r.walks, r.within) for r in haplotypes.workload(regions, records, cfg, least).collect()}
    assert cut_off == {k: (least, n == least) for k, (n, _) in whole.items()}
    plain = RegionGraph("c", 0, 12, "ACGTACGTACGT", [], True)
    assert sum(1 for _ in plain.kmers(9, 5)) == 4
