"""Region graphs, samplers and the top-k plan against literal cases and brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import Kmers, Pileup, Scores
from strandlake.operators import graphs, haplotypes
from strandlake.operators.region_graph import Allele, Record, RegionGraph, reverse_complement
from strandlake.operators.sampler import Automaton, Sampler
from strandlake.plans.topk import RESULT, topk
from strandlake.sources import fasta, vcf


def allele(pos: int, ref: str, alt: str) -> Allele | None:
    """An ALT without its padding, by hand: shared ends off the right first, then the left."""
    if alt == "*":
        return None
    r = 0
    if len(ref) > 1 and len(alt) > 1:
        while r < min(len(ref), len(alt)) - 1 and ref[-1 - r] == alt[-1 - r]:
            r += 1
    n = 0
    while n < min(len(ref), len(alt)) - r and ref[n] == alt[n]:
        n += 1
    return Allele(pos + n, pos + len(ref) - r, alt[n : len(alt) - r], len(alt) - len(ref))


def record(name: str, pos: int, ref: str, alts: list[str], gt: str = "", ps: int | None = None) -> Record:
    out = [allele(pos, ref, a) for a in alts]
    known = [a for a in out if a]
    start = min((a.start for a in known), default=pos)
    end = max((a.end for a in known), default=pos + len(ref))
    r = Record(name, start, end, out)
    if gt:
        numbers = [None if g == "." else int(g) for g in gt.replace("|", "/").split("/")]
        kind = ("local" if ps is not None else "global") if "|" in gt else "implicit" if len(set(numbers)) == 1 else "unphased"
        r.gts, r.phases = {"Sample": numbers}, {"Sample": (kind, ps)}
    return r


def spelled(g: RegionGraph, sample: str = "Sample") -> list[list[str]]:
    return [[g.sequence(s) for s in segments] for segments in g.haplotypes(sample)]


#: Calls of two neighbouring records and how many segments each haplotype has.
TRANSITIONS = [
    ("0/1", None, "0/1", None, 2),
    ("0/1", None, "0|1", None, 2),
    ("0/1", None, "0|1", 1000001, 2),
    ("0/1", None, "1/1", None, 1),
    ("0|1", None, "0/1", None, 2),
    ("0|1", None, "0|1", None, 1),
    ("0|1", None, "0|1", 1000001, 2),
    ("0|1", None, "1/1", None, 1),
    ("0|1", 1000000, "0/1", None, 2),
    ("0|1", 1000000, "0|1", None, 2),
    ("0|1", 1000000, "0|1", 1000000, 1),
    ("0|1", 1000000, "0|1", 1000001, 2),
    ("0|1", 1000000, "1/1", None, 1),
]


@pytest.mark.parametrize("gt1,ps1,gt2,ps2,n", TRANSITIONS)
def test_phase_transitions(gt1, ps1, gt2, ps2, n):
    ref = "ACGTACGTACGGACGTACGTA"
    g = RegionGraph("chr1", 100, 121, ref, [record("a", 110, "G", ["A"], gt1, ps1), record("b", 111, "G", ["C"], gt2, ps2)])
    assert [len(h) for h in g.haplotypes("Sample")] == [n, n]


def test_star_allele_is_phased_by_the_deletion():
    ref = "GATTCCGTTGCCAAAAAAAAGA"
    records = [record("d", 9, "GCC", ["G"], "0/1"), record("i", 10, "C", ["CAAAAAAAAAA", "*"], "1/2")]
    g = RegionGraph("chr14", 0, len(ref), ref, records)
    assert spelled(g) == [["GATTCCGTTGCAAAAAAAAAACAAAAAAAAGA"], ["GATTCCGTTGAAAAAAAAGA"]]


def test_star_alleles_are_exchanged_where_that_helps():
    deleted = "CGGGCATCTATGATGCTGATTGATGTCCCCAGCATCCCGGGCATCTATGATGCTGATTGATGTCCCCAGCATCCCG"
    ref = "CCCAGCATCC" + deleted + "GGCATCTATG"[:10]
    records = [record("d", 10, deleted, ["C"], "0/1"), record("s", 10 + len(deleted) - 2, "CG", ["*", "C"], "1/2")]
    g = RegionGraph("chr1", 0, len(ref), ref, records)
    one, two = spelled(g)
    assert one == [ref[:84] + "C" + ref[86:]] and two == ["CCCAGCATCC" + "C" + ref[86:]]


def random_graph(r: random.Random, n: int = 4, size: int = 60) -> RegionGraph:
    ref = "".join(r.choice("ACGT") for _ in range(size))
    records, at = [], 3
    for i in range(n):
        length = r.randint(1, 5)
        a = ref[at : at + length]
        alts = sorted({a[0] + "".join(r.choice("ACGT") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 2))} - {a})
        if alts:
            records.append(record(f"v{i}", at, a, alts))
        at += r.randint(1, 8)
        if at > size - 10:
            break
    return RegionGraph("c", 0, size, ref, records)


def all_walks(g: RegionGraph) -> list[list[int]]:
    out, todo = [], [[1]]
    while todo:
        w = todo.pop()
        if w[-1] == g.size:
            out.append(w)
        todo += [[*w, m] for m in g.next[w[-1]]]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_graph_against_all_walks(seed):
    g = random_graph(random.Random(seed))
    assert all(b > a for a, b in g.edges())
    walks = all_walks(g)
    assert g.reference_path in walks
    reach = g.reachable()
    together = {(a, b) for w in walks for i, a in enumerate(w) for b in w[i:]}
    assert all((a, b) in together for a in range(1, g.size + 1) for b in range(1, g.size + 1) if reach[a] >> b & 1)
    k = 5
    # A k-mer is unique if no walk spells it from two places.
    unique = g.unique_kmers(k, 50)
    for w in walks:
        starts: dict[str, set] = {}
        text = "".join(f"{c}" for n in w for c in g.seq[n])
        places = [(n, i) for n in w for i in range(len(g.seq[n]))]
        for i in range(len(text) - k + 1):
            starts.setdefault(text[i : i + k], set()).add(places[i])
        assert all(len(starts[x]) == 1 for x in unique if x in starts)
    spelled_kmers = {"".join(g.seq[n] for n in w)[i : i + k] for w in walks for i in range(len("".join(g.seq[n] for n in w)) - k + 1)}
    assert set(unique) <= spelled_kmers
    assert {x for x, _, _ in g.kmers(k, 50)} == spelled_kmers
    cheapest = min(sum(len(g.seq[n]) for n in w) for w in walks)
    assert sum(len(g.seq[n]) for n in g.backbone()) == cheapest
    sets = {frozenset().union(*(g.marks[n] for n in w)) for w in walks}
    assert len(g.representatives()) == len(sets)


@pytest.mark.parametrize("seed", range(6))
def test_beam_finds_the_best_walks(seed):
    r = random.Random(100 + seed)
    g = random_graph(r)
    unique = g.unique_kmers(4, 50)
    zygosity = {x: r.choice(["absent", "heterozygous", "homozygous", "frequent"]) for x in unique}
    s = Sampler(g, unique, zygosity)
    best: dict[frozenset, float] = {}
    for w in all_walks(g):
        covered = frozenset().union(*(g.marks[n] for n in w))
        best[covered] = max(best.get(covered, -1e9), s.path_score(w))
    for n in (1, 3, 5):
        found = s.best(n)
        assert [round(w.score, 9) for w in found] == [round(x, 9) for x in sorted(best.values(), reverse=True)[:n]]
        assert all(abs(w.score - s.path_score(w.path())) < 1e-9 for w in found)
    chosen = s.haplotypes(4)
    assert len({frozenset().union(*(g.marks[n] for n in w)) for w in chosen}) == len(chosen)
    pairs = s.diplotypes(chosen, 100)
    assert len(pairs) == len(chosen) * (len(chosen) + 1) // 2
    on = [s.automaton.on_path(w) for w in chosen]
    expected = {"absent": 0, "heterozygous": 1, "homozygous": 2}
    for i, j, score in pairs:
        assert score == sum(1 - abs((k in on[i]) + (k in on[j]) - expected[z]) for k, z in enumerate(s.zygosity) if z in expected)


def test_scores_change_with_the_choice():
    g = RegionGraph("c", 0, 20, "ACGTTGCAACGGTCATTGCA", [record("v", 8, "A", ["ATTTT"])])
    unique = g.unique_kmers(5, 10)
    s = Sampler(g, unique, dict.fromkeys(unique, "homozygous"), scores=Scores())
    first = s.haplotypes(1)[0]
    on = s.automaton.on_path(first)
    assert all(abs(x - (0.9 if k in on else 1.0)) < 1e-12 for k, x in enumerate(s.score))


def test_automaton_finds_all_runs():
    places = [[((1, 2), 0)], [((2,), 0)], [((1, 2, 3), 0)], [((3, 4), 0), ((2, 3, 4), 0)]]
    a = Automaton(places)
    for path in itertools.product([1, 2, 3, 4], repeat=5):
        want = {k for k, where in enumerate(places) for p, _ in where if any(path[i : i + len(p)] == p for i in range(5))}
        assert a.on_path(list(path)) == want


def test_universal_and_canonical_kmers():
    ref = "AAACCCGGGTTTACGTAGCTAGCATCG"
    g = RegionGraph("c", 0, len(ref), ref, [record("v", 12, "A", ["T"])])
    all_, some = g.unique_kmers(6, 10), g.unique_kmers(6, 10, exclude_universal=True)
    inside = {ref[i : i + 6] for i in range(7, 13)} | {(ref[:12] + "T" + ref[13:])[i : i + 6] for i in range(7, 13)}
    assert set(some) == set(all_) & inside
    assert all(x <= reverse_complement(x) for x in g.unique_kmers(6, 10, canonical=True))
    gone = g.unique_kmers(6, 10, reference_counts={ref[0:6]: 1, ref[1:7]: 2, "TTTTTC": 1})
    assert ref[0:6] in gone and ref[1:7] not in gone


def test_multiallelic_alleles_are_not_chained():
    ref = "ACGTACGTACGTACGT"
    r = record("m", 4, "ACGT", ["AC", "ACGTTT", "AGT"])
    loose, strict = RegionGraph("c", 0, 16, ref, [r], False), RegionGraph("c", 0, 16, ref, [r], True)
    assert set(strict.edges()) <= set(loose.edges())
    lines = list(strict.gfa(["none"]))
    assert lines[0].startswith("H") and sum(x.startswith("S") for x in lines) == strict.size


HEADER = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "##contig=<ID=chr2,length=3000>", "##contig=<ID=chr1,length=3000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A reference of two contigs and a VCF with a homozygous deletion, a heterozygous insertion, and a small record."""
    r = random.Random(9)
    seq = {c: "".join(r.choice("ACGT") for _ in range(3000)) for c in ("chr1", "chr2")}
    folder = tmp_path_factory.mktemp("world")
    inserted = "".join(r.choice("ACGT") for _ in range(70))
    rows = [
        ("chr1", 1000, seq["chr1"][1000:1081], [seq["chr1"][1000]], "1|1", "0|1"),
        ("chr1", 1300, seq["chr1"][1300], ["ACGT"[("ACGT".index(seq["chr1"][1300]) + 1) % 4]], "0|1", "0|0"),
        ("chr2", 500, seq["chr2"][500], [seq["chr2"][500] + inserted, seq["chr2"][500] + inserted[:30] + inserted[35:]], "0|1", "1|2"),
    ]
    text = "\n".join([*HEADER, *(f"{c}\t{p + 1}\t.\t{ref}\t{','.join(alts)}\t30\tPASS\t.\tGT\t{a}\t{b}" for c, p, ref, alts, a, b in rows)]) + "\n"
    (folder / "in.vcf").write_text(text)
    (folder / "ref.fa").write_text("".join(f">{c} a contig\n" + "\n".join(s[i : i + 60] for i in range(0, 3000, 60)) + "\n" for c, s in seq.items()))
    return folder, seq, inserted, rows


def test_topk_plan(spark, world):
    folder, seq, inserted, rows = world
    records = vcf.read(spark, str(folder / "in.vcf"))
    reference = fasta.read(spark, str(folder / "ref.fa"))
    # Counts as sample A would have them: both copies of the deletion, one of the insertion.
    k = 15
    depth: dict[str, int] = {}
    for hap in (0, 1):
        for c in ("chr1", "chr2"):
            s = seq[c]
            if c == "chr1":
                snv = rows[1][3][0] if hap else s[1300]
                s = s[:1001] + s[1081:1300] + snv + s[1301:]
            elif hap:
                s = s[:501] + inserted + s[501:]
            for i in range(len(s) - k + 1):
                depth[s[i : i + k]] = depth.get(s[i : i + k], 0) + 10
    counts = spark.createDataFrame(list(depth.items()), "kmer string, cnt bigint")
    got = topk(records, reference, counts, "A", 20.0, Kmers(k=k), Pileup()).toPandas().set_index("variant")
    assert sorted(got.reset_index().columns) == sorted(RESULT) and len(got) == 2
    deletion = got[got.region.str.startswith("chr1:")].iloc[0]
    assert deletion.region == "chr1:902-1181"
    assert list(deletion.haplotype_idxs) == [0, 0] and deletion.diplotype_idx == 0 and deletion.true_diplotype_idx == 0
    assert deletion.haplotypes == 2 and deletion.diplotypes == 3
    insertion = got[got.region.str.startswith("chr2:")].iloc[0]
    assert insertion.haplotypes == 3 and insertion.diplotypes == 6
    assert insertion.diplotype_idx == 0 and insertion.all_diplotype_idx == 0 and sorted(insertion.true_haplotype_idxs) == sorted(insertion.haplotype_idxs)


def test_graph_tables(spark, world):
    folder, seq, _, _ = world
    records = vcf.read(spark, str(folder / "in.vcf"))
    regions = spark.createDataFrame([("r", "chr1", 900, 1400, seq["chr1"][900:1400])], "region string, contig string, start bigint, end bigint, sequence string")
    g = graphs.build(regions, records).cache()
    steps, nodes = graphs.path_steps(g), graphs.nodes(g)
    text = {r["path"]: r["sequence"] for r in graphs.path_sequences(steps, nodes).collect()}
    assert text["chr1"] == seq["chr1"][900:1400]
    assert text["A#0#chr1#0"] == seq["chr1"][900:1001] + seq["chr1"][1081:1400]
    assert {r["sample"] for r in graphs.samples_including(steps, graphs.allele_nodes(steps)).collect()} == {"A", "B"}
    whole = graphs.haplotype_nodes(steps).where("sample = 'B' AND haplotype = 0").first()["nodes"]
    ref = [r["node"] for r in steps.where("kind = 'reference'").orderBy("step").collect()]
    assert whole == ref
    closed = {(r["src"], r["dst"]) for r in graphs.reachability(graphs.edges(g), ["region"], 16).collect()}
    assert (ref[0], ref[-1]) in closed
    assert graphs.gfa_lines(g).where(F.startswith("line", F.lit("P\t"))).count() == g.select(F.size("paths")).first()[0]


def test_vcf_round_trip(spark, world, tmp_path):
    folder, _, _, rows = world
    records = vcf.read(spark, str(folder / "in.vcf"))
    head = vcf.header(spark, str(folder / "in.vcf"))
    assert vcf.sample_names(head) == ["A", "B"] and vcf.contigs(head) == ["chr2", "chr1"]
    vcf.write(records, str(tmp_path / "out.vcf"), head)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out.vcf")).collect()]
    assert lines[: len(HEADER)] == HEADER and [x.split("\t")[0] for x in lines[len(HEADER) :]] == ["chr2", "chr1", "chr1"]
    (tmp_path / "again.vcf").write_text("\n".join(lines) + "\n")
    key = ["contig", "pos", "ref", "alts", "qual", "filters", "variant_id", "start", "end"]
    again = vcf.read(spark, str(tmp_path / "again.vcf"))
    assert sorted(map(str, again.select(*key, "samples").collect())) == sorted(map(str, records.select(*key, "samples").collect()))
    chosen = records.selectExpr("variant_id", "explode(array('A', 'B')) AS sample").where("sample = 'A' OR variant_id IS NOT NULL")
    vcf.write_by_sample(records, str(tmp_path / "split"), head, chosen)
    b = spark.read.text(str(tmp_path / "split" / "sample=B")).collect()
    assert len(b) == 3 and all(len(r["value"].split("\t")) == 10 for r in b)
    assert vcf.read(spark, str(folder / "in.vcf"), ["B"]).select(F.size("samples")).distinct().collect()[0][0] == 1


def test_formats():
    assert vcf.detect_format("x.vcf.gz") == "vcf" and vcf.detect_format("x.bcf") == "bcf"
    with pytest.raises(ValueError):
        vcf.detect_format("x.txt")


def test_symbolic_alleles_are_refused(spark, tmp_path):
    (tmp_path / "s.vcf").write_text("\n".join([*HEADER, "chr1\t10\t.\tA\t<DEL>\t.\t.\t.\tGT\t0/1\t0/0"]) + "\n")
    with pytest.raises(Exception, match="symbolic"):
        vcf.read(spark, str(tmp_path / "s.vcf")).collect()


def test_sampling_without_kmers(spark, world):
    folder, seq, _, _ = world
    records = vcf.read(spark, str(folder / "in.vcf"))
    regions = spark.createDataFrame([("r", "chr1", 900, 1200, seq["chr1"][900:1200])], "region string, contig string, start bigint, end bigint, sequence string")
    none = spark.createDataFrame([], "region string, kmer string, places array<struct<nodes:array<bigint>,offset:int>>, zygosity string")
    row = haplotypes.sample(regions, records, none, Kmers(k=15), sample_name="A").first()
    assert len(row["haplotypes"]) == 2 and row["n_kmers"] == 0
