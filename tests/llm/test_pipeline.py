"""The stages against brute force, one after the other."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from strandlake.llm import exact_dedup, mixing, near_copies, quality_classifier
from strandlake.llm import simhash as simhash_

from .fixtures import SCHEMA, near_components, rows, sha, simhash, words


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = stage("quality classifier")(spark, docs, sf).cache()
    assert good.columns == docs.columns
    accepted = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(known[i] == 1 for i in accepted if i in known) or sum(known[i] == 0 for i in accepted if i in known) <= 2

    single = stage("exact dedup")(spark, good, sf).cache()
    by_text: dict = {}
    for r in good.collect():
        by_text[r.text] = max(by_text.get(r.text, r.doc_id), r.doc_id)
    assert Counter(r.doc_id for r in single.collect()) == Counter(by_text.values())

    far = stage("SimHash near-dedup")(spark, single, sf).cache()
    assert Counter(r.doc_id for r in far.collect()) == Counter(alike([(r.doc_id, r.text) for r in single.collect()]))

    mixed = stage("mixing")(spark, far, sf).cache()
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(far).collect():
        want[r.doc_id] += len(r.draws)
    assert Counter(r.doc_id for r in mixed.collect()) == +want

    last = stage("byte-level BPE")(spark, mixed, sf).collect()
    assert len(last) == mixed.count()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) for r in last)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_on_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def alike(docs: list[tuple]) -> list:
    """The ids that stay when of each component of similarity 0.8 or more the smallest does."""
    sets = []
    for _, t in docs:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] == docs[j][1] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least: dict = {}
    for i, (x, _) in enumerate(docs):
        least.setdefault(root[i], []).append((x is None, x))
    return [min(v)[1] for v in least.values()]


def copies() -> list[tuple]:
    """Random texts of 6 to 1500 words with copies at similarities around 0.8, chains of copies, and a large family."""
    r = random.Random(3)
    made = []
    for i in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 25, 60, 300, 1500]))]
        for k in range(3):
            made.append((10 * i + k, " ".join(w)))
            step = 20 + 3 * i
            w = [f"x{r.randrange(5000)}" if j % step == step // 2 else x for j, x in enumerate(w)]
    w = [f"v{r.randrange(5000)}" for _ in range(150)]
    for i in range(150):
        rate = r.choice([0.0, 0.01, 0.02, 0.05])
        made.append((1000 + i, " ".join(f"y{r.randrange(5000)}" if r.random() < rate else x for x in w)))
    r.shuffle(made)
    return made


def test_near_copies_at_similarity_0_8_are_dropped(spark, tmp_path):
    made = copies()
    want = alike(made)
    assert len({simhash(t) for _, t in made}) > len(want) > 100
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    near = stage("SimHash near-dedup")
    # A table and a scan of files, which are told apart.
    for d in (docs, spark.read.parquet(f"{tmp_path}/d.parquet")):
        assert sorted(r.doc_id for r in near(spark, d, "").collect()) == sorted(want)


def test_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "A_TASK", 3000)
    made = copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == sorted(alike(made))


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash_, "CROWDED", 40)
    made = copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == sorted(alike(made))
    got = {r.doc_id: r.component_id for r in simhash_.near_duplicates(docs).collect()}
    ids = [i for i, _ in made]
    assert got == dict(zip(ids, near_components(ids, [simhash(t) for _, t in made]), strict=True))


def test_recall_is_that_of_the_shape():
    """Pairs of similarity 0.8 share a variant of some short fingerprint as often as `shape` says."""
    r = np.random.default_rng(5)
    for n in (1000, 10**6):
        bits, tables = near_copies.shape(n)
        met = 0
        for _ in range(400):
            h = r.integers(0, 2**63, 1000, np.int64).view(np.uint64)
            two = near_copies.signatures([h[:900], h[100:]], -(-bits * tables // 64))[:, : bits * tables].reshape(2, tables, bits)
            met += bool(((two[0] != two[1]).sum(axis=1) <= 2).any())
        assert met >= 392


def test_stages_drop_the_same_rows_of_files_and_tables(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(f"{tmp_path}/d.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    files = spark.read.parquet(f"{tmp_path}/d.parquet")
    table = spark.createDataFrame(files.collect(), SCHEMA)
    for f in (lambda d: quality_classifier.drop_rejected(d, labels), exact_dedup.drop_duplicates, near_copies.drop_near_copies):
        one, two = f(files), f(table)
        assert one.columns == two.columns == files.columns
        assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter((r.doc_id, r.text) for r in two.collect())
