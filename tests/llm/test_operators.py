"""Every operator against a brute-force version, over documents with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import groupby

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe, exact_dedup, language_id, mixing, near_copies, pii, quality_classifier, quality_rules, simhash, token_counts, warc

from .fixtures import SCHEMA, held, near_components, rows, sha, words
from .fixtures import simhash as slow_simhash

BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 8 > 1), 0) for i in range(60)] + [(None, 1, 0), (5, None, None), (7, 1, 1), (7, 0, 1)], "doc_id bigint, quality int, toxic int")


def looked_up(pages, id_col, url_col, html_col):
    """The captures of all of `pages`, each found by its URL."""
    folder = warc.new_folder(pages.sparkSession)
    return warc.lookup(warc.index(warc.write(pages, folder, id_col, url_col, html_col), folder), pages, url_col)


OPERATORS = {
    "classify": lambda d, labels: quality_classifier.classify(d, labels),
    "rules": lambda d, _: quality_rules.apply_policy(quality_rules.ledger(d)),
    "languages": lambda d, _: language_id.identify(d),
    "pii": lambda d, _: pii.find(d),
    "tokens": lambda d, _: token_counts.token_counts(d, PIECES),
    "bpe": lambda d, _: byte_bpe.digests(d, *BPE),
    "ids": lambda d, _: byte_bpe.encode(d, *BPE),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "mix": lambda d, _: mixing.mix(d),
    "exact": lambda d, _: exact_dedup.exact_dedup(d),
    "drop rejected": lambda d, labels: quality_classifier.drop_rejected(d, labels),
    "drop copies": lambda d, _: exact_dedup.drop_duplicates(d),
    "drop near copies": lambda d, _: simhash.drop_near_duplicates(d),
    "drop copies by shingles": lambda d, _: near_copies.drop_near_copies(d),
    "mixed": lambda d, _: mixing.mixed(d),
    "captures": lambda d, _: warc.write(d, warc.new_folder(d.sparkSession), "doc_id", "source", "text"),
    "records": lambda d, _: warc.read(looked_up(d, "doc_id", "source", "text"), payloads=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, labels, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](empty, labels).count() == 0
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


def _plain(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "captures"])
def test_extra_columns_with_clashing_names(docs, labels, name):
    one = OPERATORS[name](docs, labels)
    extra = ["TEXT", "f", "fp", "h", "s", "l", "b", "w", "t", "score", "kept", "digest", "size", "draws", "__size", "__source", "__h", "__id", "__sha", "sha", "hash", "text_hash", "c0", "a b", "x.y"]
    more = docs.select("*", *[F.lit(7).alias(c) for c in extra])
    two = OPERATORS[name](more, labels)
    if name.startswith("drop") or name == "mixed":
        assert two.columns == more.columns
        two = two.toDF(*[f"c{i}" for i in range(len(two.columns))])
        assert two.where(" OR ".join(f"c{i} <> 7" for i in range(5, len(two.columns)))).count() == 0
        two = two.select(*two.columns[:5])
    assert _plain(one) == _plain(two)


@pytest.mark.parametrize("name", ["classify", "rules", "languages", "pii", "tokens", "bpe", "simhash", "mix", "exact"])
def test_one_row_for_each_document(docs, labels, name):
    got = OPERATORS[name](docs, labels)
    assert Counter(r[0] for r in got.select("doc_id").collect()) == Counter(r[0] for r in rows())


def test_classifier(docs, labels):
    got = quality_classifier.classify(docs, labels).collect()
    for r in got:
        assert r.held_out == held(r.doc_id, 5, 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert len({r.score for r in got if r.doc_id is not None and r.doc_id < 60}) > 10


def test_classifier_against_a_plain_discriminant(docs, labels):
    import numpy as np

    known: dict = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality in (0, 1) and not held(r.doc_id, 5, 0):
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.quality)
    x = {c: np.array([quality_classifier.statistics(t) for i, t, *_ in rows() if known.get(i) == c]) for c in (0, 1)}
    total = sum(map(len, x.values()))
    spread = {c: np.cov(v, rowvar=False, bias=True) for c, v in x.items()}
    pooled = sum(len(x[c]) / total * spread[c] for c in x)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))

    def density(v, c):
        cov = 0.9 * spread[c] + 0.1 * pooled
        d = v - x[c].mean(axis=0)
        return -0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]) + np.log(len(x[c]) / total)

    want = Counter()
    for i, t, *_ in rows():
        v = np.array(quality_classifier.statistics(t))
        want[i, round(float(1 / (1 + np.exp(-np.clip(density(v, 1) - density(v, 0), -500, 500)))), 5)] += 1
    assert Counter((r.doc_id, round(r.score, 5)) for r in quality_classifier.classify(docs, labels).collect()) == want


def test_classifier_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.classify(d, known).join(known, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_classifier_with_one_class_or_none(docs, labels):
    assert {r.score for r in quality_classifier.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def slow_rules(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rules(docs):
    book = quality_rules.ledger(docs).cache()
    want = Counter((r[0], *slow_rules(r[1])) for r in rows())
    assert Counter(map(tuple, book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())) == want
    for r in quality_rules.apply_policy(book).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_ablation(docs):
    book = quality_rules.ledger(docs).cache()
    bits = [r.fail_bits for r in book.collect()]
    mask = quality_rules.POLICIES["v2"]
    for r in quality_rules.ablate(book, "v2").collect():
        assert (r.n, r.failed) == (len(bits), sum(bool(b & r.bit) for b in bits))
        assert r.kept_without == sum(not b & mask & ~r.bit for b in bits)


def test_languages(docs):
    for r in language_id.identify(docs).collect():
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1
        text = next(x[1] for x in rows() if x[0] == r.doc_id)
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "fr", "de"}


def test_whole_language_sample_among_empty_rows(spark):
    rare = spark.range(40).selectExpr("id AS doc_id", "'xx' AS lang", "concat('words of it ', id) AS text")
    empty = spark.range(1000, 101000).selectExpr("id AS doc_id", "'xx' AS lang", "'12 !' AS text")
    ((lang, text),) = language_id.sample(rare.union(empty), F.lit(True))
    assert lang == "xx" and text.count("words of it") == 40


def test_language_sample_takes_whole_rows(spark):
    made = [(i, "xx", f"start{i} " + "wort " * 400 + f"end{i}") for i in range(9)] + [(50, "yy", "lang " * 300_000), (60, "zz", "kurz und gut")]
    made += [(100 + i, "xx", "12 !") for i in range(3000)]
    df = spark.createDataFrame(made, "doc_id bigint, lang string, text string")
    got = dict(language_id.sample(df, F.lit(True)))
    assert set(got) == {"xx", "yy", "zz"} and got["yy"] == made[9][2]
    assert all(made[i][2] in got["xx"] for i in range(9))


def test_language_of_long_words():
    samples = (("a", "donaudampfschifffahrt" * 10), ("b", "und so weiter"))
    found = language_id.Languages(samples)
    n, h = found.entropies(["donaudampfschifffahrt" * 10, ""])
    # Whole, the run of 210 letters and its borders are one phrase.
    assert n.tolist() == [210, 0] and abs(h[0][0] - found.bits[0] / 210) < 1e-9 and h[0][1] > 1


def test_phrases_are_greedy_longest_matches():
    samples = (("a", "der die das und nicht"), ("b", "the and that not under"))
    got = language_id.Languages(samples).phrases(list_ := ["der", "under", "xyz", "thatdas", "d", "ünd"])
    for k, (_, t) in enumerate(samples):
        t = f" {t} "
        for w, n in zip(list_, got[:, k].tolist(), strict=True):
            s, i, want = f" {w} ", 0, 0
            while i < len(s):
                j = i
                while j < len(s) and s[i : j + 1] in t:
                    j += 1
                want, i = want + 1, max(j, i + 1)
            assert n == want


def test_language_accuracy_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def slow_spans(text):
    text = text or ""
    out = [(0, *m.span()) for m in pii.EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(docs):
    texts = {r[0]: r[1] for r in rows()}
    for r in pii.find(docs).collect():
        want = slow_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
    assert pii.base_spans(texts[308]) == slow_spans(texts[308]) and len(slow_spans(texts[308])) == 4


def test_pii_patterns_on_random_text():
    import random

    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("a1.@+-() 9%\n25") for _ in range(50))
        assert pii.base_spans(t) == slow_spans(t)


def test_crf_finds_what_the_patterns_miss():
    model = pii.fitted()
    for text, kind, span in [("write to erin [at] mail [dot] com now", "email", "erin [at] mail [dot] com"), ("call (555) 123-4567 today", "phone", "(555) 123-4567"), ("card 4539.5787.6362.1486 was", "card", "4539.5787.6362.1486")]:
        found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, model, pii.base_spans(text))]
        assert found == [(kind, span)]
    for text in ["on 2021-03-14 at 10:30 for 12.50", "version 1.2.3 of 1234 things", "the key 9742a250774262d69ad6a86100194aaf"]:
        assert not pii.added_spans(text, model, pii.base_spans(text))


def test_crf_windows_equal_the_whole_text():
    import random

    model, r = pii.fitted(), random.Random(9)
    text = "write to erin at mail dot com now"
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, model, [])] == [(0, "erin at mail dot com")]
    parts = ["the", "mail", "erin", "at", "DOT", "com", "[at]", "(dot)", "x(at)y.org", "555-123-4567", "call", "tel", "10", "a@b.de", "one", "two", "three", "four"]
    for _ in range(1500):
        text = r.choice(["", " "]) + "".join(r.choice(parts[:6] + parts[-4:] if r.random() < 0.8 else parts) + r.choice([" ", "  ", "\n"]) for _ in range(r.randint(1, 60)))
        w = pii.Window(text, [m.span() for m in re.finditer(r"\S+", text)])
        found = [s for x in pii.windows(text) for s in model.best(pii.Window(text, x))]
        assert abs(path_score(model, w, found) - path_score(model, w, model.best(w))) < 1e-9, text


def test_crf_against_all_segmentations():
    import random

    model, r = pii.fitted(), random.Random(4)
    parts = ["the", "mail", "erin", "at", "dot", "com", "[at]", "555-123-4567", "call", "10", "a@b.de", "4 4", "(555)"]

    def every(w, at, scores):
        if at == len(w.tokens):
            yield []
            return
        for rest in every(w, at + 1, scores):
            yield rest
        for j in range(at + 1, min(len(w.tokens), at + pii.MAX_TOKENS) + 1):
            if scores.get((at, j)) is not None:
                a, b, _ = w.spans[at, j]
                for rest in every(w, j, scores):
                    for k in range(4):
                        yield [(k, a, b), *rest]

    for _ in range(60):
        text = " ".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        w = pii.Window(text, [m.span() for m in re.finditer(r"\S+", text)])
        scores = {ij: model.scored(f) for ij, (_, _, f) in w.spans.items()}
        most = max(path_score(model, w, named) for named in every(w, 0, scores))
        assert abs(path_score(model, w, model.best(w)) - most) < 1e-9, text


def test_crf_leaves_prose_alone():
    model = pii.fitted()
    for text in ["He sat at home. Of course they did", "onharent.\nAt the end", "shre, at to ernded.\nHeatin", "look at this and that. So"]:
        assert not pii.added_spans(text, model, [])


def test_crf_on_a_long_table_of_numbers():
    import random
    import tracemalloc

    r = random.Random(1)
    text = " ".join(str(r.randrange(10 ** r.randint(1, 6))) for _ in range(30_000))
    model = pii.fitted()
    tracemalloc.start()
    pii.added_spans(text, model, [])
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def path_score(model, w, named):
    """The score of a segmentation of the whole text; segmentations may tie."""
    places = {(a, b): (i, j, f) for (i, j), (a, b, f) in w.spans.items()}
    total, at, label = 0.0, 0, 0
    for k, a, b in named:
        i, j, f = places[a, b]
        for _ in range(i - at):
            total, label = total + model.moves[label, 0], 0
        total, at, label = total + model.moves[label, k + 1] + model.scores(f)[k + 1], j, k + 1
    for _ in range(len(w.tokens) - at):
        total, label = total + model.moves[label, 0], 0
    return total


def test_token_counts(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in token_counts.token_counts(docs, PIECES).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_token_counts_on_random_text():
    import random

    r, s = random.Random(4), token_counts.shortcut(PIECES)
    assert s.separable
    for _ in range(3000):
        t = "".join(r.choice("ab the\n▁é.1<s>\t") for _ in range(r.randint(0, 40)))
        assert s.count(t) == len(s.model.encode(t))


def library_bpe():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=byte_bpe.codec(*BPE).ranks, special_tokens={})


def test_bpe(docs):
    library = library_bpe()
    texts = {r[0]: r[1] or "" for r in rows()}
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(docs, *BPE).collect()}
    for r in byte_bpe.digests(docs, *BPE).collect():
        want = library.encode_ordinary(texts[r.doc_id])
        assert ids[r.doc_id] == want and r.n_tokens == len(want)
        assert r.ids_sha256 == sha(",".join(map(str, want))) and r.decoded_sha256 == sha(texts[r.doc_id])


def test_bpe_on_random_words():
    import random

    r, c, library = random.Random(5), byte_bpe.codec(*BPE), library_bpe()
    odd = [bytes(r.choice(b"aabthein'") for _ in range(r.randint(1, 40))) for _ in range(3000)] + [b"a" * k for k in range(1, 100)] + [bytes(r.randrange(256) for _ in range(9)) for _ in range(2000)]
    ids, count = c.replay(odd)
    ends = count.cumsum()
    for w, a, b in zip(odd, ends - count, ends, strict=True):
        want = library._core_bpe.encode_single_piece(w)
        if w not in c.ranks:
            assert ids[a:b].tolist() == want == c.merge_one(w)


def test_simhash(docs):
    data = rows()
    prints = [slow_simhash(r[1]) for r in data]
    roots = near_components([r[0] for r in data], prints)
    want = Counter((r[0], p, c) for r, p, c in zip(data, prints, roots, strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert {roots[60 + i] for i in range(4)} == {100}


def test_simhash_keeps_one_of_each_component(docs):
    data = rows()
    roots = near_components([r[0] for r in data], [slow_simhash(r[1]) for r in data])
    want = Counter({r[0]: 1 for r, c in zip(data, roots, strict=True) if r[0] == c})
    assert Counter(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_simhash_crowded_bucket(spark):
    import random

    r = random.Random(6)
    centre = r.getrandbits(64)
    crowd = list({centre ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 5))) for _ in range(500)})
    pairs = simhash.links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in crowd], "fp bigint")).collect()
    assert all(((p.a ^ p.b) % (1 << 64)).bit_count() <= 4 for p in pairs)
    groups = near_components(crowd, crowd)
    root = {x: x for x in crowd}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        a, b = find(p.a % (1 << 64)), find(p.b % (1 << 64))
        root[max(a, b)] = min(a, b)
    assert [find(x) for x in crowd] == groups
    small = simhash.Buckets(10)
    whole = [(f >> 54 ^ m, f) for f in crowd for m in simhash.flips(0, 10, 2)]
    import numpy as np

    whole.sort()
    begin, fp = np.array([x for x, _ in whole], np.uint64), np.array([x for _, x in whole], np.uint64)
    before, simhash.UNPACKED = simhash.UNPACKED, 5000
    split = small.links(begin, fp)
    simhash.UNPACKED = before
    assert len(split) == len(small.links(begin, fp)) == len(crowd) - len(set(groups))


def slow_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


def test_mix(spark):
    data = rows() + [(400 + i, "few words here", "en", "aaa", 3) for i in range(3)] + [(500, "", "en", "empty", 0)]
    d = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(d).collect()
    sizes: dict = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    want = slow_targets(sizes)
    assert want["aaa"] == 27
    for s, g in groupby(sorted(got, key=lambda r: (r.source is None, r.source or "")), key=lambda r: r.source):
        g = list(g)
        assert {r.source_size for r in g} == {sizes[s]}
        assert all(abs(r.target - want[s]) < 1e-6 for r in g)
        assert all(r.taken <= 3 * r.size and r.taken == len(r.draws) * r.size for r in g)
        assert abs(sum(r.taken for r in g) - want[s]) <= max(r.size for r in g)
    again = mixing.mix(d.repartition(7)).collect()
    key = lambda r: str(r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(d).count() == sum(len(r.draws) for r in got)


def test_splitting_tree_keeps_quotas(spark):
    q = [40, 0, 7, 113]
    # All sources in one row, and one or two of them in each.
    for chunks in ([q], [q[:2], q[2:]], [[x] for x in q]):
        leaves = mixing.split_tree(spark.createDataFrame(list(enumerate(chunks)), "chunk bigint, q array<bigint>"), 4, 3).collect()
        whole = {k: [x for r in sorted(g, key=lambda r: r.chunk) for x in r.q] for k, g in groupby(sorted(leaves, key=lambda r: r.shard), key=lambda r: r.shard)}
        assert sorted(whole) == list(range(16))
        assert [sum(v[i] for v in whole.values()) for i in range(4)] == q
        assert all(x >= 0 for v in whole.values() for x in v)
        assert {sum(v) for v in whole.values()} == {10}


def test_splitting_tree_draws_without_bias(spark):
    """Of 30 and 10 blocks half go left: 15 of the first in the mean, with the variance of a hypergeometric draw."""
    rows_ = [(s, c, x) for s in range(200) for c, x in enumerate((30, 10))]
    df = spark.createDataFrame(rows_, "shard bigint, chunk bigint, x bigint")
    got = df.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("chunk", "x"))).alias("c")).selectExpr(mixing.drawn_left("c.x", "40", "20", 7, 0, "shard", -1) + " AS g").collect()
    first = [r.g[0] for r in got]
    assert all(sum(r.g) == 20 for r in got)
    mean = sum(first) / len(first)
    assert abs(mean - 15) < 0.5 and 1.0 < sum((x - mean) ** 2 for x in first) / len(first) < 3.0


def test_mix_of_many_sources(spark):
    """More sources than a row of quotas has, in code-point order over several ranges."""
    n = 5000
    data = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"host{i}.example" if i else None, 1) for i in range(n)] + [(n + i, "w " * 400, "en", "big", 1) for i in range(300)]
    d = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = mixing.mix(d).collect()
    sizes: dict = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    want = slow_targets(sizes)
    taken: dict = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= (400 if s == "big" else 7) for s in sizes)


def test_exact_dedup(docs):
    data = rows()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i))):
            want[i, best, len(ids), k == len(ids) - 1, sha(text)] += 1
    for k in (1024, 1):
        got = exact_dedup.exact_dedup(docs, k=k).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert Counter(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == Counter(k[0] for k in want.elements() if k[3])


def test_frequent_digests_are_found_and_few(spark):
    data = [(bytes([i % 50]),) for i in range(500)] + [(b"hot",)] * 400 + [(b"warm",)] * 100
    found = {bytes(r.digest) for r in exact_dedup.frequent(spark.createDataFrame(data, "digest binary").repartition(5), 9).collect()}
    assert b"hot" in found and len(found) <= 10


@pytest.fixture(scope="module")
def archives(spark):
    big = "<p>" + "Ünd " * 400
    data = [(i, f"https://www.site{i % 5}.example.com:8080/p/{i % 9}?q={i}", f"<html>{i}</html>" * 20) for i in range(40)] + [(100 + i, "http://copy.org/", big) for i in range(30)]
    data += [(None, None, None), (200, "not a url", ""), (201, "http://[x", "short"), (202, "http://a.b/\r\nX: y", "short"), (203, "http://copy.org/", big), (203, "http://copy.org/", big)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(3)
    folder = warc.new_folder(spark)
    before, warc.BLOCK_CAPTURES = warc.BLOCK_CAPTURES, 10
    directory = warc.index(warc.write(pages, folder), folder)
    warc.BLOCK_CAPTURES = before
    return data, directory


def test_warc_round_trip(archives):
    import hashlib

    data, directory = archives
    got = warc.read(warc.captures_of(directory), payloads=True).collect()
    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in data)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    copies = [r for r in got if r.payload_bytes >= 1000 and r.page_id >= 100]
    assert [r.page_id for r in copies if r.record_type == "response"] == [203]
    assert all(r.refers_to == 203 and r.payload is None for r in copies if r.record_type == "revisit")
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 1000)
    html = {i: (h or "").encode() for i, _, h in data}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")


def test_warc_lookup(spark, archives):
    data, directory = archives
    assert directory.count() > 3
    urls = ["http://copy.org/", "https://www.site3.example.com:8080/p/3?q=3", "http://none.example/", "not a url", None]
    found = warc.lookup(directory, spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert Counter((r.id, r.url) for r in found) == Counter((i, u) for i, u, _ in data if u in urls)


def test_warc_keys():
    assert warc.url_key("HTTP://WWW.Example.com:81/A?b=c") == "com,example,www:81)/A?b=c"
    assert warc.url_key(None) == "-" and warc.url_key("http://[x") == "http://[x"


def test_warc_damaged_record():
    good = warc.record(1, "http://a/", b"payload", None, False)
    assert warc.parse(good)[:4] == (1, "http://a/", b"payload", 7)
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"payloaX\r\n"))


def test_warc_of_files_and_of_long_pages(spark, tmp_path):
    long = "<p>" + "0123456789abcdef" * 1_500_000
    made = [(i, f"http://h{i % 3}.example/{i % 5}", long if i < 2 else "x" * 2000 if i % 4 else f"page {i} " * 300) for i in range(40)] + [(None, None, "x" * 2000), (7, "http://h1.example/2", "x" * 2000)]
    pages = spark.createDataFrame(made, "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/p.parquet")
    for p in (pages, spark.read.parquet(f"{tmp_path}/p.parquet")):
        got = [r for r in warc.read(looked_up(p, "page_id", "url", "html"), payloads=True).collect()]
        assert Counter(r.page_id for r in got) == Counter(i for i, _, _ in made)
        assert sum(r.record_type == "response" for r in got) == len({h for _, _, h in made})
        html = {i: h for i, _, h in made}
        for r in got:
            assert (r.payload is None) == (r.record_type == "revisit")
            if r.payload is None:
                assert r.refers_to == max(i for i in html if i is not None and html[i] == html[r.page_id])
            else:
                assert r.payload.decode() == html[r.page_id]


def test_simhash_takes_even_radii_only(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,), (2,)], "fp bigint"), 3)
