"""Queries over vectors, losses, batches and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import embeddings, metrics, packing
from .registry import query

V = "list_transform(embedding, lambda x: x::DOUBLE)"
SQ = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))"
DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def queries_and_support(t):
    """The query set, every vector whose id is divisible by 100, against all other vectors, in blocks of queries."""
    e = t.embeddings.select("vec_id", "embedding", "label")
    queries = e.where("vec_id % 100 = 0").selectExpr("vec_id AS q", "embedding AS a", "label AS la")
    return embeddings.beside(e.selectExpr("vec_id AS s", "embedding AS b", "label AS lb"), queries, "s", "q").where("q <> s")


def sides(t):
    """All vectors, with the rank that each has beside a query of another label, and the query set."""
    rows = t.embeddings.selectExpr("vec_id AS id", "embedding AS vector", "label", "CASE WHEN vec_id % 5 = 0 THEN 2 WHEN vec_id % 3 = 0 THEN 3 ELSE 0 END AS rank")
    return rows, t.embeddings.where("vec_id % 100 = 0").selectExpr("vec_id AS id", "embedding AS vector", "label")


QS = f"(SELECT q.vec_id AS q, s.vec_id AS s, q.label AS la, s.label AS lb, {V.replace('embedding', 'q.embedding')} AS a, {V.replace('embedding', 's.embedding')} AS b FROM embeddings q JOIN embeddings s ON q.vec_id % 100 = 0 AND q.vec_id <> s.vec_id)"
UNIT = f"(SELECT q, s, la, lb, list_transform(a, lambda x: x / na) AS a, list_transform(b, lambda x: x / nb) AS b, d / (na * nb) AS cos FROM (SELECT *, sqrt({DOT.format('a', 'a')}) AS na, sqrt({DOT.format('b', 'b')}) AS nb, {DOT.format('a', 'b')} AS d FROM {QS}))"


@query(f"SELECT q, s, round(sqrt({SQ.format('a', 'b')}), 6) AS distance FROM {UNIT}")
def embedding_euclidean(t):
    """Distances of vectors scaled to length 1."""
    return embeddings.distances(*sides(t))


@query(f"SELECT q, min(s) AS prediction, round(max(cos), 6) AS metric FROM (SELECT *, max(round(cos, 9)) OVER (PARTITION BY q) AS m FROM {UNIT}) WHERE round(cos, 9) = m GROUP BY 1")
def embedding_cosine_argmax(t):
    """The support with the largest cosine for each query."""
    m = queries_and_support(t).select("q", "s", F.round(vectors.cosine("a", "b"), 9).alias("m"))
    return embeddings.predict(m, "q", "s", "m", largest=True).select("q", "prediction", F.round("metric", 6).alias("metric"))


CODES = f"(SELECT vec_id AS code, {V} AS cv FROM embeddings WHERE vec_id % 100 = 0)"
ASSIGNED = f"(SELECT vec_id, v, arg_min(code, (d, code)) AS code, min(d) AS d FROM (SELECT vec_id, v, code, {SQ.format('v', 'cv')} AS d FROM (SELECT vec_id, {V} AS v FROM embeddings), {CODES}) GROUP BY 1, 2)"


def assigned(t):
    codes = t.embeddings.where("vec_id % 100 = 0").selectExpr("vec_id AS code", "embedding AS code_vector")
    return embeddings.assign(t.embeddings.selectExpr("vec_id", "embedding AS vector"), codes), codes


@query(f"SELECT vec_id, code, round(d, 6) AS distance FROM {ASSIGNED}")
def vq_assign(t):
    """The nearest code for each vector; the codes are the vectors of the query set."""
    a, _ = assigned(t)
    return a.select("vec_id", "code", F.round("distance", 6).alias("distance"))


@query(f"WITH c AS (SELECT code, count(*) AS n FROM {ASSIGNED} GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT exp(-sum(p * ln(p + 1e-10))) AS perplexity, count(*) AS codes FROM p")
def vq_perplexity(t):
    return embeddings.perplexity(assigned(t)[0])


@query(
    f"""WITH a AS {ASSIGNED}, c AS {CODES}, k AS (SELECT code, i, cv[i] AS x FROM (SELECT *, unnest(range(1, len(cv) + 1)) AS i FROM c)), s AS (SELECT code, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a) GROUP BY 1, 2),
    u AS (SELECT k.code, k.i, 0.01 * coalesce(n, 0) AS size, 0.99 * x + 0.01 * coalesce(s, 0) AS total FROM k LEFT JOIN s USING (code, i)), t AS (SELECT sum(size) AS n, count(*) AS k FROM u WHERE i = 1)
    SELECT u.code, u.i, round(total / ((size + 1e-5) / (n + k * 1e-5) * n), 6) AS x FROM u, t"""
)
def vq_update(t):
    """The codes after one step of moving averages, in all 64 dimensions."""
    u = embeddings.update_codes(*assigned(t), 64)
    return u.select("code", F.posexplode("code_vector").alias("i", "x")).select("code", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))



RANKED = f"(SELECT q, s, sqrt({SQ.format('a', 'b')}) AS m, CASE WHEN la = lb THEN 1 WHEN s % 5 = 0 THEN 2 WHEN s % 3 = 0 THEN 3 ELSE 0 END AS r FROM {UNIT})"


@query(f"SELECT avg(CASE WHEN r IN (1, 2) THEN m * m ELSE pow(greatest(0, 1 - m), 2) END) AS loss, count(*) AS pairs FROM {RANKED}")
def contrastive_loss(t):
    return embeddings.contrastive_loss(*sides(t))


@query(
    f"""WITH x AS (SELECT q, m / 0.07 AS x, r IN (1, 2) AS p FROM {RANKED}), m AS (SELECT *, x - max(x) OVER (PARTITION BY q) AS y FROM x), n AS (SELECT q, sum(CASE WHEN NOT p THEN exp(y) ELSE 0 END) AS neg FROM m GROUP BY 1),
    v AS (SELECT n.q, avg(CASE WHEN p THEN y - ln(exp(y) + neg + 1e-8) END) AS v FROM m JOIN n USING (q) GROUP BY 1) SELECT -sum(v) / count(*) AS loss, count(*) AS variants FROM v"""
)
def infonce_loss(t):
    return embeddings.info_nce(*sides(t))


@query(
    f"""WITH g AS (SELECT q, sum(CASE WHEN r = 1 THEN exp(m / 0.1) END) AS n1, sum(CASE WHEN r >= 0 THEN exp(m / 0.1) END) AS d1, sum(CASE WHEN r = 2 THEN exp(m / 0.225) END) AS n2, sum(CASE WHEN r IN (0, 2, 3) THEN exp(m / 0.225) END) AS d2,
        sum(CASE WHEN r = 3 THEN exp(m / 0.5) END) AS n3, sum(CASE WHEN r IN (0, 3) THEN exp(m / 0.5) END) AS d3 FROM {RANKED} GROUP BY 1)
    SELECT avg(coalesce(-ln(n1 / d1 + 1e-8), 0) + coalesce(-ln(n2 / d2 + 1e-8), 0) + coalesce(-ln(n3 / d3 + 1e-8), 0)) AS loss, count(*) AS variants FROM g"""
)
def rince_loss(t):
    return embeddings.rince(*sides(t))


@query(f"SELECT vec_id, (p // 8 // 4) * 2 + p % 8 // 4 AS patch, round(sum(x), 6) AS total, count(*) AS cells FROM (SELECT vec_id, v[i] AS x, i - 1 AS p FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, {V} AS v FROM embeddings))) GROUP BY 1, 2")
def patch_reduce(t):
    """Sums by patch of vectors seen as images eight wide, in patches of four by four."""
    p = embeddings.patches(t.embeddings, "vec_id", "embedding", 8, (4, 4))
    return p.groupBy("vec_id", F.col("patch").cast("bigint").alias("patch")).agg(F.round(F.sum(F.col("value").cast("double")), 6).alias("total"), F.count(F.lit(1)).alias("cells"))


MASKS = "(SELECT vec_id, patch, row_number() OVER (PARTITION BY vec_id ORDER BY ((vec_id * 16 + patch) * 1103515245 + 12345) % 2147483648, patch) <= 8 AS masked FROM (SELECT vec_id, unnest(range(0, 16)) AS patch FROM embeddings))"


@query(f"SELECT vec_id, patch, masked FROM {MASKS}")
def patch_mask(t):
    """Half of sixteen patches of each image."""
    return embeddings.patch_masks(t.embeddings, "vec_id", 16, 0.5).select("vec_id", F.col("patch").cast("bigint").alias("patch"), "masked")


@query(f"WITH c AS (SELECT vec_id, v[i] AS x, (i - 1) // 4 % 16 AS patch FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, {V} AS v FROM embeddings))) SELECT round(sum(abs(x - 0.5)) / (count(*) + 1e-5), 6) AS loss, count(*) AS masked FROM c JOIN {MASKS} m USING (vec_id, patch) WHERE m.masked")
def masked_l1(t):
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "value")).withColumn("patch", (F.floor(F.col("i") / 4) % 16).cast("int")).withColumn("p", F.lit(0.5))
    return embeddings.masked_l1(cells, embeddings.patch_masks(t.embeddings, "vec_id", 16, 0.5), "vec_id", "value", "p").select(F.round("loss", 6).alias("loss"), "masked")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 256 / 255.0 - 0.5) / 0.5 AS signed, (l_partkey % 256)::INT AS back FROM lineitem")
def normalise_pixels(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", vectors.to_signed(F.col("l_partkey") % 256).alias("signed"))
    return x.select("*", vectors.from_signed("signed").alias("back"))


@query(f"WITH x AS (SELECT q.vec_id AS q, s.vec_id % 100 AS i, {DOT.format('a', 'b')} AS d FROM (SELECT vec_id, {V} AS a FROM embeddings) q JOIN (SELECT vec_id, {V} AS b FROM embeddings) s ON q.vec_id % 100 = 0 AND s.vec_id // 100 = q.vec_id // 100 AND s.vec_id % 100 BETWEEN 1 AND 1 + q.vec_id // 100 % 7) SELECT q, arg_max(i, (round(d, 9), -i)) AS prediction, round(max(d), 6) AS metric, count(*) AS supports FROM x GROUP BY 1")
def ragged_predict(t):
    """Each query beside its own supports, of which queries have different numbers, and the one with the largest product."""
    e = t.embeddings.selectExpr("vec_id", "vec_id div 100 AS g", "vec_id % 100 AS i", "embedding")
    queries = e.where("i = 0").selectExpr("g", "embedding AS query")
    supports = e.where("i BETWEEN 1 AND 1 + g % 7").selectExpr("g", "i AS index", "embedding AS support")
    m = packing.expanded(queries, supports, ["g"], F.round(vectors.dot("query", "support"), 9))
    p = embeddings.predict(m, "g", "index", "metric", largest=True).join(m.groupBy("g").agg(F.count(F.lit(1)).alias("supports")), "g")
    return p.select((F.col("g") * 100).alias("q"), "prediction", F.round("metric", 6).alias("metric"), "supports")


PACK_LIMIT = 250_000
SIZES = "(SELECT source, doc_id, coalesce(n_chars, 0) AS z, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents)"
PACKED = f"""WITH RECURSIVE s AS (SELECT * FROM {SIZES}), p(source, doc_id, z, i, batch, used, "begin") AS (SELECT source, doc_id, z, i, 0, z, 0::BIGINT FROM s WHERE i = 1
    UNION ALL SELECT s.source, s.doc_id, s.z, s.i, CASE WHEN p.used + s.z > {PACK_LIMIT} THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used + s.z > {PACK_LIMIT} THEN s.z ELSE p.used + s.z END, CASE WHEN p.used + s.z > {PACK_LIMIT} THEN 0 ELSE p.used END FROM p JOIN s ON s.source = p.source AND s.i = p.i + 1)"""


def packed(t):
    return packing.greedy(t.documents.selectExpr("source", "doc_id", "coalesce(n_chars, 0) AS z"), "source", "doc_id", "z", PACK_LIMIT)


@query(f'{PACKED} SELECT source, doc_id, z, batch, "begin" FROM p')
def greedy_pack(t):
    """Documents in batches of bounded size, in order, source by source."""
    return packed(t)


@query(f"{PACKED} SELECT source, batch, doc_id, (doc_id % 3 + 1) AS n, sum(doc_id % 3 + 1) OVER (PARTITION BY source, batch ORDER BY doc_id) - (doc_id % 3 + 1) AS \"offset\" FROM p")
def pack_offsets(t):
    """Where each document's support begins in its batch."""
    p = packed(t).withColumn("n", F.col("doc_id") % 3 + 1)
    return packing.offsets(p, "source", "doc_id", "n").select("source", "batch", "doc_id", "n", "offset")


@query(f"{PACKED}, l AS (SELECT source, batch, doc_id, unnest([doc_id % 4, doc_id % 4, 3, 3]) AS l, generate_subscripts([1, 2, 3, 4], 1) AS j FROM p), g AS (SELECT source, batch, string_agg(l::VARCHAR, ',' ORDER BY doc_id, j) AS x, count(*) AS n FROM l GROUP BY 1, 2) SELECT source, batch, x || repeat(',-100', (4000 - n)::INT) AS labels FROM g")
def label_expand(t):
    """A batch's ranked labels, two replicates each, padded."""
    p = packed(t).withColumn("labels", packing.repeated_labels(F.array(F.col("doc_id") % 4, F.lit(3).cast("bigint")), 2))
    b = packing.batch_labels(p, "source", "doc_id", "labels", 4000)
    return b.select("source", "batch", F.array_join("labels", ",").alias("labels"))


#: The truth and the prediction of each labelled document: genotypes of three.
CALLS = "(SELECT doc_id, (quality + toxic)::INT AS truth, (doc_id % 3)::INT AS prediction FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
RANKS = f"(SELECT *, list_transform(range(0, 3), lambda i: CASE WHEN i = truth THEN 1 WHEN truth > 0 AND i > 0 THEN 3 ELSE 0 END) AS r FROM {CALLS})"


def called(t):
    c = t.labels.where("quality IS NOT NULL AND toxic IS NOT NULL").selectExpr("doc_id", "cast(quality + toxic AS int) AS truth", "cast(doc_id % 3 AS int) AS prediction")
    return c.withColumn("ranks", metrics.label_ranks(F.lit(3), F.col("truth")))


TABLE = f"(SELECT count(*) FILTER (r[prediction + 1] IN (1, 2)) AS correct, count(*) AS total, count(*) FILTER (r[prediction + 1] <> 0 AND r[1] = 0) AS tp, count(*) FILTER (r[prediction + 1] = 0 AND r[1] = 0) AS fn, count(*) FILTER (r[prediction + 1] = 0 AND r[1] <> 0) AS fp, count(*) FILTER (r[prediction + 1] <> 0 AND r[1] <> 0) AS tn FROM {RANKS})"


@query(f"SELECT * FROM {TABLE}")
def concordance_metrics(t):
    return metrics.contingency(called(t))


@query(f"SELECT *, correct / total AS concordance, (tp + tn) / total AS nonref_concordance, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM {TABLE}")
def nonref_metrics(t):
    return metrics.rates(metrics.contingency(called(t)))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber LIMIT 25)")
def worst_losses(t):
    """The twenty-five rows with the largest loss."""
    rows = t.lineitem.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return metrics.worst(rows, "l_extendedprice", "k", 25).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("SELECT source, count(*) AS samples, string_agg(coalesce(n_chars, 0)::VARCHAR, ',' ORDER BY doc_id) AS lengths FROM documents GROUP BY 1")
def shard_lengths(t):
    s = packing.shard_lengths(t.documents.selectExpr("source", "doc_id", "coalesce(n_chars, 0) AS n"), "source", "doc_id", "n")
    return s.select("source", "samples", F.array_join("lengths", ",").alias("lengths"))


@query("SELECT doc_id, source, substr(d, 9) AS \"order\", (('0x' || substr(d, 1, 8))::BIGINT % 8)::INT AS shard FROM (SELECT doc_id, source, md5('3/' || doc_id) AS d FROM documents)")
def shuffle_shards(t):
    """Documents dealt to eight shards, each in a shuffled order that a rerun repeats."""
    return packing.shuffled(t.documents.select("doc_id", "source"), "doc_id", 3, 8)
