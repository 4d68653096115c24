"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources in code-point order (null last) weigh 5, 2, 1, repeating. They share the total number of words by weight;
   no target exceeds three times its source's size, and what is over is shared again by weight.
2. Documents fall into blocks of their source by hash. A source's quota is counted in block draws: whole passes over
   all its blocks, then blocks in permuted order, the last of them in part.
3. The vector of quotas is split in two again and again, each time drawing the left half's blocks without replacement
   from all blocks of the node, which is a multivariate hypergeometric draw; leaves are the output shards.
4. A shard's share of a source is a run of the source's permuted draws, so shards are disjoint; rows of a shard are
   put in the order of a hash.

All steps are DataFrame or SQL functions, and the table of sources is spread over tasks like any other. Only the table of blocks, at most MOST_BLOCKS plus one for each source, is joined
to the documents; texts are never shuffled for the decision.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its own and comes last; rows
alike in id, source and text get the same decision; an empty table gives an empty mix; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, numbered, pick, place, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Blocks in all, besides one for each source: LEAST_BLOCKS, or as many more as make FULL_BLOCK documents each, up to MOST_BLOCKS; but no
#: block has less than DOCS_A_BLOCK documents.
LEAST_BLOCKS = 1024
MOST_BLOCKS = 65536
FULL_BLOCK = 50_000
DOCS_A_BLOCK = 32
SHARDS = 16
#: Sources whose quotas stand in one row.
CHUNK = 1024
#: Rows of the block table up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    parts = F.split(text, SPACE)
    # An empty string can stand at either end only.
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """`df` with __size, __source and the row's hash __h."""
    df = df.withColumn("__size", n_words(text_or_empty(text_col)))
    return df.withColumn("__source", F.col(source_col)).withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.xxhash64(text_or_empty(text_col))))


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with rank, their place in code-point order, null last. Sorted by ranges; the only global window has a row for each range."""
    order = F.col("__source").asc_nulls_last()
    sorted_ = cut(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sorted_.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return sorted_.join(F.broadcast(begins), "range").withColumn("rank", F.col("begin") + F.col("at")).drop("range", "at", "begin")


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: __source, rank, docs, source_size, target. Rounds of one aggregation over the sources find the level of words
    for each unit of weight; a source that it fills is full, and what it can't take raises the level for the others."""
    sources = ranked(rows.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    weighed = cut(weighed.withColumn("cap", F.col("source_size") * MAX_REPEATS))
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, full = (total / weight if weight else 0.0), -1
    while True:
        n, cap, heavy = weighed.where(F.col("cap") <= F.lit(level) * F.col("weight")).agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == full or heavy == weight:
            break
        full, level = n, (total - cap) / (weight - heavy)
    return weighed.select("__source", "rank", "docs", "source_size", F.least(F.lit(float(level)) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def block_of(blocks: Column) -> Column:
    return F.pmod(F.col("__h"), blocks)


def inner_order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col("__h"))


def drawn_left(q: str, n: str, left: str, *names: object) -> str:
    """SQL of the array of how many of each of `q`'s counts go left, if `left` of all `n` do: going through the items one by one, each goes
    left with probability (places left) / (items left), so every subset of that size is equally likely. `names` seed the hash."""
    seeds = ", ".join(map(str, names))
    return f"""aggregate(
        transform({q}, (x, r) -> struct(x, r)),
        named_struct('n', cast({n} AS bigint), 'l', cast({left} AS bigint), 'out', cast(array() AS array<bigint>)),
        (acc, s) -> transform(array(aggregate(
            if(s.x > 0, sequence(1L, s.x), cast(array() AS array<bigint>)),
            named_struct('n', acc.n, 'l', acc.l, 'g', 0L),
            (a, i) -> if((cast(xxhash64({seeds}, s.r, i) & 1125899906842623 AS double) / 1125899906842624D) * a.n < a.l,
                named_struct('n', a.n - 1L, 'l', a.l - 1L, 'g', a.g + 1L),
                named_struct('n', a.n - 1L, 'l', a.l, 'g', a.g)))),
            t -> named_struct('n', t.n, 'l', t.l, 'out', concat(acc.out, array(t.g))))[0],
        acc -> acc.out)"""


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """`quotas`: chunk and q, the block quotas of a chunk's sources by rank. Returns rows (shard, chunk, q) of the 2**levels leaves.

    A node gives half of its blocks to its left child. How many of each chunk's go there is drawn over the chunks' sums, and then for each
    chunk, in a row of its own, over its sources: the two draws make one over all sources.
    """
    nodes = quotas.select(F.lit(0).cast("bigint").alias("shard"), "chunk", "q").withColumn("n", F.expr("aggregate(q, 0L, (a, x) -> a + x)"))
    for level in range(levels):
        sums = nodes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("chunk", "n"))).alias("c"), F.sum("n").alias("all"))
        sums = sums.withColumn("g", F.expr(drawn_left("c.n", "all", "(all + shard % 2) div 2", seed, level, "shard", -1)))
        share = sums.selectExpr("shard AS s", "explode(zip_with(c, g, (x, y) -> struct(x.chunk AS chunk, y AS l))) AS x").selectExpr("s", "x.chunk AS k", "x.l AS l")
        given = nodes.join(share, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("k")))
        halves = given.selectExpr("shard", "chunk", "q", f"{drawn_left('q', 'n', 'l', seed, level, 'shard', 'chunk')} AS left")
        halves = halves.selectExpr("chunk", "explode(array(struct(shard * 2 AS shard, left AS q), struct(shard * 2 + 1 AS shard, zip_with(q, left, (x, y) -> x - y) AS q))) AS c")
        nodes = cut(halves.selectExpr("c.shard", "chunk", "c.q", "aggregate(c.q, 0L, (a, x) -> a + x) AS n"))
    return nodes


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The block table: s, nb, b, source_size, target, draws (array of pass, shard, part), cut_h, fit_h, extra."""
    levels = max(shards - 1, 0).bit_length()
    sources = cut(targets(rows))
    blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.sum("docs") / FULL_BLOCK)))
    total = sources.agg(F.sum("source_size").alias("total"), blocks.alias("blocks"))
    sources = sources.join(F.broadcast(total)).withColumn("nb", F.greatest(F.lit(1), F.least(F.ceil(F.col("source_size") * F.col("blocks") / F.greatest(F.col("total"), F.lit(1))), F.ceil(F.col("docs") / DOCS_A_BLOCK))).cast("long"))
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = cut(sources.withColumn("more", F.col("target") - F.col("passes") * F.col("source_size")).drop("total", "blocks", "docs"))
    small = F.broadcast if sources.count() <= BROADCAST_ROWS else (lambda x: x)
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]

    nb = sources.select(F.col("__source").alias("s"), "nb")
    placed = rows.join(small(nb), F.col("__source").eqNullSafe(F.col("s"))).select("__source", block_of(F.col("nb")).alias("block"), "__size", "__h")
    sums = placed.groupBy("__source", "block").agg(F.sum("__size").alias("block_size"))
    s = sources.withColumnRenamed("__source", "s")
    sums = sums.join(small(s), F.col("__source").eqNullSafe(F.col("s"))).drop("s")
    running = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block"), "block")
    sums = sums.withColumn("upto", F.sum("block_size").over(running))
    sums = cut(
        sums.withColumn("whole", (F.col("upto") <= F.col("more")) & (F.col("more") > 0))
        .withColumn("need", F.when((F.col("upto") > F.col("more")) & (F.col("upto") - F.col("block_size") < F.col("more")), F.col("more") - F.col("upto") + F.col("block_size")))
    )

    # Of the block that is drawn in part: documents in hash order while they fit. Then one more of the source's documents that the last
    # pass leaves out, the one that fits best.
    part = sums.where("need is not null").select(F.col("__source").alias("s"), F.col("block").alias("b"), "need", "rank")
    inside = placed.join(small(part), F.col("__source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = inside.withColumn("o", inner_order(seed)).groupBy("rank", "need", "o").agg(F.sum("__size").alias("z"))
    inside = inside.withColumn("upto", F.sum("z").over(Window.partitionBy("rank").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.when(F.col("upto") <= F.col("need"), F.struct("upto", "o"))
    cuts = cut(inside.groupBy("rank").agg(F.max(taken).alias("t"), F.max("need").alias("need")).select("rank", F.col("t.o").alias("cut_h"), (F.col("need") - F.coalesce("t.upto", F.lit(0))).alias("left")))
    out = sums.where("NOT whole").join(small(cuts), "rank").select(F.col("__source").alias("s"), F.col("block").alias("b"), "rank", "left", F.when(F.col("need").isNotNull(), F.col("cut_h")).alias("cut_h"))
    spare = placed.join(small(out), F.col("__source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("o", inner_order(seed))
    spare = spare.where((F.col("cut_h").isNull() | (F.col("o") > F.col("cut_h"))) & (F.abs(F.col("left") - F.col("__size")) < F.col("left")))
    fits = spare.groupBy("rank").agg(F.min(F.struct(F.abs(F.col("left") - F.col("__size")).alias("d"), "o")).alias("f")).select("rank", F.col("f.o").alias("fit_h"))
    cuts = cuts.join(fits, "rank", "left").select(F.col("rank").alias("r"), "cut_h", "fit_h")

    # Draws: every whole pass, the whole blocks of the last pass, and the block drawn in part.
    whole_passes = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: F.struct(p.alias("pass"), F.lit(False).alias("part")))).otherwise(F.array().cast("array<struct<pass:bigint,part:boolean>>"))
    last = F.when(F.col("whole"), F.array(F.struct(F.col("passes").alias("pass"), F.lit(False).alias("part")))).when(F.col("need").isNotNull(), F.array(F.struct(F.col("passes").alias("pass"), F.lit(True).alias("part")))).otherwise(F.array().cast("array<struct<pass:bigint,part:boolean>>"))
    draws = sums.select("rank", "block", F.explode(F.concat(whole_passes, last)).alias("d")).select("rank", "block", "d.*")
    permuted = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 3), "rank", "block", "pass"), "block", "pass")
    draws = cut(draws.withColumn("at", F.row_number().over(permuted) - 1))
    quota = draws.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    quota = sources.select("rank").join(quota, "rank", "left").select(F.floor(F.col("rank") / CHUNK).alias("chunk"), F.struct("rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).alias("x"))
    quota = quota.groupBy("chunk").agg(F.array_sort(F.collect_list("x")).alias("x")).select("chunk", F.col("x.n").alias("q"))
    leaves = split_tree(quota, levels, seed)
    ends = leaves.select("shard", "chunk", F.posexplode("q").alias("at", "n")).select("shard", (F.col("chunk") * CHUNK + F.col("at")).alias("rank"), "n")
    ends = ends.withColumn("end", F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))).groupBy("rank").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    draws = draws.join(small(ends), "rank").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    # The extra document comes with the block that is drawn in part.
    extra = draws.where("part").select(F.col("rank").alias("xr"), F.struct("pass", "shard", "part").alias("extra"))
    by_block = draws.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "part"))).alias("draws"))
    table = sums.select("__source", "rank", "block", "nb", "source_size", "target").join(by_block, ["rank", "block"], "left").join(cuts, F.col("rank") == F.col("r"), "left").join(extra, F.col("rank") == F.col("xr"), "left")
    return cut(table.select(F.col("__source").alias("s"), "nb", F.col("block").alias("b"), "source_size", "target", F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int,part:boolean>>")).alias("draws"), "cut_h", "fit_h", "extra"))


def decide(rows: DataFrame, table: DataFrame, seed: int = 7) -> DataFrame:
    """`rows` (of `sized`) with source_size, target and draws, the copies that the mix takes: an array of (pass, shard)."""
    n = table.count()
    small = F.broadcast if n <= BROADCAST_ROWS else (lambda x: x)
    nb = table.groupBy("s").agg(F.max("nb").alias("nb"))
    rows = rows.join(small(nb), F.col("__source").eqNullSafe(F.col("s"))).withColumn("__block", block_of(F.col("nb"))).drop("s", "nb")
    rows = rows.join(small(table), F.col("__source").eqNullSafe(F.col("s")) & (F.col("__block") == F.col("b")))
    rows = rows.withColumn("__o", inner_order(seed))
    inside, fits = F.coalesce(F.col("__o") <= F.col("cut_h"), F.lit(False)), F.coalesce(F.col("__o") == F.col("fit_h"), F.lit(False))
    draws = F.filter("draws", lambda d: ~d["part"] | inside)
    rows = rows.withColumn("draws", F.when(fits & F.col("extra").isNotNull(), F.concat(draws, F.array("extra"))).otherwise(draws))
    return rows.drop("s", "nb", "b", "cut_h", "fit_h", "extra", "__block", "__o")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, draws, taken."""
    picked = pick(df, doc_id=id_col, text=text_col, source=source_col)
    rows = cut(sized(picked, "doc_id", "text", "source", seed).select("doc_id", "__source", "__size", "__h"))
    decided = decide(rows, plan(rows, shards, seed=seed), seed)
    return decided.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "draws", (F.size("draws") * F.col("__size")).cast("long").alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of `df`, each as often as it is drawn, dealt to shards and shuffled within each of them."""
    full = sized(numbered(df), *[f"c{place(df, c)}" for c in (id_col, text_col, source_col)], seed)
    table = plan(cut(full.select("__source", "__size", "__h")), shards, seed=seed)
    drawn = decide(full, table, seed).withColumn("__d", F.explode("draws"))
    drawn = drawn.withColumn("__shard", F.col("__d.shard")).withColumn("__at", F.xxhash64(F.lit(seed + 4), "__d.shard", "__d.pass", "__h"))
    # The shard spreads over tasks by the hash's order, so that a shard may be larger than one task.
    return drawn.repartitionByRange("__shard", "__at").sortWithinPartitions("__shard", "__at").select(*numbered(df).columns).toDF(*df.columns)
