"""Mixing sources to target weights.

1. Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a target
   stops at twice its source's words and the excess goes to the others by weight. The end of that resharing has a
   closed form: target = min(cap, level * weight), the level being where the targets sum to the whole.
2. Quotas. A document's hash gives it a block, 1 of 1024 of its source, and inside that a sub-block, 1 of 1024. Whole
   passes over the source come first; the rest of the target is a prefix of the permuted blocks, then of the
   sub-blocks of the one block on the edge, then of the documents of the one sub-block on the edge. What the edge
   leaves over is filled, twice with the largest document that fits and once with the one that comes closest. So no window ever holds more than the
   blocks of a source or a millionth of its documents, however hot the source is.
3. Splitting tree. The vector of block quotas of all sources is split in two, again and again, until there is a part
   for each output shard. Each split is an exact multivariate-hypergeometric draw (selection sampling, source after
   source), so shards get equal numbers of blocks and each source its exact quota over all shards. Beyond 256 sources
   there is a tree for each 256 of them.
4. Each source deals its permuted blocks out by its shards' quotas: disjoint runs of the permutation. Inside a shard,
   copies are ordered by a hash.

All random choices are hashes of the seed, so that reruns agree. Everything is DataFrame and SQL functions.

Defined results: null text has size 0 and is never short of its target; a null source is a source of its own;
repeated rows are documents of their own (equal ids share a block); an empty table gives an empty result; columns
other than id, text and source are not read. A quota vector has one number a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, words_sql

WEIGHTS = (5, 2, 1)
FAN_BITS = 10


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.expr(f"cast(size({words_sql('`' + text_col + '`')}) as bigint)").alias("size"), F.col(source_col).cast("string").alias("source"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    fan = 1 << FAN_BITS
    return d.select("*", h.alias("h"), F.pmod(h, F.lit(fan)).cast("int").alias("b1"), F.pmod(F.shiftright(h, FAN_BITS), F.lit(fan)).cast("int").alias("b2"))


def targets(blocks: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, rank (1 first), source_size, target; blocks has source and words."""
    s = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = s.select("source", "rank", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("cap"), (F.col("source_size") * cap / w).alias("r"))
    everything, rising = Window.partitionBy(F.lit(1)), Window.orderBy("r", "rank")
    s = s.withColumn("whole", F.sum("source_size").over(everything) * F.lit(ratio))
    s = s.withColumn("capped", F.sum("cap").over(rising) + F.col("r") * (F.sum("w").over(everything) - F.sum("w").over(rising)) <= F.col("whole"))
    left = F.col("whole") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    over = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    return s.select("source", "rank", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * left / over).alias("target"))


def _same(a: str, b: str, *cols: str):
    cond = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for c in cols:
        cond = cond & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return cond


def _prefix(cells: DataFrame, by: list, limit: str) -> DataFrame:
    """Adds inside (the cell ends within the source's limit), edge (the limit lies within it) and rest (of the limit,
    at the cell's start). cells has source, words and the limit."""
    c = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("upto") - F.col("words")
    return c.select("*", (F.col("upto") <= F.col(limit)).alias("inside"), ((F.col("upto") > F.col(limit)) & (before < F.col(limit))).alias("edge"), (F.col(limit) - before).alias("rest"))


def split_sql(counts: str, total: str, node: str, seed: int) -> str:
    """The left half's share of a quota vector: a multivariate-hypergeometric draw of floor(total / 2) blocks."""
    u = f"(shiftrightunsigned(xxhash64({seed}, {node}, a.i, j), 11) / 9007199254740992D)"
    draw = (f"aggregate(if(k <= 0, cast(array() as array<bigint>), sequence(1L, k)), struct(a.n as n, a.m as m, 0L as x), (b, j) -> "
            f"if({u} * b.n < b.m, struct(b.n - 1 as n, b.m - 1 as m, b.x + 1 as x), struct(b.n - 1 as n, b.m as m, b.x as x)))")
    step = f"element_at(transform(array({draw}), r -> struct(a.n - k as n, r.m as m, a.i + 1 as i, concat(a.o, array(r.x)) as o)), 1)"
    return f"aggregate({counts}, struct({total} as n, cast({total} div 2 as bigint) as m, 0L as i, cast(array() as array<bigint>) as o), (a, k) -> {step}, a -> a.o)"


def shard_quotas(quotas: DataFrame, depth: int, seed: int, together: int = 256) -> DataFrame:
    """(rank, per_shard): each source's blocks in each of the 2^depth shards. quotas: rank, q. Sources are split in
    groups of `together` ranks, each with a tree of its own, so that a row holds that many numbers at most."""
    s = quotas.groupBy(F.expr(f"cast((rank - 1) div {together} as bigint)").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("rank", "q"))).alias("s"))
    s = s.select("grp", F.lit(1).cast("bigint").alias("node"), F.expr("transform(s, x -> x.rank)").alias("ranks"), F.expr("transform(s, x -> x.q)").alias("counts"))
    for _ in range(depth):
        s = s.select("grp", "node", "ranks", "counts", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("total"))
        s = s.select("grp", "node", "ranks", "counts", F.expr(split_sql("counts", "total", "grp, node", seed)).alias("left"))
        s = s.select("grp", "ranks", F.explode(F.expr("array(struct(2 * node as node, left as counts), struct(2 * node + 1 as node, zip_with(counts, left, (c, l) -> c - l) as counts))")).alias("x")).select("grp", "x.node", "ranks", "x.counts")
    s = s.select("node", F.explode(F.expr("arrays_zip(ranks, counts)")).alias("x")).select("node", "x.ranks", "x.counts")
    return s.groupBy(F.col("ranks").alias("rank")).agg(F.expr("transform(sort_array(collect_list(struct(node, counts))), x -> x.counts)").alias("per_shard"))


def mix(docs: DataFrame, shards: int = 64, seed: int = 4, ratio: float = 1.5, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, shards (one for each copy), order_keys
    (one for each copy; a shard is read in their order). shards must be a power of two."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    d = scratch.keep(sized(docs, seed, id_col, text_col, source_col), "sizes")
    blocks = scratch.keep(d.groupBy("source", "b1").agg(F.sum("size").alias("words")), "blocks")
    goals = targets(blocks, ratio, weights=weights)
    goals = scratch.keep(goals.select("*", F.expr("if(source_size = 0, 1L, cast(floor(target / source_size) as bigint))").alias("passes")), "targets")
    goals = goals.withColumn("more", F.col("target") - F.col("passes") * F.col("source_size"))

    # blocks: whole passes, then a prefix of the permutation
    b = blocks.alias("b").join(goals.alias("g"), _same("b", "g")).select("g.source", "rank", "b1", "words", "passes", "more")
    b = _prefix(b, [F.xxhash64(F.lit(seed), "rank", "b1"), F.col("b1")], "more")
    b = scratch.keep(b.select("source", "rank", "b1", "passes", "edge", "rest", (F.col("passes") + F.when(F.col("inside") & (F.col("more") > 0), 1).otherwise(0)).alias("draws")), "draws")

    # the edge: sub-blocks of one block, then documents of one sub-block
    e1 = d.alias("d").join(b.where("edge").alias("b"), _same("d", "b", "b1")).select("d.*", F.col("rest").alias("limit1"))
    s2 = _prefix(e1.groupBy("source", "b1", "b2", "limit1").agg(F.sum("size").alias("words")), [F.col("b2")], "limit1")
    e2 = e1.alias("d").join(s2.where("inside or edge").select("source", "b1", "b2", "inside", "rest").alias("s"), _same("d", "s", "b1", "b2")).select("d.doc_id", "d.source", "d.size", "d.h", "inside", F.col("rest").alias("limit2"))
    last = _prefix(e2.where("not inside").select("doc_id", "source", "h", "limit2", F.col("size").alias("words")), [F.col("h"), F.col("doc_id"), F.col("words")], "limit2")
    edge = scratch.keep(e2.where("inside").select("doc_id", "source", "h", "size").unionByName(last.where("inside").select("doc_id", "source", "h", F.col("words").alias("size"))), "edge")

    # one row a document so far: copies
    picked = edge.groupBy("source", "doc_id", "h").agg(F.count("*").alias("n"))
    c = d.alias("d").join(b.alias("b"), _same("d", "b", "b1")).select("d.doc_id", "d.source", "d.size", "d.h", "d.b1", "b.rank", "b.passes", "b.draws", "b.edge")
    c = c.alias("d").join(picked.alias("p"), _same("d", "p", "doc_id", "h") & F.col("d.edge"), "left")
    c = scratch.keep(c.select("d.*", (F.col("draws") + F.when(F.col("n").isNotNull(), 1).otherwise(0)).cast("int").alias("copies")), "copies0")

    # fill what the edge left over with the document that fits best
    for k in range(3):
        close = F.col("c.size") <= F.col("gap") if k < 2 else F.abs(F.col("gap") - F.col("c.size")) < F.abs(F.col("gap"))
        got = c.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
        gap = goals.alias("g").join(got.alias("t"), _same("g", "t")).select("g.source", "g.passes", (F.col("target") - F.col("got")).alias("gap"))
        free = c.alias("c").join(gap.alias("g"), _same("c", "g")).where(F.expr("c.copies = g.passes and c.size > 0") & close)
        best = free.groupBy("c.source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("c.size")).alias("off"), F.col("c.h").alias("h"), F.col("c.doc_id").alias("doc_id"))).alias("best")).select("source", "best.h", "best.doc_id")
        c = scratch.keep(c.alias("c").join(best.alias("f"), _same("c", "f", "doc_id", "h"), "left").select("c.doc_id", "c.source", "c.size", "c.h", "c.b1", "c.rank", "c.passes", "c.draws", "c.edge", (F.col("c.copies") + F.when(F.col("f.doc_id").isNotNull() & (F.col("c.copies") == F.col("c.passes")), 1).otherwise(0)).alias("copies")), f"copies{k + 1}")

    # the splitting tree over block draws; a block that only some documents draw once more counts as drawn
    drawn = c.groupBy("rank", "b1").agg(F.max("copies").alias("n"))
    drawn = scratch.keep(drawn.where("n > 0").select("rank", "b1", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass")), "drawn")
    tree = shard_quotas(drawn.groupBy("rank").agg(F.count("*").alias("q")), shards.bit_length() - 1, seed)
    place = drawn.withColumn("at", F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "b1", "pass"), "b1", "pass")))
    upto = "transform(per_shard, (x, i) -> aggregate(slice(per_shard, 1, i + 1), 0L, (a, y) -> a + y))"
    place = place.join(tree.select("rank", F.expr(upto).alias("upto")), "rank").select("rank", "b1", "pass", F.expr("size(filter(upto, x -> x < at))").alias("shard"))
    place = place.groupBy("rank", "b1").agg(F.expr("transform(sort_array(collect_list(struct(pass, shard))), x -> x.shard)").alias("places"))
    out = c.alias("c").join(place.alias("p"), ["rank", "b1"], "left").join(goals.alias("g"), "rank").select(
        "c.doc_id", "c.source", "c.size", "g.source_size", "g.target", "c.copies",
        F.expr("if(copies = 0, cast(array() as array<int>), slice(places, 1, copies))").alias("shards"),
        F.expr(f"if(copies = 0, cast(array() as array<bigint>), transform(sequence(1, copies), i -> xxhash64({seed}, h, i)))").alias("order_keys"))
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that the mix takes, one for each copy: the columns of docs, copy (from 1), shard and order_key. A shard
    is its rows in the order of order_key. Rows of one id are taken alike, those without one too. Columns of docs with one of the new names give
    way."""
    plan = mix(docs, id_col=id_col, **options).where("copies > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.struct("shards", "order_keys")).alias("m"))
    plan = plan.select("__id", F.posexplode(F.arrays_zip("m.shards", "m.order_keys")).alias("k", "m")).select("__id", F.struct((F.col("k") + 1).alias("copy"), F.col("m.shards").alias("shard"), F.col("m.order_keys").alias("order_key")).alias("__m"))
    return docs.join(plan, docs[id_col].eqNullSafe(plan["__id"])).select(*(docs[c] for c in docs.columns if c.lower() not in ("copy", "shard", "order_key")), "__m.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "shards")
