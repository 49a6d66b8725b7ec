"""Near-duplicates by MinHash.

1. One pass over the texts gives each document's shingle count, a 128-bit key of its shingle set, the minima of 400
   universal hashes (a * x + b over 64 bits) as 50 band keys of 8 minima each, and one byte of every minimum as its
   signature. Documents with one set become one node, so that copies are never paired.
2. Nodes that share a band key are candidates. Each bucket's most central node (the one with most bucket mates over all
   its bands) meets the bucket's others; signatures that agree in 75 % of places or more (five standard deviations
   under 85 %) are a loose link. Where a bucket's members do not all hang on its centre, the signatures of those that do
   not are compared with all inside tasks, and only a spanning forest of the loose links comes out.
3. Components of the loose links, by alternating large-star and small-star, hold all pairs that can be alike. Inside
   each, pairs are counted exactly on their full shingle sets, as a product of incidence matrices, and a spanning
   forest of the confirmed links comes out. In a large one, a few pivots meet all first, and then only the members that
   their links left outside the largest part meet all (see confirmed).
4. Confirmed links go to connected components, again by large-star and small-star.

Groups beyond BLOCK members or PAYLOAD bytes are cut into blocks, and a task gets a block of members that are not
settled and a block of all: no task grows with a group, and no pair is ever a row. Joins on a band, a centre or a
component deal a hot key to several tasks. A member is sent once for each block of its group's unsettled members.

A pair at the threshold shares no band with a chance of (1 - 0.85^8)^50 = 1.2e-7.

Defined results: null or empty text, or white space, has no shingle and links with nothing; a row without an id links
with nothing, has no component and is kept; ids may be negative; repeated rows are one node and each gets its row; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens_np
from .common import BROADCAST_IDS, Scratch, salted_join, table, without
from .components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, BANDS = 8, 50
BLOCK, PAYLOAD = 512, 6_000_000


def _coefficients(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    a = rng.integers(0, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, rows * bands, dtype=np.uint64)


def minima(grams: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least a[j] * x + b[j] (mod 2^64) over each row's n-grams; rows without any get none."""
    full = np.flatnonzero(np.diff(starts))
    out = np.empty((len(full), len(a)), dtype=np.uint64)
    if len(full):
        at = starts[full]
        buf = np.empty_like(grams)
        with np.errstate(over="ignore"):
            for j in range(len(a)):
                np.multiply(grams, a[j], out=buf)
                np.add(buf, b[j], out=buf)
                out[:, j] = np.minimum.reduceat(buf, at)
    return out


def featurizer(n: int, rows: int, bands: int):
    def features(batches):
        import pyarrow as pa

        a, b = _coefficients(rows, bands)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in tokens_np.pieces(texts, 300_000):
                grams, starts = tokens_np.ngrams(*tokens_np.words(data, offsets), n)
                counts = np.zeros(hi - lo, dtype=np.int64)
                k1, k2 = np.zeros(hi - lo, dtype=np.uint64), np.zeros(hi - lo, dtype=np.uint64)
                full = np.flatnonzero(np.diff(starts))
                low = minima(grams, starts, a, b)
                for r in full:
                    distinct = np.unique(grams[starts[r] : starts[r + 1]])
                    counts[r] = len(distinct)
                    k1[r] = np.add.reduce(tokens_np.mix(distinct))
                    k2[r] = np.add.reduce(tokens_np.mix(distinct ^ tokens_np.STEP))
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                for j in range(bands):
                    h = np.full(len(full), j + 1, dtype=np.uint64)
                    for k in range(rows):
                        h = tokens_np.mix(h * tokens_np.STEP + low[:, j * rows + k])
                    keys[:, j] = h
                of = np.zeros(hi - lo + 1, dtype=np.int32)
                of[1:] = np.cumsum(np.diff(starts) > 0) * bands
                signs = low.view(np.uint8)[:, ::8] if len(full) else np.zeros((0, rows * bands), dtype=np.uint8)
                signatures: list = [None] * (hi - lo)
                for i, r in enumerate(full):
                    signatures[r] = signs[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(counts), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(of), pa.array(keys.reshape(-1).view(np.int64))), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "signature"])

    return features


def agreeing(batches):
    """(a, b, share of equal signature bytes, w) of pairs."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1)), batch.column(4)], names=["a", "b", "share", "w"])


def forest(linked: np.ndarray) -> np.ndarray:
    """The least index that each index can reach over a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    for start in range(n):
        if label[start] != start:
            continue
        seen = np.zeros(n, dtype=bool)
        seen[start] = True
        edge = seen
        while edge.any():
            edge = linked[edge].any(axis=0) & ~seen
            seen = seen | edge
        label[seen] = start
    return label


def _spanning(nodes: np.ndarray, linked: np.ndarray):
    import pyarrow as pa

    label = forest(linked)
    rows = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": pa.array(nodes[rows]), "v": pa.array(nodes[label[rows]])})


def _block(t):
    """A block's rows by node, each node once, and which of them meet all the others."""
    nodes, own = t["node"].to_numpy(), np.array(t["own"].to_pylist(), dtype=bool)
    order = np.lexsort((~own, nodes))
    order = order[np.concatenate([[True], nodes[order][1:] != nodes[order][:-1]])]
    return order, nodes[order], np.flatnonzero(own[order])


def alike_signatures(share: float):
    """A spanning forest of the loose links of a block (node, payload: signature, n_shingles, tag, own). Nodes of one tag
    are linked already; own ones meet all."""

    def run(t):
        order, nodes, own = _block(t)
        sizes, tags = (t[c].to_numpy()[order] for c in ("n_shingles", "tag"))
        x = np.frombuffer(b"".join(t["payload"].to_pylist()), dtype=np.uint8).reshape(len(t["node"]), -1)[order]
        linked = np.zeros((len(nodes), len(nodes)), dtype=bool)
        for i in own:
            # sets whose sizes are too far apart cannot be alike
            near = np.minimum(sizes, sizes[i]) >= (share + 0.1) * np.maximum(sizes, sizes[i]) - 1e-9
            near[near] = (x[near] == x[i]).mean(axis=1) >= share
            linked[i] |= near
            linked[:, i] |= near
        names, counts = np.unique(tags, return_counts=True)
        for tag in names[counts > 1]:
            same = np.flatnonzero(tags == tag)
            linked[same[0], same] = linked[same, same[0]] = True
        return _spanning(nodes, linked)

    return run


def alike_sets(n: int, percent: int):
    """A spanning forest of the confirmed links of a block (node, payload: text, own); own nodes meet all."""

    def run(t):
        order, nodes, own = _block(t)
        payload = t["payload"].combine_chunks() if hasattr(t["payload"], "combine_chunks") else t["payload"]
        sets = []
        import pyarrow as pa

        for _, _, data, offsets in tokens_np.pieces(payload.cast(pa.string()).take(pa.array(order))):
            grams, starts = tokens_np.ngrams(*tokens_np.words(data, offsets), n)
            sets += [np.unique(grams[starts[r] : starts[r + 1]]) for r in range(len(starts) - 1)]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        n_sets, of = len(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        del sets
        shared = counts > 1
        place = (np.cumsum(shared) - 1).astype(np.int32)
        some = shared[ids]
        of, ids = of[some], place[ids[some]]
        both = np.zeros((len(own), n_sets), dtype=np.float32)
        order = np.argsort(ids, kind="stable")
        of, ids = of[order], ids[order]
        width = 2048
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(ids, [lo, lo + width])
            m = np.zeros((n_sets, width), dtype=np.float32)
            m[of[a:b], ids[a:b] - lo] = 1
            both += m[own] @ m.T
        linked = np.zeros((n_sets, n_sets), dtype=bool)
        linked[own] = (100 * both >= percent * (sizes[own][:, None] + sizes - both)) & (both > 0)
        return _spanning(nodes, linked | linked.T)

    return run


def blocks_of(members: DataFrame, group: str, block: int, payload: int) -> DataFrame:
    """(group, n, ka, ku): how many blocks a group's members, and those of them that are not settled, are cut into. Where
    few are not settled, they can go to many blocks at little cost, so these are smaller."""
    cut = lambda m, size, rows: F.least(m, F.greatest(F.ceil(m / rows), F.ceil(size / payload))).cast("int")
    free, size = F.when(~F.col("settled"), 1), F.length("payload")
    g = members.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count(free).alias("u"), F.sum(free * size).alias("ubytes"))
    return g.where("n > 1 and u > 0").select(group, "n", cut(F.col("n"), F.col("bytes"), F.least(F.lit(block), F.greatest(F.lit(64), 8 * F.col("u")))).alias("ka"), cut(F.col("u"), F.col("ubytes"), F.lit(block)).alias("ku"))


def in_blocks(scratch: Scratch, name: str, members: DataFrame, group: str, kernel, block: int = BLOCK, payload: int = PAYLOAD) -> DataFrame:
    """The kernel's edges (u, v) over the groups of members (group, node, payload, n_shingles, tag, settled). Members
    that are not settled meet all of their group, settled ones are linked to each other already. Groups of more than
    `block` members or `payload` bytes are cut by hash, and a task gets a block of the one kind and a block of all."""
    sizes = scratch.keep(blocks_of(members, group, block, payload), f"sizes-{name}")
    m = salted_join(scratch, name, members, sizes.select(group, "ka", "ku"), group, counts=sizes.select(group, "n"))
    h = F.xxhash64("node")
    m = m.select(F.col(group).alias("g"), "node", "payload", "n_shingles", "tag", "settled", "ka", "ku", F.pmod(h, "ka").cast("int").alias("i"), F.pmod(F.shiftright(h, 20), F.col("ku")).cast("int").alias("j"))
    every = "transform(sequence(0, ku - 1), x -> struct(x as a, i as b, not settled and ka = 1 and ku = 1 as own))"
    free = "if(settled or ka * ku = 1, array(), transform(sequence(0, ka - 1), x -> struct(j as a, x as b, true as own)))"
    m = m.select("g", "node", "payload", "n_shingles", "tag", F.explode(F.expr(f"concat({every}, {free})")).alias("x")).select("g", "x.a", "x.b", "node", "payload", "n_shingles", "tag", "x.own")
    return m.groupBy("g", "a", "b").applyInArrow(kernel, "u bigint, v bigint")


#: So many nodes of a large group, half of them the most central ones and half any, meet the whole group first.
PIVOTS = 16


def confirmed(scratch: Scratch, texts: DataFrame, central: DataFrame, kernel, pivots: int = PIVOTS) -> DataFrame:
    """The kernel's edges over the loose components of texts (component, node, payload, n_shingles, tag). In a component
    of several blocks a few pivots meet all the others first; the largest part that their links hold together is then
    settled, and only what is left of the component meets all of it. No link between different parts can be lost by that,
    and a group of copies around a centre costs its own size, not the square."""
    texts = texts.withColumn("settled", F.lit(False))
    sizes = in_blocks.__defaults__
    # nothing is settled yet, so these are the components of several full blocks
    big = scratch.keep(blocks_of(texts, "component", *sizes).where("ka > 1").select("component", "n"), "big")
    if not big.count():
        return in_blocks(scratch, "sets", texts, "component", kernel)
    ids = F.broadcast(big.select("component")) if big.count() <= BROADCAST_IDS else big.select("component")
    large = scratch.keep(texts.join(ids, "component", "left_semi"), "large")
    ranks = large.select("component", "node").join(central, "node")
    first = [ranks.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(*by))).where(f"r <= {pivots // 2}").select("node") for by in ([F.col("mates").desc(), F.col("node")], [F.xxhash64("node"), F.col("node")])]
    first = scratch.keep(first[0].unionByName(first[1]).distinct(), "pivots")
    met = large.drop("settled").join(first.withColumn("pivot", F.lit(True)), "node", "left").withColumn("settled", F.col("pivot").isNull()).drop("pivot")
    links = scratch.keep(in_blocks(scratch, "pivots", met, "component", kernel), "pivot-links")
    parts = connected_components(links).select("node", F.col("component").alias("part")).join(large.select("node", "component"), "node")
    parts = scratch.keep(parts, "parts")
    most = parts.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("x")).select((-F.col("x.p")).alias("part"))
    core = scratch.keep(parts.join(most, "part", "left_semi").select("node", F.lit(True).alias("core")), "core")
    rest = large.drop("settled").join(core, "node", "left").withColumn("settled", F.col("core").isNotNull()).drop("core")
    others = texts.join(ids, "component", "left_anti")
    return links.unionByName(in_blocks(scratch, "rest", rest, "component", kernel)).unionByName(in_blocks(scratch, "sets", others, "component", kernel))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row a document: doc_id, n_shingles, component_id (least id of the component), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    loose = percent / 100 - 0.1
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    made = d.mapInArrow(featurizer(n, rows, bands), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary")
    made = scratch.keep(made, "features")
    # one node a shingle set: the least id that has it
    nodes = scratch.keep(made.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node")), "nodes")
    node_of = made.join(nodes.select(F.col("node"), "k1", "k2"), (made["doc_id"] == F.col("node")) & (made["k1"] == nodes["k1"]) & (made["k2"] == nodes["k2"]), "left_semi")
    signs = node_of.groupBy(F.col("doc_id").alias("node"), "n_shingles").agg(F.first("signature").alias("signature"))
    members = node_of.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = scratch.keep(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = scratch.keep(salted_join(scratch, "shared", members, shared, "band", counts=shared), "buckets")
    central = scratch.keep(buckets.groupBy("node").agg(F.sum("n").alias("mates")), "central")
    ranked = buckets.select("band", "node").join(central, "node")
    centres = ranked.groupBy("band").agg(F.min(F.struct((-F.col("mates")).alias("w"), F.col("node"))).alias("c")).select("band", F.col("c.node").alias("centre"), F.col("c.w").alias("w"))
    hung = scratch.keep(salted_join(scratch, "hung", buckets.select("band", "node"), centres, "band", counts=shared), "hung")

    # loose links to the centres
    pairs = scratch.keep(hung.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "w").distinct(), "pairs")
    far = f"least(m, n_shingles) >= {percent / 100} * greatest(m, n_shingles) - 1e-9"
    p = salted_join(scratch, "pairs", pairs, signs.select(F.col("node").alias("a"), F.col("signature").alias("x"), F.col("n_shingles").alias("m")), "a")
    p = p.join(signs.select(F.col("node").alias("b"), F.col("signature").alias("y"), "n_shingles"), "b").where(far)
    star = p.select("a", "b", "x", "y", "w").mapInArrow(agreeing, "a bigint, b bigint, share double, w bigint").where(f"share >= {loose}").select("a", "b", "w")
    star = scratch.keep(star, "star")
    # a bucket whose members all hang on one centre is done; the others are compared inside
    holds = star.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("w", "a")).alias("c")).select("node", F.col("c.a").alias("on"))
    # a node that hangs on none has a tag of its own, a pair of it and false, which no other can have
    tag = lambda on, hung_up: F.struct(on.alias("on"), hung_up.alias("hangs"))
    tagged = hung.join(holds, "node", "left").select("band", "node", "centre", F.when(F.col("node") == F.col("centre"), tag(F.col("centre"), F.lit(True))).when(F.col("on").isNotNull(), tag(F.col("on"), F.lit(True))).otherwise(tag(F.col("node"), F.lit(False))).alias("tag"))
    tagged = scratch.keep(tagged, "tagged")
    mixed = tagged.groupBy("band").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("band")
    inner = salted_join(scratch, "mixed", tagged, mixed, "band", "left_semi", counts=shared).join(signs, "node")
    inner = inner.select("band", "node", F.col("signature").alias("payload"), "n_shingles", F.xxhash64("tag.on", "tag.hangs").alias("tag"), (F.col("tag.hangs") & (F.col("tag.on") == F.col("centre"))).alias("settled"))
    more = in_blocks(scratch, "buckets", inner, "band", alike_signatures(loose))
    links = scratch.keep(star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(more).distinct(), "loose")
    clusters = scratch.keep(connected_components(links), "clusters")

    # exact counts inside the loose components
    wanted = clusters.select(F.col("node").alias("doc_id"))
    if clusters.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = d.join(wanted, "doc_id", "left_semi").join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
    texts = texts.join(nodes.select(F.col("node").alias("doc_id"), "n_shingles"), "doc_id").select("component", F.col("doc_id").alias("node"), F.col("text").alias("payload"), "n_shingles", F.lit(0).alias("tag"))
    sure = scratch.keep(confirmed(scratch, scratch.keep(texts, "texts"), central, alike_sets(n, percent)), "links")
    scratch.drop("texts", "large", "buckets", "hung", "pairs", "star", "tagged", "shared")
    components = scratch.keep(connected_components(sure), "components")
    small = nodes.join(components, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = made.select("doc_id", "n_shingles", "k1", "k2").join(small, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 7, bands: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one document a component is left, the one of the least id. Rows of one id are one
    document and stay or go together; null ids stay."""
    found = near_duplicates(docs, n, percent, rows, bands, id_col, text_col)
    gone = Scratch(docs.sparkSession, "dedup").keep(found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return without(docs, gone, id_col)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
