"""Benchmark decontamination by SimHash windows.

A document is contaminated by an item if one of its windows of the item's length in words is alike: weighted Jaccard
of 5-word shingles (weights: occurrences) of 0.8 or more. Words are lower-cased and freed of everything but letters
and digits. A document shorter than the item is one window. An item of fewer than 5 words is one shingle, and meets
the documents' shingles of as many words.

1. Prefix filter, lossless. An alike window lacks at most 20 % of the item's shingles, so it has one of any
   floor(0.2 * n) + 1 of them; the hashes of so many rarest shingles of each item meet the documents' shingles in a
   join. Documents keep only candidate items, no text is moved before that.
2. Windows. The candidate document's places of the item's shingles, by a join, say which of all its windows of the
   item's length is worth a fingerprint: a place counts for the windows from its item's length before it, or from just
   after as many earlier places of its shingle as the item has, up to itself. A sweep over the ends of these intervals
   finds the first window with most of the item, in n log n steps for n places. A candidate whose best window is
   too poor is done.
3. SimHash. A window and an item have 64-bit fingerprints of their weighted shingles. A multi-index of 24 blocks finds
   the items within Hamming distance 23, whatever bits differ: of 24 blocks one must be equal. At the threshold the
   angle between two windows makes about 10 bits differ, with a deviation of 3. Blocks of 2 or 3 bits select little, so
   the index is looked up under the candidate items' keys and not under all items of the length.
4. The exact weighted Jaccard similarity of the shingles decides, for those items and for candidates beyond the radius
   (heavily repeated shingles can turn that many bits). So no alike window is lost.

Everything is DataFrame and SQL functions. The benchmark's index is broadcast only if it has at most
BROADCAST_ROWS rows (24 bytes each); else the joins shuffle.

Defined results: null or empty texts, and items without words, have no match; repeated rows are judged row by row and
repeated items each match; an empty table, on either side, gives no pairs; columns other than ids and texts are not
read, and a document id need not be unique, nor be there: a null id is an id like others.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, let, lets, table

SHINGLE = 5
PERCENT = 80
RADIUS = 23
BROADCAST_ROWS = 400_000


def norm_words(text: str) -> str:
    return f"array_remove(split(regexp_replace(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}\\\\s]+', ''), '[\\\\s]+'), '')"


def shingles_sql(w: str, n: int = SHINGLE) -> str:
    """Hashes of the n-word windows of array w, in order; all words as one if there are fewer, none without words."""
    window = f"xxhash64({', '.join(f'h[i + {k}]' for k in range(n))})"
    return lets(
        f"case when size(h) = 0 then cast(array() as array<bigint>) when size(h) < {n} then array(aggregate(h, 42L, (a, x) -> xxhash64(a, x))) else transform(sequence(0, size(h) - {n}), i -> {window}) end",
        ("h", f"transform({w}, x -> xxhash64(x))"))


def item_shingles_sql(w: str) -> str:
    """The shingles of an item of words w: of its own length if it is shorter than a shingle."""
    return f"case size({w}) {' '.join(f'when {n} then {shingles_sql(w, n)}' for n in range(1, SHINGLE))} else {shingles_sql(w)} end"


def weighted_sql(s: str) -> str:
    """Array of (shingle, weight) of an array of shingles that is not empty, in the order of the shingles."""
    return lets(
        "transform(at, (b, k) -> struct(o[b] as g, if(k + 1 < size(at), at[k + 1], size(o)) - b as n))",
        ("o", f"sort_array({s})"), ("at", "filter(sequence(0, size(o) - 1), i -> i = 0 or o[i] <> o[i - 1])"))


def labels_sql(s: str) -> str:
    """A set that stands for an array of shingles with their weights: each shingle's first, second, ... occurrence."""
    return f"flatten(transform({weighted_sql(s)}, y -> transform(sequence(1, y.n), k -> xxhash64(y.g, k))))"


def best_window_sql(o: str, m: str, n: str) -> str:
    """(best, b): the most of an item's shingles, with their weights, that a window of m of n shingles holds, and the
    first start of such a window. o: array of (g, pos, c) in order, the places of shingles of which the item has c."""
    low = "greatest(0, x.pos - m + 1, if(j >= x.c, if(o[j - x.c].g = x.g, o[j - x.c].pos + 1, 0), 0))"
    step = ("if(e % 2 = 1, struct(a.n - 1 as n, a.best as best, a.b as b), "
            "if(a.n + 1 > a.best, struct(a.n + 1 as n, a.n + 1 as best, e div 2 as b), struct(a.n + 1 as n, a.best as best, a.b as b)))")
    return lets(
        f"aggregate(sort_array(flatten(transform(filter(ends, x -> x.low <= 2 * greatest(0, n - m)), x -> array(x.low, x.high)))), struct(0L as n, 0L as best, 0L as b), (a, e) -> {step}, a -> struct(a.best as best, a.b as b))",
        ("m", m), ("n", n), ("o", o), ("ends", f"transform(o, (x, j) -> struct(2L * {low} as low, 2L * x.pos + 1 as high))"))


def simhash_sql(s: str) -> str:
    """64-bit SimHash of an array of shingles; each occurrence weighs one."""
    bit = "if(2 * aggregate(hs, 0, (a, x) -> a + cast(getbit(x, b) as int)) > size(hs), shiftleft(1L, b), 0L)"
    return let(f"transform({s}, x -> xxhash64(x, 7L))", "hs", f"aggregate(transform(sequence(0, 63), b -> {bit}), 0L, (a, x) -> a | x)")


def blocks_sql(f: str, radius: int = RADIUS) -> str:
    """radius + 1 disjoint blocks of the 64 bits, as (number, value)."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return "array(" + ", ".join(f"struct({k} as k, shiftrightunsigned({f}, {a}) & {(1 << (b - a)) - 1}L as v)" for k, (a, b) in enumerate(zip(cuts, cuts[1:]))) + ")"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, item_id, start (of the first of the most alike windows, in words from 0) and similarity: one row
    for each document and item that contaminates it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select("item_id", F.expr(norm_words("text")).alias("w")).where("size(w) > 0")
    items = items.select("item_id", F.expr("size(w)").alias("len"), F.expr(item_shingles_sql("w")).alias("s"))
    items = items.groupBy("len", "s").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    items = scratch.keep(items.select(F.xxhash64("len", "s").alias("key"), "len", "s", "item_ids", F.expr(labels_sql("s")).alias("il"), F.expr(simhash_sql("s")).alias("fp")), "items")
    n_items = items.count()
    rarity = items.select("key", F.explode(F.array_distinct("s")).alias("g"), F.size("s").alias("n")).withColumn("df", F.count("*").over(Window.partitionBy("g")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "g"))
    # at most (100 - percent) % of the occurrences can be missing
    prefix = scratch.keep(rarity.withColumn("rank", rank).where(f"rank <= floor({100 - percent} * n / 100) + 1").select("g", "key"), "prefix")
    n_prefix = prefix.count()
    if not n_prefix:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, start int, similarity double").select(F.col("doc_id").cast(docs.schema[id_col].dataType), F.col("item_id").cast(benchmark.schema["item_id"].dataType), "start", "similarity")

    # in a struct, null ids are equal to each other in joins
    d = docs.select(F.struct(F.col(id_col).alias("id")).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    # documents are cut at 5 words, and at the lengths of the items of fewer words
    short = sorted(r["len"] for r in items.where(f"len < {SHINGLE}").select("len").distinct().collect())
    lengths = [*short, SHINGLE]
    cut = [F.expr(shingles_sql("w", n)).alias(f"s{n}") for n in lengths]
    words = F.expr(norm_words("text")).alias("w")
    s = d.select("doc_id", "th", words).select("doc_id", "th", F.explode(F.expr(let(f"concat({', '.join(shingles_sql('w', n) for n in lengths)})", "o", "array_distinct(o)"))).alias("g"))
    pairs = s.join(_small(prefix, n_prefix), "g").select("doc_id", "th", "key").distinct()
    pairs = scratch.keep(pairs, "pairs")

    # places of the candidate items' shingles in their documents; repeated rows are alike in all that follows
    few = pairs.select("doc_id", "th").distinct()
    texts = d.join(_small(few, few.count()), ["doc_id", "th"], "left_semi").select("doc_id", "th", words).select("doc_id", "th", *cut)
    texts = scratch.keep(texts.dropDuplicates(["doc_id", "th"]), "texts")
    weights = scratch.keep(items.select("key", F.expr(f"if(len < {SHINGLE}, len, {SHINGLE})").alias("cut"), F.size("s").alias("m"), F.explode(F.expr(weighted_sql("s"))).alias("x")).select("key", "cut", "m", "x.g", F.col("x.n").alias("c")), "weights")
    known = weights.select("cut", "g").distinct()
    n_known = weights.count()
    places = [texts.select("doc_id", "th", F.lit(n).alias("cut"), F.size(f"s{n}").alias("n"), F.posexplode(f"s{n}").alias("pos", "g")) for n in lengths]
    places = functools.reduce(DataFrame.unionByName, places)
    places = places.join(F.broadcast(known), ["cut", "g"], "left_semi") if n_known <= BROADCAST_ROWS else places
    wanted = pairs.join(_small(weights, n_known), "key")
    hits = places.join(wanted, ["doc_id", "th", "cut", "g"]).groupBy("doc_id", "th", "key", "cut", "m", "n").agg(F.sort_array(F.collect_list(F.struct("g", "pos", "c"))).alias("o"))
    windows = hits.select("doc_id", "th", "key", "cut", "m", "n", F.expr(best_window_sql("o", "m", "n")).alias("w")).where(f"100 * w.best >= {percent} * (m + least(m, n) - w.best)")
    windows = scratch.keep(windows.select("doc_id", "th", "key", "cut", "m", F.col("w.b").cast("int").alias("start")), "starts")
    of_cut = f"case cut {' '.join(f'when {n} then s{n}' for n in short)} else s{SHINGLE} end" if short else f"s{SHINGLE}"
    windows = windows.join(texts, ["doc_id", "th"]).select("doc_id", "key", "cut", "start", F.expr(f"slice({of_cut}, start + 1, m)").alias("s"))
    windows = scratch.keep(windows.withColumn("wkey", F.xxhash64("cut", "s")), "windows")

    # each content is looked up once
    content = windows.groupBy("wkey").agg(F.first("s").alias("s"))
    content = scratch.keep(content.select("wkey", F.expr(labels_sql("s")).alias("wl"), F.expr(simhash_sql("s")).alias("fp")), "content")
    cuts = windows.select("wkey", "key").distinct()
    index = items.select("key", F.col("fp").alias("ifp"), F.explode(F.expr(blocks_sql("fp", radius))).alias("b")).select("key", "ifp", "b.k", "b.v")
    probe = cuts.join(content.select("wkey", "fp"), "wkey").select("wkey", "key", "fp", F.explode(F.expr(blocks_sql("fp", radius))).alias("b")).select("wkey", "key", "fp", "b.k", "b.v")
    near = probe.join(_small(index, n_items * (radius + 1)), ["key", "k", "v"]).where(f"bit_count(fp ^ ifp) <= {radius}").select("wkey", "key").distinct()
    far = cuts.join(near, ["wkey", "key"], "left_anti")
    checked = near.unionByName(far).join(content.select("wkey", "wl"), "wkey").join(_small(items.select("key", "il", "item_ids"), n_items), "key")
    checked = checked.select("wkey", "key", "item_ids", F.expr("size(wl) + size(il)").alias("sizes"), F.expr("size(array_intersect(wl, il))").alias("both")).where(f"100 * both >= {percent} * (sizes - both)")
    found = windows.select("doc_id", "key", "wkey", "start").join(checked.select("wkey", "key", F.explode("item_ids").alias("item_id"), F.expr("both / (sizes - both)").alias("similarity")), ["wkey", "key"])
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"))).alias("x"))
    best = scratch.keep(best.select(F.col("doc_id.id").alias("doc_id"), "item_id", F.col("x.start").alias("start"), (-F.col("x.s")).alias("similarity")), "found")
    scratch.drop("items", "prefix", "pairs", "texts", "weights", "starts", "windows", "content")
    return best


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that no item contaminates, with their columns."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__id")).distinct()
    bad = Scratch(docs.sparkSession, "leaks").keep(bad, "bad")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All windows of all documents by counts of equal shingles, without fingerprints or a prefix filter.
OP1_SQL = r"""
WITH i AS (
  SELECT item_id, w, len(w) AS words, least(len(w), 5) AS cut FROM (
    SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT item_id, cut, words, unnest(list_transform(range(1, len(w) - cut + 2), lambda k: array_to_string(w[k:k + cut - 1], ' '))) AS g FROM i),
c AS (SELECT item_id, cut, g, count(*) AS c, max(words) - max(cut) + 1 AS m FROM g GROUP BY item_id, cut, g),
s AS (SELECT r, doc_id, cut, len(w) - cut + 1 AS n, k - 1 AS pos, array_to_string(w[k:k + cut - 1], ' ') AS g FROM d, (SELECT DISTINCT cut FROM i), unnest(range(1, len(w) - cut + 2)) AS t(k)),
h AS (SELECT r, doc_id, item_id, m, n, pos, greatest(0, pos - m + 1, coalesce(lag(pos, c) OVER (PARTITION BY r, item_id, g ORDER BY pos) + 1, 0)) AS low FROM s JOIN c USING (cut, g)),
b AS (SELECT DISTINCT r, doc_id, item_id, m, n, low AS start FROM h WHERE low <= greatest(0, n - m)),
k AS (SELECT b.r, b.doc_id, b.item_id, b.start, m + least(m, n) AS sizes, count(*) AS k FROM b JOIN (SELECT r, item_id, low, pos FROM h) x ON x.r = b.r AND x.item_id = b.item_id AND x.low <= b.start AND x.pos >= b.start
      GROUP BY b.r, b.doc_id, b.item_id, b.start, m, n)
SELECT doc_id, item_id, start::INTEGER AS start, k / (sizes - k)::DOUBLE AS similarity FROM k WHERE 100 * k >= 80 * (sizes - k)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k / (sizes - k)::DOUBLE DESC, start) = 1
"""
