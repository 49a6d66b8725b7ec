"""What the training-data operators share: tables, folds, scratch tables, SQL fragments."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a folder of this machine is made,
    which only a local master can share."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="axisgrove-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor."""

    _scopes: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for scope in self._scopes[-1:]:
            scope.append(self)

    @classmethod
    @contextlib.contextmanager
    def scope(cls):
        """All tables of objects that are made inside are deleted at the end: what was made of them must be written by then."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for made in cls._scopes.pop():
                made.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; all of them if none is named."""
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def sampled(rows: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """The rows whose key is in a sample of at most `most` keys (for each value of `by`): all of them if there are no
    more rows than that, else those of the least hash in each of `most` bins of the keys' hashes. It never comes out
    empty where there are rows, two runs agree, and nothing but a row a bin is shuffled."""
    group = [by] if by else []
    h = rows.withColumn("__h", F.xxhash64(key)).withColumn("__bin", F.pmod(F.shiftright("__h", 7), F.lit(most)))
    bins = h.groupBy(*group, "__bin").agg(F.min("__h").alias("__least"), F.count("*").alias("__n"))
    sizes = bins.groupBy(*group).agg((F.sum("__n") <= most).alias("__all"))
    bins = (bins.join(sizes, by) if by else bins.crossJoin(F.broadcast(sizes))).select(*group, "__bin", "__least", "__all")
    return h.join(F.broadcast(bins), [*group, "__bin"]).where("__all or __h = __least").select(*rows.columns)


def let(value: str, name: str, body: str) -> str:
    """SQL that computes value once per row and gives it to body by name. (A lambda variable keeps the
    optimizer from copying an expensive expression into an inner lambda, where each element would pay for it.)"""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def lets(body: str, *bound: tuple[str, str]) -> str:
    for name, value in reversed(bound):
        body = let(value, name, body)
    return body


def words_sql(text: str) -> str:
    """The array of words; null text has none."""
    return f"array_remove(split(coalesce({text}, ''), '{WS.replace(chr(92), chr(92) * 2)}'), '')"


def ascii_lower_sql(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate({text}, '{upper}', '{upper.lower()}')"


def rows_of(df: DataFrame) -> int:
    """A count that parquet answers from its footers."""
    return df.count()


#: Ids are broadcast up to so many (16 bytes each in a hashed relation); beyond it the join shuffles.
BROADCAST_IDS = 200_000


#: A task gets about so many rows of one key in a salted join.
HOT = 500


def salted_join(scratch: Scratch, name: str, many: DataFrame, one: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, rows: int = HOT) -> DataFrame:
    """many joined with one on a key of which one has one row. Keys of which many has more than `rows` rows are dealt to
    parts of about so many, and one's row goes to each part; so no task grows with a key. counts (key, n) if known.
    (Were there more of such keys than can be broadcast, they would be left to the shuffle, as no key is hot among so many.)"""
    counts = counts if counts is not None else many.groupBy(key).agg(F.count("*").alias("n"))
    hot = scratch.keep(counts.where(f"n > {rows}").select(F.col(key), F.ceil(F.col("n") / rows).cast("int").alias("__k")), f"hot-{name}")
    if not 0 < hot.count() <= BROADCAST_IDS:
        return many.join(one, key, how)
    part = F.coalesce(F.pmod(F.xxhash64(*(c for c in many.columns if c != key and many.schema[c].dataType.typeName() != "binary")), F.col("__k")), F.lit(0)).cast("int")
    left = many.join(F.broadcast(hot), key, "left").withColumn("__p", part).drop("__k")
    right = one.join(F.broadcast(hot), key, "left").withColumn("__p", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1))).drop("__k")
    return left.join(right, [key, "__p"], how).drop("__p")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids (one column of that name, written already)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, "left_anti").select(*docs.columns)
