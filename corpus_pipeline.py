"""From raw documents to a training mix, in five stages that each write their result and read it again.

Each stage works on all that the one before it kept. The last returns a row for each copy that the mix takes.

Defined results of all stages: an empty table gives an empty one; rows come back with their own values in all columns,
and columns of any other name, or of a name that an operator uses inside, pass through untouched; the columns read are
doc_id, text and, for the mix, source. What each stage does with nulls, empty and long texts, ties and repeated rows
stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisgrove.llm import op1_decontaminate, op2_pii, op4_mix, op6_quality, op8_minhash
from axisgrove.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled ones outside its held-out fold.

    A null text is judged as an empty one; texts are read whole, however long; a score equal to the threshold stays;
    repeated rows are judged alike; a null id, which no label can have, is scored like any other."""
    return op6_quality.accepted(docs, op6_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays.

    It is the one of the least id. Null, empty and blank texts have no shingle and stay; so does a row without an id;
    texts are compared on their whole sets; rows of one id are one document and stay or go together."""
    return op8_minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go.

    Null and empty texts stay; windows come from the whole text; a similarity equal to the threshold goes; rows of one
    id go together, those without an id too."""
    return op1_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars, where there is one, follows the text.

    No row goes. A null text stays null, with its n_chars, and an empty one empty; texts are searched whole, until no
    span is left; of overlapping spans the first is replaced, the longer of two with one start; repeated rows alike."""
    out = op2_pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources takes, with its shard and place.

    A null source is a source of its own; a null or empty text has no words, so it costs its source nothing; equal sizes
    and fits are settled by hash; rows of one id, or of none, are taken alike. The columns copy, shard and order_key are
    the mix's own."""
    return op4_mix.mixed(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: The classifier, the labelers' classifier and the mix's draws have no SQL; the tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with Scratch.scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
