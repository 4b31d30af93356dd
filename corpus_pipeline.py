"""From raw documents to token digests: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm import bpe, decontaminate, near_dedup, quality, repeats
from intervale.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` whose doc_id is not in `gone`; rows with null doc_ids stay."""
    return docs.select(*COLUMNS).join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of them outside the held-out fold, scores at the threshold or above."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out()))
    if model is None:  # no labels of both classes: nothing can be rejected
        return docs.select(*COLUMNS)
    whole = docs.select(*COLUMNS)
    return quality.score_documents(whole, model, keep=list(COLUMNS[1:])).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, one row of those with its doc_id and text; null doc_ids stay."""
    left = _without(docs, near_dedup.near_duplicates(docs).where("not kept"))
    some = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return some.union(left.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 200-byte strings that also start elsewhere."""
    cut = repeats.cut_repeats(docs, keep=["lang", "source"], text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["lang", "source"])


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", one_of_each),
    ("repeated strings", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("token ids", tokens),
]

#: The classifier, the token ids and their digests are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
