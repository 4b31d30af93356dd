"""The shapes of a video corpus laid over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT, LONG = 50, 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _video(col: str = "vec_id", size: int = SHORT) -> Column:
    return F.concat(F.lit("v"), F.floor(F.col(col) / size).cast("int").cast("string"))


def frames(spark: SparkSession, sf_dir: str, size: int = SHORT) -> DataFrame:
    """video_id, t, h."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_video(size=size).alias("video_id"), (F.col("vec_id") % size).cast("int").alias("t"), F.col("embedding").alias("h"))


def videos(spark: SparkSession, sf_dir: str, size: int = SHORT) -> DataFrame:
    """video_id, category, duration, category_id."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % size == 0)
    return e.select(_video(size=size).alias("video_id"), F.concat(F.lit("cat"), F.col("label").cast("string")).alias("category"), (F.lit(float(size)) / 3).alias("duration"), (F.col("label") % 3).cast("int").alias("category_id"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """doc_id, said (the text as one line) of all documents, and their number."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.trim(F.translate("text", "\n", " ")).alias("said")), d.count()


def captions(spark: SparkSession, sf_dir: str, size: int = SHORT) -> DataFrame:
    """video_id, t, caption."""
    e, (d, n) = table(spark, sf_dir, "embeddings"), _documents(spark, sf_dir)
    return e.join(d, F.col("doc_id") == F.col("vec_id") % n).select(_video(size=size).alias("video_id"), (F.col("vec_id") % size).cast("int").alias("t"), F.col("said").alias("caption"))


def text_feats(spark: SparkSession, sf_dir: str, size: int = SHORT) -> DataFrame:
    """video_id, t, q: the next frame's vector."""
    f = frames(spark, sf_dir, size)
    return f.select("video_id", ((F.col("t") + size - 1) % size).cast("int").alias("t"), F.col("h").alias("q"))


def types(spark: SparkSession, sf_dir: str, size: int = SHORT) -> DataFrame:
    """video_id, t, type_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_video(size=size).alias("video_id"), (F.col("vec_id") % size).cast("int").alias("t"), (F.col("label") % 4).cast("int").alias("type_id"))


def boundary_prob(spark: SparkSession, sf_dir: str, size: int = SHORT) -> DataFrame:
    """video_id, t, b: distinct values within any 101 frames."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_video(size=size).alias("video_id"), (F.col("vec_id") % size).cast("int").alias("t"), (((F.col("vec_id") * 37) % 101).cast("double") / 101).alias("b"))


def _intervals(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == (0 if which == "pred" else 1))
    d, n = _documents(spark, sf_dir)
    start = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    out = e.join(d, F.col("doc_id") == F.col("event_id") % n)
    return out.withColumns({"video_id": F.concat(F.lit("u"), F.col("user_id").cast("string")), "start": start, "end_": start + F.col("value") * 3600})


def intervals(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """video_id, event_id, start, end_, sentence of `pred` (even events) or `ref` (odd ones)."""
    return _intervals(spark, sf_dir, which).select("video_id", "event_id", "start", "end_", F.concat("event_type", F.lit(" "), "said").alias("sentence"))


def referring(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """`intervals` whose sentences are references: the document and the event's type."""
    return _intervals(spark, sf_dir, which).select("video_id", "event_id", "start", "end_", F.struct("doc_id", "event_type").alias("sentence"))


def sentences(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame, str], DataFrame]:
    """Adds to rows, of which the named column has references, their sentences as `text`; each document moves once, each row to its document."""
    d = _documents(spark, sf_dir)[0].withColumnRenamed("doc_id", "_doc")
    return lambda rows, name: rows.join(d, F.col(name)["doc_id"] == F.col("_doc")).withColumn("text", F.concat(F.col(name)["event_type"], F.lit(" "), "said")).drop("_doc", "said")
