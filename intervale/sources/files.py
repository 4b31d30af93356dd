"""Manifests, captions, frame arrays and interval sets from files; checks that fail rather than filter."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that is no JSON of the asked shape raises.
STRICT = {"mode": "FAILFAST"}
SUFFIXES = ("mp4", "mkv", "webm", "avi", "mov")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, duration, category, path of a JSON list of entries, or of `videos` in an object. Missing or repeated ids raise."""
    return manifest_entries(spark.read.text(path, wholetext=True))


def manifest_entries(raw: DataFrame) -> DataFrame:
    """The same of column `value`."""
    record = "struct<id:string,duration:double,category:string,path:string>"
    is_list = F.ltrim("value").startswith("[")
    listed = F.coalesce(F.from_json(F.when(is_list, F.col("value")), f"array<{record}>", STRICT), F.from_json(F.when(~is_list, F.col("value")), f"struct<videos:array<{record}>>", STRICT)["videos"])
    out = raw.select(F.explode(listed).alias("v")).select(F.col("v.id").alias("video_id"), F.nullif(F.col("v.duration"), F.lit(0.0)).alias("duration"), "v.category", "v.path")
    return checked_ids(out)


def checked_ids(videos: DataFrame) -> DataFrame:
    bad = videos.agg(F.count_if(F.coalesce("video_id", F.lit("")) == "").alias("empty"), (F.count("video_id") - F.countDistinct("video_id")).alias("twice")).first()
    if bad["empty"] or bad["twice"]:
        raise ValueError(f"{bad['empty']} entries without an id, {bad['twice']} repeated ids")
    return videos


def _file_id(suffix: str) -> Column:
    return F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1)


def frame_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, t, h of the .npy files of a folder; a third axis keeps its first entry."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    return decoded_frames(files.select(_file_id("npy").alias("video_id"), "content"))


def decoded_frames(arrays: DataFrame) -> DataFrame:
    """The same of video_id and content, an array file's bytes."""

    def rows(batches):
        for b in batches:
            for video, content in zip(b.video_id, b.content, strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[:, 0, :] if a.ndim == 3 else a
                if a.ndim != 2 or not np.isfinite(a).all():
                    raise ValueError(f"{video}: not a finite matrix")
                yield pd.DataFrame({"video_id": video, "t": np.arange(len(a), dtype=np.int32), "h": list(a.astype(np.float32))})

    return arrays.mapInPandas(rows, "video_id string, t int, h array<float>")


def encoded_frames(frames: DataFrame) -> DataFrame:
    """video_id, content: each video's frames as an array file's bytes."""

    def rows(g: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack(g.sort_values("t").h.to_numpy()).astype(np.float32))
        return pd.DataFrame({"video_id": [g.video_id.iloc[0]], "content": [out.getvalue()]})

    return frames.select("video_id", "t", "h").groupBy("video_id").applyInPandas(rows, "video_id string, content binary")


def caption_lists(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, t, caption of JSON lists of strings or of lists of strings (their first)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return decoded_captions(files.select(_file_id("json").alias("video_id"), F.decode("content", "UTF-8").alias("value")))


def decoded_captions(lists: DataFrame) -> DataFrame:
    """The same of video_id and value, a list's JSON."""
    is_nested = F.col("value").rlike(r"^\s*\[\s*\[")
    nested = F.from_json(F.when(is_nested, F.col("value")), "array<array<string>>", STRICT)
    plain = F.from_json(F.when(~is_nested, F.col("value")), "array<string>", STRICT)
    return lists.select("video_id", F.posexplode(F.coalesce(F.transform(nested, lambda x: F.get(x, F.lit(0))), plain)).alias("t", "caption"))


def interval_entries(json: DataFrame) -> DataFrame:
    """video_id, duration, timestamps, sentences of column `value`: an object of videos; those without intervals too."""
    entry = "map<string,struct<duration:double,timestamps:array<array<double>>,sentences:array<string>>>"
    one = json.select(F.explode(F.from_json("value", entry, STRICT)).alias("video_id", "v"))
    return one.select("video_id", "v.duration", F.coalesce("v.timestamps", F.array().cast("array<array<double>>")).alias("timestamps"), F.coalesce("v.sentences", F.array().cast("array<string>")).alias("sentences"))


def interval_map(json: DataFrame, aligned: bool = True) -> DataFrame:
    """video_id, ord, start, end_, sentence, duration of column `value`: an object of videos with aligned timestamps and
    sentences; with `aligned`, other sizes raise when the rows are read."""
    one = interval_entries(json)
    if aligned:
        sized = F.when(F.size("timestamps") == F.size("sentences"), F.col("timestamps")).otherwise(F.raise_error(F.concat(F.lit("misaligned captions: "), "video_id")).cast("array<array<double>>"))
        one = one.withColumn("timestamps", sized)
    both = F.arrays_zip(F.col("timestamps").alias("ts"), F.slice("sentences", F.lit(1), F.size("timestamps")).alias("st"))
    return one.select("video_id", "duration", F.posexplode(both).alias("ord", "x")).select("video_id", "ord", F.col("x.ts")[0].alias("start"), F.col("x.ts")[1].alias("end_"), F.col("x.st").alias("sentence"), "duration")


def sampled_ids(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n ids in an order that a seeded digest makes: the same for any partitioning."""
    return ids.select("id").distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)).limit(n)


def resolved_paths(videos: DataFrame, listing: DataFrame, root: str | None = None) -> DataFrame:
    """video_id, resolved: the recorded path if it is listed, else the first of the usual suffixes that is listed (in `root`, if given), else null."""
    parts = F.regexp_extract("file", r"^(?:(.*)/)?[^/]+\.[^./]+$", 1)
    named = listing.select("file", parts.alias("folder"), F.regexp_extract("file", r"([^/]+)\.([^./]+)$", 1).alias("stem"), F.regexp_extract("file", r"([^/]+)\.([^./]+)$", 2).alias("suffix"))
    if root is not None:
        named = named.where(F.col("folder") == root.rstrip("/"))
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("suffix"))
    best = named.where(F.col("suffix").isin(*SUFFIXES)).groupBy("stem").agg(F.min_by("file", F.struct(rank, F.col("file"))).alias("found"))
    exact = listing.select(F.col("file").alias("path"), F.lit(True).alias("there")).distinct()
    return videos.join(exact, "path", "left").join(best, F.col("stem") == F.col("video_id"), "left").select("video_id", F.when(F.col("there"), F.col("path")).otherwise(F.col("found")).alias("resolved"))


def synthetic_frames(spark: SparkSession, n_videos: int = 8, dim: int = 64, segments: int = 4, per_segment: int = 20, noise: float = 0.08, seed: int = 7) -> DataFrame:
    """video_id, t, h, q: unit directions of eight templates with noise, the same for a seed and id anywhere."""

    def rows(batches):
        for b in batches:
            for video, word in zip(b.video_id, b.word, strict=True):
                templates = np.random.RandomState(seed).normal(size=(8, dim))
                templates /= np.linalg.norm(templates, axis=1, keepdims=True)
                rng = np.random.RandomState(int.from_bytes(bytes.fromhex(word), "little"))
                base = np.repeat(templates[rng.permutation(8)[: max(1, min(8, segments))]], per_segment, 0)
                h, q = (base + rng.normal(0, s, base.shape) for s in (noise, 0.05))
                yield pd.DataFrame({"video_id": video, "t": np.arange(len(base), dtype=np.int32), "h": list(h.astype(np.float32)), "q": list(q.astype(np.float32))})

    ids = spark.range(n_videos).select(F.format_string("demo_%04d", "id").alias("video_id"))
    words = ids.select("video_id", F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), "video_id").cast("binary")), 1, 8).alias("word"))
    return words.mapInPandas(rows, "video_id string, t int, h array<float>, q array<float>")
