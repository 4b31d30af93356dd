"""Selected events as labels in seconds, score rows and files."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(s, e, fps: float) -> tuple[Column, Column]:
    rate = max(fps, 1e-9)
    return F.col(s) / rate, (F.col(e) + 1) / rate


def labels(selected: DataFrame, videos: DataFrame, fps: float = 3.0) -> DataFrame:
    """video_id, ord, start, end_, caption, duration: clipped to the video, in order of start (ties: selection), empty spans dropped.

    selected: video_id, sel_rank, s, e, caption; videos: video_id, duration, n_frames.
    """
    length = F.greatest(F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.col("n_frames") / max(fps, 1e-9)), F.lit(1e-9))
    a, b = seconds("s", "e", fps)
    timed = selected.join(videos.select("video_id", length.alias("duration")), "video_id").withColumn("start", F.least(F.greatest(a, F.lit(0.0)), F.col("duration"))).withColumn("end_", F.least(F.greatest(b, F.lit(0.0)), F.col("duration"))).where("end_ > start")
    grouped = timed.groupBy("video_id", "duration").agg(F.array_sort(F.collect_list(F.struct("start", "sel_rank", "end_", "caption"))).alias("x"))
    return grouped.select("video_id", F.round("duration", 3).alias("duration"), F.posexplode("x").alias("ord", "x")).select("video_id", "ord", F.round("x.start", 4).alias("start"), F.round("x.end_", 4).alias("end_"), "x.caption", "duration")


def label_json(rows: DataFrame) -> DataFrame:
    """One row `value`: the object of all videos; for corpora that one file can hold (Parquet of `labels` otherwise)."""
    one = rows.groupBy("video_id").agg(F.first("duration").alias("duration"), F.array_sort(F.collect_list(F.struct("ord", "start", "end_", "caption"))).alias("x"))
    body = F.struct("duration", F.transform("x", lambda x: F.array(x["start"], x["end_"])).alias("timestamps"), F.transform("x", lambda x: x["caption"]).alias("sentences"))
    return one.select("video_id", body.alias("b")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("video_id", "b"))))).alias("value"))


def two_places(x: float) -> str:
    """Fixed point with two digits, halves of the exact binary value to even."""
    return str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def line_rows(selected: DataFrame, videos: DataFrame, fps: float = 3.0) -> DataFrame:
    """video_id, s, start, end_, caption of the line layout: the end clipped, blank captions and empty spans dropped."""
    length = F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.col("n_frames") / max(fps, 1e-9))
    a, b = seconds("s", "e", fps)
    timed = selected.join(videos.select("video_id", length.alias("duration")), "video_id").select("video_id", "s", "sel_rank", a.alias("start"), F.least(b, F.col("duration")).alias("end_"), F.regexp_replace("caption", r"^\s+|\s+$", "").alias("caption"))
    return timed.where("end_ > start and caption <> ''")


def write_labels(rows: DataFrame, layout: str, folder: str) -> str:
    """One file in `folder`; rows reach the driver one partition at a time."""
    os.makedirs(folder, exist_ok=True)
    if layout == "activitynet":
        path = os.path.join(folder, "train_pseudo.json")
        body = label_json(rows).first()["value"] or "{}"
    elif layout == "charades":
        path = os.path.join(folder, "train_pseudo.txt")
        lines = (f"{r['video_id']} {two_places(r['start'])} {two_places(r['end_'])}##{r['caption']}" for r in rows.orderBy("video_id", "s", "sel_rank").toLocalIterator())
        body = "".join(line + "\n" for line in lines)
    else:
        raise ValueError(f"unknown layout {layout}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    return path


def write_json(payload: Mapping, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
    return path
