"""Predicted intervals against reference intervals: overlap, coverage, matching, token overlap, bootstrap."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.functions.text import tokens, words
from intervale.functions.vectors import seconds_iou
from intervale.llm.memory import trimmed


def merged_refs(ref: DataFrame) -> DataFrame:
    """video_id, start, end_, sentences of distinct spans."""
    return ref.groupBy("video_id", "start", "end_").agg(F.array_sort(F.collect_list("sentence")).alias("sentences"))


def pairs(pred: DataFrame, refs: DataFrame) -> DataFrame:
    """video_id, event_id, p_*, r_*, iou of all predictions and references of a video that overlap."""
    a = pred.select("video_id", "event_id", F.col("start").alias("p_start"), F.col("end_").alias("p_end"), F.col("sentence").alias("p_sentence"))
    b = refs.select("video_id", F.col("start").alias("r_start"), F.col("end_").alias("r_end"), *([F.col("sentences")] if "sentences" in refs.columns else []))
    return a.join(b, "video_id").withColumn("iou", seconds_iou(F.col("p_start"), F.col("p_end"), F.col("r_start"), F.col("r_end"))).where("iou > 0")


def best_iou(refs: DataFrame, both: DataFrame) -> DataFrame:
    """video_id, start, end_, best of every reference (0 without an overlap)."""
    top = both.groupBy("video_id", F.col("r_start").alias("start"), F.col("r_end").alias("end_")).agg(F.max("iou").alias("best"))
    return refs.select("video_id", "start", "end_").join(top, ["video_id", "start", "end_"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def token_f1(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, f1 of the token multisets of columns a and b; rows are told apart by `key`."""
    one = rows.select(key, F.explode(F.concat(F.transform(tokens(a), lambda x: F.struct(x.alias("w"), F.lit(1).alias("side"))), F.transform(tokens(b), lambda x: F.struct(x.alias("w"), F.lit(2).alias("side"))))).alias("x"))
    count = one.groupBy(key, F.col("x.w").alias("w")).agg(F.count_if(F.col("x.side") == 1).alias("ca"), F.count_if(F.col("x.side") == 2).alias("cb"))
    sums = count.groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("both"), F.sum(F.col("ca") + F.col("cb")).alias("all"))
    return rows.select(key).join(sums, key, "left").select(key, F.coalesce(2 * F.col("both") / F.col("all"), F.lit(0.0)).alias("f1"))


def _digest(text) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


#: Adds the sentences to rows, of which the named column refers to sentences, as the column `text`.
Texts = Callable[[DataFrame, str], DataFrame]


def referred(pred: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame, Texts]:
    """`pred` and `ref` with digests in place of their sentences, and the sentences of digests."""
    said = pred.select("sentence").union(ref.select("sentence")).where("sentence is not null").groupBy(_digest("sentence").alias("_said")).agg(F.first("sentence").alias("text"))
    short = (x.withColumn("sentence", _digest("sentence")) for x in (pred, ref))
    return *short, lambda rows, name: rows.join(said, F.col(name) == F.col("_said")).drop("_said")


def _counted(text: str | None) -> Counter:
    return Counter((text or "").split())


def _bag(text: str | None) -> bytes:
    """The words said once, a line break, the other words and their counts, compressed."""
    n = _counted(text)
    often = [f"{w} {k}" for w, k in n.items() if k > 1]
    return zlib.compress("\n".join((" ".join(sorted(w for w, k in n.items() if k == 1)), " ".join(often))).encode(), 1)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`bag` of `text`, a string of words."""
    for rows in batches:
        texts = rows["text"].to_pylist()
        made = {x: _bag(x) for x in set(texts)}
        yield pa.RecordBatch.from_arrays([rows["p_said"], rows["r_said"], pa.array([made[x] for x in texts], pa.binary())], ["p_said", "r_said", "bag"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f1 of the words of `text` and those of `bag`."""
    for rows in batches:
        out, last, mine, total = [], None, Counter(), 0
        for text, bag in zip(rows["text"].to_pylist(), rows["bag"].to_pylist(), strict=True):
            if text != last:
                last, mine = text, _counted(text)
                total = mine.total()
            once, often = (x.split() for x in zlib.decompress(bag).decode().split("\n"))
            n = [int(x) for x in often[1::2]]
            both = sum(map(mine.__contains__, once)) + sum(map(min, map(mine.__getitem__, often[::2]), n))
            out.append(2 * both / (total + len(once) + sum(n)) if both else 0.0)
        yield pa.RecordBatch.from_arrays([rows["p_said"], rows["r_said"], pa.array(out, pa.float64())], ["p_said", "r_said", "f1"])


def sentence_f1(both: DataFrame, texts: Texts) -> DataFrame:
    """p_said, r_said, f1 of the token multisets of the two sentences they refer to. A reference's bag of words travels to the
    prediction's sentence; both sentences stay where `texts` finds them."""
    kinds = dict(both.dtypes)
    keys = f"p_said {kinds['p_said']}, r_said {kinds['r_said']}"
    bags = texts(both, "r_said").select("p_said", "r_said", words("text").alias("text")).mapInArrow(trimmed(_bags), f"{keys}, bag binary")
    return texts(bags, "p_said").select("p_said", "r_said", "bag", words("text").alias("text")).mapInArrow(trimmed(_overlaps), f"{keys}, f1 double")


def best_f1(pred: DataFrame, ref: DataFrame, texts: Texts, least: float = 0.5) -> DataFrame:
    """video_id, event_id, f1 of predictions with a reference at IoU `least` or more: the best token overlap with a sentence of one.

    Sentences are references; two of them are compared once, however often they meet.
    """
    a = pred.select("video_id", "event_id", F.col("start").alias("p_start"), F.col("end_").alias("p_end"), F.col("sentence").alias("p_said"))
    b = ref.select("video_id", F.col("start").alias("r_start"), F.col("end_").alias("r_end"), F.col("sentence").alias("r_said"))
    iou = seconds_iou(F.col("p_start"), F.col("p_end"), F.col("r_start"), F.col("r_end"))
    near = a.join(b, "video_id").where((iou > 0) & (iou >= least)).select("video_id", "event_id", "p_said", "r_said")
    f1 = sentence_f1(near.select("p_said", "r_said").distinct(), texts)
    return near.join(f1, ["p_said", "r_said"]).groupBy("video_id", "event_id").agg(F.max("f1").alias("f1"))


def localized_f1(pred: DataFrame, ref: DataFrame, texts: Texts | None = None, least: float = 0.5) -> DataFrame:
    """event_id, f1: the best token overlap with a sentence of a reference at IoU `least` or more; 0 without one. `sentence` is a reference
    of `texts`, or else the sentence itself."""
    if texts is None:
        pred, ref, texts = referred(pred, ref)
    found = best_f1(pred, ref, texts, least).select("event_id", "f1")
    return pred.select("event_id").join(found, "event_id", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


def _matching(edges: list[tuple[int, int]]) -> int:
    """Size of a maximum matching (augmenting paths without recursion)."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    owner: dict[int, int] = {}
    held: dict[int, int] = {}
    size = 0
    for root in near:
        back, seen, stack, free = {}, set(), [root], None
        while stack and free is None:
            a = stack.pop()
            for b in near[a]:
                if b in seen:
                    continue
                seen.add(b)
                back[b] = a
                if b not in owner:
                    free = b
                    break
                stack.append(owner[b])
        if free is None:
            continue
        while free is not None:
            a = back[free]
            before = held.get(a)
            owner[free], held[a] = a, free
            free = before
        size += 1
    return size


def matches(both: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """video_id, threshold, tp: a maximum one-to-one matching at each threshold."""

    def match(g: pd.DataFrame) -> pd.DataFrame:
        refs = {k: i for i, k in enumerate(dict.fromkeys(zip(g.r_start, g.r_end, strict=True)))}
        out = []
        for t in thresholds:
            some = g[g.iou >= t]
            out.append((g.video_id.iloc[0], t, _matching([(int(e), refs[k]) for e, k in zip(some.event_id, zip(some.r_start, some.r_end, strict=True), strict=True)])))
        return pd.DataFrame(out, columns=["video_id", "threshold", "tp"])

    near = both.where(F.col("iou") >= min(thresholds)).select("video_id", "event_id", "r_start", "r_end", "iou")  # no sentences
    return near.groupBy("video_id").applyInPandas(match, "video_id string, threshold double, tp long")


def per_video(pred: DataFrame, ref: DataFrame, videos: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7), texts: Texts | None = None) -> DataFrame:
    """A row a video: n_pred, n_ref, duplicates, mean best IoU, recovered references at each threshold, summed token F1. `sentence` is a
    reference of `texts`, or else the sentence itself."""
    if texts is None:
        pred, ref, texts = referred(pred, ref)
    refs = ref.select("video_id", "start", "end_").distinct()
    said = texts(pred.select("video_id", "sentence"), "sentence").groupBy("video_id").agg(F.countDistinct(_digest("text")).alias("d"))
    p = pred.groupBy("video_id").agg(F.count("*").alias("n_pred")).join(said, "video_id", "left")
    hit = [F.count_if(F.col("best") >= t).alias(f"recovered_{int(t * 100)}") for t in thresholds]
    r = best_iou(refs, pairs(pred, refs)).groupBy("video_id").agg(F.count("*").alias("n_ref"), F.avg("best").alias("mean_best_iou"), *hit)
    f1 = best_f1(pred, ref, texts).groupBy("video_id").agg(F.sum("f1").alias("f1_sum"))
    out = videos.join(p, "video_id", "left").join(r, "video_id", "left").join(f1, "video_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "video_id", zero("n_pred").alias("n_pred"), zero("n_ref").alias("n_ref"), (1 - zero("d") / F.greatest(zero("n_pred"), F.lit(1))).alias("duplicate_fraction"),
        F.coalesce("mean_best_iou", F.lit(0.0)).alias("mean_best_iou"), *(zero(f"recovered_{int(t * 100)}").alias(f"recovered_{int(t * 100)}") for t in thresholds), F.coalesce("f1_sum", F.lit(0.0)).alias("f1_sum"),
    )


def summary(rows: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """One row of micro and macro figures of `per_video` rows."""
    cover = [(F.sum(f"recovered_{int(t * 100)}") / F.greatest(F.sum("n_ref"), F.lit(1))).alias(f"coverage_{int(t * 100)}") for t in thresholds]
    return rows.agg(F.count("*").alias("videos"), F.sum("n_pred").alias("n_pred"), F.sum("n_ref").alias("n_ref"), F.avg("mean_best_iou").alias("mean_best_iou"), F.avg("duplicate_fraction").alias("duplicate_fraction"), (F.sum("f1_sum") / F.greatest(F.sum("n_pred"), F.lit(1))).alias("token_f1"), *cover)


def micro(whole: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """The row of `summary` with precision, recall and F1 at each threshold by the matchings `found` (of `matches`)."""
    tp = found.agg(*(F.coalesce(F.sum(F.when(F.col("threshold") == t, F.col("tp"))), F.lit(0)).alias(f"tp_{int(t * 100)}") for t in thresholds))  # one row
    one = lambda *c: F.greatest(sum((F.col(x) for x in c), F.lit(0)), F.lit(1))
    rates = [[(F.col(k) / one("n_pred")).alias(f"precision_{k[3:]}"), (F.col(k) / one("n_ref")).alias(f"recall_{k[3:]}"), (2 * F.col(k) / one("n_pred", "n_ref")).alias(f"f1_{k[3:]}")] for k in tp.columns]
    return whole.join(F.broadcast(tp)).select(*whole.columns, *tp.columns, *sum(rates, []))


def with_matches(rows: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """`per_video` rows with tp at each threshold, by the matchings `found` (of `matches`)."""
    tp = found.groupBy("video_id").agg(*(F.max(F.when(F.col("threshold") == t, F.col("tp"))).alias(f"tp_{int(t * 100)}") for t in thresholds))
    return rows.join(tp, "video_id", "left").select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in tp.columns[1:]))


def validated(pred: DataFrame, entries: DataFrame) -> DataFrame:
    """`entries` (video_id, ref_duration, duration: the prediction's or else the reference's) with duration_difference; predicted intervals
    that are empty or outside their video's duration raise."""
    limit = F.coalesce("limit", F.lit(float("inf"))) + 0.001
    joined = pred.join(entries.select("video_id", F.col("duration").alias("limit")), "video_id")
    bad = joined.where(~((F.col("start") >= 0) & (F.col("start") < F.col("end_")) & (F.col("end_") <= limit))).orderBy("video_id", "start", "end_").first()
    if bad is not None:
        raise ValueError(f"invalid interval of {bad['video_id']}: {bad['start']} to {bad['end_']}")
    return entries.select("video_id", (F.col("duration") - F.col("ref_duration")).alias("duration_difference"))


#: Videos up to which the resampled values themselves are drawn; beyond, counts of values rounded to BIN.
EXACT_VIDEOS, BIN = 1_000_000, 1e-4


def interval_of_mean(rows: DataFrame, column: str, replicates: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Bootstrap bounds of the mean of `column` over `per_video` rows.

    Up to EXACT_VIDEOS values reach the driver; of more, 1 / BIN + 1 counts, whose resampling is one multinomial draw a replicate.
    """
    if rows.count() <= EXACT_VIDEOS:
        return bootstrap_interval([r[0] for r in rows.orderBy("video_id").select(column).collect()], replicates, seed)
    counts = rows.groupBy(F.round(F.col(column) / BIN).cast("long").alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    value, n = np.array([r["bin"] for r in counts]) * BIN, np.array([r["n"] for r in counts])
    rng = np.random.default_rng(seed)
    means = np.array([rng.multinomial(n.sum(), n / n.sum()) @ value / n.sum() for _ in range(replicates)])
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def bootstrap_interval(values: list[float], replicates: int = 2000, seed: int = 42) -> tuple[float, float]:
    """The 2.5 % and 97.5 % quantiles of resampled means; values are one a video, on the driver."""
    x = np.asarray(values, float)
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(replicates)])
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))
