"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set is its distinct five-word shingles. The sketch fills BINS bins in rounds: in round i every
shingle is hashed anew into one bin and the least value of the first round that reaches a bin stays; after
BINS rounds the bins still empty take the least value over all shingles. Every coordinate is thus filled and two sets'
coordinates agree with their Jaccard similarity as probability, with Chernoff bounds as for
independent draws. BANDS bands of ROWS coordinates each make candidates: at similarity 0.75 a pair misses
all 72 bands with probability (1 - 0.75**7)**72 = 3e-5, at 0.8 with 4e-8; pairs that share a tenth of their
shingles, as documents with a common header, meet in one of 140,000 cases.

Equal sets are one class from the start. Candidates are then confirmed on full sets in three steps, so that no group's
pairs are all written out: each class against the bucket leader it shares most bands with; each against its other bucket
leaders while components still differ; and last all pairs of a bucket whose components differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.components import components
from intervale.llm.flat import mix, shingle_sets
from intervale.llm.memory import trimmed
from intervale.llm.scratch import Scratch

BINS, ROWS = 504, 7
BANDS = BINS // ROWS
#: Four bits of each coordinate: at similarity s two sets agree in a share of s + (1 - s) / 16, and a pair of similarity
#: 0.75 in fewer than 346 of 504 with probability 1e-5, less than all bands miss it with; such pairs are not fetched.
WORDS, LEAST_AGREEING = -(-BINS // 64), 346
#: Documents whose ids (8 bytes each) are broadcast to fetch their texts; more are fetched by a join.
SENT_IDS = 2_000_000
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77))
_SEEDS = _rng.integers(1, 1 << 63, 2 * BINS, dtype=np.uint64) | _U(1)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_HASH_BITS = _U(44)  # beside 10 bits of the round and 9 of the bin


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty set of 64-bit hashes."""
    values = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    m, done = len(shingles), 0
    while empty.any() and done < BINS:
        some = min(BINS - done, max(1, 5 * BINS // m))
        rounds = np.arange(done, done + some)
        h = mix(shingles[:, None] ^ _SEEDS[rounds])
        # bin, then round, then hash: the least entry of a bin is its first round's least hash
        bins = (h >> _U(32)) * _U(BINS) >> _U(32)
        key = np.sort(((bins << _U(10) | rounds.astype(np.uint64)) << _HASH_BITS | (h * _U(0x9E3779B97F4A7C15)) >> _U(20)).ravel())
        at = np.searchsorted(key, np.arange(BINS, dtype=np.uint64) << (_HASH_BITS + _U(10)))
        first = key[np.minimum(at, len(key) - 1)]
        hit = empty & (at < len(key)) & (first >> (_HASH_BITS + _U(10)) == np.arange(BINS, dtype=np.uint64))
        values[hit] = first[hit]
        empty &= ~hit
        done += some
    for j in np.flatnonzero(empty):
        values[j] = mix(shingles ^ _SEEDS[BINS + j]).min() | _U(1 << 63)
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    v = mix(values).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for k in range(ROWS):
        key = mix(key ^ v[:, k]) + _U(k)
    return key


def planes(values: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate as four planes of WORDS words; spare bits are zero in every sketch."""
    four = np.zeros(64 * WORDS, np.uint8)
    four[:BINS] = mix(values) & _U(15)
    return np.packbits(four >> np.arange(4, dtype=np.uint8)[:, None] & 1, axis=1).view(np.int64).ravel()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            some = batch.slice(i, 1024)
            n, low, high, keys, bits = [], [], [], [], []
            for s in shingle_sets(some.column(1)):
                n.append(len(s))
                low.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                high.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                v = sketch(s) if len(s) else None
                keys.append(band_keys(v).astype(np.int64) if len(s) else None)
                bits.append(planes(v) if len(s) else None)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n", "low", "high", "keys", "bits"])


def _confirm(over: int, under: int):
    """Of pairs (a, b, text_a, text_b), those whose sets meet under * |A and B| >= over * |A or B|."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                a, b = some.column(0).to_pylist(), list(zip(some.column(1).to_pylist(), some.column(3).to_pylist(), strict=True))
                first: dict = {}
                for k, x in enumerate(b):  # rows that share an id may have several texts
                    if x not in last:
                        first.setdefault(x, k)
                new = list(first.values())
                last |= dict(zip((b[k] for k in new), shingle_sets(some.column(3).take(pa.array(new, pa.int64()))), strict=True))
                keep = []
                for k, s in enumerate(shingle_sets(some.column(2))):
                    t = last[b[k]]
                    if under * min(len(s), len(t)) < over * max(len(s), len(t)):
                        continue
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if under * both >= over * (len(s) + len(t) - both):
                        keep.append(k)
                last = {b[-1]: last[b[-1]]} if b else last
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k][0] for k in keep], pa.int64())], ["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept (doc_id = component_id) of every row.

    Two rows are linked if 100 * |A and B| >= percent * |A or B|. Rows without words are linked with
    nothing. A null doc_id is never a representative: its row gets the component of a set equal to its own, or null
    and kept. Rows that share a doc_id count as one node. An empty table gives no rows; other columns are left aside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.table(texts.mapInArrow(trimmed(_set_rows), "doc_id long, n long, low long, high long, keys array<long>, bits array<long>"), "sets")

    # one class for equal sets; its least doc_id stands for it
    classes = scratch.table(
        sets.where("n > 0").groupBy("low", "high", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "keys", "bits")).alias("one")).where("rep is not null").select("low", "high", "n", "rep", F.col("one.keys").alias("keys"), F.col("one.bits").alias("bits")),
        "classes",
    )
    ids = scratch.table(sets.select("doc_id", "n", "low", "high"), "ids")
    scratch.drop("sets")
    buckets = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    leaders = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    shared = scratch.table(buckets.join(leaders, "key").join(classes.select("rep", "n"), "rep").select("key", "band", "rep", "n", "leader"), "buckets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) whose full sets are similar enough; texts come from the input, b's last so that equal b lie together."""
        pairs = scratch.table(pairs, f"{name}-pairs")
        wanted = scratch.table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-wanted")
        if wanted.count() <= SENT_IDS:
            wanted = F.broadcast(wanted)
        some = scratch.table(texts.join(wanted, "doc_id", "left_semi").distinct(), f"{name}-texts")
        one = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        two = one.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        out = scratch.table(two.mapInArrow(trimmed(_confirm(percent, 100)), "a long, b long"), name)
        scratch.drop(f"{name}-pairs", f"{name}-texts", f"{name}-wanted")
        return out

    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    size = classes.select(F.col("rep").alias("leader"), F.col("n").alias("m"))

    # 1: the leader that a class shares most bands with
    votes = shared.where("rep <> leader").groupBy("rep", "n", "leader").count().join(size, "leader").where(fits)
    best = votes.groupBy("rep").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    links = confirmed(best.select(F.col("rep").alias("a"), F.col("leader").alias("b")), "first")
    found = scratch.table(components(links, scratch, "cc1"), "found1")

    def of(table: DataFrame, node: str, out: str, found: DataFrame) -> DataFrame:
        return table.join(found.select(F.col("node").alias(node), F.col("component").alias("_c")), node, "left").withColumn(out, F.coalesce("_c", node)).drop("_c")

    # 2: its other leaders, where components differ
    other = of(of(votes, "rep", "c", found), "leader", "d", found).where("c <> d")
    links = links.union(confirmed(other.select(F.col("rep").alias("a"), F.col("leader").alias("b")), "second"))
    found = scratch.table(components(links, scratch, "cc2"), "found2")

    # 3: all pairs of a bucket whose components differ and whose sketches don't rule them out
    placed = scratch.table(of(shared, "rep", "c", found), "placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    bits = [F.col("bits")[i].alias(f"b{i}") for i in range(4 * WORDS)]
    marks = F.transform("keys", lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int")).alias("marks")
    open_ = placed.join(mixed, "key", "left_semi").join(classes.select("rep", marks, *bits), "rep").select("key", "band", "rep", "n", "c", "marks", *(f"b{i}" for i in range(4 * WORDS)))
    differing = " + ".join("bit_count(" + " | ".join(f"(x.b{i} ^ y.b{i})" for i in range(w, 4 * WORDS, WORDS)) + ")" for w in range(WORDS))
    meets = [
        "x.key = y.key and x.c < y.c",
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)",
        f"{differing} <= {BINS - LEAST_AGREEING}",
        "array_position(zip_with(x.marks, y.marks, (a, b) -> a = b), true) = x.band + 1",  # in its first common bucket only
    ]
    pairs = open_.alias("x").join(open_.alias("y"), F.expr(" and ".join(meets))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    links = links.union(confirmed(pairs, "third"))
    found = scratch.table(components(links, scratch, "cc3"), "found3")

    member = ids.join(of(classes.select("low", "high", "n", "rep"), "rep", "component_id", found), ["low", "high", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicates among `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
