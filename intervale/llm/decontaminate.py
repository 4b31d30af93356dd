"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on shingles.

Items are partitioned by the size of their shingle sets (powers of two). A set of q shingles of which a document holds at
least the share t shares one of ANY floor((1 - t) * q) + 1 of its shingles with it, so the bottom-k MinHash
sketch of that length misses nothing. Each partition has the largest hash among its items' sketches as bound:
a document's shingles under that bound are looked up in the partition's sketches by hash, and every
item met is verified on full sets. Short items inside long documents cost no more than in short ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.flat import mix, pieces, shingle_sets, shingles, texts_of
from intervale.llm.memory import trimmed
from intervale.llm.scratch import Scratch

#: Items whose sets together stay below this many shingles (8 bytes each) are sent to every worker; beyond it, sketches and documents meet in joins.
SENT_SHINGLES = 2_000_000
_U = np.uint64
_ORDER = _U(0x7F4A7C159E3779B1)


def sketch_length(q: int, percent: int) -> int:
    """Shingles of an item of q that a document with `percent` of them must meet at least once."""
    return q - -(-percent * q // 100) + 1


def item_rows(percent: int):
    """item_id, its set, the size partition, and the bottom-k sketch (as shingles) of each item with words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if len(s):
                    k = sketch_length(len(s), percent)
                    least = s[np.argsort(mix(s ^ _ORDER), kind="stable")[:k]]
                    for col, x in zip(out, (item, s.astype(np.int64), int(len(s)).bit_length(), least.astype(np.int64)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item_id", "set", "part", "least"])

    return rows


class Partitions:
    """The sketches of each size partition: sorted shingles with their items, and the partition's hash bound."""

    def __init__(self, items: list[tuple[int, np.ndarray, int, np.ndarray]]):
        self.sets = {k: set(s.tolist()) for k, (_, s, _, _) in enumerate(items)}
        self.names = [i for i, *_ in items]
        grouped: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, _, part, least) in enumerate(items):
            grouped[part] += [(x, k) for x in least.tolist()]
        self.parts = []
        for _, pairs in sorted(grouped.items()):
            by: dict[int, list[int]] = defaultdict(list)
            for x, k in pairs:
                by[x].append(k)
            keys = np.array(sorted(by), np.uint64)
            self.parts.append((keys, by, mix(keys ^ _ORDER).max()))

    def met(self, got: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) candidates of rows whose shingles lie flat in `got`."""
        order, found = mix(got ^ _ORDER), set()
        for keys, by, most in self.parts:
            under = np.flatnonzero(order <= most)
            some = got[under]
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            hit = keys[at] == some
            for row, key in zip(np.searchsorted(bounds, under[hit], "right") - 1, some[hit].tolist(), strict=True):
                found |= {(int(row), k) for k in by[key]}
        return sorted(found)


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, sent: int = SENT_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item of each pair where 100 * n_shared >= percent * n_item (distinct five-word shingles).

    An item of one to four words is one shingle, the whole of it: it matches documents of exactly those words only, as in the
    SQL, and not inside longer ones. Null, empty and blank texts match nothing; null ids pass through as null; repeated rows give repeated
    pairs (a pair for each row of `docs` and of `items`); empty tables give none; other columns are left aside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "items")
    text = F.col("text").cast("string").alias("text")
    schema = "item_id long, set array<long>, part int, least array<long>"
    index = scratch.table(items.select(F.col("item_id").cast("long").alias("item_id"), text).mapInArrow(trimmed(item_rows(percent)), schema), "index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    size = index.agg(F.sum(F.size("set")).alias("n")).first()["n"] or 0
    out = "doc_id long, item_id long, n_shared long, n_item long"
    if size <= sent:
        known = [(r["item_id"], np.array(r["set"], np.int64).astype(np.uint64), r["part"], np.array(r["least"], np.int64).astype(np.uint64)) for r in index.collect()]
        shipped = spark.sparkContext.broadcast(known)
        return rows.mapInArrow(lambda batches: _search(batches, shipped.value, percent), out)

    # the other way: a document's shingles under the partitions' bounds meet the sketches in a join
    flat = index.select(F.monotonically_increasing_id().alias("item"), "*")
    flat = scratch.table(flat, "numbered")
    keyed = scratch.table(rows.select("*", F.xxhash64("doc_id", "text").alias("row")), "rows")
    bound = flat.select(F.explode("least").alias("h")).mapInArrow(trimmed(_greatest), "most long").agg(F.max("most")).first()[0]
    probes = keyed.select("row", "text").distinct().mapInArrow(lambda batches: _under(batches, bound), "row long, h long")
    pairs = probes.join(flat.select("item", F.explode("least").alias("h")), "h").select("row", "item").distinct()
    pairs = scratch.table(pairs, "pairs")
    joined = keyed.join(pairs, "row").join(flat.select("item", "item_id", "set"), "item").select("doc_id", "text", "item_id", "set")
    return joined.mapInArrow(lambda batches: _verify(batches, percent), out)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_shared", "n_item"])


def _search(batches: Iterator[pa.RecordBatch], items: list, percent: int) -> Iterator[pa.RecordBatch]:
    index = Partitions(items)
    for batch in batches:
        ids, found = batch.column(0).to_pylist(), []
        flat, offsets = texts_of(batch.column(1))
        for i, _, part, at in pieces(flat, offsets):
            got, bounds = shingles(part, at)
            last, own = -1, set()
            for row, k in index.met(got, bounds) if index.parts else []:
                if row != last:
                    last, own = row, set(got[bounds[row] : bounds[row + 1]].tolist())
                n = len(own & index.sets[k])
                if 100 * n >= percent * len(index.sets[k]):
                    found.append((ids[i + row], index.names[k], n, len(index.sets[k])))
        yield _rows(found)


def _greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            h = mix(np.asarray(batch.column(0)).astype(np.uint64) ^ _ORDER) >> _U(1)
            yield pa.RecordBatch.from_arrays([pa.array([int(h.max())], pa.int64())], ["most"])


def _under(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
            s = s[mix(s ^ _ORDER) >> _U(1) <= _U(bound)]
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(s), pa.int64()), pa.array(s.astype(np.int64))], ["row", "h"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for d, item, s, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), shingle_sets(batch.column(1)), strict=True):
            n = len(set(own.astype(np.int64).tolist()) & set(s))
            if 100 * n >= percent * len(s):
                found.append((d, item, n, len(s)))
        yield _rows(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: `benchmark` items in `documents`."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
