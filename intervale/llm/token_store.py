"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds every id's first chunk; a bitmap says
which ids go on, and the next level holds only their next chunks. A rank directory over each bitmap
(ones before every 512th bit) leads from a place in one level to its place in the next, so any
token is found in a step a level and no block is decoded.

File: ``DACT``, the header's length (uint32), a JSON header with dtype, count and offset of each
array, then the arrays: ``doc_ids``, ``doc_null``, ``doc_ends`` and, for each level k, ``chunks{k}``,
``more{k}`` (packed bits, lowest bit first) and ``rank{k}``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervale.llm.memory import trimmed
from intervale.llm.scratch import Scratch, filesystem
from intervale.llm.word_codes import library_words

MAGIC = b"DACT"
RANK_BITS = 512
SHARD_TOKENS = 2_000_000
BATCH_TEXTS = 256
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: list[int | None], doc_ends: np.ndarray) -> bytes:
    """A file's bytes; `ids` are the ids of all documents in order, `doc_ends` their running ends."""
    arrays = {
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8"),
        "doc_null": np.array([d is None for d in doc_ids], np.uint8),
        "doc_ends": np.asarray(doc_ends, "<i8"),
    }
    rest, k = np.asarray(ids, np.uint32), 0
    while True:
        more = rest > 255
        arrays[f"chunks{k}"] = (rest & 255).astype(np.uint8)
        arrays[f"more{k}"] = bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), RANK_BITS // 8), dtype="<u8") if len(bits) else np.zeros(0, "<u8")
        arrays[f"rank{k}"] = np.concatenate([np.zeros(1, "<u8"), np.cumsum(ones, dtype="<u8")])
        if not more.any():
            break
        rest, k = rest[more] >> 8, k + 1
    header: dict = {"tokens": int(len(ids)), "levels": k + 1, "arrays": {}}
    at, body = 0, []
    for name, a in arrays.items():
        header["arrays"][name] = [a.dtype.str, int(a.size), at]
        body.append(a.tobytes())
        body.append(b"\0" * (-len(body[-1]) % 8))
        at += len(body[-2]) + len(body[-1])
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


class TokenFile:
    """Random access to a packed file's tokens and documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[4:8], "little")
        head = json.loads(data[8 : 8 + size])
        self.tokens, self.levels = head["tokens"], head["levels"]
        self.arrays = {n: np.frombuffer(data, d, c, 8 + size + at) for n, (d, c, at) in head["arrays"].items()}

    def rank(self, level: int, at: int) -> int:
        """How many of a level's first `at` entries go on."""
        bits, block = self.arrays[f"more{level}"], at // RANK_BITS
        first = block * RANK_BITS // 8
        n = int(self.arrays[f"rank{level}"][block]) + int(_ONES[bits[first : at // 8]].sum())
        return n + (bin(int(bits[at // 8]) & ((1 << at % 8) - 1)).count("1") if at % 8 else 0)

    def token(self, at: int) -> int:
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        value = 0
        for k in range(self.levels):
            value |= int(self.arrays[f"chunks{k}"][at]) << 8 * k
            if not self.arrays[f"more{k}"][at // 8] >> (at % 8) & 1:
                break
            at = self.rank(k, at)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; reads that part of every level and nothing else."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where: np.ndarray | slice = slice(None)
        for k in range(self.levels):
            if stop <= start:
                break
            out[where] |= self.arrays[f"chunks{k}"][start:stop].astype(np.uint32) << np.uint32(8 * k)
            bits = np.unpackbits(self.arrays[f"more{k}"][start // 8 : (stop + 7) // 8], bitorder="little")
            goes_on = np.flatnonzero(bits[start % 8 : start % 8 + stop - start])
            where = goes_on if k == 0 else where[goes_on]
            start, stop = self.rank(k, start), self.rank(k, stop)
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, start in the file and token ids."""
        every, start = self.slice(0, self.tokens), 0
        for d, null, end in zip(self.arrays["doc_ids"].tolist(), self.arrays["doc_null"].tolist(), self.arrays["doc_ends"].tolist(), strict=True):
            yield None if null else d, start, every[start:end]
            start = end


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode every text, append `end_id`, and write files in ascending doc_id order (nulls first, ties by text).

    Returns the files as a DataFrame: part, seq, path, docs, tokens. Only finished attempts' files are named
    in it; a lost attempt's file has another name and is never read. An empty table gives no file.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = library_words(tokenizer), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, size, seq
            ends = np.cumsum([len(x) + 1 for x in held])
            path = f"{base}/part-{part:06d}-{seq:06d}-{attempt}.dact"
            with fs.open_output_stream(path) as out:
                out.write(pack(np.concatenate([x for ids in held for x in (ids, end)]), names, ends))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "docs": pa.array([len(names)], pa.int64()), "tokens": pa.array([int(ends[-1])], pa.int64())})
            held, names, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_TEXTS):
                some = batch.slice(i, BATCH_TEXTS)
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                for d, code in zip(ids, encode([t or "" for t in texts]), strict=True):
                    held.append(code)
                    names.append(d)
                    size += len(code) + 1
                    if size >= shard_tokens:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(trimmed(write), "part int, seq int, path string, docs long, tokens long")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Documents of the written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file's base is the tokens of the partitions before (one sum a partition goes through the driver's
    plan as a broadcast) and of its partition's files before it.
    """
    spark = files.sparkSession
    totals, base = [], 0
    for r in sorted(files.groupBy("part").agg(F.sum("tokens").alias("n")).collect()):  # one row a write task
        totals.append((r["part"], base))
        base += r["n"]
    starts = spark.createDataFrame(totals, "part int, before long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(F.broadcast(starts), "part").select("path", (F.col("before") + F.col("within")).alias("base"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    file = TokenFile(f.read())
                rows = [(d, before + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in file.documents()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(n, "path").mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write `docs` as token files in the shared folder and read them back.

    Null texts are empty (one end id); null doc_ids come first and stay null; repeated doc_ids stay separate
    documents, ordered by text; an empty table gives no rows; other columns are left aside.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = f"{scratch.path}/files"
    files = scratch.table(write_tokens(docs, folder, tokenizer, end_id), "manifest")
    return read_tokens(files, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: tokens of `documents` in directly addressable files, read back."""
    import public_tokenizers

    return token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
