"""Exact token counts of whole texts; huge texts are encoded as overlapping chunks and spliced.

The pattern that cuts text into words scans from left to right and never looks back, so where a word starts, what
follows hangs on the text from there on alone. Two neighbouring chunks are spliced at a word that both
have at the same place with the same ids, at least MARGIN characters inside both ends of their overlap: the left
chunk has seen enough after it for the pattern's look-ahead and any special string, the right
chunk's first words, which its arbitrary start may have spoilt, are passed, and from a common word's start both scans go
alike. Where no such word exists, the overlap is widened, in the end to the whole rest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.memory import trimmed

#: Texts of more characters are chunked.
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: More than any special string or look-ahead of the pattern.
MARGIN = 64
BATCH_TEXTS = 64


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _words(encoding, shift: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Start in the text -> (index of the first token, ids) of every word of an encoded chunk."""
    word = np.array([-1 if w is None else w for w in encoding.word_ids])
    heads = np.flatnonzero(np.diff(word, prepend=-2) | (word < 0))
    starts, ids = encoding.offsets, encoding.ids
    return {starts[a][0] + shift: (int(a), tuple(ids[a:b])) for a, b in zip(heads, [*heads[1:], len(ids)], strict=True)}


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN) -> list[int]:
    """The ids of `text`, equal to those of one call over the whole of it."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    out: list[int] = []
    a, b = 0, min(len(text), chunk)
    left, skip = encode(a, b), 0
    while b < len(text):
        width, found = min(overlap, b - a), None
        while found is None:
            at = b - width
            end = min(len(text), at + max(chunk, 2 * width))
            right = encode(at, end)
            here, there = _words(left, a), _words(right, at)
            both = [p for p in there if at + margin <= p <= b - margin and p in here and here[p][0] >= skip and here[p][1] == there[p][1] and p + 4 * len(there[p][1]) + margin <= b]
            if both:
                found = max(both)
            elif at > a:
                width = min(2 * width, b - a)
            else:  # the overlap is the whole left chunk: take more text in one piece
                b = min(len(text), a + 2 * (b - a))
                left = encode(a, b)
                if b == len(text):
                    break
                width = min(overlap, b - a)
        if found is None:
            break
        out += left.ids[skip : here[found][0]]
        a, b, left, skip = at, end, right, there[found][0]
    return out + left.ids[skip:]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Null texts are empty (0 tokens); null and repeated doc_ids pass through, a row each; an empty
    table gives no rows; other columns are left aside. `.model` files go to sentencepiece, whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[int] = []
            for i in range(0, batch.num_rows, BATCH_TEXTS):
                texts = [t or "" for t in batch.column(1).slice(i, BATCH_TEXTS).to_pylist()]
                if tokenizer.endswith(".model"):
                    n += [len(x) for x in _pieces(tokenizer).encode(texts, num_threads=1)]
                    continue
                t = _tokenizer(tokenizer)
                got = iter(t.encode_batch_fast([x for x in texts if len(x) <= chunk], add_special_tokens=False))
                n += [len(next(got)) if len(x) <= chunk else len(spliced_ids(t, x, chunk, overlap)) for x in texts]
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens, pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(trimmed(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: token counts of `documents`."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
