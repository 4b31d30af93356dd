"""Byte-level BPE by batched numpy merge rounds, and decoding.

The symbols of many distinct words lie in one flat array. In each round every adjacent pair of a word is
looked up by binary search over the sorted pair keys, each word merges all places of its lowest-ranked pair,
left to right, and words without a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.memory import trimmed
from intervale.llm.word_codes import WordCodes, byte_symbols

BATCH_TEXTS = 256
_NONE = np.int64(1 << 40)


class Merges:
    """A byte-level vocabulary with its merges as sorted keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.int64(1 << 62))
        self.ranks = np.append(order.astype(np.int64), _NONE)
        self.made = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64)[order], 0)
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        back = {s: b for b, s in enumerate(symbols)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for s, i in vocab.items():
            pieces[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            pieces[i] = s.encode()
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.words = WordCodes(self.encode_words, self.special)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and the number of ids of each."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        symbol = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = np.empty(len(symbol), np.int64)
            key[:-1] = symbol[:-1] << 32 | symbol[1:]
            key[-1] = -1
            key[:-1][word[:-1] != word[1:]] = -1
            at = np.searchsorted(self.keys, key)
            known = self.keys[at] == key
            rank = np.where(known, self.ranks[at], _NONE)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            spans = np.diff(np.append(heads, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, heads), spans)
            over = least == _NONE
            if over.any():
                done.append((word[over], symbol[over]))
                going = ~over
                symbol, word, rank, least, at = symbol[going], word[going], rank[going], least[going], at[going]
                if not len(symbol):
                    break
            hit = rank == least
            places = np.flatnonzero(hit)
            if (np.diff(places) == 1).any():  # of overlapping places every second one, from the left
                run = np.flatnonzero(np.diff(places, prepend=-2) != 1)
                inside = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
                places = places[inside % 2 == 0]
            symbol[places] = self.made[at[places]]
            keep = np.ones(len(symbol), bool)
            keep[places + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return np.zeros(0, np.uint32), size
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.bincount(word, minlength=len(raw))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return list(self.words(texts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def merges(path: str) -> Merges:
    """One vocabulary per Python worker."""
    return Merges(path)


def encode_decode(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and token_ids and decoded with `ids`.

    Null texts are empty; null and repeated doc_ids pass through, a row each; an empty table gives no rows; other
    columns are left aside but for those named in `keep`.
    """
    extra = [c for c in keep or [] if c not in ("doc_id", "text")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_TEXTS):
                some = batch.slice(i, BATCH_TEXTS)
                lists = m.encode([t or "" for t in some.column(1).to_pylist()])
                decoded = [m.decode(x) for x in lists]
                joined = [",".join(map(m.decimal.__getitem__, x.tolist())) for x in lists]
                out = [some.column(0), pa.array([len(x) for x in lists], pa.int64()), *(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in x]) for x in (joined, decoded))]
                out += [pa.array(lists, pa.list_(pa.int64())), pa.array(decoded)] if ids else []
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids", "decoded"] if ids else [])]
                yield pa.RecordBatch.from_arrays([*out, *(some.column(2 + k) for k in range(len(extra)))], [*names, *extra])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<long>, decoded string" * ids
    return rows.mapInArrow(trimmed(code), schema + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in extra))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: `documents` encoded and decoded."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
