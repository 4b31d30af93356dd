"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words, all of it. Each passage is encoded from its bytes and words
alone: byte and hashed byte-pair shares, shares of repeated words and of word triples met elsewhere in the document, word length.
A learned layer embeds it, gated attention weighs it among its document's passages, and the weighted mean of the
embeddings is scored. Only document labels teach it. The model is fitted on the driver from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.flat import mix, pieces, texts_of, word_hashes, word_spans
from intervale.llm.memory import trimmed

PASSAGE = 48
PAIRS = 256
WIDTH = 256 + PAIRS + 6
EMBEDDING, GATE = 24, 12
#: Labelled documents that the model is fitted on, at most (half of each class where there are enough); the bound of the driver's work.
SAMPLE = 4000
#: Longer texts (in bytes) are not sampled; those sampled are read whole, and scoring reads every text whole.
SAMPLE_BYTES = 1 << 16
EPOCHS, RATE, DECAY, BATCH = 30, 5e-3, 1e-4, 128
THRESHOLD = 0.7


def passages(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of all rows, and the row bounds (n + 1); a row without words has one passage of zeros."""
    starts, ends, first = word_spans(flat, offsets)
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    owner = np.repeat(np.arange(len(words)), words)
    of_word = bounds[owner] + (np.arange(len(starts)) - first[owner]) // PASSAGE
    x = np.zeros((bounds[-1], WIDTH), np.float32)
    if not len(starts):
        return x, bounds
    total = len(x)
    # bytes of words, and one space between words
    inside = np.zeros(len(flat) + 1, np.int64)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    word_at = np.repeat(np.arange(len(starts)), ends - starts)
    home, byte = of_word[word_at], flat[at].astype(np.int64)
    size = np.maximum(np.bincount(home, minlength=total), 1).astype(np.float32)[:, None]
    x[:, :256] = np.sqrt(np.bincount(home * 256 + byte, minlength=total * 256).reshape(total, 256) / size)
    pair = (byte[:-1] * 97 + byte[1:] * 31 + 7) * 2654435761 >> 13 & (PAIRS - 1)
    same = word_at[1:] == word_at[:-1]
    x[:, 256 : 256 + PAIRS] = np.sqrt(np.bincount(home[:-1][same] * PAIRS + pair[same], minlength=total * PAIRS).reshape(total, PAIRS) / size)
    h = word_hashes(flat, starts, ends)
    n = np.maximum(np.bincount(of_word, minlength=total), 1)
    repeated = np.zeros(len(h), bool)
    repeated[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    triple = np.zeros(len(h), bool)
    if len(h) > 2:
        key = mix(h[:-2] + np.uint64(3) * mix(h[1:-1] + np.uint64(5) * mix(h[2:]))) ^ mix(owner[:-2].astype(np.uint64) + np.uint64(1))
        whole = owner[:-2] == owner[2:]
        order = np.argsort(key, kind="stable")
        twin = key[order][1:] == key[order][:-1]
        met = np.zeros(len(key), bool)
        met[order[1:][twin]] = True
        met[order[:-1][twin]] = True
        triple[:-2] = met & whole
    share = lambda flags: np.bincount(of_word, flags.astype(np.float32), minlength=total) / n
    extra = x[:, 256 + PAIRS :]
    extra[:, 0], extra[:, 1] = share(repeated), share(triple)
    extra[:, 2] = share(ends - starts) / 16
    extra[:, 3] = np.log1p(n) / 4
    extra[:, 4] = np.log1p(np.repeat(words, count)) / 8
    extra[:, 5] = np.bincount(of_word, (ends - starts).astype(np.float32) ** 2, minlength=total) / n / 256
    x[np.bincount(of_word, minlength=total) == 0] = 0
    return x, bounds


class AttentionModel:
    """Embedding, gated attention and score, with their gradients written out; all parameters in one vector for Adam."""

    shapes = {"W": (WIDTH, EMBEDDING), "b": (EMBEDDING,), "V": (EMBEDDING, GATE), "U": (EMBEDDING, GATE), "w": (GATE,), "c": (EMBEDDING,), "d": ()}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.shift = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), 0.0
        self.p = {k: np.asarray(rng.normal(0, 1 / np.sqrt(s[0]) if s else 0, s), np.float32) for k, s in self.shapes.items()}
        self.p["b"] *= 0

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        p, heads = self.p, bounds[:-1]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        rows = np.repeat(np.arange(len(heads)), np.diff(bounds))
        a = np.exp(e - np.maximum.reduceat(e, heads)[rows])
        a /= np.add.reduceat(a, heads)[rows]
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "rows": rows, "logit": z @ p["c"] + p["d"]}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.forward((x - self.mean) * self.scale, bounds)["logit"] + self.shift).astype(np.float64)))

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bounds)
        h, t, g, a, rows = f["h"], f["t"], f["g"], f["a"], f["rows"]
        out = (1 / (1 + np.exp(-f["logit"])) - y).astype(np.float32) / len(y)
        dz = out[:, None] * p["c"]
        da = (dz[rows] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, bounds[:-1])[rows])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[rows] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ out, "d": out.sum()}

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, share: float) -> AttentionModel:
        """Adam over mini-batches; `share` is the positive class's true share, to which the sample's is shifted back."""
        self.mean = x.mean(0)
        self.scale = 1 / (x.std(0) + np.float32(0.02))
        x = (x - self.mean) * self.scale
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                some = order[i : i + BATCH]
                size = bounds[some + 1] - bounds[some]
                at = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in some])
                step += 1
                for k, grad in self.gradients(x[at], np.append(0, np.cumsum(size)), y[some]).items():
                    grad = grad + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        own = y.mean()
        self.shift = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
        return self


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [passages(part, at) for _, _, part, at in pieces(*texts_of(texts))]
    sizes = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([x for x, _ in parts]), np.append(0, np.cumsum(sizes))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | None:
    """A model of `labels` (doc_id, quality) on texts of `docs`; None without rows of both classes.

    Rows are chosen by a hash of doc_id, up to half of `sample` of each class (both classes' exact counts set the prior).
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    half = sample // 2
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(half) for q in (0, 1)]
    # at most `sample` ids: bounded by the parameter, and so broadcast
    ids = F.broadcast(chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "_id"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.join(ids, F.col("doc_id") == F.col("_id")).where(F.octet_length(body) <= SAMPLE_BYTES).select("_id", "quality", body.alias("text")).groupBy("_id").agg(F.min(F.struct("quality", "text")).alias("one")).select("_id", "one.*")
    table = rows.toArrow().sort_by("_id")  # at most `sample` rows of bounded texts
    y = np.asarray(table["quality"], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x, bounds = encode(table["text"])
    return AttentionModel().fit(x, bounds, y, counts[1] / (counts[0] + counts[1]))


def score_documents(docs: DataFrame, model: AttentionModel | None, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) of every row; without a model the score is 0.5.

    Null, empty and blank texts are a bag of one passage of zeros; null and repeated doc_ids pass through, a row each; an empty
    table gives no rows; other columns are left aside but for those named in `keep`.
    """
    extra = [c for c in keep or [] if c != "doc_id"]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts_of(batch.column(1))
            scores = [np.zeros(0)]
            for i, j, part, at in pieces(flat, offsets):
                scores.append(shipped.value.score(*passages(part, at)) if shipped.value else np.full(j - i, 0.5))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *batch.columns[2:]], ["doc_id", "score", "predicted", *extra])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *extra)
    return rows.mapInArrow(trimmed(score), "doc_id long, score double, predicted int" + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in extra))


def held_out(column: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text leaves remainder 2 by 4 (a null id never does)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality scores of `documents`, learned from `labels` outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
