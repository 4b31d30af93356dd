"""Bytes that repeated 200-byte strings cover, by interval expansion on Burrows-Wheeler transforms of candidate contexts.

Where two equal strings of LENGTH bytes stand, the least-hashed GRAM-byte gram in both is at the same offset (a
window minimiser, the leftmost of equal hashes), so equal strings meet at equal anchors. The corpus is reduced in steps:

1. every document gives its anchors: position, hash of the gram, hash of the whole context (all bytes of any string that
   has this anchor);
2. anchors whose gram occurs once are dropped; contexts of equal hash become one with its count (with two or more, every
   string in it repeats);
3. the distinct contexts of one gram are laid in one text. Its BWT is searched breadth-first by backward extension: the
   intervals of all strings of length l give the common prefixes of value l, by increasing l, and stop at LENGTH; the
   boundaries still unset then are those of suffixes that share LENGTH bytes or more. Strings of one run at
   the same offset from their anchors repeat.
4. the strings found become spans of their documents, and the spans' union is cut.

A gram with more than GROUP contexts is halved by the strings' distances from the anchor: all strings of a half have
a longer part in common, by which contexts are told apart; a context alone with its part has no repeat there. Contexts that
are alike in all bytes of a half become one again (every string in them repeats there) and one of them stands for all in what
follows. Groups still of more than GROUP different ones are halved again; at a single distance the strings of a group are
equal, so that one is left. A context is thus in few groups, whatever their sizes, and none is larger than GROUP.
Keys that hold more than a small share of all rows are joined by a broadcast of those keys (`skew`), others by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.flat import PIECE, mix, pieces, powers, texts_of
from intervale.llm.memory import trimmed
from intervale.llm.scratch import Scratch
from intervale.llm.skew import counted_join

LENGTH, GRAM = 200, 100
#: Most contexts of one group in a text.
GROUP = 2048
#: Bytes of contexts in one transform, about.
TEXT_BYTES = 1 << 18
_U = np.uint64
#: Low bits of a gram's hash that give way to its place in the piece, which breaks ties: fixed, as equal strings choose alike in any piece.
_PLACE_BITS = 22
_BYTE = np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, 256, dtype=np.uint64)


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row, gram hash and context hash of every anchor."""
    n, reach = len(flat), length - gram + 1
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = _U(_PLACE_BITS)
    ranked = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(ranked) // reach) + 1
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    ahead = np.minimum.accumulate(padded.reshape(blocks, reach), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, reach)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[reach - 1 : reach + n - length])
    inside = np.zeros(n + 1, np.int8)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    at = (least[np.flatnonzero(np.cumsum(inside[: n - length + 1], dtype=np.int8))] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    row = np.searchsorted(offsets, at, "right") - 1
    low, high = np.maximum(offsets[row], at - (reach - 1)), np.minimum(offsets[row + 1], at + length)
    context = mix(mix((sums[high] - sums[low]) * down[low]) + ((at - low) * 1024 + (high - at)).astype(np.uint64))
    return row, at - offsets[row], h[at], context


def long_anchors(flat: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Position, gram hash and context hash of one long row's anchors, by pieces that see `length` bytes and more around them."""
    for a in range(0, len(flat), piece):
        low, high = max(0, a - 2 * length), min(len(flat), a + piece + 2 * length)
        _, pos, h, c = anchors(flat[low:high], np.array([0, high - low]), length, gram)
        mine = (pos >= a - low) & (pos < a - low + piece)
        yield pos[mine] + low, h[mine], c[mine]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes sorted by their first `depth` symbols (at least): as many at once as a number holds, then twice or three times as many a round.

    Values below 0 in `text` are separators; they differ from each other, count less than bytes and end comparisons.
    Also the starts, in this order, of the suffixes' classes by their first symbols, and the number of those.
    """
    n = len(text)
    kinds = np.zeros(256, np.int64)
    kinds[text[text >= 0]] = 1
    bits = int(kinds.sum() + 1).bit_length()
    first = min(63 // bits, depth)
    symbol = np.concatenate([np.where(text < 0, 0, np.cumsum(kinds)[np.maximum(text, 0)]), np.zeros(first, np.int64)])
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(first):
        key = key << bits | np.where(ended, 0, symbol[k : n + k])
        ended |= symbol[k : n + k] == 0
    order = np.argsort(key)
    # what ends within these symbols differs by its separator, and those rise with the place
    over = np.flatnonzero(ended[order])
    some = order[over]
    order[over] = some[np.lexsort((some, key[some]))]
    step, rank = key[order], np.empty(n, np.int64)
    new = np.append(True, (step[1:] != step[:-1]) | ended[order[1:]])
    rank[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    width, times = first, 3 if n < 1 << 20 else 2
    while width < depth and rank[order[-1]] < n - 1:
        key = rank
        for k in range(1, times):
            key = key * (n + 1)
            if k * width < n:
                key[: n - k * width] += rank[k * width :] + 1
        # a suffix told from all others by its first symbols has the same rank in any key
        order = np.argsort(key)
        step = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(step[1:] != step[:-1]))
        width *= times
    return order, heads, first


def expand(text: np.ndarray, order: np.ndarray, heads: np.ndarray, first: int, length: int) -> np.ndarray:
    """For each place of the suffix order (but the first), whether the common prefix with the suffix before is `length` or more.

    Breadth-first backward extension: an interval of all suffixes that start with a string w of l symbols gives, for each
    symbol c before them, the interval of cw; where its right end has no value yet, the common prefix there is l. It starts
    from the intervals of all strings of `first` symbols, which begin at `heads`.
    """
    n = len(text)
    before = text[order - 1]  # the text ends with a separator, which stands before its first suffix
    symbol = np.where(before < 0, 0, before + 1)
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(symbol.astype(np.uint16), kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[n] = False
    unset[heads] = False
    left, right = heads, np.append(heads[1:], n) - 1
    # strings that go past a separator are told apart already; those that end with one stand for it
    ends = np.append(np.flatnonzero(text < 0), n + first)
    separator = ends[np.searchsorted(ends, order[left])] - order[left]
    useful = separator >= first - 1
    left, right = left[useful], right[useful]
    for _ in range(first, length):
        if not len(left):
            break
        size = right - left + 1
        stop = np.cumsum(size)
        top = stop - size
        at = np.repeat(left - top, size)
        at += np.arange(stop[-1])
        kind = symbol[at]
        low = np.minimum.reduceat(kind, top)
        alone = low == np.maximum.reduceat(kind, top)
        straight = alone & (low > 0)  # one symbol before all; what a separator precedes cannot be extended
        if alone.all():
            left, right = left[straight], right[straight]
        else:
            mixed = np.repeat(~alone, size) & (kind > 0)
            both = np.sort((np.repeat(np.arange(len(left)), size)[mixed] * 257 + kind[mixed]) * n + at[mixed])
            key, at = both // n, both % n
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            tail = np.append(head[1:], len(key))[: len(head)] - 1
            left, right = np.concatenate([left[straight], at[head]]), np.concatenate([right[straight], at[tail]])
        left, right = last_to_first[left], last_to_first[right]
        new = unset[right + 1]
        left, right = left[new], right[new]
        unset[right + 1] = False
    return unset[1:n]


def repeated_offsets(contexts: list[bytes], places: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance from the anchor (at `places` in each context) back to the start of a string of `length` bytes
    that another context of the same group has at the same distance; -1 where there is none."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    text = raw.astype(np.int64)
    text[ends - 1] = np.arange(len(contexts)) - len(contexts)
    order, heads, first = suffix_order(text, length)
    run = np.zeros(len(text), np.int64)
    run[1:] = np.cumsum(~expand(text, order, heads, first, length))
    owner = np.repeat(np.arange(len(contexts)), sizes)[order]
    back = places[owner] - (order - (ends - sizes)[owner])
    fits = (back >= 0) & (ends[owner] - 1 - order >= length)
    owner, back, run = owner[fits], back[fits], run[fits]
    dense = np.unique(groups, return_inverse=True)[1]
    by = np.argsort((run * len(contexts) + dense[owner]) * (int(back.max(initial=0)) + 1) + back)
    owner, back, run = owner[by], back[by], run[by]
    same = (run[1:] == run[:-1]) & (groups[owner[1:]] == groups[owner[:-1]]) & (back[1:] == back[:-1])
    twice = np.zeros(len(run), bool)
    twice[1:] |= same
    twice[:-1] |= same
    least, most = np.full(len(contexts), np.iinfo(np.int64).max), np.full(len(contexts), -1, np.int64)
    np.minimum.at(least, owner[twice], back[twice])
    np.maximum.at(most, owner[twice], back[twice])
    return np.where(most < 0, -1, least), most


def _anchor_rows(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(row: np.ndarray, pos: np.ndarray, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([ids.take(take), marks.take(take), pa.array(pos.astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], ["doc_id", "mark", "pos", "h", "c"])

        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            flat, offsets = texts_of(batch.column(2))
            for i, j, part, at in pieces(flat, offsets):
                if len(part) > PIECE + 2 * length and j == i + 1:
                    for pos, h, c in long_anchors(part, length, gram):
                        yield out(np.full(len(pos), i), pos, h, c)
                else:
                    row, pos, h, c = anchors(part, at, length, gram)
                    yield out(row + i, pos, h, c)

    return rows


def _context_rows(length: int, gram: int):
    """Rows (text, [(h, c, pos)]) to contexts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, k, places, contexts = [], [], [], [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for w in wanted:
                    low = max(0, w["pos"] - (length - gram))
                    h.append(w["h"])
                    c.append(w["c"])
                    k.append(w["k"])
                    places.append(w["pos"] - low)
                    contexts.append(raw[low : w["pos"] + length])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, c, k)), pa.array(places, pa.int32()), pa.array(contexts, pa.binary())], ["h", "c", "k", "place", "context"])

    return rows


def halves(low: int, high: int) -> list[tuple[int, int]]:
    """Distances low..high in two ranges."""
    middle = (low + high) // 2
    return [(low, middle), (middle + 1, high)]


def _half_rows(length: int):
    """Groups' contexts to those of both halves of their distances, cut to the strings there, with a key of the part in common
    and a digest of all bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, low, high, h, c, place, context in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                for a, b in halves(low, high):
                    near, far = max(a, place + length - len(context)), min(b, place)  # distances whose strings the context has
                    if near <= far:
                        start = place - far
                        common = hashlib.blake2b(context[place - a : place - b + length], digest_size=8, key=f"{h},{a},{b}".encode()).digest()
                        cut = context[start : place - near + length]
                        same = hashlib.blake2b(cut, digest_size=8, key=b"%d" % far).digest()
                        out.append((int.from_bytes(common, "little", signed=True), int.from_bytes(same, "little", signed=True), a, b, h, c, far, cut))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _GROUPED.types, strict=True)], schema=_GROUPED)

    return rows


_GROUPED = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("place", pa.int32()), ("context", pa.binary())])
_GROUPED_DDL = "key long, same long, low int, high int, h long, c long, place int, context binary"


def likely(rows: list[tuple], length: int, gram: int) -> list[tuple]:
    """Contexts (key, h, c, place, bytes) that share with another of their key the part common to all strings of a fifth of the
    distances from the anchor, cut to the strings at such distances."""
    reach = length - gram
    step = max(1, reach // 5)
    spans = [(low, min(low + step, reach)) for low in range(0, max(1, reach), step)]
    seen: dict[tuple, int] = {}
    cores = []
    for key, _, _, place, context in rows:
        # a cut context has the common part of a fifth if it has any of its strings
        own = [(key, low, context[place - low : place - high + length]) if place >= low and place - high + length <= len(context) else None for low, high in spans]
        cores.append(own)
        for x in own:
            if x:
                seen[x] = seen.get(x, 0) + 1
    out = []
    for (key, h, c, place, context), own in zip(rows, cores, strict=True):
        hit = [span for span, x in zip(spans, own, strict=True) if x and seen[x] > 1]
        if hit:
            start = max(0, place - hit[-1][1])
            out.append((key, h, c, place - start, context[start : place - hit[0][0] + length]))
    return out


def _transform_rows(length: int, gram: int):
    """Contexts, those of a key together, to their repeated offsets."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = likely(rows, length, gram)
        key, h, c, places, contexts = zip(*rows, strict=True) if rows else ((),) * 5
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], ["h", "c", "least", "most"])
        least, most = repeated_offsets(list(contexts), np.array(places, np.int64), np.array(key, np.int64), length)
        keep = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[keep]) for x in (h, c)] + [pa.array(x[keep].astype(np.int32)) for x in (least, most)], ["h", "c", "least", "most"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if size >= TEXT_BYTES and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield solve(held)

    return rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def small_groups(contexts: DataFrame, scratch: Scratch, length: int, gram: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """key, h, c, place, context of groups of `most` contexts at most in which any two equal strings at one distance meet, but
    for strings of contexts alike in a half: tables h, c, least, most of those.

    `contexts`: h, c, k (contexts of the gram), place, context.
    """
    columns = ["key", "low", "high", "h", "c", "place", "context"]
    ready = contexts.where(F.col("k") <= most).select(F.col("h").alias("key"), "h", "c", "place", "context")
    open_ = contexts.where(F.col("k") > most).select(F.col("h").alias("key"), F.lit(0).alias("low"), F.lit(length - gram).alias("high"), "h", "c", "place", "context")
    alike, step, width = [], 0, length - gram + 1
    while width > 1 and not open_.isEmpty():
        cut = scratch.table(open_.mapInArrow(trimmed(_half_rows(length)), _GROUPED_DDL), f"half{step}")
        classes = scratch.table(cut.groupBy("key", "same").agg(F.count("*").alias("n"), F.min(F.struct("h", "c", "low", "high", "place", "context")).alias("x")), f"half{step}-classes")
        of_several = classes.where("n > 1").select("key", "same", "n")
        reach = cut.select("key", "same", "h", "c", (F.col("place") + length - F.octet_length("context")).alias("least"), F.col("place").alias("most"))
        alike.append(scratch.table(counted_join(reach, of_several, ["key", "same"], "n").select("h", "c", "least", "most"), f"half{step}-alike"))
        k = scratch.table(classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), f"half{step}-counts")
        sized = scratch.table(counted_join(classes.select("key", "x.*").select(*columns), k, ["key"], "k"), f"half{step}-sized")
        scratch.drop(f"half{step}", f"half{step}-classes")
        ready = ready.unionByName(sized.where(F.col("k") <= most).select("key", "h", "c", "place", "context"))
        open_ = sized.where(F.col("k") > most).drop("k")
        width, step = (width + 1) // 2, step + 1
    return ready, alike


def repeat_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, mark (xxhash64 of the text) and spans (start, end in bytes; unordered, overlapping) of rows with repeats.

    `docs`: doc_id, mark, text. Rows alike in doc_id and text have the same spans.
    """
    reach = length - gram
    all_anchors = scratch.table(docs.select("doc_id", "mark", "text").mapInArrow(trimmed(_anchor_rows(length, gram)), "doc_id long, mark long, pos int, h long, c long"), "anchors")
    again = scratch.table(all_anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "again")
    met = scratch.table(counted_join(all_anchors, again, ["h"], "n").drop("n"), "met")
    scratch.drop("anchors", "again")
    groups = scratch.table(met.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "pos")).alias("one")), "groups")
    several = scratch.table(groups.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "several")
    wanted = counted_join(groups.select("h", "c", "one"), several, ["h"], "k").select("h", "c", "k", "one.*")
    asked = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "c", "k", "pos")).alias("wanted"))
    texts = docs.alias("d").join(asked.alias("a"), F.expr("d.mark = a.mark and d.doc_id <=> a.doc_id")).select("d.text", "a.wanted")
    contexts = scratch.table(texts.mapInArrow(trimmed(_context_rows(length, gram)), "h long, c long, k long, place int, context binary").dropDuplicates(["h", "c"]), "contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small, alike = small_groups(contexts, scratch, length, gram, group)
    dealt = small.repartition(parts, "key").sortWithinPartitions("key", "c")
    found = dealt.mapInArrow(trimmed(_transform_rows(length, gram)), "h long, c long, least int, most int")
    whole = groups.where("n > 1").select("h", "c", F.lit(0).alias("least"), F.lit(reach).alias("most"))
    offsets = scratch.table(reduce(DataFrame.unionByName, alike, found.unionByName(whole)).groupBy("h", "c").agg(F.min("least").alias("least"), F.max("most").alias("most")), "offsets")
    placed = scratch.table(offsets.join(groups.select("h", "c", "n"), ["h", "c"]), "placed")
    spans = counted_join(met, placed, ["h", "c"], "n").select("doc_id", "mark", F.struct((F.col("pos") - F.col("most")).alias("s"), (F.col("pos") - F.col("least") + length).alias("e")).alias("span"))
    return spans.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep: list[str] | None = None, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with `text` the remaining text too.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere in `docs`. Null texts are
    empty; null doc_ids pass through; repeated rows are repeats of each other; an empty table gives no
    rows; other columns are left aside but for those named in `keep`. A character that loses some of its
    bytes is dropped from `text` (not from the digest).
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    extra = [c for c in keep or [] if c not in ("doc_id", "text")]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"), *extra)
    spans = scratch.table(repeat_spans(rows, scratch, length, gram, group), "spans")
    joined = rows.alias("r").join(spans.alias("s"), F.expr("r.mark = s.mark and r.doc_id <=> s.doc_id"), "left").select("r.doc_id", "r.text", "s.spans", *(f"r.`{c}`" for c in extra))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, digest, left = [], [], [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode()
                parts = merged([(max(0, x["s"]), min(len(raw), x["e"])) for x in found or []])
                rest = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in parts)], [*(a for a, _ in parts), len(raw)], strict=True))
                size.append(len(raw))
                removed.append(len(raw) - len(rest))
                runs.append(len(parts))
                digest.append(hashlib.sha256(rest).hexdigest())
                if text:
                    left.append(rest.decode("utf-8", "ignore"))
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(digest, pa.string()), *([pa.array(left, pa.string())] if text else [])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if text else [])]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[3:]], [*names, *extra])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * text
    return joined.mapInArrow(trimmed(cut), schema + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in extra))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: repeated 200-byte strings of `documents` removed."""
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
