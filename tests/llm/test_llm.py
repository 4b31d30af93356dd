import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from intervale.llm import bpe, decontaminate, near_dedup, outliers, quality, repeats, token_counts, token_store, url_reputation, web_archive

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
rng = random.Random(8)
WORDS = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
BASE = prose(120)
TEXTS = [BASE, BASE.upper(), BASE, BASE + " tail", " ".join(BASE.split()[:110]) + " x y z", prose(80), "", None, "   \n", "one two", "one two", "a<|endoftext|>b", "ab" * 400, prose(60) + "\n" + prose(3) + "\n" * 3, "x" * 900]
TEXTS += [" ".join((w := BASE.split())[:k] + ["q"] + w[k:]) for k in range(5, 100, 9)]
IDS = [*range(len(TEXTS) - 2), 3, None]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, a repeated id, a null id, and extra columns with clashing names."""
    rows = [(i, t, None if k % 5 == 0 else "en", "s", "x", 1) for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string, c int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def ids_of(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


def test_token_store_round_trip(docs, none):
    want, start = [], 0
    for i, t in sorted(zip(IDS, TEXTS, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*ids_of(t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(token_store.token_store(docs, PATH), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_store.token_store(none, PATH).count() == 0


def test_token_file_random_access():
    ids = np.array([rng.choice([3, 255, 256, 70000, 2**32 - 1]) for _ in range(3000)], np.uint32)
    f = token_store.TokenFile(token_store.pack(ids, [1], np.array([3000])))
    assert [f.token(i) for i in range(3000)] == ids.tolist()
    assert all((f.slice(a, b) == ids[a:b]).all() for a, b in ((0, 3000), (511, 513), (9, 9), (2999, 3000)))


def test_token_counts(docs, none):
    want = [(i, len((t or "").encode()), n := len(ids_of(t)), n > 512) for i, t in zip(IDS, TEXTS, strict=True)]
    for chunk, overlap in ((1 << 15, 1 << 10), (200, 140)):
        assert got(token_counts.count_tokens(docs, PATH, chunk=chunk, overlap=overlap), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_bpe(docs, none):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x := ids_of(t)), sha(",".join(map(str, x))), sha(LIB.decode(x, skip_special_tokens=False))) for i, t in zip(IDS, TEXTS, strict=True)]
    assert got(bpe.encode_decode(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode_decode(none, PATH).count() == 0
    odd = [200, 129, 50256, 255]
    assert bpe.merges(PATH).decode(np.array(odd)) == LIB.decode(odd, skip_special_tokens=False)


def test_near_duplicates(docs, none):
    rows = [(i, t) for i, t in zip(IDS, TEXTS, strict=True) if i is not None]
    rows = [r for k, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:k]]]
    sets, up = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(a):
        return a if up[a] == a else top(up[a])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(one), "doc_id", "n_shingles", "component_id", "kept") == sorted([(i, len(sets[i]), top(i), i == top(i)) for i in sets], key=repr)
    assert near_dedup.near_duplicates(docs).count() == len(TEXTS)
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("sent", [10**6, 0])
def test_decontamination(spark, docs, none, sent):
    items = [(0, " ".join(BASE.split()[10:40])), (1, "one two"), (2, None), (3, ""), (4, prose(30)), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(d, i, n, len(q)) for d, t in zip(IDS, TEXTS, strict=True) for i, b in items if (q := shingle_set(b)) and 100 * (n := len(q & shingle_set(t))) >= 75 * len(q)]
    assert got(decontaminate.contaminated(docs, bench, sent=sent), "doc_id", "item_id", "n_shared", "n_item") == sorted(want, key=repr)
    assert decontaminate.contaminated(none, bench, sent=sent).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats(docs, none, group):
    raw = [(t or "").encode() for t in TEXTS]
    for length, gram in ((200, 100), (40, 20)):
        seen = defaultdict(list)
        for k, r in enumerate(raw):
            for p in range(len(r) - length + 1):
                seen[r[p : p + length]].append((k, p))
        gone = [bytearray(len(r)) for r in raw]
        for places in seen.values():
            for k, p in places if len(places) > 1 else ():
                gone[k][p : p + length] = b"\1" * length
        want = [(i, len(r), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(b for b, x in zip(r, g, strict=True) if not x)).hexdigest()) for i, r, g in zip(IDS, raw, gone, strict=True)]
        assert got(repeats.cut_repeats(docs, length, gram, group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert repeats.cut_repeats(none).count() == 0


def removed(raw, length):
    """Spans that strings with a second start cover, by brute force."""
    seen = defaultdict(list)
    for k, r in enumerate(raw):
        for p in range(len(r) - length + 1):
            seen[r[p : p + length]].append((k, p))
    gone = [bytearray(len(r)) for r in raw]
    for places in seen.values():
        for k, p in places if len(places) > 1 else ():
            gone[k][p : p + length] = b"\1" * length
    return [[m.span() for m in re.finditer(b"\1+", bytes(g))] for g in gone]


def test_one_passage_in_every_document(spark):
    """A gram's contexts are halved by distance down to one, as with a passage that all documents share beside others."""
    passage, r = prose(30), random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(40))) + passage[r.randrange(8) :] + "".join(r.choice("ab") for _ in range(r.randrange(40))) for _ in range(60)]
    want = {i: (sum(b - a for a, b in x), len(x)) for i, x in enumerate(removed([t.encode() for t in texts], 60))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.cut_repeats(df, 60, 30, 5).collect()} == want


def test_long_rows_give_the_same_anchors():
    flat = np.frombuffer((prose(4000) + prose(30) * 20).encode(), np.uint8)
    _, pos, h, c = repeats.anchors(flat, np.array([0, len(flat)]))
    cut = [np.concatenate(x) for x in zip(*repeats.long_anchors(flat, piece=1000), strict=True)]
    assert all((a == b).all() for a, b in zip((pos, h, c), cut, strict=True))


def test_quality_rules(docs, none):
    def stats(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)

    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = outliers.quality_rules(docs)
    want = [(i, *(x := stats(t)), x[0] < 50 or 100 * x[4] > 50 * x[0]) for i, t in zip(IDS, TEXTS, strict=True)]
    assert got(out, "doc_id", *cols, "base_failed") == sorted(want, key=repr)
    assert out.where("base_failed and kept").count() == 0 and outliers.quality_rules(none).count() == 0


def test_outliers_are_rejected_and_prose_kept(spark):
    rows = [(i, prose(rng.randrange(60, 300))) for i in range(150)] + [(1000 + i, " ".join(w + "%%%" for w in prose(90).split())) for i in range(15)]
    kept = dict(got(outliers.quality_rules(spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")), "doc_id", "kept"))
    assert all(kept[i] for i in range(150)) and not any(kept[1000 + i] for i in range(15))


def test_url_rules_and_shrinkage(spark):
    pages = spark.createDataFrame([(1, "http://A.example.ORG/es/x?q#f"), (2, "https://example.org"), (3, None), (4, "nothing"), (5, "http://b.com/de/"), (6, "http://notexample.org/es/"), (None, "http://c.net/a?b"), (7, "http://bad.net/1"), (7, "http://bad.net/1")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1), (None, 1), (3, None), (1, 0), (2, 0), (4, 0), (5, 0), (6, 0)], "page_id long, bad int")
    out = got(url_reputation.judge_urls(pages, labels), "page_id", "host", "path", "rule", "verdict")
    assert (1, "a.example.org", "/es/x", "example.org/es/", "block") in out and (2, "example.org", "", None, "allow") in out and (5, "b.com", "/de/", "com/de/", "block") in out
    assert (3, "", "", None, "allow") in out and (6, "notexample.org", "/es/", "org/", "allow") in out and len(out) == 9
    hosts = spark.createDataFrame([(f"h{i}.d{i % 5}.net", 40, 38 if i % 5 == 0 else 2) for i in range(40)] + [("new.d0.net", 1, 0), ("new.d1.net", 1, 1)], "host string, n long, bad long")
    r = {x["host"]: x for x in url_reputation.reputation(hosts).collect()}
    assert r["h5.d0.net"]["bound"] > 0.5 > r["h1.d1.net"]["bound"] and r["new.d0.net"]["mean"] > 0.3 and r["new.d1.net"]["mean"] < 0.6
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0


def test_web_archive(spark):
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "short", "short", None, "é" * 60, "é" * 60, "é" * 60]
    ids = [3, 1, 4, 5, 6, 9, None, 7]
    pages = spark.createDataFrame([(i, f"http://x/{k}\r\n", h, "x") for k, (i, h) in enumerate(zip(ids, html, strict=True))], "page_id long, url string, html string, digest string")
    want = []
    for i, h in zip(ids, html, strict=True):
        raw = (h or "").encode()
        first = min((j for j, g in zip(ids, html, strict=True) if g == h and j is not None), default=None)
        again = len(raw) >= 100 and first is not None and (i is None or i > first)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got(web_archive.archive_pages(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert web_archive.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0xFFFFFFFF, 0])
def test_zip_directories(limit):
    out = io.BytesIO()
    w = web_archive.PackageWriter(out, limit)
    for name, body in (("a.txt", b"hello world"), ("é/b", b"x" * 1000)):
        w.begin(name)
        w.write(body)
        w.end()
    w.close()
    p = web_archive.Package(out, len(out.getvalue()))
    assert p.read("a.txt", 6, 5) == b"world" and p.read("é/b") == b"x" * 1000
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("a.txt") == b"hello world"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("m", b"12345")
        z.comment = b"PK\x05\x06 not the end"
    assert web_archive.Package(plain, len(plain.getvalue())).read("m", 1, 3) == b"234"


def test_quality_learns_and_keeps_folds_apart(spark, docs, none):
    rows = [(i, prose(rng.randrange(20, 200)) if i % 4 else prose(60).upper().replace(" ", "!! ")) for i in range(300)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality.train(data, labels.where(~quality.held_out()))
    out = got(quality.score_documents(data, model), "doc_id", "predicted")
    assert np.mean([p == int(i % 4 > 0) for i, p in out]) > 0.97
    assert all(0 <= s <= 1 for _, s in got(quality.score_documents(docs, model), "doc_id", "score"))
    assert quality.score_documents(none, model).count() == 0 and quality.train(data, labels.limit(0)) is None
    assert got(docs.select("doc_id", quality.held_out().alias("h")), "h") == sorted([(i is not None and zlib.crc32(str(i).encode()) % 4 == 2,) for i in IDS], key=repr)


def test_attention_gradients():
    m = quality.AttentionModel()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    x, bounds, y = r.normal(size=(7, quality.WIDTH)) / 8, np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: np.mean(np.logaddexp(0, (z := m.forward(x, bounds)["logit"])) - y * z)
    grads = m.gradients(x, bounds, y)
    for k in ("W", "V", "U", "w", "c", "b"):
        at = tuple(r.integers(0, s) for s in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    start = docs.limit(60).cache()
    ids = {r["doc_id"] for r in start.collect()}
    one = stage[names[1]](spark, start, sf)
    assert one.columns == list(corpus_pipeline.COLUMNS) and {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in near_dedup.near_duplicates(start).where("kept").collect()}
    two = {r["doc_id"]: r for r in stage[names[2]](spark, start, sf).collect()}
    assert set(two) == ids and all(len(r["text"]) == r["n_chars"] for r in two.values())
    three = {r["doc_id"] for r in stage[names[3]](spark, start, sf).collect()}
    hit = {r["doc_id"] for r in decontaminate.contaminated(start, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert three == ids - hit
    assert stage[names[4]](spark, start, sf).count() == 60


def test_texts_under_one_doc_id_are_compared_each(spark):
    import pyarrow as pa

    import corpus_pipeline

    other = prose(80)
    rows = [(1, 2, BASE, other), (1, 2, BASE, BASE + " tail"), (3, 2, BASE, BASE + " tail"), (3, 2, BASE, other)]
    cols = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])], ["a", "b", "text_a", "text_b"])
    found = [x.to_pylist() for x in near_dedup._confirm(75, 100)([batch])]
    assert sum(found, []) == [{"a": 1, "b": 2}, {"a": 3, "b": 2}]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(5, BASE), (5, BASE), (6, BASE + " tail"), (7, other)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(corpus_pipeline.one_of_each(spark, docs, ""), "doc_id") == [(5,), (7,)]


def test_small_groups_are_judged_by_their_language_or_the_corpus(spark):
    odd = lambda: " ".join(w + "%%%" for w in prose(90).split())
    rows = [(i, prose(100), "en", "a") for i in range(80)] + [(100 + i, odd(), "en", "b") for i in range(3)] + [(200, odd(), "xx", "c"), (201, prose(100), "en", "d")]
    kept = dict(got(outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "doc_id", "kept"))
    assert not any(kept[i] for i in (100, 101, 102, 200)) and all(kept[i] for i in (*range(80), 201))


def test_suffixes_and_expansion_against_brute_force():
    r = random.Random(1)
    for _ in range(150):
        alphabet = r.choice(["ab", "abcdefgh", "".join(map(chr, range(33, 250)))])
        base = "".join(r.choice(alphabet) for _ in range(40))
        contexts = [(base[r.randrange(10) :][: r.randrange(3, 40)] + r.choice(["", base[:3]])).encode() for _ in range(r.choice([2, 3, 60]))]
        length, ends = r.choice([2, 5, 8, 20, 33]), np.cumsum([len(c) + 1 for c in contexts])
        text = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.int64)
        text[ends - 1] = np.arange(len(contexts)) - len(contexts)
        suffix = [text[i : ends[np.searchsorted(ends, i, "right")]].tolist()[:length] for i in range(len(text))]
        order, heads, first = repeats.suffix_order(text, length)
        ordered = [suffix[i] for i in order]
        assert ordered == sorted(ordered)
        want = [a == b and len(b) == length and min(b) >= 0 for a, b in zip(ordered, ordered[1:], strict=False)]
        assert repeats.expand(text, order, heads, first, length).tolist() == want
