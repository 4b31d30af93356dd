import inspect
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale import __main__ as cli
from intervale import catalog
from intervale.config import Boundary, Calibration, Candidates, Settings
from intervale.functions import text, vectors
from intervale.operators import boundaries, evaluate, network, pool, refine, stats
from intervale.plans import generate as plan
from intervale.sources import files, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_distance_of_parallel_opposite_and_orthogonal(spark):
    h = [[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([("v", t, x) for t, x in enumerate(h)], "video_id string, t int, h array<float>")
    assert [round(d, 6) for _, d in rows(boundaries.frame_distance(df), "t", "d")] == [0, 2, 1]


@pytest.mark.parametrize("width", [1, 3, 4, 5])
def test_moving_average_repeats_edges(spark, width):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([("v", t, v) for t, v in enumerate(x)], "video_id string, t int, d double")
    left = width // 2
    want = [sum(x[min(max(i + k, 0), 5)] for k in range(-left, width - left)) / width for i in range(6)]
    assert [m for _, m in rows(boundaries.moving_average(df, width), "t", "m")] == pytest.approx(want)


def test_closeness_curve(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.05, 0.15, 0.25, 1.0])], "i int, x double")
    assert [v for _, v in rows(df.withColumn("p", vectors.closeness(F.col("x"))), "i", "p")] == pytest.approx([1, 1, 0.65, 0.3, 0.3])


def test_greedy_selection_equals_plain_loop(spark):
    rng = random.Random(2)
    data = [(f"v{k}", i, i, s := rng.randrange(40), s + rng.randrange(3, 20), rng.randrange(6) / 6) for k in range(20) for i in range(15)]
    got = pool.greedy(spark.createDataFrame(data, "video_id string, uid int, pool_ord int, s int, e int, sfs double"), 4, 0.5)
    want = []
    for v in {d[0] for d in data}:
        left, rank = sorted((d for d in data if d[0] == v), key=lambda d: (-d[5], d[2])), 0
        while left and rank < 4:
            best = left[0]
            want.append((v, rank, best[1]))
            rank += 1
            left = [d for d in left[1:] if max(0, min(d[4], best[4]) - max(d[3], best[3]) + 1) / (max(d[4], best[4]) - min(d[3], best[3]) + 1) <= 0.5]
    assert rows(got, "video_id", "sel_rank", "uid") == sorted(want)


def test_pool_bounds_and_statistics(spark):
    frames = files.synthetic_frames(spark, 2, 32, 4, 20).select("video_id", "t", "h").cache()
    got = pool.candidates(frames).collect()
    by = {r["video_id"]: {} for r in got}
    for r in frames.collect():
        by[r["video_id"]][r["t"]] = np.array(r["h"], float)
    for v in by:
        mine = [r for r in got if r["video_id"] == v]
        assert len(mine) <= 80 and sorted(r["uid"] for r in mine) == list(range(len(mine)))
        for r in mine:
            part = np.stack([by[v][t] for t in range(r["s"], r["e"] + 1)])
            assert r["e"] - r["s"] + 1 >= 6 and r["mid"] == (r["s"] + r["e"]) // 2
            assert np.allclose(r["fbar"], part.mean(0), atol=1e-9) and abs(r["var"] - ((part - part.mean(0)) ** 2).sum(1).mean()) < 1e-9


def test_priors_and_density(spark):
    videos = spark.createDataFrame([(f"v{i}", 0) for i in range(4)], "video_id string, category_id int")
    chosen = spark.createDataFrame([("v0", 0), ("v0", 1), ("v1", 0), ("v2", 0), ("v2", 2), ("v3", 0)], "video_id string, type_id int")
    assert [p for *_, p in rows(stats.priors(chosen, videos, chosen), "type_id", "p")] == pytest.approx([0.9, 0.3, 0.3])
    empty = spark.createDataFrame([], "video_id string, s_density double")
    assert stats.density_means(empty, videos).first()["mean"] == 1.0


def test_convergence_of_same_and_moved_rounds(spark):
    prev = spark.createDataFrame([("v", 0, 0, 0, 9), ("v", 1, 1, 20, 29)], "video_id string, uid int, sel_rank int, s int, e int")
    assert refine.converged(refine.convergence(prev, prev)).first()["converged"]
    moved = prev.withColumn("s", F.col("s") + 2)
    one = refine.converged(refine.convergence(prev, moved)).first()
    assert (one["jaccard"], one["shift"], one["converged"]) == (1.0, 1.0, False)


def test_maximum_matching_beats_greedy_and_brute_force():
    assert evaluate._matching([(0, 0), (0, 1), (1, 0)]) == 2
    rng = random.Random(4)

    def brute(edges):
        if not edges:
            return 0
        a = edges[0][0]
        rest = [e for e in edges if e[0] != a]
        return max([brute(rest)] + [1 + brute([e for e in rest if e[1] != b]) for x, b in edges if x == a])

    for _ in range(200):
        edges = [(a, b) for a in range(5) for b in range(5) if rng.random() < 0.3]
        assert evaluate._matching(edges) == brute(edges)


def test_seconds_iou_and_tokens(spark):
    one = spark.range(1).select(vectors.seconds_iou(*(F.lit(x) for x in (0.0, 10.0, 5.0, 15.0))).alias("a"), vectors.seconds_iou(*(F.lit(x) for x in (0.0, 10.0, 20.0, 30.0))).alias("b"), text.tokens(F.lit("Été_1 à-b")).alias("t"), text.frame_rate(F.lit("30000/1001")).alias("f"), text.frame_rate(F.lit("1/0")).alias("z")).first()
    assert one["a"] == pytest.approx(1 / 3) and one["b"] == 0 and one["t"] == ["été_1", "à", "b"] and round(one["f"], 2) == 29.97 and one["z"] == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"videos": [{"id": "a", "duration": 0, "category": "x"}, {"id": "b", "duration": 5.5}]}))
    assert rows(files.manifest(spark, str(tmp_path / "m.json")), "video_id", "duration") == [("a", None), ("b", 5.5)]
    (tmp_path / "twice.json").write_text(json.dumps([{"id": "a"}, {"id": "a"}]))
    with pytest.raises(ValueError):
        files.manifest(spark, str(tmp_path / "twice.json"))
    (tmp_path / "f").mkdir()
    np.save(tmp_path / "f" / "a.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert rows(files.frame_arrays(spark, str(tmp_path / "f")), "t", "h") == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    labels = spark.createDataFrame([("a", 0, 0.0, 1.5, "é", 5.0), ("a", 1, 2.0, 3.0, "x", 5.0)], "video_id string, ord int, start double, end_ double, caption string, duration double")
    path = sinks.write_labels(labels, "activitynet", str(tmp_path / "out"))
    assert json.loads(open(path, encoding="utf-8").read()) == {"a": {"duration": 5.0, "timestamps": [[0.0, 1.5], [2.0, 3.0]], "sentences": ["é", "x"]}}
    assert sinks.two_places(0.125) == "0.12" and sinks.two_places(1.005) == "1.00"


def test_paths_resolve_by_record_then_suffix(spark):
    videos = spark.createDataFrame([("a", "rec/a.mp4"), ("b", "rec/b.mp4"), ("c", None), ("d", None), ("e.f", None), (None, None)], "video_id string, path string")
    listing = spark.createDataFrame([("rec/a.mp4",), ("root/a.mkv",), ("root/b.mov",), ("root/b.webm",), ("rec/c.mp4",), ("root/d.txt",), ("root/e.f.avi",), (None,)], "file string")
    found = lambda root=None: dict(files.resolved_paths(videos, listing, root).collect())
    assert found("root/") == {"a": "rec/a.mp4", "b": "root/b.webm", "c": None, "d": None, "e.f": "root/e.f.avi", None: None}
    assert found()["c"] == "rec/c.mp4"
    assert files.resolved_paths(videos.limit(0), listing).count() == 0


def test_settings():
    s = Settings.from_dict({"scores": {"weights": [0.25] * 4, "unknown": 1}, "ablate_dimensions": ["uniq", "conf"]})
    assert s.ablated().scores.weights == (0, 0.5, 0.5, 0) and s.candidates.min_span == 6
    assert s.override("calibration.n_event_types=5").calibration.n_event_types == 5
    with pytest.raises(ValueError):
        s.override("scores.nothing=1")


def test_network_slopes_equal_differences():
    b = Boundary(width=8, heads=2)
    rng = np.random.default_rng(1)
    x, flat = rng.normal(size=(14, 3)), network.fresh(3, b, 5)
    flat += rng.normal(0, 0.1, flat.shape)

    def loss(w):
        one = network.Pass(network._named(w, 3, b), b.heads)
        return one, network.loss_and_slope(one.forward(x), [2, 6], [6, 11], b, 14, 2, 2.5)

    one, (_, slope) = loss(flat)
    total = np.zeros_like(flat)
    one.backward(slope, network._named(total, 3, b))
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert total[i] == pytest.approx((loss(flat + step)[1][0] - loss(flat - step)[1][0]) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("most", [1, 64])
def test_training_deals_every_video_to_one_step_an_epoch(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(network, "SPREAD_STEPS", most)
    frames = files.synthetic_frames(spark, n_videos=5, dim=8, segments=2, per_segment=8)
    events = frames.select("video_id").distinct().select("video_id", F.lit(2).alias("s"), F.lit(9).alias("e"))
    path = str(tmp_path / "tracks")
    network.tracks(frames, events).write.partitionBy("part").parquet(path)
    table = spark.read.parquet(path)
    b = Boundary(epochs=2, batch=2)
    one, again = network.train(table, b, 3), network.train(table, b, 3)
    assert np.allclose(one[0], again[0]) and len(one[1]) == 2 and np.isfinite(one[1]).all()
    plain = table.where(F.col("part").isin([1, 2]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [part" in plain
    assert network.train(table.limit(0), b, 3) is None


def test_generation_refines_to_labels(spark, tmp_path):
    made = files.synthetic_frames(spark, 6, 16, 4, 16)
    corpus = plan.Corpus(made.select("video_id", "t", "h"), made.select("video_id", "t", F.concat(F.lit("at "), F.col("t").cast("string")).alias("caption")), made.select("video_id", "t", "q"), made.select("video_id", F.lit("c").alias("category"), F.lit(None).cast("double").alias("duration")).distinct())
    short = spark.createDataFrame([("short", t, [1.0] * 16) for t in range(5)], "video_id string, t int, h array<float>")
    corpus.frames = corpus.frames.union(short)
    settings = Settings(candidates=Candidates(pool_max=40), boundary=Boundary(max_iters=2, epochs=1, width=16, batch=3), calibration=Calibration(type_k_range=(3, 4), use_manifest_categories=True))
    out = plan.generate(corpus, settings, folder=f"file://{tmp_path}")
    events = out.selected.collect()
    assert {r["video_id"] for r in events} == {f"demo_{i:04d}" for i in range(6)} and 1 <= len(out.history) <= 2
    for r in events:
        assert 0 <= r["s"] and r["e"] < 64 and r["e"] - r["s"] + 1 >= 6 and r["type_id"] >= 0 and r["caption"].startswith("at ")
    assert len({(r["video_id"], r["uid"]) for r in events}) == len(events)
    assert all(0 <= h["jaccard"] <= 1 and h["n_events"] <= 60 and np.isfinite(h["train_loss"]) for h in out.history)
    with pytest.raises(ValueError):
        plan.generate(plan.Corpus(short, corpus.captions, corpus.text, corpus.videos), settings, folder=f"file://{tmp_path}")


def test_clusters_choose_the_planted_number(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in np.eye(6)[i % 4] + rng.normal(0, 0.02, 6)]) for i in range(60)]
    points = spark.createDataFrame(data, "key int, v array<double>")
    assert len(stats.clusters(points, (2, 6), None, 5)) == 4
    assert stats.clusters(points.limit(3), (2, 6), None, 5) is None


def test_command_line_writes_labels_and_evaluates_them(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "m.json").write_text(json.dumps({"videos": [{"id": f"v{i}", "category": "x"} for i in range(2)]}))
    for name in ("h", "q", "c"):
        (tmp_path / name).mkdir()
    for i in range(2):
        base = np.repeat(rng.normal(size=(4, 8)), 12, 0)
        for name in ("h", "q"):
            np.save(tmp_path / name / f"v{i}.npy", (base + rng.normal(0, 0.05, base.shape)).astype(np.float32))
        (tmp_path / "c" / f"v{i}.json").write_text(json.dumps([f"scene {t // 12}" for t in range(48)]))
    args = ["generate", "--manifest", str(tmp_path / "m.json"), "--feats", str(tmp_path / "h"), "--captions", str(tmp_path / "c"), "--text", str(tmp_path / "q"), "--out", str(tmp_path / "out"), "--variant", "initial", "--set", "scores.num_events=3"]
    report = cli.run_generate(spark, cli.parser().parse_args(args))
    assert report["config"]["scores"]["num_events"] == 3 and report["iteration"] == []
    labels = json.loads((tmp_path / "out" / "train_pseudo.json").read_text())
    assert sorted(labels) == ["v0", "v1"] and all(1 <= len(v["timestamps"]) <= 3 and v["duration"] == 16 for v in labels.values())
    same = cli.run_evaluate(spark, cli.parser().parse_args(["evaluate", "--pred", report["labels"], "--ref", report["labels"], "--out", str(tmp_path / "eval")]))
    assert same["precision_70"] == same["recall_70"] == same["f1_30"] == same["coverage_50"] == same["token_f1"] == 1.0


def test_whole_texts_are_stripped_at_both_ends(spark, tmp_path):
    long = " \t\n" + "word " * 50 + "end"
    spark.createDataFrame([(0, long + " \n"), (1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(catalog.QUERIES["strip_text"](spark, str(tmp_path)), "doc_id", "t") == [(0, long.lstrip()), (1, "a")]


def test_steps_have_batch_videos_at_every_size(spark, tmp_path, monkeypatch):
    counts = {p: 1 + p % 7 for p in range(900)}
    steps = network.deal(counts, 32, [1, 0])
    assert [sum(z - a for _, a, z in share) for share in steps[:-1]] == [32] * (len(steps) - 1) and len(steps) == -(-sum(counts.values()) // 32) > network.SPREAD_STEPS
    assert sorted((p, i) for share in steps for p, a, z in share for i in range(a, z)) == [(p, i) for p in counts for i in range(counts[p])]
    frames = files.synthetic_frames(spark, n_videos=5, dim=8, segments=2, per_segment=8)
    events = frames.select("video_id").distinct().select("video_id", F.lit(2).alias("s"), F.lit(9).alias("e"))
    monkeypatch.setattr(network, "DEALT", 2)
    network.tracks(frames, events, 2).write.partitionBy("part").parquet(str(tmp_path / "tracks"))
    table, b = spark.read.parquet(str(tmp_path / "tracks")), Boundary(epochs=1, batch=2)
    many = network.train(table, b, 3)
    monkeypatch.setattr(network, "SPREAD_STEPS", 1)
    assert np.allclose(many[0], network.train(table, b, 3)[0])


def test_every_point_enters_the_choice_of_k(spark, monkeypatch):
    digest = F.xxhash64(F.col("key").cast("string"), F.lit(42))
    order = [r["key"] for r in spark.range(2200).select(F.col("id").alias("key")).orderBy(digest).collect()]
    rng = np.random.default_rng(5)
    data = [(key, [float(x) for x in np.eye(6)[i % 3 if i < 2000 else 3] + rng.normal(0, 0.02, 6)]) for i, key in enumerate(order)]
    points = spark.createDataFrame(data, "key long, v array<double>")
    monkeypatch.setattr(stats, "BLOCK", 600)
    assert len(stats.clusters(points, (2, 4), None, 5)) == 4
    some = points.limit(90).select("key", vectors.unit("v").alias("u")).cache()
    x, book = np.array([r["u"] for r in some.collect()]), np.eye(6)[:3]
    book[2] += book[1] * 0.9
    monkeypatch.setattr(stats, "BLOCK", 20)
    got = stats.mean_silhouettes(some, len(x), [book, np.eye(6)[:1]])
    near = ((x[:, None] - book) ** 2).sum(2).argmin(1)
    gap, wide = np.sqrt(((x[:, None] - x) ** 2).sum(2)), []
    for i, k in enumerate(near):
        own = gap[i][near == k].sum() / max((near == k).sum() - 1, 1)
        other = min(gap[i][near == j].mean() for j in set(near) - {k})
        wide.append((other - own) / max(own, other) if (near == k).sum() > 1 else 0.0)
    assert got == [pytest.approx(np.mean(wide)), None]


def test_generating_queries_run_the_default_settings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plan, "generate", lambda corpus, settings: seen.append(settings))
    catalog._generated(spark, "/root/testdata/sf0.001")
    assert seen == [Settings()]


def test_captions_come_from_every_document_and_whole_texts(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(250).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("long\n"), F.lit(40)), F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["scan_captions"](spark, str(tmp_path)).collect()
    assert {(r["video_id"], r["t"]): r["caption"] for r in got} == {(f"v{i // 50}", i % 50): "long " * 40 + str(i % 250) for i in range(300)}
    assert not any("substring(text" in q or "% 200" in q for q in catalog.ORACLES.values())


def test_variants():
    plain = Settings()
    assert plain.variant("alignment").scores.weights == (0.0, 0.0, 0.0, 1.0) and plain.variant("alignment").boundary == plain.boundary
    assert plain.variant("initial").boundary.max_iters == 0 and plain.variant("initial").scores == plain.scores
    third = 1 / 3
    assert plain.variant("no_narr").scores.weights == pytest.approx((third, third, 0.0, third)) and plain.variant("full") == plain


def test_flags_of_settings():
    required = [x for name in ("manifest", "feats", "captions", "text", "out") for x in (f"--{name}", "x")]
    flags = ["--fps", "2", "--num-events", "4", "--pool-min", "5", "--pool-max", "9", "--max-iters", "1", "--epochs", "2", "--lr", "0.1", "--delta", "3", "--dataset", "charades", "--ablate", "uniq", "--ablate", "conf"]
    got = cli.settings_of(cli.parser().parse_args(["generate", *required, *flags]))
    assert (got.candidates.fps, got.candidates.pool_min, got.candidates.pool_max, got.scores.num_events) == (2.0, 5, 9, 4)
    assert (got.boundary.max_iters, got.boundary.epochs, got.boundary.lr, got.boundary.delta, got.output.layout) == (1, 2, 0.1, 3, "charades")
    assert got.scores.weights == (0.0, 0.5, 0.5, 0.0)


def test_evaluation_by_manifest(spark, tmp_path):
    """Durations fall back to the reference's; a reference without intervals counts; wrong files raise."""

    def run(pred, ref, ids=None):
        for name, value in (("pred", pred), ("ref", ref), ("m", [{"id": i} for i in ids or []])):
            (tmp_path / f"{name}.json").write_text(json.dumps(value))
        args = ["evaluate", "--pred", str(tmp_path / "pred.json"), "--ref", str(tmp_path / "ref.json"), "--out", str(tmp_path / "e")]
        return cli.run_evaluate(spark, cli.parser().parse_args(args + (["--manifest", str(tmp_path / "m.json")] if ids else [])))

    ref = {"a": {"duration": 10, "timestamps": [[0, 5], [0, 5], [5, 99]], "sentences": ["x y", "z", "w"]}, "b": {"duration": 8, "timestamps": [], "sentences": []}, "c": {"duration": 4, "timestamps": [[0, 4]], "sentences": ["q"]}}
    pred = {"a": {"timestamps": [[0, 5], [4, 6]], "sentences": ["x y", "x y"]}, "c": {"duration": 6, "timestamps": [[0, 6]], "sentences": ["q"]}}
    got = run(pred, ref, ["a", "b"])
    assert (got["videos"], got["n_pred"], got["n_ref"], got["tp_50"], got["mean_best_iou"]) == (2, 2, 2, 1, pytest.approx((1 + 1 / 95) / 4))
    assert got["precision_50"] == 0.5 and got["token_f1"] == 0.5 and got["duplicate_fraction"] == 0.75 and 0 <= got["mean_best_iou_ci95"][0] <= got["mean_best_iou_ci95"][1]
    assert run(pred, ref)["videos"] == 3
    of = {r["video_id"]: r for r in spark.read.json(str(tmp_path / "e" / "per_video")).collect()}
    assert of["c"]["duration_difference"] == 2 and of["a"]["duration_difference"] == 0 and (of["a"]["tp_30"], of["b"]["tp_30"], of["c"]["tp_70"]) == (1, 0, 0)
    with pytest.raises(ValueError, match="no reference of d"):
        run(pred, ref, ["a", "d"])
    with pytest.raises(ValueError, match="invalid interval of a"):
        run({"a": {"timestamps": [[0, 50]], "sentences": ["x"]}}, ref)
    with pytest.raises(Exception, match="misaligned captions: a"):
        run({"a": {"timestamps": [[0, 5], [5, 6]], "sentences": ["x"]}}, ref)


def test_malformed_files_raise(spark):
    broken = spark.createDataFrame([("v", "[1, "), ("w", '["a"]')], "video_id string, value string")
    for read in (files.decoded_captions, files.manifest_entries, files.interval_entries):
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            read(broken).collect()


def test_arrays_survive_the_file_format(spark):
    frames = files.synthetic_frames(spark, n_videos=3, dim=4, segments=2, per_segment=3)
    back = files.decoded_frames(files.encoded_frames(frames))
    assert rows(back, "video_id", "t", "h") == rows(frames, "video_id", "t", "h")


def test_missing_captions_and_vectors_raise(spark):
    frames = files.synthetic_frames(spark, n_videos=2, dim=8, segments=3, per_segment=8)
    said = frames.select("video_id", "t", F.when(F.col("video_id") == "demo_0001", F.lit(" ")).otherwise(F.lit("x")).alias("caption"))
    corpus = plan.Corpus(frames.select("video_id", "t", "h"), said, frames.select("video_id", "t", "q"), frames.select("video_id").distinct().withColumn("category", F.lit("c")).withColumn("duration", F.lit(8.0)))
    with pytest.raises(ValueError, match="demo_0001: [0-9]+ events without a caption, 0 without"):
        plan.generate(corpus, Settings(boundary=Boundary(max_iters=0)), strict=True)


def test_resampled_counts_agree_with_resampled_values(spark, monkeypatch):
    values = [(f"v{i}", float(x)) for i, x in enumerate(np.random.default_rng(1).uniform(0, 1, 400).round(4))]
    table = spark.createDataFrame(values, "video_id string, x double")
    exact = evaluate.interval_of_mean(table, "x")
    monkeypatch.setattr(evaluate, "EXACT_VIDEOS", 10)
    assert evaluate.interval_of_mean(table, "x") == pytest.approx(exact, abs=0.004)


def test_every_key_of_the_inventory_is_registered():
    for name in ("tiou_pairs", "scan_manifest", "scan_frames", "bipartite_match", "refine_round", "round_history", "boundary_prob", "kmeans_types", "silhouette"):
        assert name in catalog.QUERIES
    assert all(name in catalog.QUERIES for name in catalog.ORACLES)


def test_every_query_takes_a_session_and_a_folder():
    assert all(len(inspect.signature(f).parameters) == 2 for f in catalog.QUERIES.values())


def test_localized_f1_moves_no_sentences_with_spans(spark, tmp_path):
    """Long sentences stay with their documents: the plan shuffles references of pairs, a document's text, and one bag for a pair."""
    pred = [("v", 0, 0.0, 10.0, "A b b c"), ("v", 2, 0.0, 9.0, "a B b c"), ("v", 4, 50.0, 60.0, "x"), ("w", 6, 0.0, 10.0, None), ("w", 8, 0.0, 5.0, "!?")]
    ref = [("v", 1, 0.0, 10.0, "b B, b d"), ("v", 3, 0.0, 10.0, "b-c"), ("v", 5, 0.0, 8.0, "a b b c"), ("w", 7, 0.0, 6.0, "été"), ("w", 9, 0.0, 10.0, None)]
    a, b = (spark.createDataFrame(x, "video_id string, event_id long, start double, end_ double, sentence string") for x in (pred, ref))
    assert rows(evaluate.localized_f1(a, b), "event_id", "f1") == [(0, 1.0), (2, 1.0), (4, 0.0), (6, 0.0), (8, 0.0)]
    third = evaluate.localized_f1(a, b.where("event_id in (1, 3)"))
    assert [f for _, f in rows(third, "event_id", "f1")] == [pytest.approx(2 * 2 / 6), pytest.approx(2 * 2 / 6), 0.0, 0.0, 0.0]
    plan_of = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan_of("localized_f1") and "collect_list" not in plan_of("eval_per_video")


def test_sentences_are_told_apart_whole(spark):
    """per_video with sentences and with references of them: the same rows."""
    pred = [("v", i, float(i), i + 4.0, f"{'long ' * 300}{i % 3}") for i in range(12)]
    ref = [("v", i, i + 0.5, i + 4.0, f"{'long ' * 200}{i % 2}") for i in range(12)]
    a, b = (spark.createDataFrame(x, "video_id string, event_id long, start double, end_ double, sentence string") for x in (pred, ref))
    one = evaluate.per_video(a, b, a.select("video_id").distinct()).first()
    assert (one["n_pred"], one["n_ref"], one["duplicate_fraction"]) == (12, 12, 0.75)
    dictionary = a.union(b).select(F.col("sentence").alias("text"), F.xxhash64("sentence").alias("k")).distinct()
    keyed = [x.withColumn("sentence", F.xxhash64("sentence")) for x in (a, b)]
    same = evaluate.per_video(*keyed, a.select("video_id").distinct(), texts=lambda x, name: x.join(dictionary, F.col(name) == F.col("k")).drop("k")).first()
    assert same == one and one["f1_sum"] == pytest.approx(12 * 2 * 201 / 502, abs=0.05)


def test_matching_takes_no_sentences(spark):
    refs = spark.createDataFrame([("v", 0.0, 4.0, "r")], "video_id string, start double, end_ double, sentence string")
    pred = spark.createDataFrame([("v", 1, 0.0, 4.0, "p")], "video_id string, event_id long, start double, end_ double, sentence string")
    found = evaluate.matches(evaluate.pairs(pred, evaluate.merged_refs(refs)))
    assert not {"p_sentence", "sentences"} & set(re.findall(r"\w+", found._jdf.queryExecution().optimizedPlan().toString()))
    assert rows(found, "threshold", "tp") == [(0.3, 1), (0.5, 1), (0.7, 1)]


def test_silhouette_of_blocks_makes_no_row_of_a_pair(spark, monkeypatch):
    """Equal and nearly equal vectors far from zero, clusters of one, points without a cluster or vector."""
    monkeypatch.setattr(stats, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1e-5, (90, 6)) + 1e3 * np.eye(6)[np.arange(90) % 3] + 5
    x[3:30:3] = x[0]
    data = [(i, int(i % 3) if i < 89 else 7, [float(a) for a in v]) for i, v in enumerate(x)] + [(90, None, [0.0] * 6), (91, 1, None)]
    out = stats.silhouette(spark.createDataFrame(data, "key long, cluster int, v array<double>"))
    assert "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["key"]: r["width"] for r in out.collect()}
    label = np.array([d[1] for d in data[:90]])
    gap = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i in range(90):
        own = gap[i][label == label[i]].sum() / max((label == label[i]).sum() - 1, 1)
        other = min(gap[i][label == j].mean() for j in set(label) - {label[i]})
        assert got[i] == pytest.approx((other - own) / max(own, other) if i < 89 else 0.0, abs=1e-9)
    assert len(got) == 92 and got[90] == got[91] == 0.0
    near = spark.createDataFrame([(i, i % 2, [1e4 + a, 1e4]) for i, a in enumerate((0.0, 4e-5, 1e-5, 5e-5))], "key long, cluster int, v array<double>")
    assert [w for _, w in rows(stats.silhouette(near), "key", "width")] == pytest.approx([1 - 1 / 4.5, 1 - 1 / 3.5, 1 - 1 / 3.5, 1 - 1 / 4.5], abs=1e-3)
    assert stats.silhouette(near.limit(1)).count() == 0


def test_fits_go_together_and_alike_in_blocks_or_gathered(spark, monkeypatch):
    """No fit is a series of jobs of its own, on threads that share a job's properties (which failed with "Cannot parse null string")."""
    from pyspark.ml.clustering import KMeans

    monkeypatch.setattr(KMeans, "fit", lambda *a: pytest.fail("a fit of its own"))
    rng = np.random.default_rng(8)
    x = np.eye(5)[np.arange(200) % 5] + rng.normal(0, 0.15, (200, 5))
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "key long, v array<double>")
    assert len(stats.clusters(points, (2, 7), None, 5)) == 5
    monkeypatch.setattr(stats, "BLOCK", 30)
    data = points.select("key", vectors.unit("v").alias("u")).cache()
    u = np.array([r["u"] for r in data.collect()])
    tries = [(k, s) for k in (1, 3, 5, 9) for s in range(3)]
    here = stats._fits(data, 200, tries)
    monkeypatch.setattr(stats, "LOCAL_BYTES", 0)
    for (cost, c), (same, d), (k, _) in zip(here, stats._fits(data, 200, tries), tries, strict=True):
        gap = ((u[:, None] - c) ** 2).sum(2)
        assert c.shape == (k, 5) and np.allclose(c, d) and cost == pytest.approx(same) == pytest.approx(gap.min(1).sum())
        assert np.allclose(c, [u[gap.argmin(1) == j].mean(0) for j in range(k)], atol=0.05)
    best = min(cost for (cost, _), (k, _) in zip(here, tries, strict=True) if k == 5)
    assert best == pytest.approx(sum(((u[i::5] - u[i::5].mean(0)) ** 2).sum() for i in range(5)), rel=1e-3)
    few = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(12)], "key long, v array<double>")
    assert len(stats.clusters(few, (3, 4), 6, 5)) == 2
