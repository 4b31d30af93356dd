"""Command line: `python -m intervale generate ...` and `python -m intervale evaluate ...`."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from intervale.config import VARIANTS, Settings
from intervale.operators import evaluate, stats
from intervale.plans.generate import Corpus, generate
from intervale.sources import files, sinks


#: Most skipped videos that a report names.
NOTED = 1000
#: Flags of single settings.
FLAGS = {
    "--fps": ("candidates.fps", float),
    "--pool-min": ("candidates.pool_min", int),
    "--pool-max": ("candidates.pool_max", int),
    "--num-events": ("scores.num_events", int),
    "--max-iters": ("boundary.max_iters", int),
    "--epochs": ("boundary.epochs", int),
    "--lr": ("boundary.lr", float),
    "--delta": ("boundary.delta", int),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="intervale")
    commands = top.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate", help="pseudo-labels of a corpus of frame vectors, captions and text vectors")
    for name in ("manifest", "feats", "captions", "text", "out"):
        g.add_argument(f"--{name}", required=True)
    g.add_argument("--config", help="JSON or YAML settings")
    g.add_argument("--set", action="append", default=[], metavar="section.field=value")
    g.add_argument("--ablate", action="append", default=[], help="score dimensions to leave out, by commas; may be repeated")
    for flag, (name, kind) in FLAGS.items():
        g.add_argument(flag, type=kind, metavar=name, help=f"the same as --set {name}=...")
    g.add_argument("--dataset", choices=("activitynet", "charades"), help="layout of the labels")
    g.add_argument("--limit", type=int, help="only the manifest's first videos by id")
    g.add_argument("--quiet", action="store_true", help="print nothing")
    g.add_argument("--lenient", action="store_true", help="spans without a caption or text vector count as blank instead of raising")
    g.add_argument("--variant", choices=sorted(VARIANTS), default="full")
    e = commands.add_parser("evaluate", help="label file against a reference file")
    for name in ("pred", "ref", "out"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--manifest", help="the videos to compare; each must have a reference (without it, all references)")
    e.add_argument("--quiet", action="store_true", help="print nothing")
    return top


def settings_of(args: argparse.Namespace) -> Settings:
    """Defaults, then the file, then assignments, then ablations and the variant."""
    found = Settings.from_file(args.config) if args.config else Settings()
    flags = [f"{name}={value}" for flag, (name, _) in FLAGS.items() if (value := getattr(args, flag[2:].replace("-", "_"))) is not None]
    for assignment in [*flags, *([f"output.layout={args.dataset}"] if args.dataset else []), *args.set]:
        found = found.override(assignment)
    if args.ablate:
        found = replace(found, ablate_dimensions=tuple(x.strip() for part in args.ablate for x in part.split(",") if x.strip()))
    found = found.ablated()
    return found if args.variant == "full" else found.variant(args.variant)


def run_generate(spark: SparkSession, args: argparse.Namespace) -> dict:
    settings = settings_of(args)
    videos = files.manifest(spark, args.manifest)
    if args.limit is not None:
        videos = videos.orderBy("video_id").limit(args.limit)
    frames = files.frame_arrays(spark, args.feats).join(videos.select("video_id"), "video_id", "left_semi")
    text = files.frame_arrays(spark, args.text).withColumnRenamed("h", "q")
    out = generate(Corpus(frames, files.caption_lists(spark, args.captions), text, videos), settings, strict=not args.lenient)
    sized = videos.join(frames.groupBy("video_id").agg(F.count("*").alias("n_frames")), "video_id")
    fps, layout = settings.candidates.fps, settings.output.layout
    rows = (sinks.labels if layout == "activitynet" else sinks.line_rows)(out.selected, sized, fps)
    skipped = [r["video_id"] for r in videos.join(out.selected.select("video_id").distinct(), "video_id", "left_anti").orderBy("video_id").limit(NOTED).collect()]
    if skipped and args.variant != "full":
        raise ValueError(f"an experiment needs every video; without events: {skipped}")
    notes = [f"{v}: no usable frames or no candidates, skipped" for v in skipped]
    if settings.boundary.max_iters and not out.converged:
        notes.append(f"not converged within {settings.boundary.max_iters} rounds")
    report = {"notes": notes, "labels": sinks.write_labels(rows, layout, args.out), "converged": out.converged, "iteration": out.history, "config": settings.to_dict()}
    if settings.output.write_event_scores:
        a, b = sinks.seconds("s", "e", fps)
        kind = ["type_id"] if "type_id" in out.selected.columns else []
        numbers = [F.round(c, 6).alias(c) for c in ("sfs", "s_uniq", "s_density", "s_narr", "s_conf")]
        out.selected.select("video_id", "sel_rank", F.col("s").alias("start_frame"), F.col("e").alias("end_frame"), F.round(a, 3).alias("start_sec"), F.round(b, 3).alias("end_sec"), "caption", *kind, *numbers).orderBy("video_id", "sel_rank").write.mode("overwrite").json(os.path.join(args.out, "event_scores"))
    if settings.output.write_calibration_report and out.statistics is not None:
        s = out.statistics
        kinds = s.centroids.select(F.col("k_id").alias("type_id"))
        types = stats.type_report(out.selected, s.videos, kinds, settings.calibration.core_freq_quantile, settings.calibration.core_sfs_quantile)
        report["priors"] = [r.asDict() for r in s.priors.orderBy("category_id", "type_id").collect()]  # categories times types
        report["densities"] = [r.asDict() for r in s.means.orderBy("category_id").collect()]
        report["types"] = [r.asDict() for r in types.orderBy("category_id", "type_id").collect()]
        report["categories"] = [r.asDict() for r in stats.category_report(out.selected, s.videos).orderBy("category_id").collect()]
    sinks.write_json(report, os.path.join(args.out, "report.json"))
    return report


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Every video of the manifest, or of the references; those without predictions count as empty, predictions of other videos are left aside."""
    raw = {k: spark.read.text(path, wholetext=True) for k, path in (("pred", args.pred), ("ref", args.ref))}
    refs, preds = files.interval_entries(raw["ref"]), files.interval_entries(raw["pred"])
    videos = files.manifest(spark, args.manifest).select("video_id") if args.manifest else refs.select("video_id")
    missing = videos.join(refs, "video_id", "left_anti").orderBy("video_id").first()
    if missing is not None:
        raise ValueError(f"no reference of {missing['video_id']}")
    pred = files.interval_map(raw["pred"]).withColumn("event_id", F.monotonically_increasing_id()).join(videos, "video_id", "left_semi")
    ref = files.interval_map(raw["ref"], aligned=False).join(videos, "video_id", "left_semi")
    lengths = videos.join(refs.select("video_id", F.col("duration").alias("ref_duration")), "video_id").join(preds.select("video_id", F.col("duration").alias("own")), "video_id", "left")
    apart = evaluate.validated(pred, lengths.select("video_id", "ref_duration", F.coalesce("own", "ref_duration").alias("duration")))
    found = evaluate.matches(evaluate.pairs(pred, evaluate.merged_refs(ref)))
    rows = evaluate.with_matches(evaluate.per_video(pred, ref, videos), found).join(apart, "video_id")
    rows.write.mode("overwrite").json(os.path.join(args.out, "per_video"))
    summary = evaluate.micro(evaluate.summary(rows), found).first().asDict()
    summary["mean_best_iou_ci95"] = list(evaluate.interval_of_mean(rows, "mean_best_iou"))
    sinks.write_json(summary, os.path.join(args.out, "evaluation.json"))
    return summary


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("intervale").getOrCreate()
    result = {"generate": run_generate, "evaluate": run_evaluate}[args.command](spark, args)
    if not args.quiet:
        print(result)


if __name__ == "__main__":
    main()
