import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from intervale.llm import components, flat, near_dedup, repeats
from intervale.llm.scratch import Scratch

rng = random.Random(4)


@pytest.mark.parametrize("gap", [" ", " \n\t  "])
def test_pieces_of_long_rows_have_the_same_shingles(gap):
    for n in (0, 1, 3, 4, 5, 6, 50, 400):
        text = gap + gap.join("".join(rng.choice("aBé") for _ in range(rng.choice([1, 4, 60]))) for _ in range(n)) + rng.choice(["", gap])
        row = np.frombuffer(text.encode(), np.uint8)
        whole = np.sort(flat.shingles(row, np.array([0, len(row)]))[0])
        for piece in (8, 64, 1000):
            assert (np.sort(np.concatenate([np.zeros(0, np.uint64), *flat.long_shingles(row, piece)])) == whole).all(), (n, piece)


def test_memory_of_a_long_text():
    """A 20 MB text through sets, anchors and sketches takes less than 700 MB more."""
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(50_000)]
    text = b" ".join(rng.choice(words) for _ in range(3_600_000)).decode()
    column = pa.array([text], pa.large_string())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = next(flat.shingle_sets(column))
    assert len(found) > 3_500_000 and len(near_dedup.sketch(found[:5000])) == near_dedup.BINS
    assert sum(len(p) for p, _, _ in repeats.long_anchors(np.frombuffer(text.encode(), np.uint8))) > 300_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB


def test_components_of_chains_stars_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (103, 102), (102, 103), (200, 201), (200, 201), (None, 5), (40, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {3: 3, **{i: 3 for i in range(10, 41)}, **{i: 100 for i in range(100, 120)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "d").count() == 0


def test_pipeline_stages_on_empty_tables_nulls_and_more_columns(spark, tmp_path):
    """Every stage but the last returns the columns of documents; nulls and repeated rows pass as the stage's docstring says."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = "zero one two three four five six seven"
    rows = [(1, said, "en", "s", 38, "x"), (1, said, "en", "s", 38, "x"), (2, None, None, None, None, "y"), (None, "", "en", "s", 0, "z"), (3, "plain words here", "en", "s", 16, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
        want = {"near-duplicates": [(False, 1), (False, 2), (False, 3), (True, 0)], "benchmark decontamination": [(False, 2), (False, 3), (True, 0)]}
        assert got == want.get(name, [(False, 1), (False, 1), (False, 2), (False, 3), (True, 0)]), name
    assert docs.where(F.col("text").isNull()).count() == 1
