"""Robust multivariate outliers among documents' text statistics: minimum covariance determinant per language and source.

DataFrame functions only. Each document's statistics become a vector of fixed-point numbers; equal vectors of a (lang, source)
become one with its count. For each group the h = CORE_SHARE of the rows whose regularised covariance has the least determinant
are sought by concentration: from STARTS starts (the coordinatewise medians and quartiles, and sets of six vectors by hash) each step takes
the exactly h nearest rows by the estimate before; after FIRST_STEPS steps the BEST starts of least determinant go on until the
determinant falls no more, and the least of all is reweighted. Rows beyond a chi-square bound of that are rejected. Sums
are exact integers, so results don't hang on the order of rows.

The h-th distance is found by bins, and an order of the vectors of the one bin it falls in, so that no task sees more of a
group than that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervale.llm.scratch import Scratch
from intervale.llm.skew import counted_join

SPACE = "[\\x20\\x09-\\x0D]"
#: Coordinates, with the standard deviation that is added to each estimate's own (a regularised determinant: a constant
#: coordinate, as symbols in clean prose, would otherwise reject any other value).
FLOORS = {"log_words": 0.5, "word_length": 0.25, "log_symbols": 0.02, "log_dup_lines": 0.3, "repeats": 0.05}
#: Fixed point: 1 / SCALE. No coordinate counts for more than MOST, so that sums of products of 3e10 rows fit a long.
SCALE, MOST = 256, 64
CORE_SHARE = 0.75
#: Starts of each group, steps of all of them, and how many of them go on.
STARTS, FIRST_STEPS, BEST = 8, 2, 3
#: A determinant falls if its logarithm does by more.
FALLS = 1e-9
#: Groups with fewer rows are judged by all rows of their language, and where these are too few by all of the corpus.
LEAST_ROWS = 50
#: With five degrees of freedom: chi-square quantiles 0.975 (reweighting) and 1 - 1e-6 (rejection), and the factors that
#: make the covariance of the nearest 0.75 and of the rows under the 0.975 quantile consistent for normal data.
NEAR, FAR = 12.8325, 35.8882
CORE_FACTOR, NEAR_FACTOR = 1.41, 1.055
#: Groups up to which estimates (about 250 bytes each) are broadcast.
SENT_GROUPS = 20_000
_X = [f"x{i}" for i in range(len(FLOORS))]
_PAIRS = [(i, j) for i in range(len(FLOORS)) for j in range(i + 1)]
_BIN = 64  # bins of squared distance for each factor e
_SUMS = ["n", *(f"s{i}" for i in range(len(FLOORS))), *(f"p{i}{j}" for i, j in _PAIRS)]


def _window_key(i: str) -> str:
    return f"xxhash64(get(_w, {i}), get(_w, {i} + 1), get(_w, {i} + 2))"


def _with_repeats(rows: DataFrame) -> DataFrame:
    """`rows` with n_repeat_words: words of `_w` in three-word windows that occur twice or more.

    Window hashes with their index in the low bits are sorted as plain longs. Entries whose high bits a neighbour shares are
    compared by their full hashes, two places either way. Each repeated window covers three words, less what it overlaps.
    """
    place = lambda x: f"cast({x} & _low as int)"
    alike = lambda a, d: f"shiftright(get({a}, k + {d}) ^ x, _bits) = 0"
    same = " or ".join(f"({alike('_met', d)} and {_window_key(place(f'get(_met, k + {d})'))} = {_window_key(place('x'))})" for d in (-1, 1, -2, 2))
    covered = "aggregate(_again, named_struct('n', 0L, 'end', 0), (a, x) -> named_struct('n', a.n + cast(x + 3 - greatest(a.end, x) as bigint), 'end', x + 3), a -> a.n)"
    steps = {
        "_bits": "length(bin(size(_w)))",
        "_low": "shiftleft(1L, _bits) - 1",
        "_keys": f"case when size(_w) < 4 then array() else sort_array(transform(sequence(0, size(_w) - 3), i -> shiftleft(shiftright({_window_key('i')}, _bits), _bits) | i)) end",
        "_met": f"filter(_keys, (x, k) -> {alike('_keys', -1)} or {alike('_keys', 1)})",
        "_again": f"sort_array(transform(filter(_met, (x, k) -> {same}), x -> {place('x')}))",
        "n_repeat_words": covered,
    }
    for name, how in steps.items():
        rows = rows.withColumn(name, F.expr(how))
    return rows


def base_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    extra = [c for c in keep or [] if c not in ("doc_id", "lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *extra, text.alias("_t"))
    rows = rows.withColumn("_w", F.filter(F.split("_t", f"{SPACE}+"), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = _with_repeats(rows.withColumn("_l", lines))
    out = rows.select(
        "doc_id", "lang", "source", *extra,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """`stats` with the coordinates x0.. as whole numbers of 1 / SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = [F.log1p("n_words"), F.col("word_chars") / n, F.log1p(F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.col("n_repeat_words") / n]
    return stats.select("*", *(F.round(F.least(v, F.lit(float(MOST))) * SCALE).cast("long").alias(x) for v, x in zip(values, _X, strict=True)))


def _pooled(rows: DataFrame) -> DataFrame:
    """`rows` with `grp`, whose estimate judges the row: its language and source, its language or the corpus by base-passing rows;
    and `into`, the groups whose estimates it enters."""
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    lang = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    keyed = rows.withColumn("_own", own).withColumn("_lang", lang)
    counts = keyed.where("not base_failed").groupBy("_own", "_lang").count()
    langs = counts.groupBy("_lang").agg(F.sum("count").alias("spoken"), F.min("count").alias("least"))
    rare = langs.agg((F.min("spoken") < LEAST_ROWS).alias("rare"))  # one row
    large, common = F.col("count") >= LEAST_ROWS, F.col("spoken") >= LEAST_ROWS
    into = F.array_compact(F.array(F.when(large, F.col("_own")), F.when(common & (F.col("least") < LEAST_ROWS), F.col("_lang")), F.when(F.col("rare"), F.lit("all"))))
    plan = counts.join(langs, "_lang").join(F.broadcast(rare)).select(F.col("_own").alias("o"), F.when(large, F.col("_own")).when(common, F.col("_lang")).otherwise(F.lit("all")).alias("grp"), into.alias("into"))
    return keyed.join(plan, F.col("_own") == F.col("o"), "left").drop("o", "_own", "_lang").withColumn("grp", F.coalesce("grp", F.lit("none")))


def _judged(points: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """`points` beside their group's estimates (with n, its rows): by broadcast up to SENT_GROUPS, else by a join that leaves large groups where they are."""
    return points.join(F.broadcast(estimates), "grp") if groups <= SENT_GROUPS else counted_join(points, estimates, ["grp"], "n")


def _settled(table: DataFrame, groups: int, scratch: Scratch, name: str) -> DataFrame:
    """`table` (a row a group) computed once: on the driver up to SENT_GROUPS rows, as a local relation that further plans begin with, else in the shared folder."""
    if groups <= SENT_GROUPS:
        return table.sparkSession.createDataFrame(table.toArrow(), table.schema)
    return scratch.table(table, name)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. by means m0.. and the inverse k00.. of the covariance's Cholesky factor."""
    off = [F.col(x) / SCALE - F.col(f"m{i}") for i, x in enumerate(_X)]
    forms = [sum((F.col(f"k{i}{j}") * off[j] for j in range(1, i + 1)), F.col(f"k{i}0") * off[0]) for i in range(len(_X))]
    return sum((c * c for c in forms[1:]), forms[0] * forms[0])


def _sums() -> list[Column]:
    """Exact sums over vectors with counts w: rows, coordinates, products."""
    x = [F.col(c) for c in _X]
    return [F.sum("w").alias("n"), *(F.sum(F.col("w") * a).alias(f"s{i}") for i, a in enumerate(x)), *(F.sum(F.col("w") * x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS)]


def _estimate(sums: DataFrame, factor: float, keep: tuple[str, ...]) -> DataFrame:
    """`keep`, means, inverse Cholesky factor of factor * covariance + floors, and the logarithm of the determinant of these."""
    n = F.col("n").cast("double")
    d = lambda c: F.col(c).cast("double")
    row = lambda i: F.shiftright(i * (i + 1), 1)  # where a triangle's row begins
    floors = [F.lit(v**2) for v in FLOORS.values()]
    entries = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _PAIRS))
    none = F.array().cast("array<double>")

    def factor_entry(l: Column, at: Column) -> Column:  # noqa: E741
        i, j = at.i, at.j
        before = F.zip_with(F.slice(l, row(i) + 1, j), F.slice(l, row(j) + 1, j), lambda a, b: a * b)
        value = F.aggregate(before, F.get("c", row(i) + j), lambda v, x: v - x)
        # the floors keep every pivot positive; the guard is for rounding
        return F.array_append(l, F.when(i == j, F.sqrt(F.greatest(value, F.get("f", i) / 4))).otherwise(value / F.get(l, row(j) + j)))

    def inverse_entry(k: Column, at: Column) -> Column:
        i, j = at.i, at.j
        above = F.transform(F.slice("l", row(i) + j + 1, i - j), lambda a, t: a * F.get(k, row(j + t) + j))
        pivot = F.get("l", row(i) + i)
        return F.array_append(k, F.when(i == j, 1 / pivot).otherwise(-F.aggregate(above, F.lit(0.0), lambda v, x: v + x) / pivot))

    # triangles as arrays, a row after the other: an expression for each entry would make plans that fill the driver
    out = sums.select(*keep, F.array(*(d(f"s{i}") / n / SCALE for i in range(len(_X)))).alias("m"), F.array(*(d(f"p{i}{j}") / n / SCALE**2 for i, j in _PAIRS)).alias("q"), F.array(*floors).alias("f"))
    spread = F.transform(entries, lambda at, e: factor * (F.get("q", e) - F.get("m", at.i) * F.get("m", at.j)))
    out = out.withColumn("c", F.zip_with(entries, spread, lambda at, v: F.when(at.i == at.j, F.greatest(v, F.lit(0.0)) + F.get("f", at.i)).otherwise(v)))
    out = out.withColumn("l", F.aggregate(entries, none, factor_entry))
    out = out.withColumn("k", F.aggregate(entries, none, inverse_entry))
    pivots = F.transform(F.array(*(F.lit(_PAIRS.index((i, i))) for i in range(len(_X)))), lambda e: 2 * F.log(F.get("l", e)))
    det = F.aggregate(pivots, F.lit(0.0), lambda v, x: v + x)
    return out.select(*keep, *(F.col("m")[i].alias(f"m{i}") for i in range(len(_X))), *(F.col("k")[e].alias(f"k{i}{j}") for e, (i, j) in enumerate(_PAIRS)), det.alias("det"))


_NAMES = [*(f"m{i}" for i in range(len(FLOORS))), *(f"k{i}{j}" for i, j in _PAIRS)]


def _starts(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, total, h, start and estimate of every start; no determinant yet."""
    floors = list(FLOORS.values())
    # a map of a coordinate's distinct values, of which there are at most MOST * SCALE + 1
    middle = points.groupBy("grp").agg(*(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("w")).alias(x) for x in _X))
    spread = lambda i, x: F.sqrt(((F.col(x)[2] - F.col(x)[0]) / (1.349 * SCALE)) ** 2 + floors[i] ** 2)
    plain = middle.select("grp", F.lit(0).alias("start"), *((F.col(x)[1] / SCALE).alias(f"m{i}") for i, x in enumerate(_X)), *((1 / spread(i, _X[i]) if i == j else F.lit(0.0)).alias(f"k{i}{j}") for i, j in _PAIRS), F.lit(float("inf")).alias("det"))
    few, vector = len(_X) + 1, F.struct(*_X)
    chosen = points.groupBy("grp").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), *_X).alias("k"), vector.alias("x"))).alias(f"c{k}") for k in range(few * (STARTS - 1))))
    each = F.array(*(F.struct(F.lit(s + 1).alias("start"), F.col(f"c{few * s + k}.x").alias("x")) for s in range(STARTS - 1) for k in range(few)))
    drawn = chosen.select("grp", F.explode(each).alias("e")).select("grp", "e.start", "e.x.*").withColumn("w", F.lit(1).cast("long"))
    elemental = _estimate(drawn.groupBy("grp", "start").agg(*_sums()), 1.0, ("grp", "start")).withColumn("det", F.lit(float("inf")))
    return sizes.join(plain.unionByName(elemental), "grp")


def _concentrated(points: DataFrame, now: DataFrame, groups: int, scratch: Scratch, name: str) -> DataFrame:
    """The estimates from exactly the h nearest rows by those of `now`, and `ended`: the determinant fell no more."""
    key, kept = ["grp", "start"], ["total", "h", "old"]
    near = _judged(points, now.withColumnRenamed("det", "old").withColumn("n", F.col("total")), groups).select(*key, *kept, *_X, "w", _distance().alias("d"))
    binned = near.withColumn("bin", F.floor(F.log(F.col("d") + 1e-9) * _BIN).cast("int"))
    inside = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = binned.groupBy(*key, *kept, "bin").agg(*_sums()).select("*", *(F.sum(c).over(inside).alias(f"u{c}") for c in _SUMS))
    before = [f"b{c}" for c in _SUMS]  # sums of all bins before the one in which the h-th row falls
    crossing = upto.where("un >= h and un - n < h").select(*(F.col(k).alias(f"_{k}") for k in (*key, "bin")), *((F.col(f"u{c}") - F.col(c)).alias(f"b{c}") for c in _SUMS))
    here = binned.join(F.broadcast(crossing) if groups <= SENT_GROUPS else crossing, F.expr("grp = _grp and start = _start and bin = _bin"))
    nearest = Window.partitionBy(*key).orderBy("d", *_X).rowsBetween(Window.unboundedPreceding, 0)
    taken = here.withColumn("upto", F.sum("w").over(nearest))
    partly = taken.withColumn("w", F.least(F.col("w"), F.col("h") - F.col("bn") - (F.col("upto") - F.col("w")))).where("w > 0")
    core = partly.groupBy(*key, *kept, *before).agg(*_sums()).select(*key, *kept, *((F.col(c) + F.col(f"b{c}")).alias(c) for c in _SUMS))
    moved = _estimate(core, CORE_FACTOR, (*key, *kept))
    return _settled(moved.withColumn("ended", ~(F.col("det") < F.col("old") - FALLS)).drop("old"), groups * STARTS, scratch, name)


def _least(estimates: DataFrame, most: int) -> DataFrame:
    """Of each group the `most` estimates of least determinant (ties: the earlier start)."""
    return estimates.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))).where(F.col("_r") <= most).drop("_r")


def least_determinants(points: DataFrame, scratch: Scratch, starts: int = STARTS) -> tuple[DataFrame, int]:
    """The estimates (not yet reweighted) on which the BEST starts of every group end, and the number of groups.

    `points`: grp, x0.., w.
    """
    sizes = points.groupBy("grp").agg(F.sum("w").alias("total")).withColumn("h", F.ceil(CORE_SHARE * F.col("total")))
    groups = sizes.count()
    now = _settled(_starts(points, sizes).where(F.col("start") < starts), groups * STARTS, scratch, "starts")
    for step in range(FIRST_STEPS):
        now = _concentrated(points, now.withColumn("det", F.lit(float("inf"))), groups, scratch, f"step{step}").drop("ended")
    now, step = _settled(_least(now, BEST), groups * BEST, scratch, "best"), FIRST_STEPS
    trail = [now.withColumn("step", F.lit(step))]
    while not now.isEmpty():
        now = _concentrated(points, now, groups, scratch, f"step{step}").where("not ended").drop("ended")
        step += 1
        trail.append(now.withColumn("step", F.lit(step)))
    # the last estimate of each start whose determinant fell; no joins of all steps' tables
    rest = [c for c in now.columns if c not in ("grp", "start")]
    last = F.max_by(F.struct(*rest), "step").alias("last")
    return reduce(DataFrame.unionByName, trail).groupBy("grp", "start").agg(last).select("grp", "start", "last.*"), groups


def robust_estimates(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """grp and the reweighted minimum-covariance-determinant estimate of every group of `rows` (grp, x0..), and the number of groups."""
    points = scratch.table(rows.groupBy("grp", *_X).agg(F.count("*").alias("w")), "points")
    ended, groups = least_determinants(points, scratch)
    best = _settled(_least(ended, 1), groups, scratch, "least")
    near = _judged(points, best.withColumnRenamed("total", "n"), groups).where(_distance() <= NEAR).groupBy("grp").agg(*_sums())
    return _settled(_estimate(near, NEAR_FACTOR, ("grp", "n")), groups, scratch, "estimate"), groups


def quality_rules(docs: DataFrame, far: float = FAR) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (squared, null without an estimate) and kept of every row.

    Null texts have no words. Null lang and source are groups like others. Estimates come from the rows that pass the
    base rules; null and repeated doc_ids pass through, a row each; an empty table gives no rows; other
    columns are left aside.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    rows = scratch.table(vectors(base_statistics(docs)), "statistics")
    rows = scratch.table(_pooled(rows), "rows")
    estimates, groups = robust_estimates(rows.where("not base_failed").select(F.explode("into").alias("grp"), *_X), scratch)
    # rows without an estimate: none of their group's passes the base rules
    judged = rows.join(F.broadcast(estimates) if groups <= SENT_GROUPS else estimates, "grp", "left").withColumn("distance", _distance())
    kept = (~F.col("base_failed")) & F.coalesce(F.col("distance") <= far, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: quality rules on `documents`."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
