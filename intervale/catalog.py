"""Every query of the engine's own operators over the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale import testbed as T
from intervale.config import Boundary, Candidates, Scores, Settings
from intervale.functions import text, vectors
from intervale.functions.vectors import rounded as r
from intervale.operators import boundaries, evaluate, network, pool, refine, stats
from intervale.plans import generate as plan
from intervale.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = Candidates()

#: CTEs of the SQL side, each on those before it.
CHAIN = {
    "frames": "SELECT concat('v', vec_id // 50) AS video_id, cast(vec_id % 50 AS INT) AS t, embedding::DOUBLE[] AS h FROM embeddings",
    "videos": "SELECT concat('v', vec_id // 50) AS video_id, concat('cat', label) AS category, 50.0::DOUBLE / 3 AS duration, cast(label % 3 AS INT) AS category_id FROM embeddings WHERE vec_id % 50 = 0",
    "caps": "SELECT concat('v', vec_id // 50) AS video_id, cast(vec_id % 50 AS INT) AS t, trim(replace(text, chr(10), ' ')) AS caption FROM embeddings JOIN documents ON doc_id = vec_id % (SELECT count(*) FROM documents)",
    "txt": "SELECT video_id, cast((t + 49) % 50 AS INT) AS t, h AS q FROM frames",
    "typ": "SELECT concat('v', vec_id // 50) AS video_id, cast(vec_id % 50 AS INT) AS t, cast(label % 4 AS INT) AS type_id FROM embeddings",
    "prob": "SELECT concat('v', vec_id // 50) AS video_id, cast(vec_id % 50 AS INT) AS t, ((vec_id * 37) % 101)::DOUBLE / 101 AS b FROM embeddings",
    "dist": "SELECT video_id, t, 1 - greatest(-1, least(1, list_dot_product(h, h2) / ((sqrt(list_dot_product(h, h)) + 1e-8) * (sqrt(list_dot_product(h2, h2)) + 1e-8)))) AS d FROM (SELECT *, lead(h) OVER (PARTITION BY video_id ORDER BY t) AS h2 FROM frames) WHERE h2 IS NOT NULL",
    "smooth": "SELECT video_id, t, (coalesce(lag(d) OVER w, d) + d + coalesce(lead(d) OVER w, d)) / 3 AS m FROM dist WINDOW w AS (PARTITION BY video_id ORDER BY t)",
    "near": "SELECT *, lag(m) OVER w AS p, lead(m) OVER w AS f, count(*) OVER v AS points, avg(m) OVER v AS mu, stddev_pop(m) OVER v AS sigma FROM smooth WINDOW w AS (PARTITION BY video_id ORDER BY t), v AS (PARTITION BY video_id)",
    "peaks": "SELECT video_id, o, t, m FROM near, (VALUES (0, 0.8), (1, 0.4), (2, 0.2)) k(o, k) WHERE points >= 3 AND sigma >= 1e-9 AND m > p AND m >= f AND m > mu + k * sigma",
    "kept": "SELECT video_id, o, list_sort(list_reduce(list_transform(l, lambda x: [x]), lambda a, y: CASE WHEN len(list_filter(a, lambda q: abs(q - y[1]) < 6)) > 0 THEN a ELSE list_concat(a, y) END)) AS kept FROM (SELECT video_id, o, list(t ORDER BY m DESC, t DESC) AS l FROM peaks GROUP BY ALL)",
    "bounds": "SELECT n.video_id, n.o, n.n_frames, list_sort(list_distinct(list_concat([0, n.n_frames - 1], coalesce(kept, [])))) AS b FROM (SELECT video_id, cast(count(*) AS INT) AS n_frames, unnest([0, 1, 2]) AS o FROM frames GROUP BY video_id) n LEFT JOIN kept k ON k.video_id = n.video_id AND k.o = n.o",
    "tried": "SELECT video_id, o, n_frames, s, e FROM (SELECT *, unnest(b) AS s FROM bounds) x, unnest(x.b) AS y(e) WHERE e - s + 1 >= 6",
    "chosen": "SELECT video_id, coalesce(min(o) FILTER (n >= 20), 2) AS o FROM (SELECT video_id, o, count(*) AS n FROM tried GROUP BY ALL) GROUP BY video_id",
    "spans": "SELECT video_id, n_frames, s, e, o FROM tried JOIN chosen USING (video_id, o)",
    "sized": "SELECT video_id, n_frames, s, e, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY s, e) - 1 AS ord FROM spans",
    "grid": "SELECT video_id, n_frames, n, list_distinct(list_transform(range(12), lambda i: cast(round_even(i * (n_frames - 1) / 11.0, 0) AS INT))) AS g0 FROM (SELECT DISTINCT video_id, n_frames, n FROM sized WHERE n < 20)",
    "free": "SELECT video_id, n_frames, n, s, e FROM (SELECT *, unnest(list_sort(g0)) AS s FROM grid) x, unnest(x.g0) AS y(e) WHERE e - s + 1 >= 6 AND NOT EXISTS (SELECT 1 FROM sized z WHERE z.video_id = x.video_id AND z.s = x.s AND z.e = y.e)",
    "pad": "SELECT video_id, n_frames, s, e, n + row_number() OVER (PARTITION BY video_id ORDER BY s, e) - 1 AS ord FROM free QUALIFY ord < 20",
    "cand": "SELECT video_id, n_frames, s, e, ord FROM sized UNION ALL SELECT video_id, n_frames, s, e, ord FROM pad",
    "means": "SELECT video_id, s, e, list(a ORDER BY i) AS fbar FROM (SELECT b.video_id, b.s, b.e, i, avg(h[i]) AS a FROM cand b JOIN frames f ON f.video_id = b.video_id AND f.t BETWEEN b.s AND b.e, range(1, 65) d(i) GROUP BY ALL) GROUP BY ALL",
    "sq": "SELECT b.video_id, b.s, b.e, avg(list_dot_product(h, h)) AS q2 FROM cand b JOIN frames f ON f.video_id = b.video_id AND f.t BETWEEN b.s AND b.e GROUP BY ALL",
    "stat": "SELECT video_id, s, e, n_frames, ord, fbar, greatest(q2 - list_dot_product(fbar, fbar), 0) AS var, (s + e) // 2 AS mid FROM cand JOIN means USING (video_id, s, e) JOIN sq USING (video_id, s, e)",
    "pool": "SELECT *, ord AS uid, row_number() OVER (PARTITION BY video_id ORDER BY s, ord) - 1 AS pool_ord FROM stat",
    "uniq": "SELECT a.video_id, a.uid, 1 - least(1, greatest(0, coalesce(max(greatest(-1, least(1, list_dot_product(a.fbar, b.fbar) / ((sqrt(list_dot_product(a.fbar, a.fbar)) + 1e-8) * (sqrt(list_dot_product(b.fbar, b.fbar)) + 1e-8)))) * CASE WHEN abs(a.mid - b.mid) / a.n_frames < 0.05 THEN 1 WHEN abs(a.mid - b.mid) / a.n_frames <= 0.25 THEN 1.175 - 3.5 * abs(a.mid - b.mid) / a.n_frames ELSE 0.3 END), 0))) AS s_uniq FROM pool a LEFT JOIN pool b ON a.video_id = b.video_id AND a.uid <> b.uid GROUP BY ALL",
    "conf": "SELECT p.video_id, p.uid, coalesce(avg(c) FILTER (f.t BETWEEN p.s AND p.e) - avg(c) FILTER (f.t NOT BETWEEN p.s AND p.e), 0) AS s_conf FROM pool p JOIN txt x ON x.video_id = p.video_id AND x.t = p.mid JOIN frames f ON f.video_id = p.video_id, LATERAL (SELECT list_dot_product(f.h, x.q) / ((sqrt(list_dot_product(f.h, f.h)) + 1e-8) * (sqrt(list_dot_product(x.q, x.q)) + 1e-8)) AS c) GROUP BY ALL",
    "raw": "SELECT *, var / greatest((e - s) / 3.0, 1e-9) AS s_density, 1 - abs(mid / n_frames - 0.5) AS s_narr FROM pool JOIN uniq USING (video_id, uid) JOIN conf USING (video_id, uid)",
    "scored": "SELECT *, (mm_u + mm_d + mm_n + mm_c) * 0.25 AS sfs FROM (SELECT *, " + ", ".join(f"CASE WHEN max({c}) OVER v - min({c}) OVER v < 1e-8 THEN 0 ELSE ({c} - min({c}) OVER v) / (max({c}) OVER v - min({c}) OVER v) END AS mm_{k}" for k, c in (("u", "s_uniq"), ("d", "s_density"), ("n", "s_narr"), ("c", "s_conf"))) + " FROM raw WINDOW v AS (PARTITION BY video_id))",
    "greedy": "SELECT video_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, y: CASE WHEN len(a) >= 10 OR len(list_filter(a, lambda q: greatest(0, least(q.e, y[1].e) - greatest(q.s, y[1].s) + 1) / greatest(greatest(q.e, y[1].e) - least(q.s, y[1].s) + 1, 1) > 0.5)) > 0 THEN a ELSE list_concat(a, y) END) AS c FROM (SELECT video_id, list({'uid': uid, 's': s, 'e': e, 'sfs': sfs, 'mid': mid, 'n': n_frames, 'dens': s_density} ORDER BY round(sfs, 12) DESC, pool_ord) AS l FROM scored GROUP BY video_id)",
    "sel": "SELECT video_id, i - 1 AS sel_rank, c[i].uid AS uid, c[i].s AS s, c[i].e AS e, c[i].sfs AS sfs, c[i].mid AS mid, c[i].n AS n_frames, c[i].dens AS s_density FROM greedy, range(1, 11) r(i) WHERE i <= len(c)",
    "moved": "SELECT *, least(a, z) AS new_s, greatest(a, z) AS new_e FROM (SELECT p.video_id, p.uid, p.s, p.e, (SELECT arg_max(t, (b, -t)) FROM prob f WHERE f.video_id = p.video_id AND f.t BETWEEN p.s - 4 AND p.s + 4) AS a, (SELECT arg_max(t, (b, -t)) FROM prob f WHERE f.video_id = p.video_id AND f.t BETWEEN p.e - 4 AND p.e + 4) AS z FROM pool p)",
    "seltyp": "SELECT sel.*, type_id, category_id FROM sel JOIN typ ON typ.video_id = sel.video_id AND typ.t = sel.mid JOIN videos ON videos.video_id = sel.video_id",
    "ivl": "SELECT concat('u', user_id) AS video_id, event_id, epoch(ts)::DOUBLE AS start, epoch(ts)::DOUBLE + value * 3600 AS end_, concat(event_type, ' ', trim(replace(text, chr(10), ' '))) AS sentence FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)",
    "pred": "SELECT * FROM ivl WHERE event_id % 2 = 0",
    "ref": "SELECT video_id, start, end_, list_sort(list(sentence)) AS sentences FROM ivl WHERE event_id % 2 = 1 GROUP BY ALL",
    "pairs": "SELECT p.video_id, p.event_id, p.sentence AS p_sentence, r.start AS r_start, r.end_ AS r_end, r.sentences, x / greatest((p.end_ - p.start) + (r.end_ - r.start) - x, 1e-12) AS iou FROM pred p JOIN ref r ON p.video_id = r.video_id, LATERAL (SELECT greatest(0, least(p.end_, r.end_) - greatest(p.start, r.start)) AS x) WHERE x > 0",
    "best": "SELECT r.video_id, r.start, r.end_, coalesce(max(iou), 0) AS best FROM ref r LEFT JOIN pairs p ON p.video_id = r.video_id AND p.r_start = r.start AND p.r_end = r.end_ GROUP BY ALL",
}


def sql(body: str) -> str:
    """`body` after the CTEs it needs."""
    import re

    need, todo = set(), [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop())) & set(CHAIN) - need
        need |= words
        todo += [CHAIN[w] for w in words]
    ctes = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in CHAIN.items() if k in need)
    return f"WITH {ctes}\n{body}" if ctes else body


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


R = lambda x, a=None: f"round({x}, 6) + 0.0 AS {a or x}"


def _pool(s: SparkSession, d: str) -> DataFrame:
    return pool.candidates(T.frames(s, d), C)


def _scored(s: SparkSession, d: str) -> DataFrame:
    return pool.scored(_pool(s, d), T.frames(s, d), T.text_feats(s, d), C)


def _selected(s: SparkSession, d: str) -> DataFrame:
    """Selection with n_frames, mid, s_density and sfs rounded for ties."""
    scored = _scored(s, d).withColumn("sfs", F.round("sfs", 12))
    return pool.greedy(scored).join(scored.select("video_id", "uid", "mid", "n_frames", "s_density"), ["video_id", "uid"])


def _typed(s: SparkSession, d: str) -> DataFrame:
    return _selected(s, d).join(T.types(s, d).withColumnRenamed("t", "mid"), ["video_id", "mid"])


@query("pseudo_labels_l0", f"SELECT video_id, cast(sel_rank AS INT) AS sel_rank, {R('s / 3.0', 'start')}, {R('(e + 1) / 3.0', 'end_')}, caption, {R('sfs')} FROM sel JOIN caps ON caps.video_id = sel.video_id AND caps.t = sel.mid".replace("SELECT video_id", "SELECT sel.video_id"))
def pseudo_labels(s, d):
    a, b = sinks.seconds("s", "e", 3.0)
    return _selected(s, d).join(T.captions(s, d).withColumnRenamed("t", "mid"), ["video_id", "mid"]).select("video_id", "sel_rank", r(a).alias("start"), r(b).alias("end_"), "caption", r(F.col("sfs")).alias("sfs"))


query("frame_distance", f"SELECT video_id, t, {R('d')} FROM dist")(lambda s, d: boundaries.frame_distance(T.frames(s, d)).withColumn("d", r(F.col("d"))))
query("moving_avg_edge", f"SELECT video_id, t, {R('m')} FROM smooth")(lambda s, d: boundaries.moving_average(boundaries.frame_distance(T.frames(s, d)), 3).withColumn("m", r(F.col("m"))))


def _smooth(s, d):
    return boundaries.moving_average(boundaries.frame_distance(T.frames(s, d)), 3)


query("peak_threshold", f"SELECT DISTINCT video_id, points, {R('mu')}, {R('sigma')} FROM near")(lambda s, d: boundaries.with_threshold(_smooth(s, d)).groupBy("video_id").agg(F.max("points").alias("points"), r(F.max("mu")).alias("mu"), r(F.max("sigma")).alias("sigma")))
query("local_peaks", f"SELECT video_id, t, {R('m')} FROM peaks WHERE o = 0")(lambda s, d: boundaries.local_peaks(_smooth(s, d), 0.8).withColumn("m", r(F.col("m"))))
query("nms_peaks", "SELECT video_id, unnest(kept) AS t FROM kept WHERE o = 0")(lambda s, d: boundaries.suppressed(boundaries.local_peaks(_smooth(s, d), 0.8), 6).select("video_id", F.explode("kept").alias("t")))
query("peak_relax", "SELECT video_id, cast(o AS INT) AS factor_ord, count(*) AS n_spans FROM spans GROUP BY ALL")(lambda s, d: boundaries.relaxed_spans(T.frames(s, d), C).groupBy("video_id", "factor_ord").agg(F.count("*").alias("n_spans")))
query("sentinel_union", "SELECT video_id, unnest(b) AS b FROM bounds WHERE o = 0")(lambda s, d: boundaries.lengths(T.frames(s, d)).join(boundaries.suppressed(boundaries.local_peaks(_smooth(s, d), 0.8), 6), "video_id", "left").select("video_id", F.explode(F.array_union(F.coalesce("kept", F.array().cast("array<int>")), F.array(F.lit(0), F.col("n_frames") - 1))).alias("b")))
query("pairwise_spans", "SELECT video_id, s, e FROM spans")(lambda s, d: boundaries.relaxed_spans(T.frames(s, d), C).select("video_id", "s", "e"))
query("segment_stats", f"SELECT video_id, s, e, cast(mid AS INT) AS mid, {R('var')}, {R('fbar[1]', 'f1')}, {R('fbar[64]', 'f64')} FROM stat SEMI JOIN spans USING (video_id, s, e)")(lambda s, d: pool.segment_stats(boundaries.relaxed_spans(T.frames(s, d), C).select("video_id", "s", "e"), T.frames(s, d)).select("video_id", "s", "e", "mid", r(F.col("var")).alias("var"), r(F.col("fbar")[0]).alias("f1"), r(F.col("fbar")[63]).alias("f64")))
query("pool_pad", "SELECT video_id, s, e, cast(ord AS INT) AS ord FROM pad")(lambda s, d: pool.padding(boundaries.relaxed_spans(T.frames(s, d), C).select("video_id", "n_frames", "s", "e"), C).select("video_id", "s", "e", "ord"))
query("pool", "SELECT video_id, cast(uid AS INT) AS uid, cast(pool_ord AS INT) AS pool_ord, s, e, cast(mid AS INT) AS mid FROM pool")(lambda s, d: _pool(s, d).select("video_id", "uid", "pool_ord", "s", "e", "mid"))
query("s_uniq", f"SELECT video_id, cast(uid AS INT) AS uid, {R('s_uniq')} FROM uniq")(lambda s, d: pool.uniqueness(_pool(s, d)).withColumn("s_uniq", r(F.col("s_uniq"))))
query("s_conf", f"SELECT video_id, cast(uid AS INT) AS uid, {R('s_conf')} FROM conf")(lambda s, d: pool.alignment(_pool(s, d), T.frames(s, d), T.text_feats(s, d)).withColumn("s_conf", r(F.col("s_conf"))))
query("s_density", f"SELECT video_id, cast(uid AS INT) AS uid, {R('var / greatest((e - s) / 3.0, 1e-9)', 's_density')}, {R('var / greatest((e - s + 1) / 3.0, 1e-9)', 's_density_closed')} FROM pool")(
    lambda s, d: _pool(s, d).select("video_id", "uid", r(pool.density(C, Scores())).alias("s_density"), r(pool.density(C, Scores(density_closed_span=True))).alias("s_density_closed"))
)
query("sfs_score", f"SELECT video_id, cast(uid AS INT) AS uid, {R('s_density')}, {R('s_narr')}, {R('sfs')} FROM scored")(lambda s, d: _scored(s, d).select("video_id", "uid", *(r(F.col(c)).alias(c) for c in ("s_density", "s_narr", "sfs"))))
query("minmax_norm", f"SELECT video_id, cast(uid AS INT) AS uid, {R('mm_u')}, {R('mm_c')} FROM scored")(lambda s, d: _scored(s, d).select("video_id", "uid", r(F.col("s_uniq_n")).alias("mm_u"), r(F.col("s_conf_n")).alias("mm_c")))
query("greedy_select", f"SELECT video_id, cast(sel_rank AS INT) AS sel_rank, cast(uid AS INT) AS uid, s, e, {R('sfs')} FROM sel")(lambda s, d: pool.greedy(_scored(s, d).withColumn("sfs", F.round("sfs", 12))).withColumn("sfs", r(F.col("sfs"))))
query("pool_trim", "SELECT video_id, t FROM dist QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(d, 9) DESC, t) <= 20")(lambda s, d: pool.trimmed(boundaries.frame_distance(T.frames(s, d)).select("video_id", F.col("t").alias("s"), F.col("t").alias("e"), F.round("d", 9).alias("var")), Candidates(pool_max=20)).select("video_id", F.col("s").alias("t")))
query("video_mean", f"SELECT video_id, i AS dim, {R('avg(h[i])', 'mean')} FROM frames, range(1, 65) x(i) GROUP BY ALL")(lambda s, d: T.frames(s, d).select("video_id", F.posexplode("h").alias("i", "x")).groupBy("video_id", (F.col("i") + 1).cast("long").alias("dim")).agg(r(F.avg(F.col("x").cast("double"))).alias("mean")))
query("min_frames", "SELECT video_id, count(*) AS n_frames FROM frames GROUP BY ALL HAVING count(*) >= 8")(lambda s, d: T.frames(s, d).groupBy("video_id").agg(F.count("*").alias("n_frames")).where("n_frames >= 8"))
query("finite_check", "SELECT count(*) AS bad FROM frames WHERE len(list_filter(h, lambda x: isnan(x) OR isinf(x))) > 0")(lambda s, d: T.frames(s, d).agg(F.count_if(~F.forall("h", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("bad")))
query("duration_default", f"SELECT o_orderkey AS id, {R('coalesce(nullif(o_totalprice * (o_orderkey % 2), 0), 50 / 3.0)', 'duration')} FROM orders")(lambda s, d: T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), r(F.coalesce(F.nullif(F.col("o_totalprice") * (F.col("o_orderkey") % 2), F.lit(0.0)), F.lit(50) / 3.0)).alias("duration")))
query("l2_normalize", f"SELECT video_id, t, {R('h[1] / (sqrt(list_dot_product(h, h)) + 1e-8)', 'u1')} FROM frames")(lambda s, d: T.frames(s, d).select("video_id", "t", r(vectors.unit("h")[0]).alias("u1")))
query("phi_curve", "SELECT i, round(CASE WHEN i / 100.0 < 0.05 THEN 1 WHEN i / 100.0 <= 0.25 THEN 1.175 - 3.5 * (i / 100.0) ELSE 0.3 END::DOUBLE, 6) AS phi FROM range(101) x(i)")(lambda s, d: s.range(101).select(F.col("id").alias("i"), r(vectors.closeness(F.col("id") / 100.0)).alias("phi")))
query("grid_linspace", "SELECT t, unnest(list_distinct(list_transform(range(12), lambda i: cast(round_even(i * (t - 1) / 11.0, 0) AS INT)))) AS g FROM range(8, 60) x(t)")(lambda s, d: s.range(8, 60).select(F.col("id").alias("t"), F.explode(vectors.grid(F.col("id"))).alias("g")))
@query("tiou_pairs", f"SELECT a.video_id, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, {R('greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1) / (greatest(a.e, b.e) - least(a.s, b.s) + 1)', 'iou')} FROM spans a JOIN spans b ON a.video_id = b.video_id AND (a.s, a.e) < (b.s, b.e)")
def tiou(s, d):
    x = boundaries.relaxed_spans(T.frames(s, d), C).select("video_id", "s", "e")
    a, b = x.toDF("video_id", "s1", "e1"), x.toDF("video_id", "s2", "e2")
    return a.join(b, "video_id").where("s1 < s2 or s1 = s2 and e1 < e2").withColumn("iou", r(vectors.frames_iou(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))))


query("caption_lookup", "SELECT p.video_id, cast(uid AS INT) AS uid, coalesce(caption, '') AS caption FROM pool p LEFT JOIN caps c ON c.video_id = p.video_id AND c.t = p.mid")(lambda s, d: _pool(s, d).select("video_id", "uid", "mid").join(T.captions(s, d).withColumnRenamed("t", "mid"), ["video_id", "mid"], "left").select("video_id", "uid", F.coalesce("caption", F.lit("")).alias("caption")))
query("span_seconds", f"SELECT video_id, s, e, {R('s / 3.0', 'start')}, {R('(e + 1) / 3.0', 'end_')} FROM spans")(lambda s, d: boundaries.relaxed_spans(T.frames(s, d), C).select("video_id", "s", "e", r(sinks.seconds("s", "e", 3.0)[0]).alias("start"), r(sinks.seconds("s", "e", 3.0)[1]).alias("end_")))
_LAB = "SELECT sel.video_id, sel_rank, least(sel.s / 3.0, duration) AS st, least((sel.e + 1) / 3.0, duration) AS en, caption, duration FROM sel JOIN videos ON videos.video_id = sel.video_id JOIN caps ON caps.video_id = sel.video_id AND caps.t = sel.mid"
query("labels_activitynet", f"SELECT video_id, cast(row_number() OVER (PARTITION BY video_id ORDER BY st, sel_rank) - 1 AS INT) AS ord, round(st, 4) AS start, round(en, 4) AS end_, caption, round(duration, 3) AS duration FROM ({_LAB}) WHERE en > st")(lambda s, d: sinks.labels(_captioned(s, d), T.videos(s, d).withColumn("n_frames", F.lit(50))))
query("labels_charades", f"SELECT video_id, {R('st', 'start')}, {R('en', 'end_')}, trim(caption) AS caption FROM ({_LAB}) WHERE en > st AND trim(caption) <> ''")(lambda s, d: sinks.line_rows(_captioned(s, d), T.videos(s, d).withColumn("n_frames", F.lit(50))).select("video_id", r(F.col("start")).alias("start"), r(F.col("end_")).alias("end_"), "caption"))


def _captioned(s, d):
    return _selected(s, d).join(T.captions(s, d).withColumnRenamed("t", "mid"), ["video_id", "mid"])


query("event_scores", "SELECT video_id, cast(sel_rank AS INT) AS sel_rank, s AS start_frame, e AS end_frame, round(s / 3.0, 3) AS start_sec, round((e + 1) / 3.0, 3) AS end_sec, round(sfs, 6) AS sfs FROM sel")(lambda s, d: _selected(s, d).select("video_id", "sel_rank", F.col("s").alias("start_frame"), F.col("e").alias("end_frame"), F.round(F.col("s") / 3.0, 3).alias("start_sec"), F.round((F.col("e") + 1) / 3.0, 3).alias("end_sec"), F.round("sfs", 6).alias("sfs")))
_PRI = "SELECT category_id, type_id, (coalesce(k, 0) + 0.5) / (n + 1) AS p FROM (SELECT category_id, count(*) AS n FROM videos GROUP BY 1) CROSS JOIN (SELECT DISTINCT type_id FROM typ) LEFT JOIN (SELECT category_id, type_id, count(DISTINCT video_id) AS k FROM seltyp GROUP BY ALL) USING (category_id, type_id)"
query("priors", f"SELECT category_id, type_id, {R('p')} FROM ({_PRI})")(lambda s, d: stats.priors(_typed(s, d), T.videos(s, d), T.types(s, d)).withColumn("p", r(F.col("p"))))
query("s_narr", f"SELECT v.video_id, v.uid, {R('p * (1 - abs(mid / n_frames - 0.5))', 's_narr')} FROM (SELECT video_id, cast(uid AS INT) AS uid, mid, n_frames, type_id, category_id FROM seltyp) v JOIN ({_PRI}) USING (category_id, type_id)")(lambda s, d: _typed(s, d).join(T.videos(s, d), "video_id").join(stats.priors(_typed(s, d), T.videos(s, d), T.types(s, d)), ["category_id", "type_id"]).select("video_id", "uid", r(F.col("p") * pool.centrality()).alias("s_narr")))
_DM = "SELECT category_id, greatest(coalesce(avg(s_density), (SELECT avg(s_density) FROM seltyp), 1), 1e-8) AS mean FROM (SELECT DISTINCT category_id FROM videos) LEFT JOIN seltyp USING (category_id) GROUP BY category_id"
query("density_means", f"SELECT category_id, {R('mean')} FROM ({_DM})")(lambda s, d: stats.density_means(_selected(s, d), T.videos(s, d)).withColumn("mean", r(F.col("mean"))))
query("density_calibrated", f"SELECT video_id, cast(uid AS INT) AS uid, {R('s_density / mean', 'cal')} FROM seltyp JOIN ({_DM}) USING (category_id)")(lambda s, d: _selected(s, d).join(T.videos(s, d), "video_id").join(stats.density_means(_selected(s, d), T.videos(s, d)), "category_id").select("video_id", "uid", r(F.col("s_density") / F.col("mean")).alias("cal")))
query("type_report", """SELECT category_id, type_id, w AS n_videos_with, n_events, round(f, 4) AS frequency, round(m, 4) AS mean_sfs, CASE WHEN f >= fc AND m >= mc THEN 'core' WHEN f < fc AND m < mc THEN 'background' ELSE 'mixed' END AS label
    FROM (SELECT *, quantile_cont(f, 0.5) OVER () AS fc, quantile_cont(m, 0.5) OVER () AS mc FROM (SELECT category_id, type_id, w, n_events, coalesce(w, 0) / n AS f, m FROM (SELECT category_id, count(*) AS n FROM videos GROUP BY 1) CROSS JOIN (SELECT DISTINCT type_id FROM typ)
        LEFT JOIN (SELECT category_id, type_id, count(DISTINCT video_id) AS w, count(*) AS n_events, avg(sfs) AS m FROM seltyp GROUP BY ALL) USING (category_id, type_id))) WHERE w > 0""")(lambda s, d: stats.type_report(_typed(s, d), T.videos(s, d), T.types(s, d)))
query("category_report", "SELECT category_id, count(*) AS n_videos, round(avg(k), 3) AS mean_events_per_video FROM (SELECT v.video_id, category_id, count(uid) AS k FROM videos v LEFT JOIN sel ON sel.video_id = v.video_id GROUP BY ALL) GROUP BY category_id")(lambda s, d: stats.category_report(_selected(s, d), T.videos(s, d)))
query("assign_categories", "SELECT video_id, cast(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS assigned_id FROM videos")(lambda s, d: stats.categories(T.videos(s, d)).select("video_id", "assigned_id"))
query("nearest_centroid", "SELECT vec_id AS key, cast((SELECT arg_min(k, (round(list_distance(u, c) ** 2, 12), k)) FROM (SELECT vec_id AS k, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 8)) AS BIGINT) AS k_id FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS u FROM embeddings)")(lambda s, d: stats.nearest_centroid(T.table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), T.table(s, d, "embeddings").where("vec_id < 8").select(F.col("vec_id").alias("k_id"), vectors.doubles("embedding").alias("center"))))
query("silhouette", f"""SELECT key, {R("coalesce((b - a) / greatest(a, b), 0)", 'width')} FROM (SELECT key, min(m) FILTER (c = c2) AS a, min(m) FILTER (c <> c2) AS b FROM (SELECT x.vec_id AS key, x.label AS c, y.label AS c2, avg(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS m FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id GROUP BY ALL) GROUP BY key)""")(lambda s, d: stats.silhouette(T.table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("cluster"), vectors.doubles("embedding").alias("v"))).select("key", r(F.col("width")).alias("width")))
query("kmeans_types")(lambda s, d: stats.kmeans(T.table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), 4))
query("boundary_labels", "SELECT f.video_id, f.t, cast(max(CASE WHEN abs(f.t - x.s) <= 1 OR abs(f.t - x.e) <= 1 THEN 1 ELSE 0 END) AS INT) AS y FROM frames f JOIN sel x ON x.video_id = f.video_id GROUP BY ALL")(lambda s, d: refine.boundary_labels(T.frames(s, d), _selected(s, d), 1))
query("relocalise", "SELECT video_id, cast(uid AS INT) AS uid, s, e, CASE WHEN new_e - new_s + 1 < 6 THEN s ELSE new_s END AS new_s, CASE WHEN new_e - new_s + 1 < 6 THEN e ELSE new_e END AS new_e FROM moved")(lambda s, d: refine.relocated(_pool(s, d), T.boundary_prob(s, d), 4, 6))
query("soft_argmax", f"SELECT x.video_id, x.t AS x, {R('sum(greatest(p.b, 1e-6) ** 2 * p.t) / sum(greatest(p.b, 1e-6) ** 2)', 'pos')} FROM frames x JOIN prob p ON p.video_id = x.video_id AND abs(p.t - x.t) <= 4 GROUP BY ALL")(lambda s, d: refine.soft_argmax(T.frames(s, d).select("video_id", F.col("t").alias("x")), T.boundary_prob(s, d), 4, 0.5).withColumn("pos", r(F.col("pos"))))
query("bce_loss", f"SELECT video_id, {R('avg((1 - y) * z + ln(1 + exp(-abs(z))) + greatest(-z, 0))', 'loss')} FROM (SELECT video_id, ln(greatest(b, 0.001) / (1 - least(b, 0.999))) AS z, CASE WHEN b > 0.5 THEN 1 ELSE 0 END AS y FROM prob) GROUP BY ALL")(lambda s, d: T.boundary_prob(s, d).select("video_id", F.log(F.greatest("b", F.lit(0.001)) / (1 - F.least("b", F.lit(0.999)))).alias("z"), (F.col("b") > 0.5).cast("int").alias("y")).groupBy("video_id").agg(r(F.avg(refine.bce(F.col("z"), F.col("y")))).alias("loss")))
query("diou_loss", f"SELECT video_id, {R('avg(1 - i / (new_e - new_s + 1 + e - s + 1 - i) + ((new_s + new_e - s - e) / 2) ** 2 / greatest((greatest(e, new_e) - least(s, new_s)) ** 2, 1e-6))', 'loss')} FROM (SELECT *, greatest(least(e, new_e) - greatest(s, new_s) + 1, 0) AS i FROM moved) GROUP BY ALL")(lambda s, d: refine.relocated(_pool(s, d), T.boundary_prob(s, d), 4, 1).groupBy("video_id").agg(r(F.avg(refine.diou(F.col("new_s"), F.col("new_e"), F.col("s"), F.col("e")))).alias("loss")))


def _next(s, d):
    """The selection with every third event's start moved by two frames."""
    return _selected(s, d).withColumn("s", F.when(F.col("uid") % 3 == 0, F.greatest(F.col("s") - 2, F.lit(0))).otherwise(F.col("s")))


_NXT = "SELECT video_id, uid, sel_rank, CASE WHEN uid % 3 = 0 THEN greatest(s - 2, 0) ELSE s END AS s2, e AS e2 FROM sel"
query("jaccard_identity", f"SELECT video_id, {R('count(*) / count(*)', 'jaccard')}, {R('avg(abs(s2 - s) / 2)', 'shift')} FROM sel JOIN ({_NXT}) USING (video_id, uid) GROUP BY ALL")(lambda s, d: refine.convergence(_selected(s, d), _next(s, d), mode="identity").select("video_id", r(F.col("jaccard")).alias("jaccard"), r(F.col("shift")).alias("shift")))
_MAT = f"""SELECT video_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, y: CASE WHEN len(list_filter(a, lambda q: q.c = y[1].c OR q.p = y[1].p)) > 0 THEN a ELSE list_concat(a, y) END) AS m FROM (SELECT video_id, list({{'c': n.sel_rank, 'p': x.sel_rank, 'g': (abs(s2 - s) + abs(e2 - e)) / 2}} ORDER BY iou DESC, n.sel_rank, x.sel_rank) AS l FROM sel x JOIN ({_NXT}) n USING (video_id), LATERAL (SELECT greatest(0, least(e, e2) - greatest(s, s2) + 1) / (greatest(e, e2) - least(s, s2) + 1) AS iou) WHERE iou >= 0.5 GROUP BY video_id)"""
query("greedy_match", f"SELECT video_id, cast(len(m) AS BIGINT) AS n, {R('list_sum(list_transform(m, lambda x: x.g))', 'gap')} FROM ({_MAT})")(lambda s, d: refine.matched(_selected(s, d), _next(s, d)).groupBy("video_id").agg(F.count("*").alias("n"), r(F.sum("gap")).alias("gap")))
query("convergence", f"SELECT {R('min(j)', 'jaccard')}, {R('max(g)', 'shift')}, min(j) > 0.98 AND max(g) < 0.5 AS converged FROM (SELECT len(m) / (2 * k - len(m)) AS j, list_avg(list_transform(m, lambda x: x.g)) AS g FROM ({_MAT}) JOIN (SELECT video_id, count(*) AS k FROM sel GROUP BY 1) USING (video_id))")(lambda s, d: refine.converged(refine.convergence(_selected(s, d), _next(s, d))).select(r(F.col("jaccard")).alias("jaccard"), r(F.col("shift")).alias("shift"), "converged"))


def _pairs(s, d):
    return evaluate.pairs(T.intervals(s, d, "pred"), evaluate.merged_refs(T.intervals(s, d, "ref")))


query("iou_seconds", f"SELECT video_id, event_id, {R('r_start')}, {R('iou')} FROM pairs")(lambda s, d: _pairs(s, d).select("video_id", "event_id", r(F.col("r_start")).alias("r_start"), r(F.col("iou")).alias("iou")))
query("eval_pairs", "SELECT video_id, count(*) AS n, count(*) FILTER (iou >= 0.3) AS n30, count(*) FILTER (iou >= 0.5) AS n50 FROM pairs GROUP BY ALL")(lambda s, d: _pairs(s, d).groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("iou") >= 0.3).alias("n30"), F.count_if(F.col("iou") >= 0.5).alias("n50")))
query("ref_merge", f"SELECT video_id, {R('start')}, {R('end_')}, cast(len(sentences) AS BIGINT) AS n FROM ref")(lambda s, d: evaluate.merged_refs(T.intervals(s, d, "ref")).select("video_id", r(F.col("start")).alias("start"), r(F.col("end_")).alias("end_"), F.size("sentences").cast("long").alias("n")))
query("best_iou", f"SELECT video_id, {R('start')}, {R('end_')}, {R('best')} FROM best")(lambda s, d: evaluate.best_iou(evaluate.merged_refs(T.intervals(s, d, "ref")), _pairs(s, d)).select("video_id", *(r(F.col(c)).alias(c) for c in ("start", "end_", "best"))))
_TOK = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"
_F1 = lambda a, b: "(SELECT coalesce(2 * sum(least(ca, cb)) / (sum(ca) + sum(cb)), 0) FROM (SELECT w, count(*) FILTER (side = 1) AS ca, count(*) FILTER (side = 2) AS cb FROM (SELECT unnest(" + _TOK(a) + ") AS w, 1 AS side UNION ALL SELECT unnest(" + _TOK(b) + "), 2) GROUP BY w))"
query("token_f1", f"SELECT item_id AS key, {R(_F1('b.text', 'd.text'), 'f1')} FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")(lambda s, d: evaluate.token_f1(T.table(s, d, "benchmark").withColumnRenamed("text", "a").join(T.table(s, d, "documents").select("doc_id", F.col("text").alias("b")), F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("key"), "a", "b"), "key", "a", "b").withColumn("f1", r(F.col("f1"))))
_LOC = f"SELECT p.event_id, p.video_id, coalesce(max(f1), 0) AS f1 FROM pred p LEFT JOIN (SELECT event_id, {_F1('p_sentence', 's')} AS f1 FROM (SELECT event_id, p_sentence, unnest(sentences) AS s FROM pairs WHERE iou >= 0.5)) x ON x.event_id = p.event_id GROUP BY ALL"
query("localized_f1", f"SELECT event_id, {R('f1')} FROM ({_LOC})")(lambda s, d: evaluate.localized_f1(T.referring(s, d, "pred"), T.referring(s, d, "ref"), T.sentences(s, d)).withColumn("f1", r(F.col("f1"))))


def _per_video(s, d):
    users = T.table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id")).distinct()
    return evaluate.per_video(T.referring(s, d, "pred"), T.referring(s, d, "ref"), users, texts=T.sentences(s, d))


_PV = f"""SELECT v.video_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_ref, 0) AS n_ref, 1 - coalesce(d, 0) / greatest(coalesce(n_pred, 0), 1) AS duplicate_fraction, coalesce(mb, 0) AS mean_best_iou, coalesce(r3, 0) AS recovered_30, coalesce(r5, 0) AS recovered_50, coalesce(r7, 0) AS recovered_70, coalesce(f, 0) AS f1_sum
    FROM (SELECT DISTINCT concat('u', user_id) AS video_id FROM events) v LEFT JOIN (SELECT video_id, count(*) AS n_pred, count(DISTINCT sentence) AS d FROM pred GROUP BY 1) USING (video_id)
    LEFT JOIN (SELECT video_id, count(*) AS n_ref, avg(best) AS mb, count(*) FILTER (best >= 0.3) AS r3, count(*) FILTER (best >= 0.5) AS r5, count(*) FILTER (best >= 0.7) AS r7 FROM best GROUP BY 1) USING (video_id) LEFT JOIN (SELECT video_id, sum(f1) AS f FROM ({_LOC}) GROUP BY 1) USING (video_id)"""
_INT, _DBL = ("n_pred", "n_ref", "recovered_30", "recovered_50", "recovered_70"), ("duplicate_fraction", "mean_best_iou", "f1_sum")
query("eval_per_video", f"SELECT video_id, {', '.join(_INT)}, {', '.join(R(c) for c in _DBL)} FROM ({_PV})")(lambda s, d: _per_video(s, d).select("video_id", *_INT, *(r(F.col(c)).alias(c) for c in _DBL)))
query("eval_summary", f"SELECT count(*) AS videos, cast(sum(n_pred) AS BIGINT) AS n_pred, cast(sum(n_ref) AS BIGINT) AS n_ref, {R('avg(mean_best_iou)', 'mean_best_iou')}, {R('avg(duplicate_fraction)', 'duplicate_fraction')}, {R('sum(f1_sum) / greatest(sum(n_pred), 1)', 'token_f1')}, " + ", ".join(R(f"sum(recovered_{t}) / greatest(sum(n_ref), 1)", f"coverage_{t}") for t in (30, 50, 70)) + f" FROM ({_PV})")(lambda s, d: evaluate.summary(_per_video(s, d)).select("videos", "n_pred", "n_ref", *(r(F.col(c)).alias(c) for c in ("mean_best_iou", "duplicate_fraction", "token_f1", "coverage_30", "coverage_50", "coverage_70"))))
query("eval_validate", "SELECT count(*) FILTER (NOT (start >= 0 AND start < end_)) AS bad FROM ivl")(lambda s, d: T.intervals(s, d, "pred").union(T.intervals(s, d, "ref")).agg(F.count_if(~((F.col("start") >= 0) & (F.col("start") < F.col("end_")))).alias("bad")))
query("eval_matched")(lambda s, d: evaluate.micro(evaluate.summary(_per_video(s, d)), evaluate.matches(_pairs(s, d))))
query("bipartite_match")(lambda s, d: evaluate.matches(_pairs(s, d)))


query("bootstrap_ci")(lambda s, d: s.createDataFrame([evaluate.interval_of_mean(_per_video(s, d), "mean_best_iou")], "low double, high double"))
query("tokenize", f"SELECT item_id, list_count(w) AS n, w[1] AS first FROM (SELECT item_id, {_TOK('text')} AS w FROM benchmark)".replace("list_count(w)", "cast(len(w) AS BIGINT)"))(lambda s, d: T.table(s, d, "benchmark").select("item_id", text.tokens("text").alias("w")).select("item_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first")))
query("strip_text", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents")(lambda s, d: T.table(s, d, "documents").select("doc_id", text.strip("text").alias("t")))
query("digest", "SELECT doc_id, sha256(text) AS sha256, sha1(concat('7:', doc_id)) AS sha1 FROM documents")(lambda s, d: T.table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.sha1(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("sha1")))
query("json_roundtrip", "SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: T.table(s, d, "events").select("event_id", F.from_json(F.to_json(F.from_json("props", "struct<k:bigint>")), "struct<k:bigint>")["k"].alias("k")))
query("parse_frame_rate", "SELECT o_orderkey AS id, round(coalesce(CASE WHEN k = 0 THEN 30000 / 1001.0 WHEN k = 1 THEN 25.0 WHEN k = 2 THEN 0.0 ELSE 0.0 END, 0)::DOUBLE, 6) AS fps FROM (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)")(lambda s, d: T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), r(text.frame_rate(F.element_at(F.array(*map(F.lit, ("30000/1001", "25", "0/0", "x"))), (F.col("o_orderkey") % 4 + 1).cast("int")))).alias("fps")))
query("resample_idx", "SELECT c_custkey AS id, unnest(list_transform(range(cast(floor(c_custkey % 90 / 2.5) AS BIGINT) + 1), lambda k: cast(round_even(k * 2.5, 0) AS BIGINT))) AS idx FROM customer")(lambda s, d: T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("c_custkey") % 90 / 2.5).cast("int")), lambda k: F.rint(k * 2.5).cast("long"))).alias("idx")))
query("semi_ids", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(lambda s, d: T.table(s, d, "customer").select("c_custkey").join(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"))
query("anti_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, d: T.table(s, d, "customer").select("c_custkey").join(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"))
query("resume_antijoin", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")(lambda s, d: T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels").select("doc_id"), "doc_id", "left_anti"))
query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")(lambda s, d: T.table(s, d, "documents").select("doc_id").subtract(T.table(s, d, "labels").select("doc_id")))
query("det_sample", "SELECT c_custkey AS id FROM customer ORDER BY sha256(concat('42:', c_custkey)) LIMIT 50")(lambda s, d: files.sampled_ids(T.table(s, d, "customer").select(F.col("c_custkey").alias("id")), 50))
query("limit_n", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10")(lambda s, d: T.table(s, d, "customer").select("c_custkey").orderBy("c_custkey").limit(10))
query("densify_scatter", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")))


@query("scan_frames", f"SELECT video_id, t, cast(len(h) AS INT) AS dim, {R('h[1]', 'first')}, {R('h[64]', 'last')} FROM frames")
def scan_frames(s, d):
    """Every video as an array file's bytes, read back."""
    return files.decoded_frames(files.encoded_frames(T.frames(s, d))).select("video_id", "t", F.size("h").alias("dim"), r(F.col("h")[0].cast("double")).alias("first"), r(F.col("h")[63].cast("double")).alias("last"))


@query("scan_captions", "SELECT video_id, t, caption FROM caps")
def scan_captions(s, d):
    """Every video's captions as a JSON list (of lists for every second video), read back."""
    lists = T.captions(s, d).groupBy("video_id").agg(F.expr("transform(array_sort(collect_list(struct(t, caption))), x -> x.caption)").alias("x"))
    nested = F.to_json(F.transform("x", lambda x: F.array(x)))
    written = lists.select("video_id", F.when(F.crc32("video_id") % 2 == 0, F.to_json("x")).otherwise(nested).alias("value"))
    return files.decoded_captions(written)


@query("scan_manifest", "SELECT video_id, category, round(duration, 6) AS duration FROM videos")
def scan_manifest(s, d):
    """The videos as a manifest of one object a row, read back."""
    entry = F.struct(F.col("video_id").alias("id"), "duration", "category")
    written = T.videos(s, d).select(F.to_json(F.struct(F.array(entry).alias("videos"))).alias("value"))
    return files.manifest_entries(written).select("video_id", "category", F.round("duration", 6).alias("duration"))


@query(
    "resolve_path",
    "SELECT concat('v', k) AS video_id, CASE WHEN k % 6 = 0 THEN concat('rec/v', k, '.mp4') WHEN k % 5 < 2 THEN concat('root/v', k, '.mkv') WHEN k % 7 < 3 THEN concat('root/v', k, '.mov') END AS resolved FROM (SELECT c_custkey AS k FROM customer)",
)
def resolve_path(s, d):
    """Every third customer has a recorded path; half of the recorded files, and some of the root's, are there."""
    k = F.col("c_custkey")
    ids = T.table(s, d, "customer").select("c_custkey", F.concat(F.lit("v"), k.cast("string")).alias("video_id"))
    at = lambda cond, folder, suffix: F.when(cond, F.concat(F.lit(folder), "video_id", F.lit(suffix)))
    there = F.array(at(k % 2 == 0, "rec/", ".mp4"), at(k % 5 < 2, "root/", ".mkv"), at(k % 7 < 3, "root/", ".mov"), at(k % 2 == 1, "root/", ".txt"))
    listing = ids.select(F.explode(F.array_compact(there)).alias("file"))
    return files.resolved_paths(ids.withColumn("path", at(k % 3 == 0, "rec/", ".mp4")), listing, "root")


@query(
    "scan_labels_json",
    "SELECT concat(video_id, '-', event_id) AS video_id, cast(ord AS INT) AS ord, round(CASE WHEN ord = 0 THEN start ELSE end_ END, 6) AS start, round(CASE WHEN ord = 0 THEN end_ ELSE end_ + 1 END, 6) AS end_, CASE WHEN ord = 0 THEN sentence ELSE '' END AS sentence, round(end_ - start, 6) AS duration FROM pred, (VALUES (0), (1)) v(ord)",
)
def scan_labels_json(s, d):
    """Each prediction written as a JSON object of one video with two intervals, then read."""
    video = F.struct((F.col("end_") - F.col("start")).alias("duration"), F.array(F.array("start", "end_"), F.array("end_", F.col("end_") + 1)).alias("timestamps"), F.array("sentence", F.lit("")).alias("sentences"))
    written = T.intervals(s, d, "pred").select(F.to_json(F.create_map(F.concat_ws("-", "video_id", "event_id"), video)).alias("value"))
    return files.interval_map(written).select("video_id", "ord", *(F.round(c, 6).alias(c) for c in ("start", "end_")), "sentence", F.round("duration", 6).alias("duration"))


query("synth_frames")(lambda s, d: files.synthetic_frames(s))


def _corpus(s, d):
    return plan.Corpus(T.frames(s, d), T.captions(s, d), T.text_feats(s, d), T.videos(s, d).drop("category_id"))


def _generated(s, d):
    return plan.generate(_corpus(s, d), Settings())


@query("boundary_prob")
def boundary_prob(s, d):
    b = Boundary()
    learned = network.train(plan.Store(s).table(network.tracks(T.frames(s, d), _selected(s, d), b.batch), "tracks", ("part",)), b, b.seed)
    return network.probabilities(T.frames(s, d), learned[0], b)


query("refine_round")(lambda s, d: _generated(s, d).selected.select("video_id", "sel_rank", "uid", "s", "e", "type_id", "caption"))
query("round_history")(lambda s, d: s.createDataFrame(_generated(s, d).history, "round int, train_loss double, jaccard double, shift double, n_events long, converged boolean"))
