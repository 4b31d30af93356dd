"""URL rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled pages are good or bad. Bad rates are shrunk along the tree corpus > suffix > registered domain > host: at each level
the children's counts get a beta prior whose mean is the parent's posterior mean and whose weight is fitted to the
corpus (the intraclass correlation of the level's beta-binomial counts, by analysis of variance). A host is blocked if the
TAIL quantile of its beta posterior of the bad rate is at least `threshold`.

Ports and user names don't count for the tree; an IP address is its own suffix and domain. Suffixes are one label, or two where a
country's code follows a label of GENERIC; `suffixes` adds rules in the form of the public list (`a.b`, `*.a`, `!b.a`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Labels under which countries register domains.
GENERIC = ("ac", "co", "com", "edu", "go", "gob", "gov", "govt", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
THRESHOLD = 0.5
#: The posterior's quantile that must reach the threshold, and the normal's quantile of the same share from above.
TAIL, DEVIATIONS = 0.05, 1.6448536269514722
WEIGHTS = (1.0, 10_000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """`pages` with host and path; both are empty for null urls and those without ://."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k)
    return pages.withColumn("host", F.translate(part(1), _UPPER, _LOWER)).withColumn("path", part(2))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; the rules are a short list that becomes one CASE."""
    name = verdict = None
    for host, path, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def with_tree(hosts: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """`hosts` with suffix and domain (one label more; a suffix alone is its own domain)."""
    name = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")
    tail = lambda k: F.substring_index("_name", ".", -k)
    length = F.when(F.col("_name").rlike(r"^([0-9]+\.){3}[0-9]+$|^\[.*\]$"), 0)
    plain, wild, but = ([x.lstrip("*!.") for x in suffixes if (x[:1] if x[:1] in "*!" else "") == mark] for mark in ("", "*", "!"))
    labels = F.size(F.split("_name", r"\."))
    for k in (4, 3, 2):
        if but:
            length = length.when((labels >= k) & tail(k).isin(but), k - 1)
    for k in (4, 3, 2):
        rule = F.lit(False)
        if plain:
            rule = rule | ((labels >= k) & tail(k).isin(plain))
        if wild:
            rule = rule | ((labels >= k) & tail(k - 1).isin(wild))
        length = length.when(rule, k)
    generic = rf"(^|\.)({'|'.join(GENERIC)})\.[a-z][a-z]$"
    length = length.when(F.col("_name").rlike(generic), 2).otherwise(1)
    cut = lambda n: F.when(F.col("_k") == 0, F.col("_name")).otherwise(F.expr(f"substring_index(_name, '.', -(_k + {n}))"))
    return hosts.withColumn("_name", name).withColumn("_k", length).withColumn("suffix", cut(0)).withColumn("domain", cut(1)).drop("_name", "_k")


def beta_quantile(a: Column, b: Column) -> Column:
    """The TAIL quantile of a beta distribution: by the normal deviate of a logarithm of odds (Abramowitz and Stegun 26.5.22) where a and b are
    above 1. For b <= 1 that of beta(a, 1), which errs towards smaller quantiles, and for a <= 1 too, where it is TAIL or less in any case."""
    p, q = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h, lift = 2 / (p + q), (DEVIATIONS**2 - 3) / 6
    w = DEVIATIONS * F.sqrt(h + lift) / h - (q - p) * (lift + 5 / 6 - 2 / (3 * h))
    return F.when((a <= 1) | (b <= 1), F.pow(F.lit(TAIL), 1 / a)).otherwise(a / (a + b * F.exp(2 * w)))


def _weight(level: DataFrame) -> DataFrame:
    """One row: the prior's weight 1 / rho - 1 for counts (n, bad) of a level's members, within WEIGHTS; the largest where rho cannot be told from 0."""
    sums = level.where("n > 0").agg(F.count("*").alias("m"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum("bad").alias("B"), F.sum(F.round(F.col("bad") * F.col("bad") / F.col("n"), 9).cast("decimal(38,9)")).cast("double").alias("S"))
    N, m, B, S = F.col("N"), F.col("m"), F.col("B"), F.col("S")
    between = (S - B * B / N) / (m - 1)
    within = (B - S) / (N - m)
    size = (N - F.col("N2") / N) / (m - 1)
    weight = F.when((m > 1) & (N > m) & (between > within) & (within >= 0), (between + (size - 1) * within) / (between - within) - 1)
    low, high = WEIGHTS
    return sums.select(F.greatest(F.least(F.coalesce(weight, F.lit(high)), F.lit(high)), F.lit(low)).alias("weight"))


def reputation(hosts: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """host, n, bad, mean and bound of every host of `hosts` (host, n, bad: labelled pages and bad ones)."""
    tree = with_tree(hosts, suffixes)
    root = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    above, key = root, None
    for level in ("suffix", "domain", "host"):
        counts = tree.groupBy(*dict.fromkeys(["suffix", level] if level == "domain" else ["domain", level] if level == "host" else [level])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        joined = counts.join(above.withColumnRenamed("mean", "up"), key) if key else counts.join(F.broadcast(above.withColumnRenamed("mean", "up")))
        with_weight = joined.join(F.broadcast(_weight(counts)))  # one row
        a, b = F.col("up") * F.col("weight") + F.col("bad"), (1 - F.col("up")) * F.col("weight") + F.col("n") - F.col("bad")
        mean = a / (a + b)
        out = with_weight.select(level, "n", "bad", mean.alias("mean"), beta_quantile(a, b).alias("bound"))
        above, key = out.select(level, "mean"), level
    return out


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bound of every page.

    `outcomes`: page_id, bad (0 or 1); rows with nulls are left aside, repeated page_ids count as bad if one of their rows is.
    Hosts without labelled pages have their domain's rate. Null and repeated page_ids pass through, a row each (null: unlabelled); an
    empty table gives no rows; other columns are left aside.
    """
    parts = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = parts.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = reputation(labelled, suffixes).select(F.col("host").alias("h"), F.col("mean").alias("bad_rate"), "bound")
    rule, says = rule_of(rules)
    own = F.when(F.col("bound") >= threshold, "block").otherwise("allow")
    return parts.join(hosts, F.col("host") == F.col("h"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "bad_rate", "bound")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labels by number as page outcomes: bad if of low quality or toxic. They stand in for outcomes of the pages' own, of which there are none; `judge_urls` takes any."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: verdicts on `pages` urls."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_outcomes(spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("page_id", "host", "path", "rule", "verdict")
