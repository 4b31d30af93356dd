"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / (SHARES * partitions) of the rows is joined by broadcast: fewer than SHARES * partitions keys can be.
SHARES = 4


def counted_join(rows: DataFrame, counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of `rows` with `counts`, a row for each key, whose column `n` is the number of rows with it (a table, read twice).

    Null keys meet nothing. Rows of large keys stay where they are; what is broadcast is bounded by the shares' number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    least = max(1, total // (SHARES * parts))
    rest = [c for c in counts.columns if c not in keys]
    columns = [*rows.columns, *rest]
    same = lambda b: reduce(lambda x, y: x & y, (F.col(f"r.`{k}`") == F.col(f"{b}.`{k}`") for k in keys))
    large = counts.where(F.col(n) > least).select(*keys, *rest, F.lit(True).alias("_large"))
    seen = rows.alias("r").join(F.broadcast(large.alias("l")), same("l"), "left")
    stay = seen.where("_large").select(*(f"r.`{c}`" for c in rows.columns), *(f"l.`{c}`" for c in rest))
    move = seen.where("_large is null").select(*(f"r.`{c}`" for c in rows.columns))
    small = counts.where(F.col(n) <= least)
    met = move.alias("r").join(small.alias("s"), same("s")).select(*(f"r.`{c}`" for c in rows.columns), *(f"s.`{c}`" for c in rest))
    return stay.union(met).toDF(*columns)
