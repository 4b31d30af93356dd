"""Column functions of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(s) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), 0)


def words(s) -> Column:
    """The tokens with blanks between them."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " ")


def strip(s) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def frame_rate(s) -> Column:
    """`a/b` or a number; 0 where it can't be read or a fraction is not positive."""
    part = F.split(s, "/")
    over = F.try_divide(F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double"))
    return F.when(s.contains("/"), F.greatest(F.coalesce(over, F.lit(0.0)), F.lit(0.0))).otherwise(F.coalesce(s.try_cast("double"), F.lit(0.0)))
