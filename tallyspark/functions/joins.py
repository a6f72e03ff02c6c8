"""Left join that stays even when a few keys hold most of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT = 1_000


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    size: str | None,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many-to-one on ``keys``; ``size`` is a right column with the number of left rows per key.

    The at most ``MAX_HOT`` largest keys above ``hot_rows`` are joined by broadcast, so their left
    rows are not shuffled at all; all other rows go through the plain join. Keys beyond
    that number hold under a thousandth of the rows each. Without hot keys, or without
    known sizes, this is the plain join. Both branches depend on row content only, so a
    recomputed task gives the same rows.
    """
    if size is None or not _has_hot(right, size, hot_rows):
        return left.join(right, keys, how)
    hot = right.filter(F.col(size) > hot_rows).orderBy(F.desc(size), *keys).limit(MAX_HOT)
    served = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, how)
    return served.unionByName(rest)


def _has_hot(right: DataFrame, size: str, hot_rows: int) -> bool:
    return not right.filter(F.col(size) > hot_rows).limit(1).isEmpty()
