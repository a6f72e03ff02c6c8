"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canon(c: str | Column) -> Column:
    """Canonical text of a code: trimmed, ``99.0`` and ``99`` are the same code."""
    text = F.trim(col(c).cast("string"))
    # The pattern only runs on the few values that have a point at all.
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def code_in(df: DataFrame, name: str, codes: list[str], ready: bool = False) -> Column:
    """Is the code one of ``codes``; numeric columns are compared as numbers.

    ``ready`` says that the column is canonical already.
    """
    if isinstance(df.schema[name].dataType, NumericType):
        numbers = [float(c) for c in codes if _is_number(c)]
        return F.col(name).isin(*numbers) if numbers else F.lit(False)
    return (F.col(name) if ready else canon(name)).isin(*codes) if codes else F.lit(False)


def _is_number(text: str) -> bool:
    try:
        return float(text) == float(text)
    except ValueError:
        return False


def number(c: str | Column) -> Column:
    """Double value of a column; text that is no number, and NaN, give null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Double division; a zero denominator gives null."""
    return col(top).cast("double") / F.nullif(col(bottom).cast("double"), F.lit(0.0))


def flag(predicate: Column) -> Column:
    """1.0 where the predicate holds, 0.0 where it is false or null."""
    return F.coalesce(predicate, F.lit(False)).cast("double")


def indicator(c: str | Column, positive: tuple[str, ...] = ("1", "2")) -> Column:
    return flag(canon(c).isin(*[str(p) for p in positive]))


def digits(c: str | Column) -> Column:
    """First run of digits in a mixed code, as double."""
    return F.regexp_extract(col(c).cast("string"), r"(\d+)", 1).try_cast("double")


def not_excluded(c: str | Column, codes: tuple[str, ...] = ("0", "9")) -> Column:
    """False for the listed codes; null codes stay in."""
    return F.coalesce(~canon(c).isin(*codes), F.lit(True))


def decoded(c: str | Column, labels: dict[str, str]) -> Column:
    """Label of a code; an unknown code is shown as itself."""
    code = canon(c)
    out = F.when(F.lit(False), F.lit(""))
    for key, label in labels.items():
        out = out.when(code == key, label)
    return out.otherwise(code)


def period(year: str | Column) -> Column:
    y = col(year)
    return F.when(y <= 1999, "early").when(y <= 2009, "middle").otherwise("late")


def cohort_decade(year: str | Column, age: str | Column) -> Column:
    return (F.floor((col(year) - col(age)) / 10) * 10).cast("int")


def weighted_mean(value: str | Column, weight: str | Column | None = None) -> Column:
    """Aggregate: weighted mean over pairs where both sides are present."""
    v = col(value)
    if weight is None:
        return F.avg(v)
    w = F.when(v.isNotNull(), col(weight))
    return F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))


def total(columns: list[str]) -> Column:
    """Row sum with unparsable and missing values counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(number(c), F.lit(0.0)) for c in columns])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().upper() for c in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def hash_unit(seed: int | str, *keys: str | Column) -> Column:
    """Row-local pseudo-random number in [0, 1) from an md5 of seed and key."""
    return hash_word(seed, *keys).cast("double") / F.lit(float(16**8))


def hash_word(seed: int | str, *keys: str | Column, digits: int = 8) -> Column:
    """Leading hexadecimal digits of the md5 of seed and key, as a number."""
    text = F.md5(hash_text(seed, *keys).cast("binary"))
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("bigint")


def hash_text(seed: int | str, *keys: str | Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
