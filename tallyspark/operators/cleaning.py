"""Rule-driven cleaning: missing codes, types, harmonised codes. All row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyspark import settings
from tallyspark.functions.columns import canon, code_in, number
from tallyspark.sources.rules import RuleSet


def require_columns(df: DataFrame, columns: list[str] = settings.REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _by_year(df: DataFrame, rules: dict[str, object], year: str, use) -> Column | None:
    """CASE over years: a year's own rule first, the ALL rule otherwise."""
    fallback = use(rules["ALL"]) if "ALL" in rules else None
    chosen = None
    for key, rule in rules.items():
        if key != "ALL":
            test = code_in(df, year, [key])
            chosen = F.when(test, use(rule)) if chosen is None else chosen.when(test, use(rule))
    if chosen is None:
        return fallback
    return chosen.otherwise(fallback) if fallback is not None else chosen


def canonical_codes(df: DataFrame, variables: list[str] = settings.HARMONIZE_VARS) -> DataFrame:
    """Bring category codes to their canonical text once, so that later steps compare plainly."""
    return df.withColumns({v: canon(v) for v in variables if v in df.columns})


def apply_missing_rules(
    df: DataFrame, rules: RuleSet, year: str = settings.YEAR, ready: list[str] = []
) -> DataFrame:
    """Null every value whose code is listed as missing; rows without a year stay as they are."""
    columns = []
    for name in df.columns:
        by_year = rules.missing.get(name.upper())
        if not by_year:
            columns.append(F.col(name))
            continue
        listed = _by_year(df, by_year, year, lambda codes: code_in(df, name, codes, name in ready))
        hit = F.col(year).isNotNull() & F.coalesce(listed, F.lit(False))
        columns.append(F.when(~hit, F.col(name)).alias(name))
    return df.select(*columns)


def clean_types(df: DataFrame, numeric: list[str] = settings.NUMERIC_VARS) -> DataFrame:
    """Coerce measures to double (ids to int), trim the household key, NaN to null."""
    columns = []
    for name in df.columns:
        # Integers hold neither text nor NaN, so a plain cast is enough.
        whole = isinstance(df.schema[name].dataType, IntegralType)
        if name in ("YEAR", "PERNUM") and name in numeric:
            columns.append((F.col(name) if whole else number(name)).cast("int").alias(name))
        elif name in numeric:
            columns.append((F.col(name).cast("double") if whole else number(name)).alias(name))
        elif name == "SERIAL":
            columns.append(F.trim(F.col(name).cast("string")).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def ensure_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def harmonize(
    df: DataFrame,
    rules: RuleSet,
    variables: list[str] = settings.HARMONIZE_VARS,
    year: str = settings.YEAR,
    ready: list[str] = [],
) -> DataFrame:
    """Add ``<V>_H``: the mapped code, or the raw one where no rule maps it."""
    added = {}
    for variable in variables:
        name = variable.upper()
        if name not in df.columns:
            continue
        raw = F.col(name) if name in ready else canon(name)
        by_year = rules.mapping.get(name)
        mapped = None
        if by_year:
            mapped = _by_year(df, by_year, year, lambda codes: _lookup(raw, codes))
        added[f"{name}_H"] = raw if mapped is None else F.coalesce(mapped, raw)
    return df.withColumns(added) if added else df


def _lookup(code: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), code)


def clean_and_harmonize(df: DataFrame, rules: RuleSet) -> DataFrame:
    """One narrow stage from raw rows to the harmonised master."""
    codes = settings.HARMONIZE_VARS
    coded = canonical_codes(require_columns(df), codes)
    return harmonize(clean_types(apply_missing_rules(coded, rules, ready=codes)), rules, codes, ready=codes)
