"""Data-quality reports.

Counts that need no distinct values come from one pass grouped by year. The rest start
from one table of (variable, year, value) counts, which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import settings
from tallyspark.functions.columns import canon, number, ratio
from tallyspark.functions.ordered import quantiles_of_cells
from tallyspark.session import bounded_rows, stage
from tallyspark.sources.rules import RuleSet, schema_report

GROUP = ["VARIABLE", "YEAR"]
TOP_CODES = 10
MAX_YEARS = 1_000

# check name -> (columns it needs, failing predicate)
LOGICAL_CHECKS = {
    "BEDROOMS_GT_ROOMS": (["BEDROOMS", "ROOMS"], "BEDROOMS > ROOMS"),
    "AGE_OUT_OF_RANGE": (["AGE"], "AGE < 0 OR AGE > 110"),
    "LIVEAREA_NEGATIVE": (["LIVEAREA"], "LIVEAREA < 0"),
    "AUTOS_NEGATIVE": (["AUTOS"], "AUTOS < 0"),
    "MOTORCYCLE_NEGATIVE": (["MOTORCYCLE"], "MOTORCYCLE < 0"),
}


def long_form(df: DataFrame, variables: list[str], cast: str = "string") -> DataFrame:
    """(YEAR, VARIABLE, VALUE) rows; rows without a year drop out."""
    convert = number if cast == "double" else (lambda c: F.col(c).cast(cast))
    base = df.filter(F.col("YEAR").isNotNull()).select(
        F.col("YEAR").cast("int").alias("_year"), *[convert(c).alias(c) for c in variables]
    )
    return base.unpivot(["_year"], variables, "VARIABLE", "VALUE").withColumnRenamed("_year", "YEAR")


def value_counts(df: DataFrame, variables: list[str], cast: str = "string") -> DataFrame:
    return long_form(df, variables, cast).groupBy(*GROUP, "VALUE").agg(F.count(F.lit(1)).alias("N"))


def code_counts(df: DataFrame, variables: list[str]) -> DataFrame:
    """(VARIABLE, YEAR, VALUE, N) of canonical, non-null codes."""
    coded = df.select("YEAR", *[canon(v).alias(v) for v in variables])
    return value_counts(coded, variables).filter(F.col("VALUE").isNotNull())


def column_audit(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, missing, present and distinct values per year and variable, exact over all data.

    Exact distinct counts shuffle every distinct value once. ``approximate`` replaces them
    by sketches of fixed size, so that a single pass with one row per year suffices.
    """
    if approximate:
        return _sketched_audit(df)
    counts = value_counts(df, df.columns)
    out = counts.groupBy("YEAR", "VARIABLE").agg(
        F.sum("N").alias("N_ROWS"),
        F.sum(F.when(F.col("VALUE").isNull(), F.col("N")).otherwise(0)).alias("N_MISSING"),
        F.sum(F.when(F.col("VALUE").isNotNull(), F.col("N")).otherwise(0)).alias("SUM_NON_MISSING"),
        F.count("VALUE").alias("N_UNIQUE"),
    )
    return out.withColumn("MISSING_RATE", ratio("N_MISSING", "N_ROWS"))


def _sketched_audit(df: DataFrame) -> DataFrame:
    marks = [F.struct(F.count(c).alias("p"), F.approx_count_distinct(c, 0.01).alias("d")).alias(c) for c in df.columns]
    wide = df.filter(F.col("YEAR").isNotNull()).groupBy(F.col("YEAR").cast("int").alias("_year")).agg(
        F.count(F.lit(1)).alias("_rows"), *marks
    )
    long = wide.unpivot(["_year", "_rows"], df.columns, "VARIABLE", "m")
    return long.select(
        F.col("_year").alias("YEAR"), "VARIABLE", F.col("_rows").alias("N_ROWS"), (F.col("_rows") - F.col("m.p")).alias("N_MISSING"),
        F.col("m.p").alias("SUM_NON_MISSING"), F.col("m.d").alias("N_UNIQUE"),
    ).withColumn("MISSING_RATE", ratio("N_MISSING", "N_ROWS"))


def missingness(df: DataFrame) -> DataFrame:
    """Rows and missing values per year and variable: one pass, one row per year shuffled."""
    wide = (
        df.filter(F.col("YEAR").isNotNull())
        .groupBy(F.col("YEAR").cast("int").alias("_year"))
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    )
    long = wide.unpivot(["_year", "_rows"], df.columns, "VARIABLE", "_present")
    return long.select(
        F.col("_year").alias("YEAR"),
        "VARIABLE",
        F.col("_rows").alias("N_ROWS"),
        (F.col("_rows") - F.col("_present")).alias("N_MISSING"),
    ).withColumn("MISSING_RATE", ratio("N_MISSING", "N_ROWS"))


def year_coverage(df: DataFrame) -> DataFrame:
    """Long coverage: is a variable observed at all in a year (1/0)."""
    return missingness(df).select(
        "VARIABLE", "YEAR", (F.col("N_ROWS") > F.col("N_MISSING")).cast("int").alias("PRESENT")
    )


def coverage_matrix(coverage: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Wide coverage with one YEAR_<y> column per wave."""
    if years is None:
        found = coverage.select("YEAR").distinct()
        years = sorted(r[0] for r in bounded_rows(found, MAX_YEARS, "survey years"))
    cells = [
        F.coalesce(F.max(F.when(F.col("YEAR") == y, F.col("PRESENT"))), F.lit(0)).alias(f"YEAR_{y}") for y in years
    ]
    return coverage.groupBy("VARIABLE").agg(*cells)


def duplicate_ids(df: DataFrame, checks: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows that share their id with another row, per id."""
    checks = checks or {
        "HOUSEHOLD_ID_DUPLICATES": settings.HOUSEHOLD_KEYS,
        "PERSON_ID_DUPLICATES": settings.PERSON_KEYS,
    }
    out = None
    for name, keys in checks.items():
        if not set(keys) <= set(df.columns):
            continue
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        part = groups.agg(
            F.lit(name).alias("CHECK"),
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("VALUE"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def logical_checks(df: DataFrame, checks: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """Failing rows per check, all checks in one pass; a null comparison passes."""
    checks = checks or LOGICAL_CHECKS
    usable = {n: sql for n, (needs, sql) in checks.items() if set(needs) <= set(df.columns)}
    columns = sorted({c for n in usable for c in checks[n][0]})
    counted = df.select(*[number(c).alias(c) for c in columns]).agg(
        *[F.count_if(F.expr(sql)).alias(n) for n, sql in usable.items()]
    )
    return counted.unpivot([], list(usable), "CHECK", "N_FAIL")


def check_report(df: DataFrame) -> DataFrame:
    return logical_checks(df).unionByName(duplicate_ids(df), allowMissingColumns=True)


def combine_checks(parts: list[DataFrame], key: str = "CHECK") -> DataFrame:
    """Sum check tables of several batches by check name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy(key).agg(*[F.sum(c).alias(c) for c in whole.columns if c != key])


def combine_audits(parts: list[DataFrame]) -> DataFrame:
    """Merge audits of disjoint batches; distinct counts cannot be added, so they are left out."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    merged = whole.groupBy("YEAR", "VARIABLE").agg(
        F.sum("N_ROWS").alias("N_ROWS"), F.sum("N_MISSING").alias("N_MISSING")
    )
    return merged.withColumn("MISSING_RATE", ratio("N_MISSING", "N_ROWS"))


def _member(column: str, names) -> Column:
    names = sorted(names)
    return F.col(column).isin(*names).cast("int") if names else F.lit(0)


def metadata_usage(
    coverage: DataFrame, rules: RuleSet, dictionary: DataFrame, targets: list[str] = settings.HARMONIZE_VARS
) -> DataFrame:
    """Which observed variables the dictionary, the rules and the target list know."""
    known = dictionary.select(F.upper("variable_name").alias("VARIABLE")).distinct().withColumn("_known", F.lit(1))
    variables = coverage.select(F.upper("VARIABLE").alias("VARIABLE")).distinct()
    return variables.join(known, "VARIABLE", "left").select(
        "VARIABLE",
        F.coalesce("_known", F.lit(0)).alias("IN_VARIABLE_DICTIONARY"),
        _member("VARIABLE", rules.missing).alias("HAS_MISSING_RULE"),
        _member("VARIABLE", rules.mapping).alias("HAS_HARMONIZATION_RULE"),
        _member("VARIABLE", [t.upper() for t in targets]).alias("IS_TARGET_HARMONIZE_VAR"),
    )


def variable_docs(coverage: DataFrame, rules: RuleSet, dictionary: DataFrame) -> DataFrame:
    """Dictionary entry, observed years and harmonisation state of every variable."""
    observed = coverage.groupBy(F.upper("VARIABLE").alias("variable_name")).agg(
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("PRESENT") == 1, F.col("YEAR")))).cast("array<string>"), " | "
        ).alias("years_available")
    )
    twins = observed.filter(F.col("variable_name").endswith("_H")).select(
        F.expr("substring(variable_name, 1, length(variable_name) - 2)").alias("variable_name"),
        F.lit(1).alias("_twin"),
    )
    entries = dictionary.withColumn("variable_name", F.upper("variable_name")).withColumn("_known", F.lit(1))
    return (
        observed.join(entries, "variable_name", "left")
        .join(twins, "variable_name", "left")
        .select(
            "variable_name", "level", "dtype", "description", "use_in_analysis", "years_available",
            _member("variable_name", rules.mapping).alias("has_harmonization_rules"),
            F.when(F.col("variable_name").endswith("_H"), 1)
            .otherwise(F.coalesce("_twin", F.lit(0)))
            .alias("has_harmonized_version"),
            F.coalesce("_known", F.lit(0)).alias("documented_in_metadata"),
        )
    )


def _first_codes(ranked: DataFrame, order: list[Column], text: Column, name: str) -> DataFrame:
    """Joined text of the first ten rows per (variable, year).

    ``row_number() <= k`` is cut on the map side, so a group with many codes is never
    gathered whole.
    """
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))
    top = ranked.withColumn("_place", place).filter(F.col("_place") <= TOP_CODES)
    listed = F.array_sort(F.collect_list(F.struct("_place", text.alias("t"))))
    return top.groupBy(*GROUP).agg(F.array_join(F.transform(listed, lambda s: s["t"]), " | ").alias(name))


def _code_with_count() -> Column:
    return F.concat_ws(":", F.col("VALUE"), F.col("N").cast("string"))


def category_consistency(df: DataFrame, variables: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Codes per variable and year, with codes new or gone against the previous observed year."""
    if counts is None:
        counts = stage(code_counts(df, variables or present_categories(df)), "codes")
    waves = counts.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("N_CODES"))
    by_year = Window.partitionBy("VARIABLE").orderBy("YEAR")
    waves = waves.select(
        *GROUP, "N_CODES", F.lag("YEAR").over(by_year).alias("_prev"), F.lead("YEAR").over(by_year).alias("_next")
    )
    # One row per (variable, code, year): the neighbours of a code are at most one row per wave.
    by_code = Window.partitionBy("VARIABLE", "VALUE").orderBy("YEAR")
    traced = counts.join(waves.select(*GROUP, "_prev", "_next"), GROUP).select(
        *GROUP, "VALUE", "_prev", "_next",
        F.lag("YEAR").over(by_code).alias("_seen_before"),
        F.lead("YEAR").over(by_code).alias("_seen_after"),
    )
    new = traced.filter(~F.col("_seen_before").eqNullSafe(F.col("_prev")) | F.col("_prev").isNull()).select(*GROUP, "VALUE")
    gone = traced.filter(F.col("_next").isNotNull() & ~F.col("_seen_after").eqNullSafe(F.col("_next"))).select(
        "VARIABLE", F.col("_next").alias("YEAR"), "VALUE"
    )
    by_text = [F.col("VALUE")]
    top = _first_codes(counts, [F.col("N").desc(), F.col("VALUE")], _code_with_count(), "TOP_CODES")
    new_text = _first_codes(new, by_text, F.col("VALUE"), "NEW_CODES_VS_PREVIOUS_YEAR")
    gone_text = _first_codes(gone, by_text, F.col("VALUE"), "DISAPPEARED_CODES_VS_PREVIOUS_YEAR")
    out = waves.join(top, GROUP, "left").join(new_text, GROUP, "left").join(gone_text, GROUP, "left")
    shifted = F.col("NEW_CODES_VS_PREVIOUS_YEAR").isNotNull() | F.col("DISAPPEARED_CODES_VS_PREVIOUS_YEAR").isNotNull()
    return out.select(
        *GROUP, "N_CODES", "TOP_CODES",
        F.coalesce("NEW_CODES_VS_PREVIOUS_YEAR", F.lit("")).alias("NEW_CODES_VS_PREVIOUS_YEAR"),
        F.coalesce("DISAPPEARED_CODES_VS_PREVIOUS_YEAR", F.lit("")).alias("DISAPPEARED_CODES_VS_PREVIOUS_YEAR"),
        (shifted & F.col("_prev").isNotNull()).cast("int").alias("FLAG_CATEGORY_SHIFT"),
    )


def present_categories(df: DataFrame) -> list[str]:
    return [v for v in settings.CATEGORICAL_VARS if v in df.columns]


def harmonization_coverage(
    df: DataFrame,
    rules: RuleSet,
    variables: list[str] = settings.HARMONIZE_VARS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Share of present raw codes the rules cover, and the commonest codes they do not."""
    present = [v for v in variables if v in df.columns]
    if counts is None:
        counts = stage(code_counts(df, present), "codes")
    covered, has_rules = F.lit(False), F.lit(False)
    for variable in present:
        years = rules.mapping.get(variable.upper(), {})
        own = [y for y in years if y != "ALL" and years[y]]
        for year in own:
            here = (F.col("VARIABLE") == variable) & (F.col("YEAR").cast("string") == year)
            covered = covered | (here & F.col("VALUE").isin(*years[year]))
            has_rules = has_rules | here
        if years.get("ALL"):
            here = F.col("VARIABLE") == variable
            if own:
                here = here & ~F.col("YEAR").cast("string").isin(*own)
            covered = covered | (here & F.col("VALUE").isin(*years["ALL"]))
            has_rules = has_rules | here
    marked = counts.filter(F.col("VARIABLE").isin(*present)).withColumns({"_covered": covered, "_rules": has_rules})
    unresolved = _first_codes(
        marked.filter(~F.col("_covered")), [F.col("N").desc(), F.col("VALUE")], _code_with_count(), "TOP_UNRESOLVED_CODES"
    )
    twins = [v for v in present if f"{v}_H" in df.columns]
    totals = marked.groupBy(*GROUP).agg(
        F.sum("N").alias("NON_MISSING_RAW"),
        F.sum(F.when(F.col("_covered"), F.col("N")).otherwise(0)).alias("COVERED_BY_RULES"),
        F.max(F.col("_rules").cast("int")).alias("HAS_RULES"),
    )
    return totals.join(unresolved, GROUP, "left").select(
        *GROUP, "NON_MISSING_RAW", "COVERED_BY_RULES",
        _member("VARIABLE", twins).alias("HAS_HARMONIZED_COLUMN"),
        "HAS_RULES",
        ratio("COVERED_BY_RULES", "NON_MISSING_RAW").alias("COVERAGE_RATE"),
        F.coalesce("TOP_UNRESOLVED_CODES", F.lit("")).alias("TOP_UNRESOLVED_CODES"),
    )


def outlier_summary(df: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """Centre, spread, tails and share outside the Tukey fences per variable and year."""
    variables = variables or [v for v in settings.CONTINUOUS_VARS if v in df.columns]
    cells = stage(value_counts(df, variables, "double").filter(F.col("VALUE").isNotNull()), "values")
    cuts = quantiles_of_cells(
        cells, GROUP, "VALUE", {"P01": 0.01, "Q1": 0.25, "MEDIAN": 0.5, "Q3": 0.75, "P99": 0.99}, "N",
        at_most=cells.count(),
    )
    means = cells.groupBy(*GROUP).agg((F.sum(F.col("VALUE") * F.col("N")) / F.sum("N")).alias("MEAN"))
    limits = stage(cuts.join(means, GROUP), "limits")
    reach = 1.5 * (F.col("Q3") - F.col("Q1"))
    outside = (F.col("VALUE") < F.col("Q1") - reach) | (F.col("VALUE") > F.col("Q3") + reach)
    spread = F.col("N") * (F.col("VALUE") - F.col("MEAN")) ** 2
    return (
        cells.join(limits, GROUP)
        .groupBy(*GROUP)
        .agg(
            F.max("MEAN").alias("MEAN"),
            F.max("MEDIAN").alias("MEDIAN"),
            F.sqrt(F.sum(spread) / F.nullif(F.sum("N") - 1, F.lit(0))).alias("STD"),
            F.max("P01").alias("P01"),
            F.max("P99").alias("P99"),
            (F.sum(F.when(outside, F.col("N")).otherwise(0)) / F.sum("N")).alias("OUTLIER_RATE_IQR"),
        )
    )


def structural_breaks(summary: DataFrame) -> DataFrame:
    """Change between consecutive observed years, scaled by the mean of the two spreads."""
    by_year = Window.partitionBy("VARIABLE").orderBy("YEAR")
    before = {c: F.lag(c).over(by_year) for c in ["YEAR", "MEAN", "MEDIAN", "STD"]}
    pairs = summary.select("*", *[c.alias(f"_{n}") for n, c in before.items()]).filter(F.col("_YEAR").isNotNull())
    pooled = F.coalesce((F.col("STD") + F.col("_STD")) / 2, F.col("STD"), F.col("_STD"))
    change = F.col("MEAN") - F.col("_MEAN")
    scaled = change / F.nullif(pooled, F.lit(0.0))
    return pairs.select(
        "VARIABLE",
        F.col("_YEAR").alias("FROM_YEAR"),
        F.col("YEAR").alias("TO_YEAR"),
        change.alias("MEAN_CHANGE"),
        (F.col("MEDIAN") - F.col("_MEDIAN")).alias("MEDIAN_CHANGE"),
        scaled.alias("STANDARDIZED_MEAN_CHANGE"),
        F.coalesce((F.abs(scaled) >= 1).cast("int"), F.lit(0)).alias("FLAG_STRUCTURAL_BREAK"),
    )


def validation_suite(
    df: DataFrame, rules: RuleSet, dictionary: DataFrame, rule_files: dict[str, tuple[DataFrame, list[str]]] = {}
) -> dict[str, DataFrame]:
    """All reports by name; code counts and coverage are computed once and shared. ``rule_files``: frame and required columns."""
    targets = [v for v in settings.HARMONIZE_VARS if v in df.columns]
    codes = stage(code_counts(df, list(dict.fromkeys(present_categories(df) + targets))), "codes")
    gaps = stage(missingness(df), "missingness")
    coverage = gaps.select("VARIABLE", "YEAR", (F.col("N_ROWS") > F.col("N_MISSING")).cast("int").alias("PRESENT"))
    outliers = stage(outlier_summary(df), "outliers")
    return {
        "metadata_usage_audit": metadata_usage(coverage, rules, dictionary),
        "missingness_summary": gaps,
        "category_consistency": category_consistency(
            df, counts=codes.filter(F.col("VARIABLE").isin(*present_categories(df)))
        ),
        "harmonization_coverage": harmonization_coverage(df, rules, counts=codes),
        "outlier_summary": outliers,
        "structural_breaks": structural_breaks(outliers),
        "variable_documentation": variable_docs(coverage, rules, dictionary),
        "column_audit": column_audit(df),
        "checks": check_report(df),
        **{f"{name}_rules_schema": schema_report(frame, required, name) for name, (frame, required) in rule_files.items()},
    }
