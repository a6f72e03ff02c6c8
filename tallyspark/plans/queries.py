"""Registered queries: one per operator, each over the whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyspark import settings
from tallyspark.functions.columns import (
    digits, indicator, not_excluded, number, upper_names, weighted_mean,
)
from tallyspark.functions.ordered import gini, spearman
from tallyspark.operators import bayes, classifiers, features, indices, metrics, profiles, quality, regression, sampling
from tallyspark.operators import tables as tb
from tallyspark.operators import unsupervised
from tallyspark.operators.cleaning import apply_missing_rules, clean_and_harmonize, clean_types, harmonize, require_columns
from tallyspark.plans import oracles as o
from tallyspark.plans.census import CENSUS_RULES, census, read_census, survey, table
from tallyspark.session import new_stage_path
from tallyspark.sources import loose_csv
from tallyspark.sources.rules import HARMONIZATION_COLUMNS, RuleSet, dictionary_frame, load_rule_table, schema_report
from tallyspark.sources.tables import scan, write_table
from tallyspark.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TARGET = "wealth_class"
FEATURES = settings.MODEL_FEATURES
KEYS = settings.HOUSEHOLD_KEYS
YEARS = [1989, 1999, 2009, 2019]


def query(sql: str | None = None, needs: list[str] = [], plain: list[str] = [], doubles: list[str] = [], extra=[], digits: int = 6):
    """Register a query; with SQL, the listed double columns are rounded on both sides.

    Component scores use four digits: an eigenvector carries the summation noise of its
    matrix divided by the gap to the next eigenvalue, and there is one score per row.
    """

    def add(fn: Query) -> Query:
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: _rounded(fn(spark, folder), digits)
        if sql is not None:
            body = o.rounded(sql, plain, doubles, digits) if plain or doubles else sql
            ORACLES[name] = o.with_ctes(body, needs, extra)
        return fn

    return add


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


# --- scans, sources, sinks -------------------------------------------------------------

PERSON_SCAN = ["YEAR", "SERIAL", "PERNUM", "HHWT", "PERWT", "URBAN", "GEO1_VN", "LIVEAREA", "AGE", "SEX", "EDATTAIN"]


@query(f"SELECT {', '.join(PERSON_SCAN)} FROM census", ["census"])
def scan_persons(spark, folder):
    return read_census(spark, folder).select(*PERSON_SCAN)


@query("SELECT l_orderkey AS L_ORDERKEY, l_quantity AS L_QUANTITY FROM lineitem")
def scan_pruned(spark, folder):
    return scan(spark, f"{folder}/lineitem.parquet", ["L_OrderKey", "L_QUANTITY", "NOT_THERE"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def source_loose_csv(spark, folder):
    row = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")
    # Every data line is wrapped in the kinds of stray lines the source has to skip.
    wrapped = F.array(
        F.lit("c_custkey,c_name,c_mktsegment"), F.lit("```csv"), F.lit("---"), F.concat(F.lit("# "), row), F.lit("  "),
        F.concat(F.lit("note about "), F.col("c_name")), F.concat(F.lit("  "), row),
    )
    lines = table(spark, folder, "customer").select(F.explode(wrapped).alias("value"))
    return loose_csv.parse_lines(lines, ["c_custkey", "c_name", "c_mktsegment"])


def _yearly_totals(spark, folder) -> DataFrame:
    """Wide yearly series: one row per order status, one column per year, an empty last year."""
    wide = (
        table(spark, folder, "orders")
        .select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_totalprice")
        .groupBy("o_orderstatus")
        .pivot("y", list(range(1995, 2002)))
        .agg(F.round(F.sum("o_totalprice"), 2))
    )
    return wide.withColumn("2025", F.lit(None).cast("double"))


_SERIES = (
    "SELECT s.o_orderstatus, CAST(y.year AS INTEGER) AS year, t.value FROM (SELECT DISTINCT o_orderstatus FROM orders) s "
    "CROSS JOIN (SELECT unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001, 2025]) AS year) y LEFT JOIN ("
    "SELECT o_orderstatus, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL) t "
    "ON s.o_orderstatus = t.o_orderstatus AND y.year = t.year"
)


@query("SELECT o_orderstatus, year, round(value, 1) AS value FROM (" + _SERIES + ")")
def unpivot_series(spark, folder):
    long = loose_csv.unpivot_years(_yearly_totals(spark, folder), ["o_orderstatus"])
    return long.withColumn("value", F.round("value", 1))


@query(
    "SELECT h.YEAR, avg(ROOMS) AS mean_rooms, CASE WHEN max(s.year) IS NULL THEN 0.0 ELSE max(s.value) / 1e9 END AS Macro_Metric "
    "FROM hh h LEFT JOIN (" + _SERIES + ") s ON s.year = h.YEAR AND s.o_orderstatus = 'O' GROUP BY h.YEAR",
    ["hh"], ["YEAR"], ["mean_rooms", "Macro_Metric"],
)
def macro_micro_join(spark, folder):
    means = profiles.yearly_mean(survey(spark, folder).households, "ROOMS").withColumnRenamed("ROOMS", "mean_rooms")
    series = loose_csv.unpivot_years(_yearly_totals(spark, folder), ["o_orderstatus"])
    return tb.join_yearly_series(means, series.filter(F.col("o_orderstatus") == "O"))


@query(f"SELECT {', '.join(settings.PERSON_COLUMNS)}, IS_WORKING_AGE FROM person", ["person"])
def sink_roundtrip(spark, folder):
    path = new_stage_path(spark, "sink")
    persons = survey(spark, folder).persons
    write_table(persons, path, ["YEAR"])
    return spark.read.schema(persons.schema).parquet(path).select(*persons.columns)


# --- cleaning ------------------------------------------------------------------------


@query("SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, c_nationkey AS C_NATIONKEY FROM customer")
def standardize_columns(spark, folder):
    return upper_names(table(spark, folder, "customer").select(
        F.col("c_custkey").alias(" c_custkey"), F.col("c_name").alias("c_Name  "), "c_nationkey"
    ))


@query(f"SELECT {', '.join(o.COLUMNS)} FROM nulled", ["nulled"])
def missing_rules(spark, folder):
    return apply_missing_rules(read_census(spark, folder), CENSUS_RULES)


@query(f"SELECT {', '.join(o.COLUMNS)} FROM clean", ["clean"])
def type_cleaning(spark, folder):
    return clean_types(apply_missing_rules(read_census(spark, folder), CENSUS_RULES))


@query(f"SELECT {', '.join(o.HARM_COLUMNS)} FROM harm", ["harm"])
def harmonize_codes(spark, folder):
    return clean_and_harmonize(read_census(spark, folder), CENSUS_RULES)


@query("SELECT YEAR, SERIAL, PERNUM, CASE WHEN EDATTAIN IN ('1', '2') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_basic FROM clean", ["clean"])
def binary_indicator(spark, folder):
    return survey(spark, folder).harmonized.select("YEAR", "SERIAL", "PERNUM", indicator("EDATTAIN").alias("has_basic"))


@query("SELECT * FROM person", ["person"])
def person_table(spark, folder):
    return survey(spark, folder).persons


@query(
    "SELECT p_partkey, p_type, TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS brand_digits, "
    "TRY_CAST(regexp_extract(p_type, '(\\d+)', 1) AS DOUBLE) AS type_digits FROM part"
)
def digit_extract(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", "p_type", digits("p_brand").alias("brand_digits"), digits("p_type").alias("type_digits")
    )


@query("SELECT YEAR, SERIAL, PERNUM, EDATTAIN FROM clean WHERE EDATTAIN IS NULL OR EDATTAIN NOT IN ('0', '9')", ["clean"])
def exclude_codes(spark, folder):
    kept = survey(spark, folder).harmonized.filter(not_excluded("EDATTAIN"))
    return kept.select("YEAR", "SERIAL", "PERNUM", "EDATTAIN")


@query(
    "SELECT YEAR, SERIAL, CASE WHEN AREA_PER_PERSON IS NULL THEN NULL WHEN AREA_PER_PERSON <= a THEN 'low' "
    "WHEN AREA_PER_PERSON <= b THEN 'mid' ELSE 'high' END AS AREA_BIN FROM (SELECT *, "
    "quantile_cont(AREA_PER_PERSON, 1.0 / 3) OVER () AS a, quantile_cont(AREA_PER_PERSON, 2.0 / 3) OVER () AS b FROM hh)",
    ["hh"],
)
def qcut_bins(spark, folder):
    binned = bayes.quantile_bins(survey(spark, folder).households, "AREA_PER_PERSON", ["low", "mid", "high"], "AREA_BIN")
    return binned.select("YEAR", "SERIAL", "AREA_BIN")


@query(
    "SELECT YEAR, SERIAL, CASE WHEN GEO1_VN IN (SELECT GEO1_VN FROM (SELECT GEO1_VN, count(*) AS n FROM hh "
    "WHERE GEO1_VN IS NOT NULL GROUP BY GEO1_VN) ORDER BY n DESC, GEO1_VN LIMIT 12) THEN GEO1_VN ELSE 'OTHER' END AS GEO1_VN FROM hh",
    ["hh"],
)
def lump_top_n(spark, folder):
    return bayes.lump_top_n(survey(spark, folder).households, "GEO1_VN", 12).select("YEAR", "SERIAL", "GEO1_VN")


# --- tables and joins ----------------------------------------------------------------


@query("SELECT * FROM hh", ["hh"], [c for c in o.HOUSEHOLD_COLUMNS if "_PER_" not in c], ["AREA_PER_PERSON", "ROOMS_PER_PERSON"])
def household_rollup(spark, folder):
    return tb.household_rollup(survey(spark, folder).harmonized)


@query(
    "SELECT YEAR, SERIAL, PERNUM, PERWT, AGE, SEX FROM (SELECT *, row_number() OVER (PARTITION BY YEAR, SERIAL "
    "ORDER BY PERNUM, PERWT, AGE, SEX) AS rn FROM clean) WHERE rn = 1",
    ["clean"],
)
def dedup_keep_first(spark, folder):
    rows = survey(spark, folder).harmonized.select("YEAR", "SERIAL", "PERNUM", "PERWT", "AGE", "SEX")
    return tb.dedup_keep_first(rows, ["YEAR", "SERIAL"], ["PERNUM"])


@query("SELECT YEAR, SERIAL, PERNUM, SEX_H, wealth_class, wealth_index FROM pw", ["pw"],
       ["YEAR", "SERIAL", "PERNUM", "SEX_H", "wealth_class"], ["wealth_index"], digits=4)
def person_wealth_join(spark, folder):
    return survey(spark, folder).persons_with_wealth.select("YEAR", "SERIAL", "PERNUM", "SEX_H", "wealth_class", "wealth_index")


@query("SELECT YEAR, SERIAL, PERNUM, EDATTAIN_H, BIRTH_YEAR_PROXY, COHORT_DECADE, wealth_class, URBAN_H AS URBAN_H_HH, wealth_index FROM edu", ["edu"],
       ["YEAR", "SERIAL", "PERNUM", "COHORT_DECADE", "wealth_class", "URBAN_H_HH"], ["EDATTAIN_H", "BIRTH_YEAR_PROXY", "wealth_index"], digits=4)
def person_household_join(spark, folder):
    return survey(spark, folder).education.select(
        "YEAR", "SERIAL", "PERNUM", "COHORT_DECADE", "wealth_class", "URBAN_H_HH", "EDATTAIN_H", "BIRTH_YEAR_PROXY", "wealth_index"
    )


# --- aggregates ----------------------------------------------------------------------

_SUMMARY = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"stddev_samp({c}) AS std, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM enriched"
    for c in settings.SUMMARY_VARS
)


@query(_SUMMARY, ["enriched"], ["variable", "count"], ["mean", "min", "max", "std", "q25", "q50", "q75"])
def summary_stats(spark, folder):
    return profiles.summary_stats(survey(spark, folder).enriched)


@query("SELECT YEAR, sum(wealth_index * HHWT) / nullif(sum(HHWT), 0) AS wealth_index FROM enriched "
       "WHERE wealth_index IS NOT NULL AND HHWT IS NOT NULL GROUP BY YEAR", ["enriched"], ["YEAR"], ["wealth_index"])
def yearly_weighted_mean(spark, folder):
    return profiles.yearly_mean(survey(spark, folder).enriched, "wealth_index", "HHWT")


@query("SELECT SEX_H, sum(x * PERWT) / nullif(sum(PERWT), 0) AS mean_education FROM (SELECT SEX_H, PERWT, TRY_CAST(EDATTAIN_H AS DOUBLE) AS x FROM person) "
       "WHERE x IS NOT NULL AND PERWT IS NOT NULL GROUP BY SEX_H", ["person"], ["SEX_H"], ["mean_education"])
def weighted_mean_by_sex(spark, folder):
    return survey(spark, folder).persons.groupBy("SEX_H").agg(
        weighted_mean(number("EDATTAIN_H"), "PERWT").alias("mean_education")
    )


def _gini_sql(value: str, source: str, keys: str) -> str:
    return (
        f"SELECT {keys}, 1 - sum(w * (2 * c - xw)) / (sum(w) * sum(xw)) AS GINI FROM (SELECT *, sum(xw) OVER (PARTITION BY {keys} "
        f"ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (SELECT {keys}, x, w, x * w AS xw FROM "
        f"(SELECT {keys}, {value} - least(min({value}) OVER (PARTITION BY {keys}), 0) AS x, HHWT AS w FROM {source} "
        f"WHERE {value} IS NOT NULL AND HHWT IS NOT NULL))) GROUP BY {keys}"
    )


_ASSET_SQL = "coalesce(LIVEAREA, 0) + coalesce(MOTORCYCLE, 0) + coalesce(AUTOS, 0) + coalesce(TRY_CAST(ELECTRIC_H AS DOUBLE), 0)"
ASSETS = ["LIVEAREA", "MOTORCYCLE", "AUTOS", "ELECTRIC_H"]


@query(_gini_sql("score", f"(SELECT YEAR, URBAN_H, HHWT, {_ASSET_SQL} AS score FROM hh)", "YEAR, URBAN_H"), ["hh"], ["YEAR", "URBAN_H"], ["GINI"])
def weighted_gini(spark, folder):
    scored = indices.asset_score(survey(spark, folder).households, ASSETS, "score")
    return gini(scored, ["YEAR", "URBAN_H"], "score", "HHWT")


@query(_gini_sql("wealth_index", "enriched", "YEAR"), ["enriched"], ["YEAR"], ["GINI"])
def yearly_gini(spark, folder):
    return gini(survey(spark, folder).enriched, ["YEAR"], "wealth_index", "HHWT")


@query("SELECT YEAR, URBAN_H AS URBAN_CODE, avg(wealth_index) AS mean_wealth_index, count(*) AS n_households, "
       "CASE URBAN_H WHEN '1' THEN 'Urban' WHEN '0' THEN 'Rural' ELSE URBAN_H END AS URBAN_LABEL FROM enriched "
       "WHERE URBAN_H IS NOT NULL GROUP BY YEAR, URBAN_H", ["enriched"], ["YEAR", "URBAN_CODE", "n_households", "URBAN_LABEL"], ["mean_wealth_index"])
def urban_rural_wealth(spark, folder):
    return profiles.urban_rural_wealth(survey(spark, folder).enriched)


def _gap_sql(keys: str, rate: bool) -> str:
    def mean(c: str) -> str:
        return f"sum({c} * PERWT) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN PERWT END), 0)"

    present = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    extra = ", avg(CASE WHEN CLASSWK_H IS NOT NULL THEN 1.0 ELSE 0.0 END) AS CLASSWK_OBSERVED_RATE" if rate else ""
    return (
        f"SELECT {keys}, count(*) AS N_PERSONS, {mean('e')} AS MEAN_EDUCATION_ATTAINMENT, {mean('AGE')} AS MEAN_AGE, "
        f"{mean('wealth_index')} AS MEAN_HOUSEHOLD_WEALTH{extra} FROM (SELECT *, TRY_CAST(EDATTAIN_H AS DOUBLE) AS e FROM pw) WHERE {present} GROUP BY {keys}"
    )


_GAP = ["MEAN_EDUCATION_ATTAINMENT", "MEAN_AGE", "MEAN_HOUSEHOLD_WEALTH"]


@query(_gap_sql("YEAR, SEX_H", True), ["pw"], ["YEAR", "SEX_H", "N_PERSONS"], [*_GAP, "CLASSWK_OBSERVED_RATE"])
def gender_gap_year(spark, folder):
    return profiles.gender_gap(survey(spark, folder).persons_with_wealth, ["YEAR", "SEX_H"])


@query(_gap_sql("YEAR, URBAN_H, SEX_H", False), ["pw"], ["YEAR", "URBAN_H", "SEX_H", "N_PERSONS"], _GAP)
def gender_gap_year_urban(spark, folder):
    return profiles.gender_gap(survey(spark, folder).persons_with_wealth, ["YEAR", "URBAN_H", "SEX_H"], observed_rate=False)


@query("SELECT COHORT_DECADE, YEAR, avg(EDATTAIN_H) AS mean_education_attainment, avg(wealth_index) AS mean_household_wealth, count(*) AS n_persons "
       "FROM edu GROUP BY COHORT_DECADE, YEAR", ["edu"], ["COHORT_DECADE", "YEAR", "n_persons"], ["mean_education_attainment", "mean_household_wealth"])
def cohort_profiles(spark, folder):
    return profiles.cohort_profiles(survey(spark, folder).education)


@query("SELECT YEAR, EDATTAIN_H, avg(CASE WHEN wealth_class = 'rich' THEN 1.0 ELSE 0.0 END) AS rich_probability, avg(wealth_index) AS mean_WEALTH_INDEX, "
       "count(*) AS n_persons FROM edu GROUP BY YEAR, EDATTAIN_H", ["edu"], ["YEAR", "n_persons"], ["EDATTAIN_H", "rich_probability", "mean_WEALTH_INDEX"])
def education_rich_prob(spark, folder):
    return profiles.education_rich_probability(survey(spark, folder).education)


@query("SELECT * FROM regions", ["regions"], ["YEAR", "GEO1_VN", "household_count"], ["wealth_x_weight", "weight_sum", "weighted_mean_wealth"])
def region_year_wealth(spark, folder):
    return profiles.region_year_wealth(survey(spark, folder).enriched)


@query("SELECT YEAR, stddev_samp(weighted_mean_wealth) AS sigma_std, count(DISTINCT GEO1_VN) AS region_count FROM regions GROUP BY YEAR",
       ["regions"], ["YEAR", "region_count"], ["sigma_std"])
def sigma_convergence(spark, folder):
    # The relative spread divides by a mean near zero here; it is checked on the asset score below.
    return profiles.sigma_convergence(profiles.region_year_wealth(survey(spark, folder).enriched)).drop("sigma_cv")


@query("SELECT YEAR, stddev_samp(m) AS sigma_std, stddev_samp(m) / nullif(avg(m), 0) AS sigma_cv, count(*) AS region_count FROM "
       f"(SELECT YEAR, GEO1_VN, sum(score * HHWT) / sum(HHWT) AS m FROM (SELECT *, {_ASSET_SQL} AS score FROM hh) GROUP BY YEAR, GEO1_VN) GROUP BY YEAR",
       ["hh"], ["YEAR", "region_count"], ["sigma_std", "sigma_cv"])
def sigma_convergence_assets(spark, folder):
    scored = indices.asset_score(survey(spark, folder).households, ASSETS, "score")
    return profiles.sigma_convergence(profiles.region_year_wealth(scored, "score"))


@query("SELECT * FROM (SELECT URBAN_H, CASE WHEN YEAR <= 1999 THEN 'early' WHEN YEAR <= 2009 THEN 'middle' ELSE 'late' END AS PERIOD_GROUP, "
       "avg(wealth_index) AS mean_wealth_index, stddev_samp(wealth_index) AS gini_proxy_std, count(*) AS n_households FROM enriched "
       "WHERE URBAN_H IS NOT NULL GROUP BY 1, 2) WHERE n_households >= 100", ["enriched"],
       ["URBAN_H", "PERIOD_GROUP", "n_households"], ["mean_wealth_index", "gini_proxy_std"])
def subgroup_sensitivity(spark, folder):
    return profiles.subgroup_sensitivity(survey(spark, folder).enriched)


# --- data quality --------------------------------------------------------------------


def _audit_sql(select: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT YEAR, '{c}' AS VARIABLE, " + select.replace("{c}", c) + " FROM harm WHERE YEAR IS NOT NULL GROUP BY YEAR" for c in columns
    )


_MISSING_SQL = _audit_sql("count(*) AS N_ROWS, count(*) - count({c}) AS N_MISSING, (count(*) - count({c})) / count(*) AS MISSING_RATE", o.HARM_COLUMNS)


@query(
    _audit_sql(
        "count(*) AS N_ROWS, count(*) - count({c}) AS N_MISSING, count({c}) AS SUM_NON_MISSING, count(DISTINCT {c}) AS N_UNIQUE, "
        "(count(*) - count({c})) / count(*) AS MISSING_RATE", o.HARM_COLUMNS,
    ),
    ["harm"], ["YEAR", "VARIABLE", "N_ROWS", "N_MISSING", "SUM_NON_MISSING", "N_UNIQUE"], ["MISSING_RATE"],
)
def column_audit(spark, folder):
    return quality.column_audit(survey(spark, folder).harmonized)


@query(_MISSING_SQL, ["harm"], ["YEAR", "VARIABLE", "N_ROWS", "N_MISSING"], ["MISSING_RATE"])
def missingness(spark, folder):
    return quality.missingness(survey(spark, folder).harmonized)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS VARIABLE, " + ", ".join(f"CAST(count({c}) FILTER (WHERE YEAR = {y}) > 0 AS INTEGER) AS YEAR_{y}" for y in YEARS) + " FROM harm"
        for c in o.HARM_COLUMNS
    ),
    ["harm"],
)
def year_coverage(spark, folder):
    return quality.coverage_matrix(quality.year_coverage(survey(spark, folder).harmonized), YEARS)


_DUPS = (
    "SELECT 'HOUSEHOLD_ID_DUPLICATES' AS \"CHECK\", CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS VALUE FROM (SELECT count(*) AS n FROM harm GROUP BY YEAR, SERIAL) "
    "UNION ALL SELECT 'PERSON_ID_DUPLICATES', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM harm GROUP BY YEAR, SERIAL, PERNUM)"
)
_LOGIC = " UNION ALL ".join(f"SELECT '{n}' AS \"CHECK\", count(*) FILTER (WHERE {sql}) AS N_FAIL FROM harm" for n, (_, sql) in quality.LOGICAL_CHECKS.items())


@query(_DUPS, ["harm"])
def duplicate_ids(spark, folder):
    return quality.duplicate_ids(survey(spark, folder).harmonized)


@query(_LOGIC, ["harm"])
def logical_checks(spark, folder):
    return quality.logical_checks(survey(spark, folder).harmonized)


@query(f"SELECT \"CHECK\", N_FAIL, CAST(NULL AS BIGINT) AS VALUE FROM ({_LOGIC}) UNION ALL SELECT \"CHECK\", NULL, VALUE FROM ({_DUPS})", ["harm"])
def check_report(spark, folder):
    return quality.check_report(survey(spark, folder).harmonized)


def _values(rows: list[tuple], names: str) -> str:
    def text(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + f") AS t({names})"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


_OBSERVED = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS VARIABLE, YEAR FROM harm WHERE {c} IS NOT NULL AND YEAR IS NOT NULL" for c in o.HARM_COLUMNS)
_DICTIONARY = _values(settings.VARIABLE_DICTIONARY, "variable_name, level, dtype, description, use_in_analysis")


@query(
    "SELECT VARIABLE, CAST(VARIABLE IN (SELECT variable_name FROM " + _DICTIONARY + ") AS INTEGER) AS IN_VARIABLE_DICTIONARY, "
    f"CAST(VARIABLE IN {_in(CENSUS_RULES.missing)} AS INTEGER) AS HAS_MISSING_RULE, CAST(VARIABLE IN {_in(CENSUS_RULES.mapping)} AS INTEGER) AS HAS_HARMONIZATION_RULE, "
    f"CAST(VARIABLE IN {_in(settings.HARMONIZE_VARS)} AS INTEGER) AS IS_TARGET_HARMONIZE_VAR FROM (SELECT DISTINCT VARIABLE FROM ({_MISSING_SQL}))",
    ["harm"],
)
def metadata_usage(spark, folder):
    coverage = quality.year_coverage(survey(spark, folder).harmonized)
    return quality.metadata_usage(coverage, CENSUS_RULES, dictionary_frame(spark))


@query(
    "SELECT v.VARIABLE AS variable_name, d.level, d.dtype, d.description, d.use_in_analysis, v.years_available, "
    f"CAST(v.VARIABLE IN {_in(CENSUS_RULES.mapping)} AS INTEGER) AS has_harmonization_rules, "
    f"CAST(v.VARIABLE LIKE '%\\_H' ESCAPE '\\' OR v.VARIABLE IN {_in(settings.HARMONIZE_VARS)} AS INTEGER) AS has_harmonized_version, "
    "CAST(d.variable_name IS NOT NULL AS INTEGER) AS documented_in_metadata FROM "
    f"(SELECT VARIABLE, array_to_string(list_sort(list(YEAR)), ' | ') AS years_available FROM ({_OBSERVED}) GROUP BY VARIABLE) v "
    f"LEFT JOIN (SELECT * FROM {_DICTIONARY}) d ON d.variable_name = v.VARIABLE",
    ["harm"],
)
def variable_docs(spark, folder):
    coverage = quality.year_coverage(survey(spark, folder).harmonized)
    return quality.variable_docs(coverage, CENSUS_RULES, dictionary_frame(spark))


def _codes_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS VARIABLE, YEAR, {c} AS code, count(*) AS n FROM harm WHERE {c} IS NOT NULL GROUP BY YEAR, {c}" for c in columns
    )


_CATEGORIES = [c for c in settings.CATEGORICAL_VARS if c in o.HARM_COLUMNS]


@query(
    "SELECT c.VARIABLE, c.YEAR, len(codes) AS N_CODES, array_to_string(top[1:10], ' | ') AS TOP_CODES, "
    "array_to_string(fresh[1:10], ' | ') AS NEW_CODES_VS_PREVIOUS_YEAR, array_to_string(gone[1:10], ' | ') AS DISAPPEARED_CODES_VS_PREVIOUS_YEAR, "
    "CAST(prev IS NOT NULL AND (len(fresh) > 0 OR len(gone) > 0) AS INTEGER) AS FLAG_CATEGORY_SHIFT FROM ("
    "SELECT *, list_sort(list_filter(codes, lambda x: prev IS NULL OR NOT list_contains(prev, x))) AS fresh, "
    "list_sort(list_filter(coalesce(prev, []), lambda x: NOT list_contains(codes, x))) AS gone FROM ("
    "SELECT *, lag(codes) OVER (PARTITION BY VARIABLE ORDER BY YEAR) AS prev FROM ("
    "SELECT VARIABLE, YEAR, list(code ORDER BY code) AS codes, list(code || ':' || n ORDER BY n DESC, code) AS top FROM codes GROUP BY VARIABLE, YEAR))) c",
    ["harm"], extra=[("codes", _codes_sql(_CATEGORIES))],
)
def category_consistency(spark, folder):
    return quality.category_consistency(survey(spark, folder).harmonized)


_COVERED = " OR ".join(
    f"(VARIABLE = '{v}' AND YEAR {'=' if y != 'ALL' else '<>'} {y if y != 'ALL' else (next((k for k in ys if k != 'ALL'), '0'))} AND code IN {_in(m)})"
    for v, ys in CENSUS_RULES.mapping.items() for y, m in ys.items()
)
_RULED = " OR ".join(
    f"(VARIABLE = '{v}'" + ("" if "ALL" in ys else f" AND YEAR IN ({', '.join(ys)})") + ")" for v, ys in CENSUS_RULES.mapping.items()
)


@query(
    "SELECT VARIABLE, YEAR, CAST(sum(n) AS BIGINT) AS NON_MISSING_RAW, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS COVERED_BY_RULES, "
    "1 AS HAS_HARMONIZED_COLUMN, CAST(bool_or(ruled) AS INTEGER) AS HAS_RULES, sum(CASE WHEN hit THEN n ELSE 0 END) / sum(n) AS COVERAGE_RATE, "
    "array_to_string(coalesce(list(code || ':' || n ORDER BY n DESC, code) FILTER (WHERE NOT hit), [])[1:10], ' | ') AS TOP_UNRESOLVED_CODES "
    f"FROM (SELECT *, {_COVERED} AS hit, {_RULED} AS ruled FROM codes) GROUP BY VARIABLE, YEAR",
    ["harm"], ["VARIABLE", "YEAR", "NON_MISSING_RAW", "COVERED_BY_RULES", "HAS_HARMONIZED_COLUMN", "HAS_RULES", "TOP_UNRESOLVED_CODES"], ["COVERAGE_RATE"],
    extra=[("codes", _codes_sql(settings.HARMONIZE_VARS))],
)
def harmonization_coverage(spark, folder):
    return quality.harmonization_coverage(survey(spark, folder).harmonized, CENSUS_RULES)


_MEASURES = [c for c in settings.CONTINUOUS_VARS if c in o.HARM_COLUMNS]
_OUTLIERS = " UNION ALL ".join(
    f"SELECT '{c}' AS VARIABLE, YEAR, avg(x) AS MEAN, max(q2) AS MEDIAN, stddev_samp(x) AS STD, max(p1) AS P01, max(p99) AS P99, "
    f"avg(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS OUTLIER_RATE_IQR FROM ("
    f"SELECT YEAR, x, quantile_cont(x, 0.01) OVER w AS p1, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.5) OVER w AS q2, "
    f"quantile_cont(x, 0.75) OVER w AS q3, quantile_cont(x, 0.99) OVER w AS p99 FROM (SELECT YEAR, CAST({c} AS DOUBLE) AS x FROM harm WHERE {c} IS NOT NULL) "
    f"WINDOW w AS (PARTITION BY YEAR)) GROUP BY YEAR"
    for c in _MEASURES
)
_OUTLIER_COLUMNS = ["MEAN", "MEDIAN", "STD", "P01", "P99", "OUTLIER_RATE_IQR"]


@query(_OUTLIERS, ["harm"], ["VARIABLE", "YEAR"], _OUTLIER_COLUMNS)
def outlier_summary(spark, folder):
    return quality.outlier_summary(survey(spark, folder).harmonized)


@query(
    "SELECT VARIABLE, FROM_YEAR, YEAR AS TO_YEAR, MEAN - m AS MEAN_CHANGE, MEDIAN - q AS MEDIAN_CHANGE, (MEAN - m) / nullif((STD + s) / 2, 0) AS STANDARDIZED_MEAN_CHANGE, "
    "CAST(coalesce(abs((MEAN - m) / nullif((STD + s) / 2, 0)) >= 1, false) AS INTEGER) AS FLAG_STRUCTURAL_BREAK FROM ("
    "SELECT *, lag(YEAR) OVER w AS FROM_YEAR, lag(MEAN) OVER w AS m, lag(MEDIAN) OVER w AS q, lag(STD) OVER w AS s FROM (" + _OUTLIERS + ") "
    "WINDOW w AS (PARTITION BY VARIABLE ORDER BY YEAR)) WHERE FROM_YEAR IS NOT NULL",
    ["harm"], ["VARIABLE", "FROM_YEAR", "TO_YEAR", "FLAG_STRUCTURAL_BREAK"], ["MEAN_CHANGE", "MEDIAN_CHANGE", "STANDARDIZED_MEAN_CHANGE"],
)
def structural_breaks(spark, folder):
    return quality.structural_breaks(quality.outlier_summary(survey(spark, folder).harmonized))


# --- sampling and splits -------------------------------------------------------------

_SAMPLE = ["YEAR", "SERIAL", "URBAN_H", "HHWT"]


@query("SELECT YEAR, SERIAL, URBAN_H, HHWT FROM hh ORDER BY md5('42|' || YEAR || '|' || SERIAL), YEAR, SERIAL LIMIT 1000", ["hh"])
def priority_sample(spark, folder):
    return sampling.priority_sample(survey(spark, folder).households.select(*_SAMPLE), KEYS, 1000)


@query(
    "SELECT YEAR, SERIAL, wealth_class, CASE WHEN CAST('0x' || substr(md5('42|' || wealth_class || '|' || YEAR || '|' || SERIAL), 1, 8) AS BIGINT) % 100 < 80 "
    "THEN 'train' ELSE 'test' END AS split FROM enriched WHERE wealth_class IS NOT NULL", ["enriched"],
)
def stratified_split(spark, folder):
    rows = survey(spark, folder).enriched.filter(F.col(TARGET).isNotNull()).select(*KEYS, TARGET)
    return sampling.stratified_split(rows, KEYS, TARGET)


@query(
    "SELECT t.YEAR AS test_year, array_to_string(list_sort(list(DISTINCT e.YEAR)), ' | ') AS train_years, CAST(sum(e.n) AS BIGINT) AS n_train, max(t.n) AS n_test "
    "FROM (SELECT YEAR, count(*) AS n FROM enriched WHERE wealth_class IS NOT NULL GROUP BY YEAR) t JOIN "
    "(SELECT YEAR, count(*) AS n FROM enriched WHERE wealth_class IS NOT NULL GROUP BY YEAR) e ON e.YEAR < t.YEAR GROUP BY t.YEAR", ["enriched"],
)
def temporal_folds(spark, folder):
    return sampling.temporal_folds(survey(spark, folder).enriched, TARGET)


# --- indices -------------------------------------------------------------------------


_POOLED = ["LIVEAREA", "ROOMS", "HOUSEHOLD_SIZE", "VEHICLE_COUNT"]
_POOL_SOURCE = ("pool", "SELECT 0 AS YEAR, YEAR AS y, SERIAL AS s, YEAR || '/' || SERIAL AS SERIAL, " + ", ".join(_POOLED) + " FROM hh")


@query(
    "SELECT p.y AS YEAR, p.s AS SERIAL, c.score AS space_index FROM pool p JOIN pc_score c ON c.SERIAL = p.SERIAL", ["hh"],
    ["YEAR", "SERIAL"], ["space_index"], extra=[_POOL_SOURCE, *o.component_ctes("pc", "pool", {0: _POOLED})], digits=4
)
def pca_index(spark, folder):
    return indices.pca_index(survey(spark, folder).households, _POOLED, "space_index").select("YEAR", "SERIAL", "space_index")


@query("SELECT YEAR, i AS variable, w AS loading FROM wp_lead", ["wp_lead"], ["YEAR", "variable"], ["loading"])
def wealth_loadings(spark, folder):
    hh = survey(spark, folder).households
    return indices.loadings_table(hh, indices.fit_components(hh, settings.ASSET_VARS_BY_YEAR))


@query("SELECT YEAR, i AS variable, w AS loading FROM gp_lead", ["gp_lead"], ["YEAR", "variable"], ["loading"])
def housing_loadings(spark, folder):
    hh = survey(spark, folder).households
    return indices.loadings_table(hh, indices.fit_components(hh, settings.HOUSING_VARS_BY_YEAR))


@query("SELECT YEAR, SERIAL, wealth_class, wealth_index, housing_quality_index FROM enriched", ["enriched"],
       ["YEAR", "SERIAL", "wealth_class"], ["wealth_index", "housing_quality_index"], digits=4)
def household_indices(spark, folder):
    scored = indices.household_indices(survey(spark, folder).households)
    return scored.select("YEAR", "SERIAL", "wealth_class", "wealth_index", "housing_quality_index")


@query(
    "SELECT YEAR, SERIAL, CASE WHEN score <= a THEN 'poor' WHEN score <= b THEN 'middle' ELSE 'rich' END AS wealth_class, score FROM ("
    f"SELECT *, quantile_cont(score, 0.3) OVER (PARTITION BY YEAR) AS a, quantile_cont(score, 0.7) OVER (PARTITION BY YEAR) AS b FROM (SELECT *, {_ASSET_SQL} AS score FROM hh))",
    ["hh"], ["YEAR", "SERIAL", "wealth_class"], ["score"],
)
def wealth_class(spark, folder):
    scored = indices.asset_score(survey(spark, folder).households, ASSETS, "score")
    return indices.wealth_class(scored, "score").select("YEAR", "SERIAL", "wealth_class", "score")


@query(f"SELECT YEAR, SERIAL, {_ASSET_SQL} AS asset_score_simple FROM hh", ["hh"], ["YEAR", "SERIAL"], ["asset_score_simple"])
def asset_score(spark, folder):
    return indices.asset_score(survey(spark, folder).households, ASSETS).select("YEAR", "SERIAL", "asset_score_simple")


@query("SELECT YEAR, SERIAL, (AREA_PER_PERSON - min(AREA_PER_PERSON) OVER ()) / (max(AREA_PER_PERSON) OVER () - min(AREA_PER_PERSON) OVER ()) * 100 AS scaled FROM hh",
       ["hh"], ["YEAR", "SERIAL"], ["scaled"])
def minmax_scale(spark, folder):
    return indices.minmax(survey(spark, folder).households, "AREA_PER_PERSON", "scaled").select("YEAR", "SERIAL", "scaled")


_DIGITS = ("dig", "SELECT 0 AS YEAR, YEAR AS y, SERIAL AS s, YEAR || '/' || SERIAL AS SERIAL, URBAN_H AS u, " + ", ".join(
    f"TRY_CAST(regexp_extract({v}, '(\\d+)', 1) AS DOUBLE) AS {v}" for v in settings.PROGRESS_VARS) + " FROM hh")
_PROGRESS = ("progress", "SELECT y AS YEAR, s AS SERIAL, u AS URBAN_H, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100 AS wealth_progress_index FROM ("
             "SELECT d.*, score * (CASE WHEN avg(CASE WHEN y = 1989 THEN score END) OVER () > avg(CASE WHEN y = 2019 THEN score END) OVER () THEN -1 ELSE 1 END) AS v "
             "FROM dig d JOIN dg_score g ON g.SERIAL = d.SERIAL)")
_PROGRESS_CTES = [_DIGITS, *o.component_ctes("dg", "dig", {0: settings.PROGRESS_VARS}), _PROGRESS]


@query("SELECT YEAR, SERIAL, wealth_progress_index FROM progress", ["hh"], ["YEAR", "SERIAL"], ["wealth_progress_index"], extra=_PROGRESS_CTES, digits=4)
def progress_index(spark, folder):
    return indices.progress_index(survey(spark, folder).households).select("YEAR", "SERIAL", "wealth_progress_index")


@query("SELECT YEAR, URBAN_H, CAST(grouping(YEAR, URBAN_H) AS INTEGER) AS \"grouping\", avg(wealth_progress_index) AS mean_index, count(*) AS n_obs FROM progress "
       "GROUP BY GROUPING SETS ((YEAR), (YEAR, URBAN_H))", ["hh"], ["YEAR", "URBAN_H", "\"grouping\"", "n_obs"], ["mean_index"], extra=_PROGRESS_CTES)
def progress_means(spark, folder):
    scored = indices.progress_index(survey(spark, folder).households)
    return indices.progress_means(scored, [["YEAR"], ["YEAR", "URBAN_H"]])


# Person ids repeat in the tables, so rows are numbered.
_SCHOOLED = ("schooled", "SELECT 0 AS YEAR, YEAR AS y, CAST(row_number() OVER () AS VARCHAR) AS SERIAL, EDATTAIN_H AS e, " + ", ".join(
    f"TRY_CAST(regexp_extract({v}, '(\\d+)', 1) AS DOUBLE) AS {v}" for v in settings.PROGRESS_VARS)
    + " FROM harm WHERE EDATTAIN_H IS NULL OR EDATTAIN_H NOT IN ('0', '9')")
_SCHOOLED_SCORE = ("oriented", "SELECT d.*, score * (CASE WHEN avg(CASE WHEN y = 1989 THEN score END) OVER () > avg(CASE WHEN y = 2019 THEN score END) OVER () "
                   "THEN -1 ELSE 1 END) AS v FROM schooled d JOIN sl_score g ON g.SERIAL = d.SERIAL")


@query("SELECT y AS YEAR, e AS EDATTAIN_H, avg(scaled) AS mean_index, count(*) AS n_obs FROM (SELECT *, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100 AS scaled "
       "FROM oriented) WHERE e IS NOT NULL GROUP BY ALL", ["harm"], ["YEAR", "EDATTAIN_H", "n_obs"], ["mean_index"],
       extra=[_SCHOOLED, *o.component_ctes("sl", "schooled", {0: settings.PROGRESS_VARS}), _SCHOOLED_SCORE], digits=4)
def progress_by_schooling(spark, folder):
    return indices.progress_by_schooling(survey(spark, folder).harmonized)


def _rank_sql(source: str, a: str, b: str, keys: str = "YEAR") -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"

    return (
        f"SELECT {keys}, corr(ra, rb) AS rho FROM (SELECT {keys}, {rank('a')} AS ra, {rank('b')} AS rb FROM (SELECT {keys}, {a} AS a, {b} AS b "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) GROUP BY {keys}"
    )


@query(_rank_sql("hh", "AREA_PER_PERSON", "ROOMS_PER_PERSON"), ["hh"], ["YEAR"], ["rho"])
def spearman_rank(spark, folder):
    return spearman(survey(spark, folder).households, ["YEAR"], "AREA_PER_PERSON", "ROOMS_PER_PERSON")


_SIMPLE = "(SELECT *, CASE YEAR " + " ".join(
    f"WHEN {y} THEN " + " + ".join(f"coalesce(TRY_CAST({v} AS DOUBLE), 0)" for v in vs) for y, vs in settings.ASSET_VARS_BY_YEAR.items()
) + " END AS simple FROM enriched)"


@query("SELECT YEAR, 'pca_vs_simple_asset_score' AS comparison, rho AS spearman_rho FROM (" + _rank_sql(_SIMPLE, "wealth_index", "simple") + ")",
       ["enriched"], ["YEAR", "comparison"], ["spearman_rho"])
def robustness_main(spark, folder):
    return indices.robustness_main(survey(spark, folder).enriched)


_WITH_ROOMS = {y: sorted({*v, "ROOMS", "LIVEAREA"}) for y, v in settings.ASSET_VARS_BY_YEAR.items()}


@query(
    " UNION ALL ".join(
        f"SELECT r.YEAR, '{name}' AS specification, n.k AS n_variables, rho AS correlation_with_main_wealth_index FROM ("
        + _rank_sql(f"(SELECT e.*, z.score FROM enriched e JOIN {p}_score z USING (YEAR, SERIAL))", "wealth_index", "score")
        + f") r JOIN (SELECT YEAR, CAST(count(*) AS INTEGER) AS k FROM {p}_lead GROUP BY YEAR) n USING (YEAR)"
        for name, p in [("asset_only", "wp"), ("asset_plus_rooms", "rm"), ("housing_quality_alt", "gp")]
    ),
    ["enriched"], ["YEAR", "specification", "n_variables"], ["correlation_with_main_wealth_index"], extra=o.component_ctes("rm", "hh", _WITH_ROOMS),
)
def robustness_specs(spark, folder):
    return indices.robustness_alternatives(survey(spark, folder).enriched)


# --- regression ----------------------------------------------------------------------


@query(
    "SELECT unnest(['Intercept', 'HOUSEHOLD_SIZE']) AS term, unnest([b0, b1]) AS coefficient, unnest([sqrt(v0 * n / (n - 2)), sqrt(v1 * n / (n - 2))]) AS std_error, "
    "n AS nobs, r2 AS r_squared FROM (SELECT max(b0) AS b0, max(b1) AS b1, max(n) AS n, max(r2) AS r2, sum(e * e * (1.0 / n - mx * (x - mx) / sxx) ** 2) AS v0, "
    "sum(e * e * ((x - mx) / sxx) ** 2) AS v1 FROM (SELECT d.*, f.*, y - b0 - b1 * x AS e FROM "
    "(SELECT CAST(HOUSEHOLD_SIZE AS DOUBLE) AS x, LIVEAREA AS y FROM hh WHERE LIVEAREA IS NOT NULL) d, "
    "(SELECT regr_intercept(LIVEAREA, HOUSEHOLD_SIZE) AS b0, regr_slope(LIVEAREA, HOUSEHOLD_SIZE) AS b1, regr_avgx(LIVEAREA, HOUSEHOLD_SIZE) AS mx, "
    "regr_sxx(LIVEAREA, HOUSEHOLD_SIZE) AS sxx, regr_count(LIVEAREA, HOUSEHOLD_SIZE) AS n, regr_r2(LIVEAREA, HOUSEHOLD_SIZE) AS r2 FROM hh) f))",
    ["hh"], ["term", "CAST(nobs AS BIGINT) AS nobs"], ["coefficient", "std_error", "r_squared"],
)
def ols_hc1(spark, folder):
    fit = regression.ols_hc1(survey(spark, folder).households, "LIVEAREA", ["HOUSEHOLD_SIZE"])
    return fit.select("term", "nobs", "coefficient", "std_error", "r_squared")


_FIT = ["coefficient", "std_error", "p_value", "ci_lower", "ci_upper", "r_squared", "adj_r_squared"]
_HOUSEHOLD_PARTS = ["HOUSEHOLD_SIZE", "AREA_PER_PERSON", "ROOMS_PER_PERSON", "VEHICLE_COUNT", "C(URBAN_H)*C(YEAR)", "C(GEO1_VN)", "C(OWNERSHIP_H)"]
_AGED = ("aged", "SELECT *, AGE ** 2 AS AGE2 FROM pw")


@query(
    "SELECT 'wealth_index' AS model, * FROM hw_fit UNION ALL SELECT 'housing_quality_index', * FROM hq_fit", ["enriched"], ["term", "model", "nobs"], _FIT,
    extra=o.ols_ctes("hw", "enriched", "wealth_index", _HOUSEHOLD_PARTS) + o.ols_ctes("hq", "enriched", "housing_quality_index", _HOUSEHOLD_PARTS),
)
def household_ols(spark, folder):
    return regression.household_models(survey(spark, folder).enriched)


_SWEPT = "term = 'Intercept' OR term LIKE 'C(GEO1_VN)%' OR term LIKE 'C(OWNERSHIP_H)%'"


@query(
    f"SELECT term, 'wealth_index' AS model, nobs, coefficient, CASE WHEN {_SWEPT} THEN NULL ELSE std_error END AS std_error, r_squared, adj_r_squared FROM hw_fit",
    ["enriched"], ["term", "model", "nobs"], ["coefficient", "std_error", "r_squared", "adj_r_squared"],
    extra=o.ols_ctes("hw", "enriched", "wealth_index", _HOUSEHOLD_PARTS),
)
def household_ols_absorbed(spark, folder):
    fit = regression.ols_hc1(survey(spark, folder).enriched, "wealth_index", _HOUSEHOLD_PARTS, absorb=["GEO1_VN", "OWNERSHIP_H"])
    return fit.select("term", "model", "nobs", "coefficient", "std_error", "r_squared", "adj_r_squared")


# One level per household: far more than could be spelled out.
@query(
    "SELECT 'AGE' AS term, n AS nobs, levels - 1 AS n_levels, b AS coefficient, sqrt(v / (sxx * sxx) * n / (n - levels - 1)) AS std_error, 1 - ssr / sst AS r_squared FROM ("
    "SELECT count(*) AS n, max(l) AS levels, max(b) AS b, max(sxx) AS sxx, max(sst) AS sst, sum(x * x * (y - b * x) ** 2) AS v, sum((y - b * x) ** 2) AS ssr FROM w, "
    "(SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, var_pop(raw) * count(*) AS sst, count(DISTINCT (YEAR, SERIAL)) AS l FROM w))",
    ["pw"], ["term", "nobs", "n_levels"], ["coefficient", "std_error", "r_squared"],
    extra=[("w", "SELECT YEAR, SERIAL, e AS raw, e - avg(e) OVER (PARTITION BY YEAR, SERIAL) AS y, AGE - avg(AGE) OVER (PARTITION BY YEAR, SERIAL) AS x FROM "
                 "(SELECT YEAR, SERIAL, AGE, TRY_CAST(EDATTAIN_H AS DOUBLE) AS e FROM pw) WHERE e IS NOT NULL AND AGE IS NOT NULL")],
)
def within_household_ols(spark, folder):
    fit = regression.ols_hc1(survey(spark, folder).persons_with_wealth, "EDATTAIN_H", ["AGE"], absorb=["YEAR*SERIAL"])
    levels = F.count_if(F.col("term").startswith("C(YEAR)")).alias("n_levels")
    one = F.max(F.when(F.col("term") == "AGE", F.struct("nobs", "coefficient", "std_error", "r_squared"))).alias("r")
    return fit.agg(one, levels).select(F.lit("AGE").alias("term"), "r.nobs", "n_levels", "r.coefficient", "r.std_error", "r.r_squared")



@query(
    "SELECT 'person_education_gender_returns' AS model, * FROM pr_fit", ["pw"], ["term", "model", "nobs"], _FIT,
    extra=[_AGED, *o.ols_ctes("pr", "aged", "wealth_index", ["C(EDATTAIN_H)*C(SEX_H)", "C(YEAR)", "AGE", "AGE2", "C(URBAN_H)", "C(GEO1_VN)"])],
)
def person_returns_ols(spark, folder):
    return regression.person_returns(survey(spark, folder).persons_with_wealth)


# Saturated two-factor model: every coefficient is a contrast of cell means.
_CELLS = ("cell", "SELECT CASE SEX_H WHEN 'M' THEN '1' ELSE SEX_H END AS s, YEAR, avg(TRY_CAST(EDATTAIN_H AS DOUBLE)) AS m, "
          "count(TRY_CAST(EDATTAIN_H AS DOUBLE)) AS n, sum((TRY_CAST(EDATTAIN_H AS DOUBLE)) ** 2) AS q FROM person GROUP BY ALL")


@query(
    "SELECT 'C(SEX)[T.2]' AS term, m AS coefficient FROM (SELECT (SELECT m FROM cell WHERE s = '2' AND YEAR = 1989) - (SELECT m FROM cell WHERE s = '1' AND YEAR = 1989) AS m) "
    "UNION ALL SELECT 'Intercept', m FROM cell WHERE s = '1' AND YEAR = 1989 "
    "UNION ALL SELECT 'C(YEAR)[T.' || a.YEAR || ']', a.m - b.m FROM cell a JOIN cell b ON b.s = '1' AND b.YEAR = 1989 WHERE a.s = '1' AND a.YEAR > 1989 "
    "UNION ALL SELECT 'C(SEX)[T.2]:C(YEAR)[T.' || a.YEAR || ']', a.m - b.m - c.m + d.m FROM cell a JOIN cell b ON b.YEAR = a.YEAR AND b.s = '1' "
    "JOIN cell c ON c.s = '2' AND c.YEAR = 1989 JOIN cell d ON d.s = '1' AND d.YEAR = 1989 WHERE a.s = '2' AND a.YEAR > 1989",
    ["person"], ["term"], ["coefficient"], extra=[_CELLS],
)
def gender_edu_saturated(spark, folder):
    fit = regression.ols_hc1(survey(spark, folder).persons, "EDATTAIN_H", ["C(SEX)*C(YEAR)"])
    return fit.select("term", "coefficient")


@query()
def gender_education_ols(spark, folder):
    return regression.gender_education(survey(spark, folder).persons_with_wealth)


@query(
    "SELECT 'gender_wealth' AS model, * FROM gw_fit", ["pw"], ["term", "model", "nobs"], _FIT,
    extra=[_AGED, *o.ols_ctes("gw", "aged", "wealth_index", ["C(SEX_H)*C(URBAN_H)", "C(YEAR)", "C(EDATTAIN_H)", "AGE", "AGE2", "C(GEO1_VN)"])],
)
def gender_wealth_ols(spark, folder):
    return regression.gender_wealth(survey(spark, folder).persons_with_wealth)


# Schooling is a number in this frame, so its levels carry no decimals on either side.
_WHOLE = ("whole", "SELECT * REPLACE (CAST(CAST(EDATTAIN_H AS BIGINT) AS VARCHAR) AS EDATTAIN_H) FROM edu")


@query(
    "SELECT 'education_returns' AS model, * FROM er_fit", ["edu"], ["term", "model", "nobs"], _FIT,
    extra=[_WHOLE, *o.ols_ctes("er", "whole", "wealth_index", ["C(EDATTAIN_H)*C(YEAR)", "AGE", "C(SEX_H)", "C(URBAN_H)", "C(GEO1_VN)"])],
)
def education_returns_ols(spark, folder):
    return regression.education_returns(survey(spark, folder).education)


_POINTS = (
    "(SELECT ln(b + s) - ln(a + s) AS y, ln(a + s) AS x FROM (SELECT a, b, CASE WHEN min(least(a, b)) OVER () <= 0 THEN abs(min(least(a, b)) OVER ()) + 1 ELSE 0 END AS s "
    "FROM (SELECT GEO1_VN, max(CASE WHEN YEAR = (SELECT min(YEAR) FROM regions) THEN weighted_mean_wealth END) AS a, "
    "max(CASE WHEN YEAR = (SELECT max(YEAR) FROM regions) THEN weighted_mean_wealth END) AS b FROM regions GROUP BY GEO1_VN) WHERE a IS NOT NULL AND b IS NOT NULL))"
)


@query(
    "SELECT (SELECT min(YEAR) FROM regions) AS period_start, (SELECT max(YEAR) FROM regions) AS period_end, CAST(n AS BIGINT) AS n_regions, "
    "CASE WHEN b1 < 0 THEN 'Slope below zero: regions that started lower gained more.' ELSE 'Slope not below zero: regions that started higher gained more.' END AS interpretation, "
    "b0 AS intercept, b1 AS beta_coefficient, sqrt(v0 * n / (n - 2)) AS intercept_se, sqrt(v1 * n / (n - 2)) AS beta_se FROM ("
    "SELECT max(b0) AS b0, max(b1) AS b1, max(n) AS n, sum(e * e * (1.0 / n - mx * (x - mx) / sxx) ** 2) AS v0, sum(e * e * ((x - mx) / sxx) ** 2) AS v1 FROM ("
    f"SELECT d.*, f.*, y - b0 - b1 * x AS e FROM {_POINTS} d, (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM {_POINTS}) f))",
    ["regions"], ["period_start", "period_end", "n_regions", "interpretation"], ["intercept", "beta_coefficient", "intercept_se", "beta_se"],
)
def beta_convergence(spark, folder):
    # The SQL side has no normal distribution, so the chance is left to the tests.
    return profiles.beta_convergence(profiles.region_year_wealth(survey(spark, folder).enriched)).drop("beta_p_value")


@query(
    "SELECT sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS slope, count(*) AS n_obs, count(DISTINCT g) AS n_groups FROM (SELECT *, avg(x) OVER (PARTITION BY g) AS mx, avg(y) OVER (PARTITION BY g) AS my "
    "FROM (SELECT GEO1_VN AS g, wealth_index AS y, CAST(HOUSEHOLD_SIZE AS DOUBLE) AS x FROM enriched WHERE wealth_index IS NOT NULL AND GEO1_VN IS NOT NULL))",
    ["enriched"], ["n_obs", "n_groups"], ["slope"],
)
def within_slope(spark, folder):
    return profiles.within_group_slope(survey(spark, folder).enriched, "wealth_index", "HOUSEHOLD_SIZE", "GEO1_VN")


# --- models --------------------------------------------------------------------------


@query("SELECT URBAN_H, ELECTRIC_H, WATSUP_H, YEAR, GEO1_VN, wealth_class FROM enriched WHERE wealth_class IS NOT NULL", ["enriched"])
def model_frame(spark, folder):
    return features.model_frame(survey(spark, folder).enriched)


@query(
    "SELECT YEAR, SERIAL, coalesce(LIVEAREA, (SELECT quantile_cont(LIVEAREA, 0.5) FROM hh)) AS LIVEAREA, coalesce(ELECTRIC_H, (SELECT ELECTRIC_H FROM hh WHERE ELECTRIC_H IS NOT NULL "
    "GROUP BY ELECTRIC_H ORDER BY count(*) DESC, ELECTRIC_H LIMIT 1)) AS ELECTRIC_H FROM hh", ["hh"], ["YEAR", "SERIAL", "ELECTRIC_H"], ["LIVEAREA"],
)
def impute_median_mode(spark, folder):
    hh = survey(spark, folder).households
    cells = hh.groupBy("LIVEAREA", "ELECTRIC_H").agg(F.count(F.lit(1)).alias("n"))
    filled = features.fit_fill(cells, ["LIVEAREA", "ELECTRIC_H"]).filled(hh)
    return filled.select("YEAR", "SERIAL", "ELECTRIC_H", "LIVEAREA")


def _hot(column: str, codes: list[str]) -> str:
    return ", ".join(f"CASE WHEN coalesce({column}, m_{column}) = '{c}' THEN '1' ELSE '0' END" for c in codes)


_MODE_OF = ", ".join(
    f"(SELECT {c} FROM split WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}" for c in ["URBAN_H", "ELECTRIC_H", "WATSUP_H", "GEO1_VN"]
)


@query(
    "SELECT URBAN_H, ELECTRIC_H, WATSUP_H, YEAR, GEO1_VN, wealth_class, train, count(*) AS n, max(round((YEAR - mu) / sd, 6)) AS year_z, "
    "max(concat(" + ", ".join([_hot("URBAN_H", ["0", "1"]), _hot("ELECTRIC_H", ["0", "1"]), _hot("WATSUP_H", ["10", "11", "20"]), _hot("GEO1_VN", sorted(str(i) for i in range(25)))])
    + ")) AS one_hot FROM split, (SELECT avg(YEAR) AS mu, stddev_pop(YEAR) AS sd FROM split), (SELECT " + _MODE_OF + ") GROUP BY ALL",
    ["split"],
)
def features_prepared(spark, folder):
    from pyspark.ml.functions import vector_to_array

    cells = survey(spark, folder).cells
    encoded = features.fit_encoder(cells, FEATURES).transform(cells).withColumn("f", vector_to_array("features"))
    # The standardised year comes first, the indicator slots after it, shown as digits.
    slots = F.expr("transform(slice(f, 2, size(f) - 1), x -> cast(cast(x AS INT) AS STRING))")
    return encoded.select(*FEATURES, TARGET, "train", "n", F.col("f")[0].alias("year_z"), F.array_join(slots, "").alias("one_hot"))


def _model_query(name: str, learner: str) -> None:
    def run(spark, folder):
        s = survey(spark, folder)
        result = classifiers.evaluate(s.learner(learner).predict(s.cells.filter("NOT train")), TARGET)
        return result.select(F.lit(learner).alias("model"), "accuracy", "macro_f1", "n_obs")

    run.__name__ = name
    query()(run)


_model_query("clf_logreg", "logistic_regression")
_model_query("clf_random_forest", "random_forest")
_model_query("clf_svm_rff", "svm_rbf")
_model_query("clf_gbt", "boosted_trees")


def _rows(spark, folder) -> DataFrame:
    return survey(spark, folder).enriched.dropna(subset=[TARGET])


def _train():
    return sampling.in_train([TARGET, *KEYS])


@query()
def clf_mlp(spark, folder):
    net, history = survey(spark, folder).network
    result = classifiers.evaluate(net.predict(survey(spark, folder).cells.filter("NOT train")), TARGET)
    return result.select(F.lit("mlp_classifier").alias("model"), "accuracy", "macro_f1", "n_obs", F.lit(len(history)).alias("iterations"))


@query()
def mlp_history(spark, folder):
    _, history = survey(spark, folder).network
    return spark.createDataFrame(list(enumerate(history)), "iteration int, loss double")


def _by_mode(spark, folder) -> DataFrame:
    """Test rows with the commonest training class of their (URBAN_H, YEAR) as prediction."""
    rows = _rows(spark, folder).withColumn("_train", _train())
    counts = rows.filter("_train").groupBy("URBAN_H", "YEAR", TARGET).agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("URBAN_H", "YEAR").agg(F.min(F.struct((-F.col("n")).alias("n"), TARGET))[TARGET].alias("prediction"))
    return rows.filter("NOT _train").join(modes, ["URBAN_H", "YEAR"])


def _report_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}cls, coalesce(tp / nullif(pre, 0), 0) AS precision, coalesce(tp / nullif(sup, 0), 0) AS recall, coalesce(2.0 * tp / nullif(pre + sup, 0), 0) AS f1, "
        f"sup AS support, tp FROM (SELECT {k}cls, CAST(sum(s) AS BIGINT) AS sup, CAST(sum(p) AS BIGINT) AS pre, CAST(sum(t) AS BIGINT) AS tp FROM ("
        f"SELECT {k}wealth_class AS cls, 1 AS s, 0 AS p, CAST(wealth_class = prediction AS INTEGER) AS t FROM {source} UNION ALL "
        f"SELECT {k}prediction, 0, 1, 0 FROM {source}) GROUP BY {k}cls)"
    )


def _scores_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {k}sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, CAST(sum(support) AS BIGINT) AS n_obs FROM ({_report_sql(source, keys)}){group}"


@query(_report_sql("predicted"), ["predicted"], ["cls", "support"], ["precision", "recall", "f1"])
def classification_metrics(spark, folder):
    confusion = metrics.confusion_counts(_by_mode(spark, folder), TARGET, "prediction")
    return metrics.class_report(confusion).drop("tp")


@query("SELECT wealth_class AS label, prediction, count(*) AS n FROM predicted GROUP BY ALL", ["predicted"])
def confusion_matrix(spark, folder):
    return metrics.confusion_counts(_by_mode(spark, folder), TARGET, "prediction")


_SIDES = "(" + " UNION ALL ".join(
    f"SELECT '{d}' AS subgroup_dimension, CAST({d} AS VARCHAR) AS subgroup_value, wealth_class, prediction FROM predicted" for d in ["URBAN_H", "YEAR", "GEO1_VN"]
) + ")"


@query(f"SELECT * FROM ({_scores_sql(_SIDES, 'subgroup_dimension, subgroup_value')}) WHERE n_obs >= 30", ["predicted"],
       ["subgroup_dimension", "subgroup_value", "n_obs"], ["accuracy", "macro_f1"])
def subgroup_metrics(spark, folder):
    return metrics.subgroup_scores(_by_mode(spark, folder), TARGET, "prediction", ["URBAN_H", "YEAR", "GEO1_VN"])


def _two_models(spark, folder) -> DataFrame:
    by_mode = _by_mode(spark, folder).select(TARGET, "prediction")
    constant = by_mode.withColumn("prediction", F.lit("poor"))
    first = metrics.scores(metrics.confusion_counts(by_mode, TARGET, "prediction")).withColumn("model", F.lit("group_mode"))
    second = metrics.scores(metrics.confusion_counts(constant, TARGET, "prediction")).withColumn("model", F.lit("constant"))
    return first.select("model", "accuracy", "macro_f1").unionByName(second.select("model", "accuracy", "macro_f1", "n_obs"), allowMissingColumns=True)


_CONSTANT = "(SELECT wealth_class, 'poor' AS prediction FROM predicted)"
_TWO = (
    f"SELECT 'group_mode' AS model, accuracy, macro_f1, CAST(NULL AS BIGINT) AS n_obs FROM ({_scores_sql('predicted')}) UNION ALL "
    f"SELECT 'constant', accuracy, macro_f1, n_obs FROM ({_scores_sql(_CONSTANT)})"
)


@query(_TWO, ["predicted"], ["model", "n_obs"], ["accuracy", "macro_f1"])
def model_comparison(spark, folder):
    return _two_models(spark, folder)


@query(f"SELECT arg_max(model, macro_f1) AS best_model, max(macro_f1) AS best_score, arg_min(model, macro_f1) AS baseline_model, min(macro_f1) AS baseline_score FROM ({_TWO})",
       ["predicted"], ["best_model", "baseline_model"], ["best_score", "baseline_score"])
def rank_models(spark, folder):
    return profiles.rank_models(_two_models(spark, folder))


def _wave_gains(cls: str) -> str:
    """Gain of every split of all training rows in the first round of boosting, for one class."""
    sides = " UNION ALL ".join(
        f"SELECT '{c}' AS f, coalesce({c}, m_{c}) AS s, wealth_class FROM split, (SELECT {_TRAIN_MODES}) WHERE train" for c in ["URBAN_H", "ELECTRIC_H", "WATSUP_H", "GEO1_VN"]
    )
    return (
        "SELECT s, f, (gu * gu) / (hu + 1) + (g - gu) * (g - gu) / (h - hu + 1) - g * g / (h + 1) AS gain, -0.05 * gu / (hu + 1) AS w1, -0.05 * (g - gu) / (h - hu + 1) AS w2 FROM ("
        f"SELECT f, s, count(*) / 3.0 - count_if(wealth_class = '{cls}') AS gu, 2.0 * count(*) * 2 / 9 AS hu, max(g) AS g, max(h) AS h FROM ({sides} UNION ALL "
        "SELECT 'YEAR', CAST(y AS VARCHAR), wealth_class FROM split JOIN (SELECT DISTINCT YEAR AS y FROM split WHERE train) ON YEAR > y WHERE train) sides, "
        f"(SELECT count(*) / 3.0 - count_if(wealth_class = '{cls}') AS g, 2.0 * count(*) * 2 / 9 AS h FROM split WHERE train) GROUP BY f, s)"
    )


_TRAIN_MODES = _MODE_OF.replace("IS NOT NULL GROUP", "IS NOT NULL AND train GROUP")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS wealth_class, max(gain) AS gain, arg_max(least(w1, w2), gain) AS low_leaf, arg_max(greatest(w1, w2), gain) AS high_leaf FROM ({_wave_gains(c)})"
        for c in ["poor", "middle", "rich"]
    ),
    ["split"], ["wealth_class"], ["gain", "low_leaf", "high_leaf"],
)
def boosting_first_split(spark, folder):
    """One round of depth 1 over all training rows: the best gain of each class, and its two leaves."""
    return classifiers.first_splits(survey(spark, folder).cells.filter("train"), TARGET, FEATURES)


@query()
def model_comparison_all(spark, folder):
    s = survey(spark, folder)
    test_cells = s.cells.filter("NOT train")
    models = {name: s.learner(name) for name in classifiers.LEARNERS} | {"mlp_classifier": s.network[0]}
    compared = classifiers.compare_fitted(models, test_cells, TARGET)
    cells, edges = _network(spark, folder)
    network = classifiers.evaluate(
        bayes.predict(cells.filter("train"), cells.filter("NOT train"), edges, TARGET, settings.NETWORK_FEATURES), TARGET
    )
    return compared.unionByName(network.select(F.lit("bayesian_network").alias("model"), "accuracy", "macro_f1"))


@query()
def temporal_validation(spark, folder):
    return classifiers.temporal_validation(survey(spark, folder).cells, list(classifiers.LEARNERS), TARGET, FEATURES, net=True)


@query()
def permutation_importance(spark, folder):
    s = survey(spark, folder)
    rows = _rows(spark, folder).filter(~_train()).select(*dict.fromkeys([*KEYS, *FEATURES, TARGET]))
    models = {"random_forest": s.learner("random_forest"), "mlp_classifier": s.network[0]}
    tables = [
        classifiers.permutation_importance(model, rows, KEYS, TARGET, FEATURES).select(F.lit(name).alias("model"), "*") for name, model in models.items()
    ]
    return tables[0].unionByName(tables[1])


@query()
def ablation(spark, folder):
    return classifiers.ablation(_rows(spark, folder), _train(), TARGET, FEATURES, settings.ABLATION_SETS)


@query()
def kmeans_clusters(spark, folder):
    return unsupervised.kmeans_clusters(survey(spark, folder).cells, FEATURES)[1]


@query()
def kmeans_summary(spark, folder):
    return unsupervised.cluster_summary(unsupervised.kmeans_clusters(survey(spark, folder).cells, FEATURES)[0])


@query()
def isolation_forest(spark, folder):
    return survey(spark, folder).flagged.select(*KEYS, "wealth_index", "anomaly_score", "is_anomaly")


@query()
def anomaly_rates(spark, folder):
    return unsupervised.anomaly_rates(survey(spark, folder).flagged, ["YEAR", "URBAN_H"])


@query()
def anomaly_top(spark, folder):
    return unsupervised.top_anomalies(survey(spark, folder).flagged, KEYS).select(*KEYS, "wealth_index", "anomaly_score", "is_anomaly")


# A given forest, so that scores, rates and records can be stated in SQL: (tree, node, feature, cut, below, above, depth).
GIVEN_FEATURES = ["YEAR", "ROOMS", "URBAN_H"]
GIVEN_NODES = [
    (0, 0, 1, 5.0, 1, 2, 0.0), (0, 1, 0, 1999.0, 3, 4, 0.0), (0, 2, -1, 0.0, -1, -1, 1.0), (0, 3, -1, 0.0, -1, -1, 6.0), (0, 4, -1, 0.0, -1, -1, 4.5),
    (1, 0, 0, 1989.0, 1, 2, 0.0), (1, 1, 2, 1.0, 3, 4, 0.0), (1, 2, -1, 0.0, -1, -1, 5.0), (1, 3, -1, 0.0, -1, -1, 2.0), (1, 4, -1, 0.0, -1, -1, 3.5),
    (2, 0, 2, 1.0, 1, 2, 0.0), (2, 1, -1, 0.0, -1, -1, 1.5), (2, 2, 1, 2.0, 3, 4, 0.0), (2, 3, -1, 0.0, -1, -1, 4.0), (2, 4, -1, 0.0, -1, -1, 5.5),
]
GIVEN_TYPICAL, GIVEN_SHARE = 4.0, 0.1
_GIVEN = (
    "SELECT *, CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, 0.9) FROM given_scores) THEN 1 ELSE 0 END AS is_anomaly FROM given_scores"
)
_GIVEN_SCORES = (
    "SELECT YEAR, SERIAL, URBAN_H, pow(2.0, -((CASE WHEN ROOMS > 5 THEN 1.0 WHEN YEAR <= 1999 THEN 6.0 ELSE 4.5 END) "
    "+ (CASE WHEN YEAR > 1989 THEN 5.0 WHEN CAST(URBAN_H AS DOUBLE) <= 1 THEN 2.0 ELSE 3.5 END) "
    "+ (CASE WHEN CAST(URBAN_H AS DOUBLE) <= 1 THEN 1.5 WHEN ROOMS <= 2 THEN 4.0 ELSE 5.5 END)) / 3 / 4.0) AS anomaly_score FROM hh"
)
_GIVEN_CTES = [("given_scores", _GIVEN_SCORES), ("given_flags", _GIVEN)]


def _given_flags(spark, folder) -> DataFrame:
    names = [c.split()[0] for c in unsupervised.NODE_SCHEMA.split(", ")]
    forest = unsupervised.pack_forest([dict(zip(names, node)) for node in GIVEN_NODES])
    rows = survey(spark, folder).households.select(*KEYS, *[c for c in GIVEN_FEATURES if c not in KEYS])
    none = [f"_v_{c}" for c in GIVEN_FEATURES]
    fill = features.Fill(none, [], {c: 0.0 for c in none}, {}, {}, {})
    return unsupervised.flag_anomalies(rows, GIVEN_FEATURES, fill, forest, GIVEN_TYPICAL, GIVEN_SHARE)


@query("SELECT YEAR, SERIAL, anomaly_score, is_anomaly FROM given_flags", ["hh"], ["YEAR", "SERIAL", "is_anomaly"], ["anomaly_score"], _GIVEN_CTES)
def anomaly_scores_given(spark, folder):
    return _given_flags(spark, folder).select(*KEYS, "anomaly_score", "is_anomaly")


@query(
    "SELECT 'YEAR' AS group_dimension, CAST(YEAR AS VARCHAR) AS group_value, count(*) AS n_obs, avg(is_anomaly) AS anomaly_rate FROM given_flags "
    "GROUP BY YEAR UNION ALL SELECT 'URBAN_H', URBAN_H, count(*), avg(is_anomaly) FROM given_flags GROUP BY URBAN_H",
    ["hh"], ["group_dimension", "group_value", "n_obs"], ["anomaly_rate"], _GIVEN_CTES,
)
def anomaly_rates_given(spark, folder):
    return unsupervised.anomaly_rates(_given_flags(spark, folder), ["YEAR", "URBAN_H"])


@query(
    "SELECT YEAR, SERIAL, anomaly_score, is_anomaly FROM given_flags ORDER BY is_anomaly DESC, anomaly_score DESC, YEAR, SERIAL LIMIT 500",
    ["hh"], ["YEAR", "SERIAL", "is_anomaly"], ["anomaly_score"], _GIVEN_CTES,
)
def anomaly_top_given(spark, folder):
    return unsupervised.top_anomalies(_given_flags(spark, folder), KEYS).select(*KEYS, "anomaly_score", "is_anomaly")


@query()
def representation_benchmark(spark, folder):
    return survey(spark, folder).representation


# --- Bayesian network ----------------------------------------------------------------

VARIABLES = settings.NETWORK_FEATURES
# A fixed structure for the SQL checks; the search below learns its own.
EDGES = [("URBAN_H", TARGET), (TARGET, "ELECTRIC_H"), ("URBAN_H", "ELECTRIC_H"), (TARGET, "WATSUP_H"), ("YEAR", "WATSUP_H"), (TARGET, "GEO1_VN")]


def _network(spark, folder) -> tuple[DataFrame, list]:
    return survey(spark, folder).bayes_network


@query("SELECT k_year, k_serial, YEAR, GEO1_VN, URBAN_H, ELECTRIC_H, WATSUP_H, wealth_class FROM network", ["network"])
def bn_prepare(spark, folder):
    hh = survey(spark, folder).enriched.withColumns({"k_year": F.col("YEAR"), "k_serial": F.col("SERIAL")})
    return bayes.prepare(hh, keep=["k_year", "k_serial"])


@query()
def bn_edges(spark, folder):
    _, edges = _network(spark, folder)
    return spark.createDataFrame(edges, "source string, target string")


def _cpt(child: str, given: list[str], name: str) -> tuple[str, str]:
    cols = ", ".join([*given, child])
    over = f"PARTITION BY {', '.join(given)}" if given else ""
    return name, f"SELECT {cols}, n / sum(n) OVER ({over}) AS p FROM (SELECT {cols}, count(*) AS n FROM network WHERE train GROUP BY {cols})"


_CPTS = [
    _cpt(TARGET, ["URBAN_H"], "t_class"), _cpt("ELECTRIC_H", ["URBAN_H", TARGET], "t_elec"), _cpt("WATSUP_H", ["YEAR", TARGET], "t_wat"),
    _cpt("GEO1_VN", [TARGET], "t_geo"), _cpt("URBAN_H", [], "t_urb"), _cpt("YEAR", [], "t_year"),
]


@query("SELECT URBAN_H, wealth_class, ELECTRIC_H, p AS prob FROM t_elec", ["network"], ["URBAN_H", TARGET, "ELECTRIC_H"], ["prob"], extra=[_CPTS[1]])
def bn_cpt(spark, folder):
    cells = survey(spark, folder).network_cells().filter("train")
    return bayes.conditional_table(cells, "ELECTRIC_H", ["URBAN_H", TARGET])


@query(
    " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count(*) AS cardinality, '{' | '.join(bayes.parents_of(EDGES, VARIABLES)[v])}' AS evidence, "
        f"array_to_string(list({v} ORDER BY {v}), ' | ') AS state_names FROM (SELECT DISTINCT {v} FROM network WHERE train)"
        for v in VARIABLES
    ),
    ["network"],
)
def bn_cpd_summary(spark, folder):
    return bayes.table_summary(survey(spark, folder).network_cells().filter("train"), EDGES, VARIABLES)


_SET_NAME = "concat_ws('+', " + ", ".join(f"CASE WHEN grouping({v}) = 0 THEN '{v}' END" for v in VARIABLES) + ")"


@query(
    "SELECT s AS variables, count(*) AS n_states, sum(n * ln(n)) AS n_log_n FROM (SELECT " + _SET_NAME + f" AS s, count(*) AS n FROM network WHERE train GROUP BY CUBE ({', '.join(VARIABLES)})) GROUP BY s",
    ["network"], ["variables", "n_states"], ["n_log_n"],
)
def bn_subset_statistics(spark, folder):
    stats = bayes.subset_statistics(survey(spark, folder).network_cells().filter("train"), VARIABLES)
    rows = [("+".join(v for v in VARIABLES if v in names), n, float(t)) for names, (t, n) in stats.items()]
    return spark.createDataFrame(rows, "variables string, n_states bigint, n_log_n double")


@query(
    "SELECT YEAR, GEO1_VN, URBAN_H, ELECTRIC_H, WATSUP_H, label AS wealth_class, coalesce(arg_max(st, rk), (SELECT wealth_class FROM network WHERE train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS prediction, "
    "CAST(max(n) AS BIGINT) AS n FROM (SELECT c.YEAR, c.GEO1_VN, c.URBAN_H, c.ELECTRIC_H, c.WATSUP_H, c.wealth_class AS label, c.n, s.wealth_class AS st, "
    "CASE WHEN a.p * e.p * w.p * g.p IS NOT NULL THEN -row_number() OVER (PARTITION BY c.YEAR, c.GEO1_VN, c.URBAN_H, c.ELECTRIC_H, c.WATSUP_H, c.wealth_class ORDER BY ln(a.p) + ln(e.p) + ln(w.p) + ln(g.p) DESC NULLS LAST, s.wealth_class) END AS rk "
    "FROM (SELECT YEAR, GEO1_VN, URBAN_H, ELECTRIC_H, WATSUP_H, wealth_class, count(*) AS n FROM network WHERE NOT train GROUP BY ALL) c, (SELECT DISTINCT wealth_class FROM network WHERE train) s "
    "LEFT JOIN t_class a ON a.URBAN_H = c.URBAN_H AND a.wealth_class = s.wealth_class "
    "LEFT JOIN t_elec e ON e.URBAN_H = c.URBAN_H AND e.wealth_class = s.wealth_class AND e.ELECTRIC_H = c.ELECTRIC_H "
    "LEFT JOIN t_wat w ON w.YEAR = c.YEAR AND w.wealth_class = s.wealth_class AND w.WATSUP_H = c.WATSUP_H "
    "LEFT JOIN t_geo g ON g.wealth_class = s.wealth_class AND g.GEO1_VN = c.GEO1_VN) GROUP BY ALL",
    ["network"], extra=_CPTS[:4],
)
def bn_predict(spark, folder):
    cells = survey(spark, folder).network_cells()
    return bayes.predict(cells.filter("train"), cells.filter("NOT train"), EDGES, TARGET, VARIABLES).select(
        *[v for v in VARIABLES if v != TARGET], TARGET, "prediction", "n"
    )


_NAIVE = {"baseline": {}, "urban_with_services": {"URBAN_H": "1", "ELECTRIC_H": "1", "WATSUP_H": "11"}, "rural_without_services": {"URBAN_H": "0", "ELECTRIC_H": "0", "WATSUP_H": "10"}}


def _scenario_sql(name: str, evidence: dict[str, str]) -> str:
    where = " AND ".join(f"u.{k} = '{v}'" if k == "URBAN_H" else f"{'e' if k == 'ELECTRIC_H' else 'w'}.{k} = '{v}'" for k, v in evidence.items())
    text = " | ".join(f"{k}={v}" for k, v in evidence.items())
    return (
        f"SELECT '{name}' AS scenario, '{text}' AS evidence, " + ", ".join(f"sum(CASE WHEN wealth_class = '{c}' THEN j END) / sum(j) AS {c}_prob" for c in ["poor", "middle", "rich"])
        + " FROM (SELECT c.wealth_class, u.p * c.p * e.p * w.p * y.p AS j FROM t_urb u JOIN t_class c ON c.URBAN_H = u.URBAN_H JOIN t_elec e ON e.URBAN_H = u.URBAN_H AND e.wealth_class = c.wealth_class "
        "JOIN t_wat w ON w.wealth_class = c.wealth_class JOIN t_year y ON y.YEAR = w.YEAR" + (f" WHERE {where}" if where else "") + ")"
    )


@query(" UNION ALL ".join(_scenario_sql(n, e) for n, e in _NAIVE.items()), ["network"], ["scenario", "evidence"], ["poor_prob", "middle_prob", "rich_prob"], extra=_CPTS)
def bn_scenarios(spark, folder):
    cells = survey(spark, folder).network_cells().filter("train")
    return bayes.scenarios(cells, EDGES, VARIABLES, TARGET, _NAIVE)


# --- run summary and streaming --------------------------------------------------------


@query("SELECT 1 AS streaming_stage_used, (SELECT count(*) FROM hh) AS households_analyzed, (SELECT count(*) FROM person) AS person_rows_for_regressions, "
       "4 AS traditional_models_run, 2 AS deep_learning_components_run, 1 AS bayesian_network_run", ["hh", "person"])
def run_summary(spark, folder):
    s = survey(spark, folder)
    for name in classifiers.LEARNERS:
        s.learner(name)
    # Fitted by the first that asks, and shared with the reports on them.
    s.network, s.representation, s.bayes_network
    return s.run_summary()


def _person_stream(spark, folder) -> DataFrame:
    lines = streams.file_stream(spark, folder, table(spark, folder, "lineitem").schema, "lineitem.parquet")
    return census(lines, table(spark, folder, "orders"), table(spark, folder, "customer"))


@query(f"SELECT {', '.join(o.HARM_COLUMNS)} FROM harm", ["harm"])
def stream_ingest(spark, folder):
    out, log = new_stage_path(spark, "stream"), new_stage_path(spark, "stream-log")
    streams.ingest(_person_stream(spark, folder), CENSUS_RULES, out, log)
    schema = survey(spark, folder).harmonized.schema
    return spark.read.schema(schema).parquet(out).select(*schema.names)


@query(_audit_sql("count(*) AS N_ROWS, count(*) - count({c}) AS N_MISSING, (count(*) - count({c})) / count(*) AS MISSING_RATE", o.COLUMNS).replace("FROM harm", "FROM nulled"),
       ["nulled"], ["YEAR", "VARIABLE", "N_ROWS", "N_MISSING"], ["MISSING_RATE"])
def stream_audit(spark, folder):
    stream = apply_missing_rules(_person_stream(spark, folder), CENSUS_RULES)
    return streams.stream_missingness(stream, new_stage_path(spark, "stream-log"))


_CODED = ["GEO1_VN", "URBAN", "OWNERSHIP", "ELECTRIC", "WATSUP", "SEWAGE", "WALL", "ROOF", "SEX", "MARST", "EDATTAIN", "CLASSWK"]


@query(" UNION ALL ".join(f"SELECT YEAR, '{c}' AS VARIABLE, count(DISTINCT {c}) AS N_UNIQUE FROM nulled GROUP BY YEAR" for c in _CODED), ["nulled"])
def stream_distincts(spark, folder):
    """Distinct codes from sketches in the state store; sketches of that few codes hold them all."""
    stream = apply_missing_rules(_person_stream(spark, folder), CENSUS_RULES)
    return streams.distinct_counts([streams.stream_sketches(stream, _CODED, new_stage_path(spark, "stream-log"))])


@query(_LOGIC, ["harm"])
def stream_checks(spark, folder):
    return streams.stream_checks(clean_and_harmonize(_person_stream(spark, folder), CENSUS_RULES), new_stage_path(spark, "stream-log"))


@query(
    "SELECT YEAR, GEO1_VN, sum(PERWT * ROOMS) / sum(PERWT) AS weighted_mean, count(*) AS n_obs FROM harm "
    "WHERE ROOMS IS NOT NULL AND PERWT IS NOT NULL AND GEO1_VN IS NOT NULL GROUP BY YEAR, GEO1_VN",
    ["harm"], ["YEAR", "GEO1_VN", "n_obs"], ["weighted_mean"],
)
def stream_region_means(spark, folder):
    persons = clean_and_harmonize(_person_stream(spark, folder), CENSUS_RULES)
    sums = streams.stream_sums(persons, ["YEAR", "GEO1_VN"], "ROOMS", "PERWT", new_stage_path(spark, "stream-log"))
    return streams.group_means([sums], ["YEAR", "GEO1_VN"])


# --- rules from files, whole suite -----------------------------------------------------


def _rule_file(spark, folder) -> DataFrame:
    """A harmonisation file written from the tables, nations to regions, read by the rule loader."""
    path = new_stage_path(spark, "rules")
    rules = table(spark, folder, "nation").select(
        F.lit("GEO1_VN").alias("Variable_Name"), F.lit("ALL").alias("YEAR"), F.col("n_nationkey").alias("original_code"),
        F.concat(F.lit("R"), "n_regionkey").alias("harmonized_code"),
    )
    rules.write.option("header", True).csv(path)
    return load_rule_table(spark, path)


@query(
    "SELECT c.YEAR, 'R' || n_regionkey AS GEO1_VN_H, count(*) AS n_persons, min(s.present) AS all_columns FROM census c "
    "JOIN nation ON CAST(n_nationkey AS VARCHAR) = c.GEO1_VN CROSS JOIN (SELECT 1 AS present) s GROUP BY ALL", ["census"],
)
def rules_from_files(spark, folder):
    """Persons by year and region, harmonised by rules that were loaded from a file; whether the file has all columns."""
    loaded = _rule_file(spark, folder)
    rules = RuleSet.from_frames(None, loaded)
    whole = schema_report(loaded, HARMONIZATION_COLUMNS, "harmonization").agg(F.min("present")).first()[0]
    persons = harmonize(require_columns(read_census(spark, folder)), rules, ["GEO1_VN"])
    return persons.groupBy("YEAR", "GEO1_VN_H").agg(F.count(F.lit(1)).alias("n_persons")).withColumn("all_columns", F.lit(whole))


# Names of the reports, and of the queries that have their SQL.
_SUITE = {
    "metadata_usage_audit": "metadata_usage", "missingness_summary": "missingness", "category_consistency": "category_consistency",
    "harmonization_coverage": "harmonization_coverage", "outlier_summary": "outlier_summary", "structural_breaks": "structural_breaks",
    "variable_documentation": "variable_docs", "column_audit": "column_audit", "checks": "check_report",
}


@query(
    " UNION ALL ".join(f"SELECT '{report}' AS report, count(*) AS n_rows FROM ({ORACLES[name]}) t" for report, name in _SUITE.items())
    + f" UNION ALL SELECT 'harmonization_rules_schema', {len(HARMONIZATION_COLUMNS)}"
)
def validation_suite(spark, folder):
    """Rows of every report of the whole suite."""
    reports = survey(spark, folder).validation({"harmonization": (_rule_file(spark, folder), HARMONIZATION_COLUMNS)})
    sizes = [r.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows")) for name, r in reports.items()]
    out = sizes[0]
    for part in sizes[1:]:
        out = out.unionByName(part)
    return out
