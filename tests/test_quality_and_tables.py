import math

import numpy as np
import pandas as pd
import pytest

from tallyspark.operators import indices, profiles, quality, tables
from tallyspark.sources.rules import RuleSet, dictionary_frame


def test_household_takes_first_present_value(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, None, 60.0, 2.0), (1, "a", 2, "7", None, 9.0), (1, "b", 1, "8", 10.0, None), (None, "c", 1, "9", 1.0, 1.0)],
        "YEAR int, SERIAL string, PERNUM int, URBAN string, LIVEAREA double, ROOMS double",
    )
    got = {r["SERIAL"]: r for r in tables.household_rollup(df).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["HOUSEHOLD_SIZE"], got["a"]["URBAN"], got["a"]["LIVEAREA"], got["a"]["ROOMS"]) == (2, "7", 60.0, 2.0)
    assert got["a"]["AREA_PER_PERSON"] == 30.0 and got["b"]["ROOMS_PER_PERSON"] is None
    with pytest.raises(ValueError):
        tables.household_rollup(df.drop("YEAR"))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_rollup_with_a_hot_household(spark, parts):
    pdf = pd.DataFrame({"YEAR": 1999, "SERIAL": ["hot"] * 1000 + [str(i) for i in range(500)], "PERNUM": list(range(1000)) + [1] * 500})
    pdf["ROOMS"] = np.where(pdf["PERNUM"] < 3, np.nan, pdf["PERNUM"] % 7).astype(float)
    out = {r["SERIAL"]: r for r in tables.household_rollup(spark.createDataFrame(pdf).repartition(parts)).collect()}
    assert out["hot"]["HOUSEHOLD_SIZE"] == 1000 and len(out) == 501


def test_person_table_and_join(spark):
    persons = spark.createDataFrame([(1, "a", 1, 14.0, "1"), (1, "a", 2, 15.0, "1"), (1, "z", 1, None, "0")], "YEAR int, SERIAL string, PERNUM int, AGE double, URBAN_H string")
    assert [r["IS_WORKING_AGE"] for r in tables.person_table(persons).orderBy("SERIAL", "PERNUM").collect()] == [0.0, 1.0, 0.0]
    hh = spark.createDataFrame([(1, "a", 0.5, "0")], "YEAR int, SERIAL string, wealth double, URBAN_H string")
    joined = tables.join_households(persons, hh, ["wealth", "URBAN_H"])
    assert {r["SERIAL"]: (r["wealth"], r["URBAN_H_HH"]) for r in joined.collect()} == {"a": (0.5, "0"), "z": (None, None)}


def test_yearly_series_join_keeps_empty_cells_and_zeroes_unknown_years(spark):
    values = spark.createDataFrame([(1999, 1.0), (2009, 2.0), (2050, 3.0)], "YEAR int, v double")
    series = spark.createDataFrame([(1999, 5e9), (2009, None)], "year int, value double")
    got = {r["YEAR"]: r["Macro_Metric"] for r in tables.join_yearly_series(values, series).collect()}
    assert got == {1999: 5.0, 2009: None, 2050: 0.0}


def test_category_shift(spark):
    rows = [(1989, "a")] * 3 + [(1989, "b")] + [(2009, "b"), (2009, "c")]
    df = spark.createDataFrame(rows, "YEAR int, SEX string")
    got = [tuple(r) for r in quality.category_consistency(df, ["SEX"]).orderBy("YEAR").collect()]
    assert got == [("SEX", 1989, 2, "a:3 | b:1", "a | b", "", 0), ("SEX", 2009, 2, "b:1 | c:1", "c", "a", 1)]


def test_category_report_with_very_many_codes(spark):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 1989, 1999) as YEAR", "lpad(id, 6, '0') as SEX")
    got = {r["YEAR"]: r for r in quality.category_consistency(df, ["SEX"]).collect()}
    assert got[1999]["N_CODES"] == 10_000 and got[1999]["FLAG_CATEGORY_SHIFT"] == 1
    assert got[1999]["NEW_CODES_VS_PREVIOUS_YEAR"].split(" | ") == [f"{i:06d}" for i in range(1, 20, 2)]
    assert got[1999]["DISAPPEARED_CODES_VS_PREVIOUS_YEAR"].split(" | ") == [f"{i:06d}" for i in range(0, 20, 2)]


def test_harmonization_coverage(spark):
    rules = RuleSet.from_rows([], [("URBAN", "ALL", "1", "1"), ("URBAN", "2009", "2", "0")])
    df = spark.createDataFrame([(1999, "1"), (1999, "2"), (2009, "1"), (2009, "2"), (2009, "2")], "YEAR int, URBAN string")
    got = {r["YEAR"]: r for r in quality.harmonization_coverage(df, rules, ["URBAN"]).collect()}
    assert (got[1999]["COVERAGE_RATE"], got[1999]["TOP_UNRESOLVED_CODES"]) == (0.5, "2:1")
    assert (got[2009]["COVERED_BY_RULES"], got[2009]["TOP_UNRESOLVED_CODES"]) == (2, "1:1")


def test_break_flags(spark):
    summary = spark.createDataFrame(
        [("v", 1989, 0.0, 0.0, 1.0), ("v", 1999, 2.0, 1.0, 1.0), ("c", 1989, 1.0, 1.0, 0.0), ("c", 1999, 2.0, 2.0, 0.0), ("n", 1989, 1.0, 1.0, None), ("n", 1999, 2.0, 2.0, 0.5)],
        "VARIABLE string, YEAR int, MEAN double, MEDIAN double, STD double",
    )
    got = {r["VARIABLE"]: (r["STANDARDIZED_MEAN_CHANGE"], r["FLAG_STRUCTURAL_BREAK"]) for r in quality.structural_breaks(summary).collect()}
    assert got == {"v": (2.0, 1), "c": (None, 0), "n": (2.0, 1)}


def test_audit_checks_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 5.0, 3.0, 120.0), (1, "a", 1, None, 3.0, 30.0), (1, "b", 1, 1.0, None, -1.0)],
        "YEAR int, SERIAL string, PERNUM int, BEDROOMS double, ROOMS double, AGE double",
    )
    checks = {r["CHECK"]: r["N_FAIL"] for r in quality.logical_checks(df).collect()}
    assert checks == {"BEDROOMS_GT_ROOMS": 1, "AGE_OUT_OF_RANGE": 2}
    dups = {r["CHECK"]: r["VALUE"] for r in quality.duplicate_ids(df).collect()}
    assert dups == {"HOUSEHOLD_ID_DUPLICATES": 2, "PERSON_ID_DUPLICATES": 2}
    audit = {r["VARIABLE"]: r for r in quality.column_audit(df).collect()}
    assert (audit["BEDROOMS"]["N_MISSING"], audit["SERIAL"]["N_UNIQUE"]) == (1, 2)
    sketch = quality.column_audit(df, approximate=True)
    assert sketch.exceptAll(quality.column_audit(df).select(*sketch.columns)).count() == 0
    halves = [quality.missingness(df.filter("SERIAL = 'a'")), quality.missingness(df.filter("SERIAL = 'b'"))]
    merged = {r["VARIABLE"]: r["N_MISSING"] for r in quality.combine_audits(halves).collect()}
    assert merged == {r["VARIABLE"]: r["N_MISSING"] for r in quality.missingness(df).collect()}
    parts = quality.combine_checks([quality.logical_checks(df.filter("SERIAL = 'a'")), quality.logical_checks(df.filter("SERIAL = 'b'"))])
    assert {r["CHECK"]: r["N_FAIL"] for r in parts.collect()} == checks


def test_documentation(spark):
    df = spark.createDataFrame([(1989, "1", None), (1999, "1", "1")], "YEAR int, SEX string, SEX_H string")
    coverage = quality.year_coverage(df)
    docs = {r["variable_name"]: r for r in quality.variable_docs(coverage, RuleSet.default(), dictionary_frame(spark)).collect()}
    assert docs["SEX_H"]["years_available"] == "1999" and docs["SEX"]["has_harmonized_version"] == 1
    assert docs["SEX"]["documented_in_metadata"] == 1 and docs["SEX_H"]["documented_in_metadata"] == 0
    wide = {r["VARIABLE"]: r for r in quality.coverage_matrix(coverage).collect()}
    assert (wide["SEX_H"]["YEAR_1989"], wide["SEX_H"]["YEAR_1999"]) == (0, 1)


def test_beta_convergence_shift_and_errors(spark):
    first, last = np.array([-0.5, 0.0, 0.4, 1.0]), np.array([0.3, 0.1, 0.5, 0.9])
    rows = [(1989, str(i), float(v)) for i, v in enumerate(first)] + [(2019, str(i), float(v)) for i, v in enumerate(last)]
    got = profiles.beta_convergence(spark.createDataFrame(rows, "YEAR int, GEO1_VN string, weighted_mean_wealth double")).first()
    x, y = np.log(first + 1.5), np.log(last + 1.5) - np.log(first + 1.5)
    design = np.column_stack([np.ones(4), x])
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    error = y - design @ beta
    cov = inverse @ (design.T * error**2) @ design @ inverse * 4 / 2
    assert got["beta_coefficient"] == pytest.approx(beta[1]) and got["intercept"] == pytest.approx(beta[0])
    assert got["beta_se"] == pytest.approx(np.sqrt(cov[1, 1])) and got["intercept_se"] == pytest.approx(np.sqrt(cov[0, 0]))
    assert got["beta_p_value"] == pytest.approx(math.erfc(abs(beta[1]) / np.sqrt(2 * cov[1, 1])))
    assert got["interpretation"].startswith("Slope below zero")


def test_progress_by_schooling_against_brute_force(spark):
    rng = np.random.default_rng(5)
    codes = {"EDATTAIN_H": ["0", "1", "2", "9", None], "ELECTRIC_H": ["0", "1", None], "WATSUP_H": ["a11", "21", None], "URBAN_H": ["0", "1"]}
    years = [1989, 1999, 2019]
    rows = [(int(rng.choice(years)), *(v[rng.integers(len(v))] for v in codes.values())) for _ in range(400)]
    frame = spark.createDataFrame(rows + rows[:20], "YEAR int, " + ", ".join(f"{c} string" for c in codes))
    got = {(r["YEAR"], r["EDATTAIN_H"]): (r["mean_index"], r["n_obs"]) for r in indices.progress_by_schooling(frame).collect()}

    local = pd.DataFrame(rows + rows[:20], columns=["YEAR", *codes])
    local = local[~local["EDATTAIN_H"].isin(["0", "9"])]
    digits = local[["ELECTRIC_H", "WATSUP_H", "URBAN_H"]].apply(lambda c: c.str.extract(r"(\d+)")[0].astype(float))
    digits = digits.fillna(digits.median())
    scaled = ((digits - digits.mean()) / digits.std(ddof=0)).to_numpy()
    score = scaled @ np.linalg.eigh(np.cov(scaled.T))[1][:, -1]
    if score[local["YEAR"] == 1989].mean() > score[local["YEAR"] == 2019].mean():
        score = -score
    local["i"] = (score - score.min()) / (score.max() - score.min()) * 100
    want = local.groupby(["YEAR", "EDATTAIN_H"])["i"].agg(["mean", "size"])
    assert set(got) == set(want.index)
    for key, (mean, size) in want.iterrows():
        assert got[key][0] == pytest.approx(mean) and got[key][1] == size


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_equals_plain_join(spark, how):
    from tallyspark.functions.joins import skew_join

    left = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) AS k", "id AS v").union(
        spark.createDataFrame([(None, 9), ("none", 8)], "k string, v bigint")
    )
    right = left.groupBy("k").count().filter("k <> 'none'").selectExpr("k", "count AS size", "upper(k) AS name")
    plain = left.join(right, "k", how)
    for hot_rows in (100, 30, 10**9):
        got = skew_join(left, right, ["k"], "size", how, hot_rows)
        assert got.columns == plain.columns
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_top_rows(spark):
    df = spark.range(5000).repartition(20)
    got = [r["id"] for r in profiles.top_rows(df, [df["id"].desc()], 7, buckets=3).collect()]
    assert got == list(range(4999, 4992, -1))


def test_household_join_with_hot_households(spark):
    persons = spark.range(300).selectExpr("1999 AS YEAR", "if(id < 150, 'hot', cast(id as string)) AS SERIAL", "cast(id as int) AS PERNUM")
    hh = tables.household_rollup(persons).selectExpr("*", "length(SERIAL) AS w")
    plain = tables.join_households(persons, hh, ["w"])
    split = tables.join_households(persons, hh, ["w"], hot_rows=100)
    assert split.exceptAll(plain).count() == 0 and split.count() == 300
