import pytest
from pyspark.sql import functions as F

from tallyspark.functions import columns as c
from tallyspark.operators.cleaning import apply_missing_rules, clean_and_harmonize, clean_types, harmonize, require_columns
from tallyspark.sources.rules import RuleSet, schema_report


def one(df):
    return [r[0] for r in df.collect()]


def test_canonical_codes_agree_however_they_are_written(spark):
    df = spark.createDataFrame([("99",), ("99.0",), (" 99 ",), ("99.5",), (None,), ("10",)], "v string")
    assert one(df.select(c.canon("v"))) == ["99", "99", "99", "99.5", None, "10"]
    assert one(spark.createDataFrame([(99.0,), (None,)], "v double").select(c.canon("v"))) == ["99", None]


def test_year_specific_missing_rule_beats_all(spark):
    rules = RuleSet.from_rows([("W", "ALL", "99|999"), ("W", "2019", "30"), ("W", "2019", "31")], [])
    df = spark.createDataFrame([(2009, "99"), (2009, "30"), (2019, "99"), (2019, "30.0"), (2019, "31"), (None, "99")], "YEAR int, W string")
    assert [r["W"] for r in apply_missing_rules(df, rules).collect()] == [None, "30", "99", None, "31", "99"]


def test_missing_rule_on_numeric_columns(spark):
    rules = RuleSet.from_rows([("L", "ALL", "9999|x")], [])
    df = spark.createDataFrame([(2009, 9999.0, 9999), (2009, 12.0, 7)], "YEAR int, L double, M int")
    assert [tuple(r) for r in apply_missing_rules(df, rules).collect()] == [(2009, None, 9999), (2009, 12.0, 7)]


def test_harmonize_year_set_replaces_all_and_last_duplicate_wins(spark):
    rules = RuleSet.from_rows([], [("S", "ALL", "1", "a"), ("S", "ALL", "2", "b"), ("S", "2019", "1", "x"), ("S", "2019", "1", "y")])
    df = spark.createDataFrame([(2009, "1"), (2009, "3"), (2019, "1.0"), (2019, "2"), (None, "1")], "YEAR int, S string")
    assert [r["S_H"] for r in harmonize(df, rules, ["S", "ABSENT"]).collect()] == ["a", "3", "y", "2", "a"]
    assert "ABSENT_H" not in harmonize(df, rules, ["ABSENT"]).columns


def test_types_and_required_columns(spark):
    df = spark.createDataFrame([("1989", " 7 ", "1.0", "x"), (None, "8", "2", "3.5")], "YEAR string, SERIAL string, PERNUM string, AGE string")
    rows = [tuple(r) for r in clean_types(df).collect()]
    assert rows == [(1989, "7", 1, None), (None, "8", 2, 3.5)]
    with pytest.raises(ValueError):
        require_columns(df.drop("PERNUM"))
    assert clean_and_harmonize(df, RuleSet.default()).count() == 2


def test_small_column_functions(spark):
    df = spark.createDataFrame([("1.0", 1999, 20.0), ("5", 2009, None), (None, 2019, 64.0)], "v string, y int, a double")
    assert one(df.select(c.indicator("v"))) == [1.0, 0.0, 0.0]
    assert one(df.select(c.period("y"))) == ["early", "middle", "late"]
    assert one(df.select(c.flag(F.col("a").between(15, 64)))) == [1.0, 0.0, 1.0]
    assert one(df.select(c.cohort_decade("y", "a"))) == [1970, None, 1950]
    assert one(df.select(c.decoded("v", {"1": "Urban"}))) == ["Urban", "5", None]
    assert one(df.select(c.ratio("a", F.lit(0)))) == [None, None, None]
    codes = spark.createDataFrame([("0.0",), ("9",), ("3",), (None,)], "v string")
    assert one(codes.filter(c.not_excluded("v"))) == ["3", None]
    assert one(spark.createDataFrame([("a12b3",), ("x",)], "v string").select(c.digits("v"))) == [12.0, None]


def test_weighted_mean_drops_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (3.0, None)], "v double, w double")
    assert df.agg(c.weighted_mean("v", "w")).first()[0] == 1.0
    zero = spark.createDataFrame([(1.0, 0.0)], "v double, w double")
    assert zero.agg(c.weighted_mean("v", "w")).first()[0] is None


def test_schema_report(spark):
    frame = spark.createDataFrame([("A", "ALL")], "` Variable_Name` string, YEAR string")
    got = {r["column_name"]: r["present"] for r in schema_report(frame, ["variable_name", "year", "missing_codes"], "m").collect()}
    assert got == {"variable_name": 1, "year": 1, "missing_codes": 0}
