"""Cases that once gave wrong or incomplete results."""

import numpy as np
import pytest

from tallyspark.operators.indices import wealth_class
from tallyspark.operators.regression import ols_hc1
from tallyspark.operators.unsupervised import isolation_forest
from tallyspark.sources import loose_csv, rules


def test_isolation_forest_keeps_negative_zero(spark):
    rows = [(k, float(k % 17), -0.0 if k == 5 else float(k % 3)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    assert isolation_forest(df, ["x", "y"], ["k"]).count() == 200


def test_rank_deficient_fit_is_the_shortest(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        year = 1.0 + k % 2
        sex = "M" if year == 2.0 and k % 4 == 1 else ["1", "2"][k // 2 % 2]
        rows.append((float(rng.normal() + year), sex, year, 100 * year))
    df = spark.createDataFrame(rows, "y double, SEX string, YEAR double, SCALED double")
    fit = ols_hc1(df, "y", ["C(SEX)", "YEAR", "SCALED"]).toPandas()
    names = {"Intercept": lambda r: 1.0, "YEAR": lambda r: r[2], "SCALED": lambda r: r[3]}
    names |= {f"C(SEX)[T.{v}]": (lambda r, v=v: float(r[1] == v)) for v in ("1", "2", "M")}
    design = np.array([[names[t](r) for t in fit["term"]] for r in rows])
    y = np.array([r[0] for r in rows])
    inverse = np.linalg.pinv(design.T @ design, rcond=1e-12)
    beta = inverse @ design.T @ y
    error = y - design @ beta
    free = len(y) - np.linalg.matrix_rank(design)
    cov = inverse @ (design.T * error**2) @ design @ inverse * len(y) / free
    assert fit["coefficient"].to_numpy() == pytest.approx(beta, rel=1e-6, abs=1e-8)
    assert fit["std_error"].to_numpy() == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-6, abs=1e-8)


def test_loose_headers(spark, tmp_path):
    for header in ("a, b", '"a","b"', " a,b "):
        path = tmp_path / f"f{abs(hash(header))}.csv"
        path.write_text(f"# title, with comma\n{header}\n1,x\n2,\"y,z\"\n")
        got = loose_csv.read_loose_csv(spark, str(path))
        assert got.columns == ["a", "b"] and sorted(tuple(r) for r in got.collect()) == [("1", "x"), ("2", "y,z")]


def test_rule_table_falls_back(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("variable_name,year,missing_codes\nA,ALL,9\n# note, a, b, c, d\nB,2019,8\n")
    got = rules.load_rule_table(spark, str(path))
    assert sorted(tuple(r) for r in got.collect()) == [("A", "ALL", "9"), ("B", "2019", "8")]


def test_yearly_series_quoted(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('"Data Source","World"\n\n"Updated","2024"\n\n"Country, Name","Code","1990","1991"\n"A, B","X","1","2"\n')
    got = loose_csv.read_yearly_series(spark, str(path))
    assert got.columns == ["Country, Name", "Code", "1990", "1991"] and [tuple(r) for r in got.collect()] == [("A, B", "X", "1", "2")]


def test_isolation_forest_scores_rows_where_they_lie(spark):
    """Far rows are flagged, nulls take the median's place, equal rows get equal scores, and no join is planned."""
    rows = [(k, float(k % 10), float(k % 7) if k % 50 else None) for k in range(600)] + [(1_000 + k, 500.0, -300.0) for k in range(6)]
    flagged = isolation_forest(spark.createDataFrame(rows, "k int, x double, y double"), ["x", "y"], ["k"], trees=40)
    assert "Join" not in flagged._jdf.queryExecution().toString()
    got = {r.k: r for r in flagged.collect()}
    assert len(got) == len(rows) and all(got[1_000 + k].is_anomaly == 1 for k in range(6))
    assert got[1].anomaly_score == got[71].anomaly_score and got[50].y is None and 0 < got[50].anomaly_score < got[1_000].anomaly_score


def test_wealth_classes_are_not_dealt_by_year(spark):
    """A few groups would be a few tasks; their cut points reach all rows even where the planner may not broadcast."""
    rows = [(y, float(k)) for y in (1, 2) for k in range(11)] + [(1, None), (None, 5.0)]
    df = spark.createDataFrame(rows, "YEAR int, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classed = wealth_class(df, "score")
        plan = classed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        got = [(r.YEAR, r.score, r.wealth_class) for r in classed.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    label = lambda y, v: None if v is None else "rich" if y is None or v > 7 else "poor" if v <= 3 else "middle"
    assert sorted(got, key=str) == sorted([(y, v, label(y, v)) for y, v in rows], key=str)
