import numpy as np
import pandas as pd
import pytest

from tallyspark.operators import regression
from tallyspark.operators.profiles import within_group_slope
from tallyspark.operators.regression import ols_hc1


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(40, 10, 800), "a": rng.choice(["1", "2", "10"], 800), "b": rng.choice(["u", "v"], 800)})
    pdf["x2"] = pdf["x"] ** 2
    pdf["y"] = 1 + 0.3 * pdf["x"] + (pdf["a"] == "2") * 2 - (pdf["b"] == "v") + rng.normal(size=800) * (1 + (pdf["b"] == "v"))
    pdf.loc[:4, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(5)


def hc1(design, y):
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    n, k = len(y), np.linalg.matrix_rank(design)
    cov = inverse @ (design.T * e**2) @ design @ inverse * n / (n - k)
    return beta, np.sqrt(np.diag(cov)), 1 - e @ e / ((y - y.mean()) ** 2).sum()


def test_matches_dense_solution(data):
    pdf, df = data
    kept = pdf.dropna()
    a2, a10, v = [(kept[c] == level).to_numpy(float) for c, level in [("a", "2"), ("a", "10"), ("b", "v")]]
    design = np.column_stack([np.ones(len(kept)), a2, a10, v, a2 * v, a10 * v, kept["x"], kept["x2"]])
    beta, se, r2 = hc1(design, kept["y"].to_numpy())
    got = ols_hc1(df, "y", ["C(a)*C(b)", "x", "x2"]).toPandas()
    assert list(got["term"]) == ["Intercept", "C(a)[T.2]", "C(a)[T.10]", "C(b)[T.v]", "C(a)[T.2]:C(b)[T.v]", "C(a)[T.10]:C(b)[T.v]", "x", "x2"]
    assert got["coefficient"].to_numpy() == pytest.approx(beta, rel=1e-6, abs=1e-8)
    assert got["std_error"].to_numpy() == pytest.approx(se, rel=1e-6)
    assert got["r_squared"][0] == pytest.approx(r2) and got["nobs"][0] == 795


def test_rank_deficient_design_gives_the_same_fit(data):
    _, df = data
    twice = df.selectExpr("*", "x * 2 AS again")
    full = ols_hc1(df, "y", ["x"]).toPandas()
    extra = ols_hc1(twice, "y", ["x", "again"]).toPandas()
    assert extra["r_squared"][0] == pytest.approx(full["r_squared"][0])
    assert extra["coefficient"][1] + 2 * extra["coefficient"][2] == pytest.approx(full["coefficient"][1])


def test_within_slope_equals_group_dummies(data):
    _, df = data
    slope = within_group_slope(df, "y", "x", "a").first()["slope"]
    fit = ols_hc1(df, "y", ["x", "C(a)"]).toPandas().set_index("term")
    assert slope == pytest.approx(fit.loc["x", "coefficient"])


def linked(rng, n=900):
    """Rows with two unbalanced factors that overlap, an explicit factor and two numbers."""
    pdf = pd.DataFrame({"f": rng.integers(0, 40, n), "x": rng.normal(5, 2, n), "a": rng.choice(["1", "2", "10"], n)})
    pdf["g"] = np.where(rng.random(n) < 0.1, pdf["f"] % 17, rng.integers(0, 17, n))
    pdf["z"] = pdf["x"] * 0.5 + pdf["f"] * 0.1 + rng.normal(size=n)
    pdf["y"] = 2 + pdf["x"] - 0.3 * pdf["z"] + pdf["f"] * 0.2 - (pdf["g"] % 3) + (pdf["a"] == "2") + rng.normal(size=n) * (1 + pdf["x"].abs() / 5)
    return pdf


def indicators(column):
    levels = sorted(set(column), key=float)
    return np.column_stack([column.to_numpy() == v for v in levels[1:]]).astype(float)


def test_absorbed_factors_equal_indicators(spark):
    pdf = linked(np.random.default_rng(8))
    df = spark.createDataFrame(pdf.astype({"f": str, "g": str})).repartition(7)
    dense = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["z"], indicators(pdf["a"]), indicators(pdf["f"]), indicators(pdf["g"])])
    beta, se, r2 = hc1(dense, pdf["y"].to_numpy())
    for absorb in (["f"], ["f", "g"]):
        parts = ["x", "z", "C(a)", "C(f)", "C(g)"]
        got = ols_hc1(df, "y", parts, absorb=absorb).toPandas().set_index("term")
        assert len(got) == dense.shape[1]
        for place, term in enumerate(["x", "z", "C(a)[T.2]", "C(a)[T.10]"]):
            assert got.loc[term, "coefficient"] == pytest.approx(beta[1 + place], rel=1e-6)
            assert got.loc[term, "std_error"] == pytest.approx(se[1 + place], rel=1e-6)
        assert got["r_squared"].iloc[0] == pytest.approx(r2) and got.loc["Intercept", "coefficient"] == pytest.approx(beta[0], rel=1e-5)
        levels = [f"C(f)[T.{v}]" for v in range(1, 40)] + [f"C(g)[T.{v}]" for v in range(1, 17)]
        assert got.loc[levels, "coefficient"].to_numpy() == pytest.approx(beta[5:], rel=1e-5, abs=1e-6)
        assert got.loc[f"C({absorb[0]})[T.3]", ["std_error", "p_value"]].isna().all()


def test_large_factors_are_absorbed_on_their_own(spark, monkeypatch):
    pdf = linked(np.random.default_rng(9))
    df = spark.createDataFrame(pdf.astype({"f": str, "g": str}))
    whole = ols_hc1(df, "y", ["x", "C(a)*C(g)", "C(f)"]).toPandas().set_index("term")
    monkeypatch.setattr(regression, "EXPLICIT_TERMS", 30)
    part = ols_hc1(df, "y", ["x", "C(a)*C(g)", "C(f)"]).toPandas().set_index("term")
    assert whole["std_error"].notna().all() and part["std_error"].notna().sum() == 1
    for column in ("coefficient", "std_error", "r_squared", "adj_r_squared"):
        assert part.loc["x", column] == pytest.approx(whole.loc["x", column], rel=1e-6)


def test_absorbed_factor_of_parts_that_never_meet(spark):
    """Two blocks of levels without a shared cell: one more dependent column, and a column the factors span."""
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"f": rng.integers(0, 6, 300)})
    pdf["g"] = np.where(pdf["f"] < 3, rng.integers(0, 3, 300), rng.integers(3, 6, 300))
    pdf["x"], pdf["flat"] = rng.normal(size=300), pdf["f"] * 2.0
    pdf["y"] = pdf["x"] + pdf["f"] - pdf["g"] + rng.normal(size=300)
    dense = np.column_stack([np.ones(300), pdf["x"], indicators(pdf["f"]), indicators(pdf["g"])])
    beta, se, r2 = hc1(dense, pdf["y"].to_numpy())
    got = ols_hc1(spark.createDataFrame(pdf), "y", ["x", "flat"], absorb=["f", "g"]).toPandas().set_index("term")
    assert got.loc["x", "coefficient"] == pytest.approx(beta[1]) and got.loc["x", "std_error"] == pytest.approx(se[1])
    assert got.loc["flat", "coefficient"] == 0 and got["r_squared"].iloc[0] == pytest.approx(r2)


def test_categorical_design_runs_without_python(data, monkeypatch):
    _, df = data
    plans = []
    keep = regression._gather
    monkeypatch.setattr(regression, "_gather", lambda sums, size: plans.append(sums._jdf.queryExecution().toString()) or keep(sums, size))
    ols_hc1(df, "y", ["C(a)*C(b)", "x"])
    assert len(plans) == 2 and not any("InPandas" in p or "InArrow" in p or "Python" in p for p in plans)


def test_empty_and_missing_rows(spark):
    empty = spark.createDataFrame([], "y double, x double, a string")
    for parts in (["x"], ["x", "C(a)"]):
        with pytest.raises(ValueError):
            ols_hc1(empty, "y", parts)


def test_one_absorbed_factor_stores_only_its_cells(spark, monkeypatch):
    """Means of a single factor come from its cells: no table of sweeps, errors or effects is written, and only rows meet their level."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"h": rng.integers(0, 90, 500), "x": rng.normal(size=500)})
    pdf["k"], pdf["y"] = pdf["h"] % 4, pdf["x"] * 0.4 + pdf["h"] * 0.1 + rng.normal(size=500)
    pdf.loc[:3, "x"] = np.nan
    stored, joins = [], []
    keep, gather = regression.stage, regression._gather
    monkeypatch.setattr(regression, "stage", lambda df, name, *more: stored.append(name) or keep(df, name, *more))
    monkeypatch.setattr(regression, "new_stage_path", lambda *_: pytest.fail("a table of means is written"))
    monkeypatch.setattr(regression, "_gather", lambda sums, size: joins.append("Join" in sums._jdf.queryExecution().toString()) or gather(sums, size))
    df = spark.createDataFrame(pdf.astype({"h": str, "k": str})).unionByName(spark.createDataFrame([(None, 1.0, "1", 2.0)], "h string, x double, k string, y double"))
    got = ols_hc1(df, "y", ["x"], absorb=["k*h"]).toPandas().set_index("term")
    assert stored == ["cells"] and joins == [False, True]
    kept = pdf.dropna()
    beta, se, r2 = hc1(np.column_stack([np.ones(len(kept)), kept["x"], indicators(kept["h"])]), kept["y"].to_numpy())
    assert got.loc["x", ["coefficient", "std_error"]].to_numpy(float) == pytest.approx([beta[1], se[1]], rel=1e-6)
    assert got["r_squared"].iloc[0] == pytest.approx(r2) and len(got) == kept["h"].nunique() + 1
    assert got.loc["Intercept", "coefficient"] == pytest.approx(kept[kept["h"] == kept[kept["k"] == 0]["h"].pipe(lambda h: min(h, key=int))].pipe(lambda g: (g["y"] - beta[1] * g["x"]).mean()))
