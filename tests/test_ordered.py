import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import ordered
from tallyspark.operators import indices


def frame(spark, rows, schema="g string, x double, w double"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "values, expected",
    [([5, 5, 5], 0.0), ([0, 0, 0, 1], 0.75), ([-1, 0, 1], 4 / 9), ([0, 0], 0.0), ([None], None)],
)
def test_gini_known_values(spark, values, expected):
    df = frame(spark, [("a", None if v is None else float(v), 1.0) for v in values])
    got = ordered.gini(df, ["g"], "x", "w").first()["GINI"]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_gini_ignores_incomplete_pairs_and_scale(spark):
    rows = [("a", 1.0, 2.0), ("a", 4.0, 1.0), ("a", None, 9.0), ("a", 7.0, None)]
    plain = ordered.gini(frame(spark, rows), ["g"], "x", "w").first()["GINI"]
    scaled = ordered.gini(frame(spark, [(g, x and x * 10, w) for g, x, w in rows]), ["g"], "x", "w").first()["GINI"]
    assert plain == pytest.approx(scaled) and 0 <= plain <= 1


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value of it a third of them."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(rng.random(6000) < 0.9, "hot", rng.choice(list("abc"), 6000)), "x": rng.normal(size=6000).round(2)})
    pdf.loc[rng.random(6000) < 0.33, "x"] = 0.5
    pdf["y"] = (pdf["x"] * 2 + rng.normal(size=6000)).round(1)
    pdf["w"] = rng.integers(1, 5, 6000).astype(float)
    return pdf, spark.createDataFrame(pdf)


def test_sliced_totals_equal_window_totals(skewed):
    _, df = skewed
    cells = ordered.value_cells(df, ["g"], "x", {"n": F.lit(1)})
    both = [
        sorted((r["g"], r["x"], r["cum_n"], r["tot_n"]) for r in ordered.running_totals(cells, ["g"], "x", ["n"], limit).collect())
        for limit in (10**9, 0)
    ]
    assert both[0] == both[1] and len(both[0]) > 100


@pytest.mark.parametrize("limit", [None, 0])
def test_quantiles_equal_linear_interpolation(skewed, limit):
    pdf, df = skewed
    probs = {"a": 0.01, "b": 0.3, "c": 0.5, "d": 0.99}
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "x", probs, window_cells=limit).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(part["x"].quantile(p))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_results_do_not_depend_on_partitioning(skewed, parts):
    pdf, df = skewed
    got = {r["g"]: r["rho"] for r in ordered.spearman(df.repartition(parts), ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()))
    ginis = {r["g"]: r["GINI"] for r in ordered.gini(df.repartition(parts), ["g"], "x", "w").collect()}
    for g, part in pdf.groupby("g"):
        x = (part["x"] - min(part["x"].min(), 0)).to_numpy()
        order = np.argsort(x, kind="stable")
        x, w = x[order], part["w"].to_numpy()[order]
        area = (w * (2 * np.cumsum(x * w) - x * w)).sum()
        assert ginis[g] == pytest.approx(1 - area / (w.sum() * (x * w).sum()))


def test_spearman_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0), (1, 2.0, 3.0), (1, None, 9.0)], "k int, a double, b double")
    assert ordered.spearman(df, ["k"], "a", "b").first()["rho"] == pytest.approx(0.866025, abs=1e-6)


def test_wealth_class_cuts(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 11)] + [(1, None)], "YEAR int, s double")
    got = [r["wealth_class"] for r in indices.wealth_class(df, "s").orderBy("s").collect()]
    assert got == [None] + ["poor"] * 3 + ["middle"] * 4 + ["rich"] * 3


def test_component_scores_have_zero_mean_and_eigenvalue_variance(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=500)
    pdf = pd.DataFrame({"YEAR": 2009, "a": base + rng.normal(size=500), "b": base, "c": -base + rng.normal(size=500)})
    pdf.loc[::50, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    fitted = indices.fit_components(df, {2009: ["a", "b", "c", "absent"]})
    scores = indices.with_component(df, fitted, "s").toPandas()["s"]
    assert scores.mean() == pytest.approx(0, abs=1e-9)
    assert scores.var(ddof=0) == pytest.approx(fitted[2009].eigenvalue)
    lead = fitted[2009].loadings
    assert lead[int(np.argmax(np.abs(lead)))] > 0
    filled = pdf[["a", "b", "c"]].fillna(pdf[["a", "b", "c"]].median())
    z = ((filled - filled.mean()) / filled.std(ddof=0)).to_numpy()
    expected = np.linalg.svd(z, full_matrices=False)[2][0]
    assert np.abs(expected) == pytest.approx(np.abs(lead))


def test_index_rules(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 3.0)], "YEAR int, a double, b double")
    with pytest.raises(ValueError):
        indices.pca_index(df, ["a", "b"], "s")
    with pytest.raises(ValueError):
        indices.asset_score(df, ["zzz"])
    assert [r["t"] for r in indices.asset_score(df, ["a", "b", "q"], "t").collect()] == [3.0, 3.0]
    assert indices.fit_components(df, {1: ["a", "b"]}) == {}
