import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import bayes, classifiers, features, metrics, sampling, trees, unsupervised


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"YEAR": rng.choice([1989, 1999, 2009], n), "SERIAL": [str(i) for i in range(n)], "URBAN_H": rng.choice(["0", "1"], n), "GEO1_VN": rng.choice(list("abcd"), n)})
    score = (pdf["URBAN_H"] == "1") * 2 + (pdf["GEO1_VN"] == "a") + rng.normal(size=n) * 0.3
    pdf["wealth_class"] = np.where(score > 2.5, "rich", np.where(score > 0.7, "middle", "poor"))
    pdf["wealth_index"] = score
    return pdf, spark.createDataFrame(pdf)


FEATURES = ["URBAN_H", "YEAR", "GEO1_VN"]
KEYS = ["YEAR", "SERIAL"]


@pytest.fixture(scope="module")
def cells(people):
    return features.model_cells(people[1], "wealth_class", FEATURES, KEYS)


def test_macro_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    row = metrics.scores(metrics.confusion_counts(df, "y", "p")).first()
    assert row["macro_f1"] == pytest.approx(2 / 3) and row["accuracy"] == pytest.approx(2 / 3)
    only = spark.createDataFrame([("a", "c")], "y string, p string")
    assert metrics.scores(metrics.confusion_counts(only, "y", "p")).first()["macro_f1"] == 0.0


def test_split_is_complete_disjoint_and_stratified(people):
    split = sampling.stratified_split(people[1], KEYS, "wealth_class")
    share = split.groupBy("wealth_class").agg(F.avg((F.col("split") == "train").cast("double")).alias("s")).collect()
    assert all(0.74 < r["s"] < 0.86 for r in share)
    again = sampling.stratified_split(people[1].repartition(17), KEYS, "wealth_class")
    assert again.exceptAll(split).count() == 0


def test_priority_sample_is_fixed_size_and_stable(people):
    one = sampling.priority_sample(people[1], KEYS, 100)
    two = sampling.priority_sample(people[1].repartition(9), KEYS, 100)
    assert one.count() == 100 and one.exceptAll(two).count() == 0
    assert sampling.priority_sample(people[1], KEYS, 10**6).count() == 3000
    whole = one.collect()
    sampling.THIN_ABOVE, before = 10, sampling.THIN_ABOVE
    assert sampling.priority_sample(people[1], KEYS, 100).collect() == whole
    sampling.THIN_ABOVE = before


def test_temporal_folds(people):
    folds = {r["test_year"]: r for r in sampling.temporal_folds(people[1], "wealth_class").collect()}
    assert set(folds) == {1999, 2009} and folds[2009]["train_years"] == "1989 | 1999"


def test_fill_uses_median_and_lowest_mode(spark):
    cells = spark.createDataFrame([(1.0, "b", 1), (None, "a", 1), (9.0, None, 1), (2.0, "a", 0), (3.0, "b", 0)], "v double, c string, n bigint")
    fill = features.fit_fill(cells.filter("n > 0"), ["v", "c"])
    assert fill.medians == {"v": 5.0} and fill.modes == {"c": "a"}


def test_unseen_category_encodes_as_zeros(spark, cells):
    encoder = features.fit_encoder(cells, ["URBAN_H"])
    new = spark.createDataFrame([("7",)], "URBAN_H string")
    assert sum(encoder.transform(new).first()["features"]) == 0.0


def test_cells_train_the_same_as_rows(people, cells):
    train = cells.filter("train")
    rows = train.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i").withColumn("n", F.lit(1).cast("bigint"))
    a = classifiers.fit_classifier("logistic_regression", train, "wealth_class", FEATURES).learner
    b = classifiers.fit_classifier("logistic_regression", rows, "wealth_class", FEATURES).learner
    assert np.abs(a.coefficientMatrix.toArray() - b.coefficientMatrix.toArray()).max() < 0.05


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest", "svm_rbf", "boosted_trees"])
def test_learners_beat_the_majority(cells, name):
    model = classifiers.fit_classifier(name, cells.filter("train"), "wealth_class", FEATURES, trees=10, depth=5, rounds=2)
    assert classifiers.evaluate(model.predict(cells.filter("NOT train")), "wealth_class").first()["accuracy"] > 0.8


def test_network_learns(people):
    net, history = classifiers.fit_network(people[1], "wealth_class", FEATURES, hidden=(8,), max_iter=40)
    assert history[-1] < history[0]
    sample = people[1].groupBy(*FEATURES, "wealth_class").agg(F.count(F.lit(1)).alias("n"))
    assert classifiers.evaluate(net.predict(sample), "wealth_class").first()["accuracy"] > 0.7


def test_permutation_keeps_each_column_and_row_count(people):
    permuted = classifiers.permuted_cells(people[1].select(*KEYS, "URBAN_H", "GEO1_VN", "wealth_class"), KEYS, "wealth_class", ["URBAN_H", "GEO1_VN"], repeats=2).toPandas()
    pdf = people[0]
    for (feature, repeat), part in permuted.groupby(["feature", "repeat"]):
        for column in ["URBAN_H", "GEO1_VN", "wealth_class"]:
            assert part.groupby(column)["n"].sum().to_dict() == pdf[column].value_counts().to_dict()
        kept = "GEO1_VN" if feature == "URBAN_H" else "URBAN_H"
        assert part.groupby([kept, "wealth_class"])["n"].sum().to_dict() == pdf.groupby([kept, "wealth_class"]).size().to_dict()


def test_importance_ranks_the_driving_feature_first(people, cells):
    model = classifiers.fit_classifier("random_forest", cells.filter("train"), "wealth_class", FEATURES, trees=10, depth=5)
    table = {r["feature"]: r["importance_mean"] for r in classifiers.permutation_importance(model, people[1], KEYS, "wealth_class", FEATURES).collect()}
    assert max(table, key=table.get) == "URBAN_H" and abs(table["YEAR"]) < 0.05


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(None,)], "v double")
    got = [r["b"] for r in bayes.quantile_bins(df, "v", ["l", "m", "h"], "b").orderBy(F.col("v").asc_nulls_last()).collect()]
    assert got == ["l"] * 3 + ["m"] * 3 + ["h"] * 3 + [None]
    flat = spark.createDataFrame([(5.0,), (None,)], "v double")
    assert {r["b"] for r in bayes.quantile_bins(flat, "v", ["l", "m"], "b").collect()} == {"5.0", "-1.0"}
    lumpy = spark.createDataFrame([(0.0,)] * 8 + [(6.0,), (9.0,)], "v double")
    got = [r["b"] for r in bayes.quantile_bins(lumpy, "v", ["l", "m", "h"], "b").orderBy("v").collect()]
    assert got == ["l"] * 8 + ["m", "h"]


@pytest.fixture(scope="module")
def network(people):
    prepared = bayes.prepare(people[1], ["YEAR", "GEO1_VN", "URBAN_H", "wealth_class"], keep=["SERIAL"])
    return bayes.network_cells(prepared, ["YEAR", "GEO1_VN", "URBAN_H", "wealth_class"], "wealth_class", ["SERIAL"])


VARIABLES = ["YEAR", "GEO1_VN", "URBAN_H", "wealth_class"]


def test_search_links_class_to_its_causes(network):
    edges = bayes.search_structure(network, VARIABLES)
    linked = {v for e in edges if "wealth_class" in e for v in e}
    assert {"URBAN_H", "GEO1_VN"} <= linked and not any("YEAR" in e for e in edges)


def test_tables_sum_to_one_and_posterior_matches_counts(people, network):
    table = bayes.conditional_table(network, "wealth_class", ["URBAN_H", "GEO1_VN"])
    sums = table.groupBy("URBAN_H", "GEO1_VN").agg(F.sum("prob").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    edges = [("URBAN_H", "wealth_class"), ("GEO1_VN", "wealth_class"), ("URBAN_H", "GEO1_VN")]
    pdf = people[0]
    got = {r["wealth_class"]: r["prob"] for r in bayes.posterior(network, edges, "wealth_class", VARIABLES, {"GEO1_VN": "a"}).collect()}
    expected = pdf[pdf["GEO1_VN"] == "a"]["wealth_class"].value_counts(normalize=True).to_dict()
    assert got == pytest.approx(expected)
    base = {r["wealth_class"]: r["prob"] for r in bayes.posterior(network, edges, "wealth_class", VARIABLES, {}).collect()}
    assert base == pytest.approx(pdf["wealth_class"].value_counts(normalize=True).to_dict())


def test_prediction_falls_back_to_the_mode(spark, network):
    test = spark.createDataFrame([("1989", "new", "1", "rich", 2)], "YEAR string, GEO1_VN string, URBAN_H string, wealth_class string, n bigint")
    edges = [("URBAN_H", "wealth_class"), ("GEO1_VN", "wealth_class")]
    mode = max(((r["k"], r["wealth_class"]) for r in network.groupBy("wealth_class").agg(F.sum("n").alias("k")).collect()))[1]
    assert bayes.predict(network, test, edges, "wealth_class", VARIABLES).first()["prediction"] == mode


def test_clusters_and_anomalies(people, cells):
    labelled, row = unsupervised.kmeans_clusters(cells, FEATURES, starts=2)
    assert -1 <= row.first()["silhouette_score"] <= 1
    assert unsupervised.cluster_summary(labelled).agg(F.sum("n_households")).first()[0] == 3000
    extreme = people[1].withColumn("wealth_index", F.when(F.col("SERIAL") == "17", 500.0).otherwise(F.col("wealth_index")))
    flagged = unsupervised.isolation_forest(extreme, ["YEAR", "wealth_index"], KEYS, trees=30).cache()
    assert flagged.count() == 3000
    assert flagged.filter("SERIAL = '17'").first()["is_anomaly"] == 1
    share = flagged.agg(F.avg("is_anomaly")).first()[0]
    assert 0 < share <= 0.031
    rates = unsupervised.anomaly_rates(flagged, ["YEAR", "URBAN_H"]).collect()
    assert {(r["group_dimension"], r["group_value"]) for r in rates} == {("YEAR", "1989"), ("YEAR", "1999"), ("YEAR", "2009"), ("URBAN_H", "0"), ("URBAN_H", "1")}


def test_representation_loss_falls_with_size(people, cells):
    scored = people[1].groupBy(*FEATURES, "wealth_index").agg(F.count(F.lit(1)).alias("n"))
    rows = unsupervised.representation_benchmark(cells, scored, "wealth_class", FEATURES, sizes=(2, 3), starts=1).collect()
    assert rows[0]["reconstruction_mse"] > rows[1]["reconstruction_mse"]
    assert rows[0]["explained_variance_ratio"] < rows[1]["explained_variance_ratio"] <= 1 + 1e-9


def small_table(seed=2):
    rng = np.random.default_rng(seed)
    x = np.unique(np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 2, 60), rng.integers(0, 5, 60)]).astype(float), axis=0)
    return trees.make_table(x, rng.integers(0, 30, (len(x), 3)).astype(float) + 20 * (x[:, [0, 1, 2]] > 0))


def test_histogram_finds_the_best_split():
    table = small_table()
    rng = np.random.default_rng(3)
    node = rng.integers(0, 3, len(table.x))
    g, h = rng.normal(size=len(node)) * 9, rng.uniform(1, 5, len(node))
    best, gain = trees.best_splits(table, np.arange(len(table.columns)), node, 3, g, h)
    for k in range(3):
        own, found = node == k, {}
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + trees.PENALTY)
        for s, (column, cut) in enumerate(zip(table.columns, table.cuts)):
            up = own & (table.x[:, column] > cut)
            if min(h[up].sum(), h[own & ~up].sum()) >= trees.LEAST_WEIGHT:
                found[s] = score(up) + score(own & ~up) - score(own)
        assert gain[k] == pytest.approx(max(found.values())) and found[best[k]] == pytest.approx(gain[k])


def test_boosting_follows_its_own_steps():
    """Margins from the returned trees give a falling loss, and equal cells split into two give the same trees."""
    table = small_table()

    def grown(t, rounds=12):
        return list(trees.boost(t, rounds, 3, 0.3, 1.0, 1.0, 1))

    def totals(made, x):
        wide = [(k, *zip(*[(f, c, lo, up, [w if j == k else 0.0 for j in range(3)]) for _, f, c, lo, up, w in sorted(nodes)])) for _, k, nodes in made]
        rows = [(i, *map(np.array, parts[1:-1]), np.concatenate(parts[-1])) for i, parts in enumerate(wide)]
        return trees.pack(rows, 3).totals(x)

    def loss(margin):
        share = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        return -(table.counts * np.log(share)).sum()

    losses = [loss(totals(grown(table, r), table.x)) for r in (1, 4, 12)]
    assert losses[0] > losses[1] > losses[2]
    half = trees.make_table(np.vstack([table.x, table.x]), np.vstack([table.counts, table.counts]) / 2)
    assert [n[:2] for _, _, nodes in grown(half) for n in nodes] == [n[:2] for _, _, nodes in grown(table) for n in nodes]


def test_forest_is_repeatable_and_its_trees_differ(spark):
    table = small_table()
    one, two = (trees.fit_forest(spark, table, 20, 30, 7) for _ in range(2))
    assert (one.feature == two.feature).all() and (one.value == two.value).all() and len(one.roots) == 20
    pure = trees.make_table(np.array([[0.0], [1.0], [2.0]]), np.array([[50.0, 0], [0, 50], [50, 0]]))
    forest = trees.fit_forest(spark, pure, 9, 30, 7)
    assert forest.totals(pure.x).argmax(axis=1).tolist() == [0, 1, 0]
    roots = {(one.feature[r], one.cut[r]) for r in one.roots}
    assert len(roots) > 1


def test_more_cells_than_fit_take_the_distributed_learner(cells, monkeypatch):
    monkeypatch.setattr(trees, "MAX_CELLS", 3)
    model = classifiers.fit_classifier("random_forest", cells.filter("train"), "wealth_class", FEATURES, trees=5, depth=4)
    assert not isinstance(model.learner, trees.TreeLearner)
    assert classifiers.evaluate(model.predict(cells.filter("NOT train")), "wealth_class").first()["accuracy"] > 0.8
