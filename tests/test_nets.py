import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyspark.operators import classifiers, nets


def _cells(spark):
    rows = [(1989 + 10 * (k % 3), str(k % 2), ["a", "b", None][k % 5 % 3], ["poor", "middle", "rich"][(k % 2 + k % 3) % 3], 1 + 7 * (k % 4)) for k in range(60)]
    return spark.createDataFrame(rows, "YEAR int, URBAN_H string, GEO1_VN string, wealth_class string, n bigint")


def test_cells_give_the_net_of_their_rows(spark):
    names = ["YEAR", "URBAN_H", "GEO1_VN"]
    cells = _cells(spark)
    rows = cells.select(*names, "wealth_class", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")
    a, one = classifiers.fit_network_cells(cells, "wealth_class", names, (4,), 15)
    b, two = classifiers.fit_network(rows, "wealth_class", names, (4,), 15)
    assert np.allclose(one, two, atol=1e-6) and one[-1] < one[0]
    assert np.allclose(a.learner.weights.toArray(), b.learner.weights.toArray(), atol=1e-3)


def test_net_follows_the_learner_of_spark(spark):
    rng = np.random.default_rng(3)
    rows = [(float(k % 3), rng.normal(size=4).round(3).tolist(), 1) for k in range(120)]
    df = spark.createDataFrame(rows, "_y double, x array<double>, n bigint").select("_y", array_to_vector("x").alias("features"), "n").coalesce(1)
    theirs = MultilayerPerceptronClassifier(layers=[4, 5, 3], labelCol="_y", maxIter=12, seed=42, blockSize=120).fit(df)
    model, history = nets.fit_net(df, "n", (5,), 3, 12, 42, 1)
    assert np.allclose(history, theirs.summary().objectiveHistory, atol=1e-5)
    assert np.allclose(model.weights.toArray(), theirs.weights.toArray(), atol=1e-2)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    layers, x, y, n = [3, 4, 2], rng.normal(size=(6, 3)), np.array([0, 1, 1, 0, 1, 0]), np.arange(1.0, 7.0)
    w = rng.normal(size=4 * 4 + 5 * 2)
    found = nets.loss_and_gradient(w, layers, x, y, n)[1:]
    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-6
        up, down = (nets.loss_and_gradient(w + s, layers, x, y, n)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - found[k]) < 1e-4
