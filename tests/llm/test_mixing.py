import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import mixing
from weft.llm.common import Scratch

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    model = mixing.fit(docs, labels.where(fold == 0))
    p = mixing.posteriors(docs, model).join(labels.where(fold == 1).select("doc_id", mixing.domain().alias("d")), "doc_id").collect()
    assert np.mean([int(np.argmax([r.p0, r.p1, r.p2])) == r.d for r in p]) > 0.8
    assert all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in p)


def brute(n, p, goal):
    """Plain projected gradient in numpy with many small steps on the same objective."""
    m = (p * n[:, None]).T @ p
    w = np.linalg.pinv(m + np.eye(len(goal)) * 1e-6 * np.trace(m))
    r = np.ones(len(n))
    for _ in range(4000):
        r = np.maximum(0, r - 0.2 * p @ (w @ ((r * n) @ p - goal)))
    return r


@pytest.mark.parametrize("share", [[0.5, 0.3, 0.2], [0.9, 0.06, 0.04]])
def test_rates(spark, share):
    g = np.random.default_rng(2)
    n, p = g.integers(1, 500, 200), g.dirichlet([2, 1, 0.5], 200)
    scored = spark.createDataFrame([(i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n long, p0 double, p1 double, p2 double")
    goal = [float(x * n.sum()) for x in share]
    rated, totals = mixing.fit_rates(scored, goal, Scratch(spark), steps=60)
    r = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
    want = brute(n.astype(float), p, np.array(goal))
    assert (r >= 0).all() and np.allclose(totals, (r * n) @ p, rtol=1e-6)
    assert np.allclose((r * n) @ p, (want * n) @ p, atol=0.02 * n.sum())
    if share[0] < 0.9:
        assert np.allclose(totals, goal, rtol=0.001)


def test_edges_and_drawing(spark):
    docs = spark.createDataFrame([(1, "good words here", 7), (1, "good words here", 7), (None, None, 0), (2, "", 1), (3, "bad stuff", 2)], "doc_id long, text string, n int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (77, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rates = mixing.mix(spark, docs, labels)
    assert rates.count() == 5
    out = mixing.draw(docs, rates)
    assert out.columns == docs.columns
    fixed = spark.createDataFrame([(1, 2.0), (None, 1.0), (2, 0.0), (3, 0.5)], "doc_id long, rate double")
    times = {r.doc_id: r["count"] for r in mixing.draw(docs, fixed).groupBy("doc_id").count().collect()}
    assert times[1] == 4 and times[None] == 1 and 2 not in times
    assert mixing.mix(spark, docs.limit(0), labels.limit(0)).count() == 0


def test_draws_follow_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert abs(mixing.draw(docs, docs.select("doc_id", F.lit(0.3).alias("rate"))).count() - 1200) < 120


def test_labels_of_one_id_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i, "some words here" if i % 2 else "other things there") for i in range(20)], "doc_id long, text string")
    rows = [(i, i % 2, 0) for i in range(20)] + [(i, 1, 1) for i in range(5)] + [(i, 0, None) for i in range(3, 12)]
    models = [mixing.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n)) for x, n in ((rows, 1), (rows[::-1], 1), (sorted(rows, key=str), 3))]
    assert models[0] == models[1] == models[2]
