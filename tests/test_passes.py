"""Models that pass over their rows many times."""

import random

from pyspark.ml.linalg import Vectors

from murmur.operators import experiments


def tasks_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
    return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)  # skipped stages have none


def test_kmeans_passes_do_not_grow_with_the_files(spark):
    """3 and 60 partitions of the same rows: the same groups, and but for the first reading the same number of tasks."""
    r = random.Random(5)
    rows = [(f"u{k}", "train", "human", Vectors.dense([r.gauss(k % 5 * 3, 1), r.gauss(0, 1)])) for k in range(600)]
    data = spark.createDataFrame(rows, ["user_id", "split", "label", "raw"])
    found = {}
    for parts in (3, 60):
        given = data.repartition(parts)
        frame, n = tasks_of(spark, f"kmeans-{parts}", lambda given=given: experiments.kmeans_groups(given, 5, starts=2, parts=6))
        found[parts] = ({x.user_id: x.community_id for x in frame.collect()}, n)
    assert found[3][0] == found[60][0]
    assert len(set(found[3][0].values())) == 5
    assert found[60][1] - found[3][1] <= 3 * 57  # the reading itself, and not every pass


def test_gradient_passes_equal_a_plain_version_and_take_one_stage(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + r.normal(size=300) > 0).astype(float)
    split = ["train" if k % 3 else "valid" if k % 2 else "test" for k in range(300)]
    rows = spark.createDataFrame([(s, float(b), v.tolist()) for s, b, v in zip(split, y, x, strict=True)], "split string, y double, z array<double>")
    (weights, bias, epochs), tasks = tasks_of(spark, "gradient", lambda: experiments.logistic_gradient_descent(rows, 3, epochs=40))
    train, valid = (np.array([s == k for s in split]) for k in ("train", "valid"))
    w, b, best, least = np.zeros(3), 0.0, None, np.inf
    for epoch in range(41):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))[valid].mean()
        if epoch and loss + 1e-9 < least:
            best, least = (w, b), loss
        w, b = w - 0.05 * ((p - y)[train] @ x[train] / train.sum() + 0.001 * w), b - 0.05 * (p - y)[train].mean()
    assert epochs == 40
    assert np.allclose(weights, best[0], atol=1e-9) and abs(bias - best[1]) < 1e-9
    n = spark.sparkContext.defaultParallelism
    assert tasks <= 41 * n + 3 * n + 8  # no second stage a pass


def test_gradient_of_no_valid_rows(spark):
    rows = spark.createDataFrame([("train", 1.0, [1.0]), ("train", 0.0, [-1.0])], "split string, y double, z array<double>")
    weights, bias, epochs = experiments.logistic_gradient_descent(rows, 1, epochs=3)
    assert epochs == 3 and weights[0] > 0
