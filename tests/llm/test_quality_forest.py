"""op2's forest and threshold come from every labelled row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality

N = 30_000


@pytest.fixture(scope="module")
def stats(spark):
    """Passing rows, one in ten of them with many symbols and capitals, some with both kinds' features."""
    odd = F.col("id") % 10 == 0
    h = F.pmod(F.xxhash64("id"), F.lit(97))
    rows = spark.range(N).select(
        F.col("id").alias("doc_id"),
        (F.lit(50) + h).alias("n_words"),
        (F.lit(250) + 4 * h + F.col("id") % 41).alias("word_chars"),
        F.when(odd, h).otherwise(h % 11).alias("n_symbols"),
        F.lit(0).cast("long").alias("n_dup_lines"),
        (h % 5).alias("n_repeat_words"),
        F.when(odd, 3 * h).otherwise(h % 29).alias("n_upper"),
        (F.lit(240) + h).alias("n_letters"),
        (F.col("id") % 7).alias("n_calls"),
        (F.col("id") % 3).alias("n_bars"),
    )
    return rows.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(N).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))


def plain_threshold(scores, good):
    """The best cut by trying each score."""
    best, at = 0, None
    values = np.unique(scores)
    for s in values:
        gain = int((good & (scores < s)).sum()) * int((~good).sum()) - int((~good & (scores < s)).sum()) * int(good.sum())
        if gain > best:
            best, at = gain, s
    return np.inf if at is None else (values[np.searchsorted(values, at) - 1] + at) / 2


def test_all_labelled_rows_make_the_model(spark, stats, labels):
    forest, threshold = quality.train(stats, labels, trees=12)
    frame = stats.toPandas()
    x, good = quality.features(frame), (frame.doc_id % 10 != 0).to_numpy()
    assert forest.size == N
    for tree in range(12):
        at = forest.nodes(x, tree, forest.depth)
        leaves, n = np.unique(at, return_counts=True)
        level = np.floor(np.log2(leaves + 1))
        assert (forest.feature[tree, leaves] < 0).all() and n.sum() == N
        assert np.allclose(forest.path[tree, leaves], level + quality.expected_path(n))
        for node in np.flatnonzero(forest.feature[tree] >= 0):
            level = int(np.log2(node + 1))
            inside = x[forest.nodes(x, tree, level) == node, forest.feature[tree, node]]
            assert inside.min() <= forest.cut[tree, node] < inside.max()
    assert threshold == plain_threshold(forest.score(x), good) and np.isfinite(threshold)
    judged = quality.judge(stats, (forest, threshold)).toPandas()
    assert (judged.kept == (judged.anomaly < threshold)).all()
    assert (judged.kept == (judged.doc_id % 10 != 0)).mean() > 0.9


def test_model_does_not_depend_on_partitions(spark, stats, labels):
    models = [quality.train(stats.repartition(n, "doc_id"), labels, trees=3) for n in (1, 7)]
    assert (models[0][0].cut == models[1][0].cut).all() and (models[0][0].path == models[1][0].path).all() and models[0][1] == models[1][1]


@pytest.mark.parametrize("seed", range(4))
def test_threshold_against_every_cut(spark, seed):
    draw = random.Random(seed)
    scores = [(draw.choice([draw.random(), 0.5, round(draw.gauss(0.5, 1e-5), 7), round(draw.random(), 1)]),) for _ in range(800)]
    rows = [(min(1.0, s), draw.random() > s * (seed % 3) / 2) for (s,) in scores]
    got = quality.calibrate(quality.distinct_scores(spark.createDataFrame(rows, "anomaly double, good boolean")))
    assert got == plain_threshold(np.array([s for s, _ in rows]), np.array([g for _, g in rows]))


def test_no_cut_keeps_all(spark):
    for rows in ([(0.2, False), (0.9, True)], [(0.4, True), (0.4, False)], [(0.4, True)]):
        assert quality.calibrate(quality.distinct_scores(spark.createDataFrame(rows, "anomaly double, good boolean"))) == np.inf
