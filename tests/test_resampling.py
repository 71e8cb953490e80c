"""Resampled intervals against weights that are applied in memory, and the unseeded parts of replies and labels."""

import difflib
import hashlib
import json

import numpy as np
import pytest

from proofline.operators import assigned, evidence, ranking, resampling as B, runs

R = 24


@pytest.fixture(scope="module", params=[0, 1, 2])
def scored(request, spark):
    """Scores with ties, one score that a third of all rows have, and all rows of one kind."""
    rng = np.random.default_rng(request.param)
    x = np.concatenate((rng.integers(0, 30, 300).astype(float), rng.random(200) * 30, np.full(250, 7.0)))
    bad = rng.random(len(x)) < 0.2 + x / 60 if request.param < 2 else np.ones(len(x), bool)
    ids = [f"item {i}" for i in range(len(x))]
    rows = [(i, float(a), bool(b)) for i, a, b in zip(ids, x, bad)] + [("no score", None, True)]
    return spark.createDataFrame(rows, "item_id string, score double, error boolean").repartition(5), ids, x, bad


def test_weights_are_those_of_a_poisson_distribution():
    w = B.weights([str(i) for i in range(3000)], 40, 1)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert (B.weights(["7"], 40, 1) == w[7]).all() and (B.weights(["7"], 40, 2) != w[7]).any()


def test_areas(scored):
    df, ids, x, bad = scored
    w = B.weights(ids, R, 5)
    above = (x[:, None] > x) + 0.5 * (x[:, None] == x)
    want = {}
    for r in range(R):
        p, n = w[:, r] * bad, w[:, r] * ~bad
        if p.sum() and n.sum():
            want[r] = p @ above @ n / (p.sum() * n.sum())
    got = {q.r: q.value for q in B.auc_draws(df, R, 5).collect()}
    assert got.keys() == want.keys() and all(got[r] == pytest.approx(want[r], abs=1e-12) for r in want)


@pytest.mark.parametrize("budget", [0.0, 0.1, 0.5, 1.0])
def test_recalls(scored, budget):
    df, ids, x, bad = scored
    w = B.weights(ids, R, 5)
    got = {q.r: q.value for q in B.recall_draws(df, budget, R, 5).collect()}
    for r in range(R):
        k = min(max(1, round(budget * int(w[:, r].sum()))), int(w[:, r].sum()))
        before, caught = 0, 0.0
        for s in sorted(set(x), reverse=True):
            m, p = w[x == s, r].sum(), (w[:, r] * bad)[x == s].sum()
            caught += p * max(0, min(m, k - before)) / m if m else 0
            before += m
        assert got[r] == pytest.approx(caught / (w[:, r] * bad).sum(), abs=1e-12)


def test_means_keep_items_whole(spark):
    rows = [(str(i), float(v)) for i in range(200) for v in range(i % 4)]
    w = B.weights([str(i) for i in range(200)], R, 3)
    top, bottom = np.zeros(R), np.zeros(R)
    for i, v in rows:
        top, bottom = top + w[int(i)] * v, bottom + w[int(i)]
    got = {q.r: q.value for q in B.mean_draws(spark.createDataFrame(rows, "item_id string, value double"), R, 3).collect()}
    assert got == pytest.approx(dict(enumerate(top / bottom)))


def test_intervals_of_nothing(spark):
    none = spark.createDataFrame([], "item_id string, score double, error boolean")
    assert ranking.bootstrap_auc(none, 20).first().resamples == 0 and evidence.recall_interval(none, 0.1, 20).first().n == 0


def test_nearest_labels_are_those_of_the_library(spark):
    paths = ["animal.cat", "animal.dog", "plant.oak", "plant.ash", "stone"]
    invented = ["animal.cats", "plnt.oak", "zzz", "ston", "animal", ""]
    tree = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.value: r.nearest for r in assigned.nearest_labels(spark.createDataFrame([(str(i), v) for i, v in enumerate(invented + paths)], "item_id string, value string"), tree).collect()}
    assert got == {v: ",".join(difflib.get_close_matches(v, sorted(paths), 3, 0.5)) for v in invented}


def test_scripted_replies_follow_from_a_digest(spark):
    rows = [(str(i), f"question {i}") for i in range(50)]
    got = {r.item_id: r.reply for r in runs.collect(spark.createDataFrame(rows, "item_id string, prompt string"), runs.scripted_provider("judge-x")).collect()}
    for i, prompt in rows:
        roll = int.from_bytes(hashlib.blake2b(f"judge-x\0{prompt}".encode(), digest_size=8).digest(), "big") / 2**64
        assert json.loads(got[i])["correct"] == (roll < 0.75)
