import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tensor as X
from corpusloom.operators import training


def test_softmax_is_shift_invariant():
    x = np.array([[1.0, 2, 3], [5, 5, 5]])
    assert np.allclose(X.softmax(x), X.softmax(x + 100)) and np.allclose(X.softmax(x).sum(-1), 1)


def test_attention_mask_and_widths():
    rng = np.random.default_rng(0)
    q, k, v = rng.normal(size=(2, 2, 3, 4)), rng.normal(size=(2, 2, 5, 4)), rng.normal(size=(2, 2, 5, 6))
    mask = np.zeros((3, 5), bool)
    mask[:, 2] = True
    assert np.allclose(X.attention(q, k, v, mask), np.repeat(v[..., 2:3, :], 3, -2))


def test_rope_keeps_norms_and_relative_products():
    x = np.random.default_rng(1).normal(size=(4, 8))
    assert np.allclose(np.linalg.norm(X.rope(x, [0, 3, 5, 9]), axis=1), np.linalg.norm(x, axis=1))
    a, b = x[:1], x[1:2]
    assert np.isclose((X.rope(a, [2]) * X.rope(b, [5])).sum(), (X.rope(a, [10]) * X.rope(b, [13])).sum())
    with pytest.raises(ValueError):
        X.rope(np.zeros((1, 3)), [0])


def test_multi_head_is_causal_and_checks_heads():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(6, 8)), [rng.normal(size=(8, 8)) for _ in range(4)]
    y = x.copy()
    y[4:] += 1
    assert np.allclose(X.multi_head(x, *w, 2, np.arange(6))[:4], X.multi_head(y, *w, 2, np.arange(6))[:4])
    with pytest.raises(ValueError):
        X.multi_head(x, *w, 3)


def test_language_model_takes_short_sequences():
    g = np.ones(8)
    rng = np.random.default_rng(3)
    layer = {k: rng.normal(size=(8, 8)) for k in "qkvo"} | {"w1": rng.normal(size=(16, 8)), "w2": rng.normal(size=(8, 16)), "w3": rng.normal(size=(16, 8)), "ln1": g, "ln2": g}
    w = {"embedding": rng.normal(size=(11, 8)), "layers": [layer], "ln_final": g, "lm_head": rng.normal(size=(11, 8))}
    full = X.language_model([1, 2, 3, 4], w, 2)
    assert full.shape == (4, 11) and np.allclose(full[:2], X.language_model([1, 2], w, 2))


def test_initial_weights():
    w = X.linear_init(30, 40)
    assert np.abs(w).max() <= 3 * (2 / 70) ** 0.5 and X.default_d_ff(512) == 1344 and X.default_d_ff(1) == 64


def test_cross_entropy_survives_large_logits(spark):
    rows = spark.createDataFrame([([1000.0, 0.0], 0), ([0.0, 0.0], 1)], "x array<double>, t int")
    got = [r[0] for r in rows.select(training.cross_entropy(F.col("x"), F.col("t"))).collect()]
    assert np.allclose(got, [0, math.log(2)])


def test_clip_skips_nulls(spark):
    rows = spark.createDataFrame([(0, 3.0), (1, 4.0), (2, None)], "k int, g double")
    assert np.allclose([r.g for r in training.clip_gradients(rows, 1.0).orderBy("k").collect()[:2]], [0.6, 0.8], atol=1e-6)
    assert [r.g for r in training.clip_gradients(rows, 10.0).orderBy("k").collect()] == [3.0, 4.0, None]


def test_adamw_against_numpy(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "k int, v double, m double, s double")
    v, m, s = 1.0, 0.0, 0.0
    for t in range(1, 4):
        g = 0.5 * t
        rows = training.adamw_step(rows.withColumn("g", F.lit(g)), t)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v * (1 - 1e-5) - 1e-3 * (m / (1 - 0.9**t)) / (math.sqrt(s / (1 - 0.999**t)) + 1e-8)
    assert np.isclose(rows.first().v, v)


def test_schedule(spark):
    got = [r[0] for r in spark.range(25).select(training.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21)).collect()]
    assert got[0] == 0 and np.isclose(got[7], 1) and np.isclose(got[8], 0.98871756) and np.isclose(got[21], 0.1) and got[24] == 0.1


def test_batches(spark):
    rows = spark.createDataFrame([(list(range(100)),), ([1, 2],)], "ids array<int>")
    got = training.get_batch(rows, 7, F.lit(92)).collect()
    assert len(got) == 1 and got[0].x == list(range(92, 99)) and got[0].y == list(range(93, 100))


def test_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([("w", 0, 1.5)], "param string, i int, v double")
    training.save_checkpoint(rows, 12, str(tmp_path))
    back, it = training.load_checkpoint(spark, str(tmp_path))
    assert it == 12 and back.collect() == rows.collect()
