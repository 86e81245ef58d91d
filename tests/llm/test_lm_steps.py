"""A training step adds the gradients of all tokens of a row, for even and odd numbers of classes."""

import numpy as np
import pytest

from evidara.llm import lm


@pytest.mark.parametrize("classes", [6, 7])
def test_step_equals_plain_sums(classes):
    rng = np.random.default_rng(3)
    model, features = lm.Softmax(classes, features=8), 8
    model.weights[:] = rng.standard_normal(model.weights.shape) / 4
    rows = np.stack([rng.integers(0, features, 500) + j * features for j in range(3)] + [3 * features + rng.integers(0, classes * classes, 500), np.full(500, 3 * features + classes * classes)], axis=1)
    kinds, weights, squares = rng.integers(0, classes, 500), model.weights.astype(np.float64), np.ones(model.weights.shape)
    for at in range(0, 500, 128):
        r, k = rows[at : at + 128], kinds[at : at + 128]
        e = np.exp(weights[r].sum(axis=1))
        g = e / e.sum(axis=1, keepdims=True) - np.eye(classes)[k]
        sums = np.zeros_like(weights)
        for j in range(5):
            np.add.at(sums, r[:, j], g)
        squares += sums * sums
        weights -= lm.STEP * sums / np.sqrt(squares)
    held = np.ones(model.weights.shape, np.float32)
    model.train(rows, kinds, held, batch=128)
    np.testing.assert_allclose(model.weights, weights, atol=2e-5)
    np.testing.assert_allclose(held, squares, rtol=1e-4)
