"""The softmax of the language model passes once over its logits, unless a weight has grown too large."""

import numpy as np

from ledgerlens.llm import maxent


def _plain(logits, outcome):
    logits = np.minimum(logits, maxent.LARGEST)
    powers = np.exp(logits)
    total = powers @ np.ones(powers.shape[1], np.float32)
    return logits[np.arange(len(logits)), outcome] - np.log(total), powers, total


def test_softmax_bounds_only_what_is_too_large(monkeypatch):
    rng = np.random.default_rng(5)
    passes, minimum = [], np.minimum
    for top in (3, 80):
        logits = (rng.standard_normal((50, 64)) * top).astype(np.float32)
        outcome = rng.integers(0, 64, 50)
        expected = _plain(logits, outcome)
        with monkeypatch.context() as m:
            m.setattr(maxent.np, "minimum", lambda *a, **b: passes.append(top) or minimum(*a, **b))
            found = maxent._softmax_of(logits, outcome)
        for x, y in zip(found, expected, strict=True):
            assert np.array_equal(x, y)
    assert passes == [80]


def test_logits_add_up_the_rows_of_all_features():
    rng = np.random.default_rng(6)
    table = rng.standard_normal((40, 8)).astype(np.float32)
    rows, constant = rng.integers(0, 40, (30, 3)).astype(np.uint16), table[-1]
    before = table.copy()
    assert np.array_equal(maxent._logits(table, rows, constant),
                          table[rows[:, 0]] + table[rows[:, 1]] + table[rows[:, 2]] + constant)
    assert np.array_equal(table, before)
