"""Steps of the language model that tokens share."""

import numpy as np

from citeweave.llm import maxent_lm


def test_leaves_of_tokens_alike_are_scored_once():
    """Tokens of one row and class are one group; rows that two classes share stay two groups, next to each other."""
    rng = np.random.default_rng(9)
    leaves = [{"leaf": k, "count": 1000, "known": 100} for k in range(maxent_lm.CLASSES * maxent_lm.SHARED)]
    m = maxent_lm._start([], leaves)
    m.weights[:] = rng.normal(size=m.weights.shape)
    m.leaf_weights[:] = rng.normal(size=m.leaf_weights.shape)
    row, kind, r = rng.integers(0, 9, 5000), rng.integers(0, maxent_lm.CLASSES, 5000), rng.integers(0, len(m.weights), (3, 5000))
    rows, kinds, n, group = maxent_lm._alike(row, kind)
    assert len(rows) == 9 * maxent_lm.CLASSES and n.sum() == 5000 and (np.diff(rows) >= 0).all()
    assert (rows[group] == row).all() and (kinds[group] == kind).all()
    classes, leaves = maxent_lm._forward(m, m.weights, m.leaf_weights, r, rows, kinds)
    each = maxent_lm._forward(m, m.weights, m.leaf_weights, r, row, kind)
    assert leaves.shape[0] == len(rows) and np.array_equal(classes, each[0]) and np.array_equal(leaves[group], each[1])


def test_words_are_numbered_as_met():
    seen = maxent_lm._Numbers()
    assert [*map(seen.__getitem__, [b"a", b"b", b"a"])] == [1, 2, 1] and len(seen.words) == len(seen.ends) == 3
    assert seen.words[0] == maxent_lm._END and seen.ends[1] == maxent_lm.ending(b"a")
