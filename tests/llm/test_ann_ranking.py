"""The ranking of a file's entries in op8: the footrule distance by shared weights, and the best of many scores."""

import numpy as np
import pytest

from procmon.llm import ann


@pytest.mark.parametrize(("entries", "count", "prefix"), [(40, 96, 96), (60, 400, 100), (30, 4096, 512)])
def test_shared_weights_rank_as_the_footrule(entries, count, prefix):
    rng = np.random.default_rng(entries)
    perms = np.array([rng.permutation(count)[:prefix] for _ in range(entries)])
    own = np.arange(prefix, 0, -1, dtype=np.int16)
    weights = np.zeros((entries, count), np.int16)
    np.put_along_axis(weights, perms, own[None, :], 1)
    by_pivot = np.ascontiguousarray(weights.T)
    for q in [*(rng.permutation(count)[:prefix].astype(np.int16) for _ in range(5)), perms[3].astype(np.int16)]:
        place = {int(p): i for i, p in enumerate(q)}
        footrule = []
        for perm in perms:
            rank = {int(p): i for i, p in enumerate(perm)}
            footrule.append(sum(abs(place.get(p, prefix) - rank.get(p, prefix)) for p in {*place, *rank}))
        near = ann.shared_weights(by_pivot, q, own)
        assert len(set((np.array(footrule) + 2 * near).tolist())) == 1  # 131,328 at the nearest, past 16 bits


def test_top_keeps_ties_and_undefined_scores_last():
    rng = np.random.default_rng(2)
    for k in (1, 5, 30, 200):
        scores, ids = rng.integers(0, 6, 200).astype(float), rng.permutation(200)
        scores[:9] = np.nan
        order = np.lexsort([ids, -scores])[:k]
        got = ann.top(scores, ids, k)
        assert got[0].tolist() == ids[order].tolist() and np.array_equal(got[1], scores[order], equal_nan=True)
    assert ann.best("q", np.array([1.0, 2.0]), np.array([7, 8]), 1) == [("q", 8, 2.0)]


def test_the_ranking_sorts_only_the_best(monkeypatch):
    """Before, all scores were sorted."""
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    ann.best("q", np.arange(1000.0), np.arange(1000), 20)
    assert sizes == [20]
