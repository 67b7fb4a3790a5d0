"""Boosted trees against a numpy version that knows no passes, and their growth best first."""

import numpy as np
import pytest

from rowsmith.operators.models import boosting
from tests.test_models import frame, predictions


def plain(x, y, classes, rounds, rules, cuts):
    """All rounds with whole arrays: one node after another, each split found from its own rows."""
    n, k = len(y), 1 if classes == 2 else classes
    shares = np.bincount(y, minlength=classes) / n
    raw = np.tile([np.log(shares[1] / shares[0])] if k == 1 else np.log(shares), (n, 1))
    bins = np.column_stack([[np.sum(np.array(c) < v) for v in x[:, j]] for j, c in enumerate(cuts)])
    out = []
    for _ in range(rounds):
        if k == 1:
            p = 1 / (1 + np.exp(-raw))
            slope = y[:, None] - p
        else:
            p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
            slope = np.eye(k)[y] - p
        curve, trees = p * (1 - p), []
        for c in range(k):
            def best(rows, depth):
                top = None
                if depth >= rules.depth:
                    return None
                for j in range(x.shape[1]):
                    for cut in range(len(cuts[j])):
                        left, right = rows[bins[rows, j] <= cut], rows[bins[rows, j] > cut]
                        if min(len(left), len(right)) < max(1, rules.least_rows) or min(curve[left, c].sum(), curve[right, c].sum()) < rules.least_curvature:
                            continue
                        w = (lambda r: curve[r, c].sum()) if rules.newton else len
                        gain = sum(slope[r, c].sum() ** 2 / w(r) for r in (left, right)) - slope[rows, c].sum() ** 2 / w(rows)
                        if gain > 1e-9 and (top is None or gain > top[0] * (1 + 1e-9)):
                            top = (gain, j, cut, left, right)
                return top

            everything = np.arange(n)
            leaves = [[everything, 0, best(everything, 0)]]
            while len(leaves) < rules.leaves and any(leaf[2] for leaf in leaves):
                chosen = max((leaf for leaf in leaves if leaf[2]), key=lambda leaf: leaf[2][0])
                leaves = [leaf for leaf in leaves if leaf is not chosen]
                leaves += [[rows, chosen[1] + 1, best(rows, chosen[1] + 1)] for rows in chosen[2][3:]]
            trees.append([sorted(rows.tolist()) for rows, _, _ in leaves])
            for rows, _, _ in leaves:
                raw[rows, c] += rules.rate * rules.scale * slope[rows, c].sum() / curve[rows, c].sum()
        out.append(trees)
    e = np.exp(raw - raw.max(1, keepdims=True))
    p = 1 / (1 + np.exp(-raw[:, 0]))
    return out, np.column_stack([1 - p, p]) if k == 1 else e / e.sum(1, keepdims=True)


@pytest.mark.parametrize("classes, newton, leaves, depth, rows", [(3, False, 8, 3, 300), (2, False, 8, 3, 300), (4, True, 9, 99, 400), (2, True, 31, 99, 400)])
def test_equal_to_whole_arrays(spark, monkeypatch, classes, newton, leaves, depth, rows):
    """Same leaves and probabilities, over several written copies of the scores."""
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 2)
    rng = np.random.default_rng(rows + classes)
    x = np.column_stack([rng.normal(size=rows).round(1), rng.integers(0, 6, rows), rng.normal(size=rows).round(1)])
    y = np.clip((x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=rows) * 0.3).astype(int) % classes, 0, classes - 1)
    f = frame(spark, x, y, classes, parts=4)
    rules = boosting.Rules(leaves, depth, 5 if newton else 1, 1e-3 if newton else 0.0, newton, 0.3, 1.0)
    model = boosting.fit(f, 5, rules)
    wanted_leaves, wanted = plain(x, y, classes, 5, rules, model.state["cuts"])
    bins = boosting.binned(x, [np.array(c) for c in model.state["cuts"]])
    for trees, expected in zip(model.state["trees"], wanted_leaves, strict=True):
        for tree, groups in zip(trees, expected, strict=True):
            at = boosting.reached(bins, tuple(np.array(a) for a in tree))
            assert sorted(np.flatnonzero(at == leaf).tolist() for leaf in set(at)) == sorted(groups)
    assert predictions(model, f, "probability") == pytest.approx(wanted, abs=1e-9)


def test_summing_both_children_and_in_parts_changes_nothing(spark, monkeypatch, blobs_like):
    x, y, f = blobs_like
    first = boosting.histogram_boosting_classifier(f, rounds=2)
    monkeypatch.setattr(boosting, "KEPT_SUMS", 0)
    monkeypatch.setattr(boosting, "MAX_SUMS", 20_000)
    monkeypatch.setattr(boosting, "CELLS", 1000)
    second = boosting.histogram_boosting_classifier(frame(spark, x, y, 3, parts=9), rounds=2)
    for a, b in zip(first.state["trees"], second.state["trees"], strict=True):
        for t, u in zip(a, b):
            assert t[:3] == u[:3] and t[3] == pytest.approx(u[3], abs=1e-9)


@pytest.fixture(scope="module")
def blobs_like(spark):
    rng = np.random.default_rng(5)
    y = np.arange(5000) % 3
    x = np.array([[0, 0], [2, 0], [0, 2]])[y] + rng.normal(size=(5000, 2))
    return x, y, frame(spark, x, y, 3, parts=3)


def test_one_tree_per_class_with_at_most_31_leaves_and_20_rows_each(blobs_like):
    x, y, f = blobs_like
    model = boosting.histogram_boosting_classifier(f, rounds=3)
    bins = boosting.binned(x, [np.array(c) for c in model.state["cuts"]])
    assert all(len(c) == boosting.BINS for c in model.state["cuts"])
    for trees in model.state["trees"]:
        assert len(trees) == 3
        for tree in trees:
            sizes = np.bincount(boosting.reached(bins, tuple(np.array(a) for a in tree)))
            assert sum(v < 0 for v in tree[2]) == 31 and sizes[sizes > 0].min() >= 20
    assert (predictions(model, f) == y).mean() > 0.8


def test_no_more_passes_than_a_tree_is_deep(blobs_like, monkeypatch):
    _, _, f = blobs_like
    passes = []
    inner = boosting._Rows._pass
    monkeypatch.setattr(boosting._Rows, "_pass", lambda self, *a: passes.append(1) or inner(self, *a))
    boosting.gradient_boosting_classifier(f, rounds=2)
    assert len(passes) == 2 * 3     # the levels that are split, for all classes at once
    passes.clear()
    boosting.histogram_boosting_classifier(f, rounds=1)
    assert len(passes) <= 12


def test_nothing_to_split(spark):
    f = frame(spark, np.ones((40, 2)), np.arange(40) % 2, 2)
    model = boosting.gradient_boosting_classifier(f)
    assert model.state["trees"] == [] and predictions(model, f, "probability") == pytest.approx(np.full((40, 2), 0.5))
