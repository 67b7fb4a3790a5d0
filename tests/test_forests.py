"""Trees of any depth: against a plain numpy tree, in large and small tasks, however rows lie."""

import numpy as np
import pytest

from rowsmith.operators.models import forests, stretches
from rowsmith.operators.models.base import Frame, load_fitted
from tests.test_models import frame, predictions

KINDS = [
    forests.decision_tree_classifier, lambda f, **o: forests.random_forest_classifier(f, 7, **o), lambda f, **o: forests.bagging_classifier(f, 5, **o),
    lambda f, **o: forests.extra_trees_classifier(f, 7, **o),
]


def whole(model):
    return [tuple(a.tolist() for a in tree) for tree in model._whole(list(range(len(model.state["sizes"]))))]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=600).round(1), rng.normal(size=600), rng.integers(0, 4, 600)])
    y = (x[:, 0] + x[:, 2] + rng.normal(size=600) > 1.5).astype(int) + (x[:, 1] > 1)
    return x, y


@pytest.mark.parametrize("fit", KINDS)
@pytest.mark.parametrize("task_rows", [10 ** 6, 60])
def test_trees_do_not_depend_on_partitions(spark, noisy, fit, task_rows):
    x, y = noisy
    one, seven = (fit(frame(spark, x, y, 3, parts), task_rows=task_rows) for parts in (1, 7))
    assert whole(one) == whole(seven)
    f = frame(spark, x, y, 3)
    p = predictions(one, f, "probability")
    assert p.sum(1) == pytest.approx(np.ones(600)) and (predictions(one, f) == p.argmax(1)).all()


def gini_worth(y, w, sides):
    return sum((np.bincount(y[s], w[s], 3) ** 2).sum() / w[s].sum() for s in sides)


@pytest.mark.parametrize("task_rows", [10 ** 6, 100])
def test_every_split_of_a_tree_is_the_best_of_its_rows(spark, noisy, task_rows):
    """Quantiles of three coarse features are all their values, so large nodes are cut as exactly as small ones."""
    x, y = noisy
    x = np.round(x, 1)
    tree = forests.decision_tree_classifier(frame(spark, x, y, 3), task_rows=task_rows)._whole([0])[0]
    rows_at = {0: np.arange(len(y))}
    for node in range(len(tree[2])):
        rows = rows_at[node]
        if tree[2][node] < 0:
            assert len(set(y[rows])) == 1 or (x[rows] == x[rows[0]]).all()
            assert tree[3][node] == pytest.approx(np.bincount(y[rows], minlength=3) / len(rows))
            continue
        left = x[rows, tree[0][node]] <= tree[1][node]
        w = np.ones(len(y))
        here = gini_worth(y, w, (rows[left], rows[~left]))
        for j in range(3):
            for cut in np.unique(x[rows, j])[:-1]:
                assert gini_worth(y, w, (rows[x[rows, j] <= cut], rows[x[rows, j] > cut])) <= here + 1e-9
        rows_at[tree[2][node]], rows_at[tree[2][node] + 1] = rows[left], rows[~left]


@pytest.mark.parametrize("task_rows", [10 ** 6, 80])
def test_extra_trees_cut_between_the_ends_of_the_node(spark, noisy, task_rows):
    """The cut of each node is the one its key draws from the ends of its own rows; the best feature of those tried is taken."""
    x, y = noisy
    model = forests.extra_trees_classifier(frame(spark, x, y, 3), 3, task_rows=task_rows)
    plan = forests.Plan(3, 3, True, forests.ROOT, False, 42)
    for t, tree in enumerate(model._whole([0, 1, 2])):
        open_ = [(0, plan.root(t), np.arange(len(y)))]
        while open_:
            node, key, rows = open_.pop()
            if tree[2][node] < 0:
                continue
            low, high = x[rows].min(0), x[rows].max(0)
            j = tree[0][node]
            assert j in plan.tried(key, high > low) and tree[1][node] == plan.cuts(key, low, high)[j]
            left = x[rows, j] <= tree[1][node]
            assert 0 < left.sum() < len(rows)
            open_ += [(tree[2][node], forests.child_key(key, 0), rows[left]), (tree[2][node] + 1, forests.child_key(key, 1), rows[~left])]


@pytest.mark.parametrize("task_rows", [10 ** 6, 50])
def test_depth_has_no_bound(spark, task_rows):
    """A staircase that can only be climbed step by step, and one cut off at a time."""
    x = np.arange(400.0)[:, None]
    y = 1.9 ** np.arange(400) % 1e6
    f = frame(spark, x, y)
    model = forests.decision_tree_regressor(f, task_rows=task_rows)
    assert predictions(model, f) == pytest.approx(y, rel=1e-12)
    steep = np.array([3.0 ** i for i in range(40)])
    g = frame(spark, np.arange(40.0)[:, None], steep)
    tree = forests.decision_tree_regressor(g, task_rows=10)
    assert predictions(tree, g) == pytest.approx(steep, rel=1e-12)
    depth = {0: 0}
    left = tree._whole([0])[0][2]
    for node in range(len(left)):
        if left[node] >= 0:
            depth[left[node]] = depth[left[node] + 1] = depth[node] + 1
    assert max(depth.values()) > 30


@pytest.mark.parametrize("fit", [forests.random_forest_regressor, forests.extra_trees_regressor])
@pytest.mark.parametrize("task_rows", [10 ** 6, 100])
def test_regression_forests(spark, fit, task_rows):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, size=(500, 2))
    y = x[:, 0] ** 2 + np.sin(3 * x[:, 1])
    model = fit(frame(spark, x, y), 10, task_rows=task_rows)
    q = rng.uniform(-1.8, 1.8, size=(200, 2))
    gap = predictions(model, frame(spark, q, np.zeros(200))) - (q[:, 0] ** 2 + np.sin(3 * q[:, 1]))
    assert np.sqrt(np.mean(gap ** 2)) < 0.25


def test_bootstrap_draws(spark):
    plan = forests.Plan(2, 1, False, forests.ALL, True, 1)
    w = plan.weights(np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 50_000), 3)
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and abs(w.var() - 1) < 0.03


@pytest.mark.parametrize("fit", KINDS)
def test_equal_rows_of_different_classes_and_constant_features(spark, fit):
    x = np.repeat([[1.0, 5.0], [2.0, 5.0]], 30, axis=0)
    y = np.concatenate([np.arange(30) % 3 == 0, np.ones(30)]).astype(int)
    f = frame(spark, x, y, 2)
    for task_rows in (1000, 5):
        p = predictions(fit(f, task_rows=task_rows), f, "probability")
        assert (p[30:, 1] == 1).all() and np.ptp(p[:30, 1]) == 0 and 0 < p[0, 1] < 0.9


def test_scoring_in_parts_and_after_loading(spark, noisy, monkeypatch, tmp_path):
    x, y = noisy
    f = frame(spark, x, y, 3)
    model = forests.random_forest_classifier(f, 6, task_rows=200)
    before = predictions(model, f, "probability")
    model.save(spark, str(tmp_path / "m"))
    monkeypatch.setattr(forests, "HELD_NODES", 300)
    assert predictions(load_fitted(spark, str(tmp_path / "m")), f, "probability") == pytest.approx(before, abs=1e-12)


@pytest.mark.parametrize("fit", KINDS + [lambda f, **o: forests.extra_trees_regressor(f, 3, **o)])
@pytest.mark.parametrize("task_rows", [10 ** 6, 60])
def test_rows_sent_to_subtrees_are_told_the_same(spark, noisy, monkeypatch, fit, task_rows):
    x, y = noisy
    f = frame(spark, x, y, 3)
    model = fit(f, task_rows=task_rows)
    twice = f.df.unionByName(f.df)
    held = model.transform(twice)
    want = sorted(map(str, held.collect()))
    monkeypatch.setattr(forests, "HELD_NODES", 10)
    monkeypatch.setattr(forests.Forest, "_whole", None)  # no whole tree is put together
    sent = model.transform(twice)
    assert sent.schema.simpleString() == held.schema.simpleString()
    assert sorted(map(str, sent.collect())) == want
    assert model.transform(f.df.limit(0)).count() == 0


def test_rows_are_binned_once_for_all_trees(monkeypatch):
    """The sums of large nodes are those of a plain loop, from one binning of a batch."""
    rng = np.random.default_rng(3)
    x, y, h = rng.normal(size=(500, 3)), rng.integers(0, 3, 500).astype(float), rng.integers(0, 1 << 62, 500)
    calls = []
    monkeypatch.setattr(forests, "sum_over_rows", lambda frame, part, size: part(x, y, h))
    monkeypatch.setattr(forests, "cut_points", lambda frame: [[-0.5, 0.0, 0.5]] * 3)
    bin_rows = forests.binned
    monkeypatch.setattr(forests, "binned", lambda x, table: calls.append(1) or bin_rows(x, table))
    for classes in (3, 0):
        plan = forests.Plan(classes, 4, False, forests.ALL, True, 5)
        upper = object.__new__(forests._Upper)
        upper.frame, upper.plan, upper.width = Frame(None, "k"), plan, classes or 3
        upper.frame.__dict__["_size"] = (500, 3)
        upper.trees, upper.table = [forests.Nodes(plan.root(t)) for t in range(4)], [np.array([-0.5, 0.0, 0.5])] * 3
        for tree in upper.trees:
            tree.split(0, 1, 0.1)
        some, seen = [(t, n) for t in range(4) for n in (1, 2)], []
        sums = forests._Upper._sums
        upper._sums = lambda *a: seen.append(sums(upper, *a)) or seen[-1]
        calls.clear()
        upper._best(some, 4, 10 ** 6)
        assert len(calls) == 1
        bins = bin_rows(x, upper.table)
        for (t, node), got in zip(some, seen[0]):
            w = plan.weights(h, t) * ((x[:, 1] <= 0.1) == (node == 1))
            what = plan.counted(y, w)
            for j in range(3):
                assert got[j] == pytest.approx(np.array([what[bins[:, j] == b].sum(0) for b in range(4)]))


def one_after_another(x, y, w, key, plan):
    """A tree whose nodes are looked into one at a time: its leaves as (rows, value), its splits as (rows, feature, cut)."""
    out, open_ = [], [(key, np.arange(len(y)))]
    while open_:
        key, rows = open_.pop()
        best, here = None, x[rows]
        if len(set(y[rows])) > 1:
            low, high = here.min(0), here.max(0)
            for j in plan.tried(key, high > low):
                if plan.drawn:
                    cuts = [plan.cuts(key, low, high)[j]]
                else:
                    values = np.unique(here[:, j])
                    cuts = values[:-1] + (values[1:] - values[:-1]) / 2
                for cut in cuts:
                    worth = 0.0
                    for side in (here[:, j] <= cut, here[:, j] > cut):
                        what = np.bincount(y[rows][side].astype(int), w[rows][side], plan.classes) if plan.classes else (w * y)[rows][side].sum()
                        worth += (what ** 2).sum() / w[rows][side].sum()
                    if best is None or worth > best[0] * (1 + 1e-12):
                        best = (worth, j, cut)
        if best is None:
            sums = np.bincount(y[rows].astype(int), w[rows], plan.classes) if plan.classes else np.array([(w * y)[rows].sum()])
            out.append((rows.tolist(), -1, (sums / w[rows].sum()).round(9).tolist()))
            continue
        left = here[:, best[1]] <= best[2]
        out.append((rows.tolist(), int(best[1]), round(float(best[2]), 9)))
        open_ += [(forests.child_key(key, 0), rows[left]), (forests.child_key(key, 1), rows[~left])]
    return sorted(out, key=str)


@pytest.mark.parametrize("classes", [0, 2, 3, 20])
@pytest.mark.parametrize("drawn, subset", [(True, forests.ROOT), (True, forests.ALL), (False, forests.ROOT), (False, forests.ALL)])
@pytest.mark.parametrize("presorted", [16, 0])
def test_all_nodes_of_a_level_grow_like_one_after_another(monkeypatch, classes, drawn, subset, presorted):
    monkeypatch.setattr(forests, "PRESORTED", presorted)
    monkeypatch.setattr(forests, "PADDED", 32)
    rng = np.random.default_rng(classes + drawn)
    x = rng.normal(size=(250, 4)).round(1)
    y = rng.integers(0, classes or 50, 250).astype(float)
    w = rng.integers(1, 4, 250).astype(float)
    plan = forests.Plan(classes, 1, drawn, subset, False, 7)
    feature, cut, left, value = forests.grow(x, y, w, plan.root(0), plan)
    out, rows_at = [], {0: np.arange(250)}
    for node in range(len(left)):
        rows = rows_at[node]
        if left[node] < 0:
            out.append((rows.tolist(), -1, value[node].round(9).tolist()))
            continue
        out.append((rows.tolist(), int(feature[node]), round(float(cut[node]), 9)))
        to_left = x[rows, feature[node]] <= cut[node]
        rows_at[left[node]], rows_at[left[node] + 1] = rows[to_left], rows[~to_left]
    assert sorted(out, key=str) == one_after_another(x, y, w, plan.root(0), plan)


def test_nodes_of_a_level_are_drawn_at_once(monkeypatch):
    """Thousands of nodes take as many steps as the tree is deep."""
    hashed, calls = forests._hash, []
    monkeypatch.setattr(forests, "_hash", lambda a, b: calls.append(1) or hashed(a, b))
    x = np.arange(5000.0)[:, None]
    nodes = forests.grow(x, x[:, 0] * 7919 % 1009, np.ones(5000), 5, forests.Plan(0, 1, True, forests.ALL, False, 7))
    assert len(nodes[0]) == 9999 and len(calls) < 100


def test_no_null_arrays_are_sent_with_the_rows(spark, noisy, monkeypatch):
    """Writing a batch of null arrays takes as many steps as the square of its rows."""
    x, y = noisy
    f = frame(spark, x, y, 3)
    model = forests.extra_trees_classifier(f, 3, task_rows=60)
    monkeypatch.setattr(forests, "HELD_NODES", 10)
    seen, kind = [], type(f.df)
    mapped = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **o: seen.append(self) or mapped(self, *a, **o))
    model.transform(f.df).count()
    for df in seen:
        arrays = [c for c, t in df.dtypes if t.startswith("array")]
        assert df.where(" or ".join(f"{c} is null" for c in arrays)).count() == 0


@pytest.mark.parametrize("kind", ["noise", "repeated", "smooth"])
def test_large_nodes_of_one_feature_are_cut_like_small_ones(spark, monkeypatch, kind):
    """The tree does not depend on how many rows a task takes: no node is cut between quantiles alone."""
    monkeypatch.setattr(stretches, "BLOCK", 16)
    monkeypatch.setattr(stretches, "HELD_BLOCKS", 8)
    monkeypatch.setattr(stretches, "FETCHED", 4)
    monkeypatch.setattr(stretches, "LIKELY", 2)
    rng = np.random.default_rng(11)
    x = np.arange(1500.0) if kind != "repeated" else rng.integers(0, 400, 1500).astype(float)
    y = np.sin(x / 300) * 50 + x / 10 if kind == "smooth" else rng.integers(0, 1009, 1500).astype(float)
    f = frame(spark, x[:, None], y, parts=5)
    trees = []
    for task_rows, at_hand in ((300, 4096), (10 ** 6, 4096), (10 ** 6, 100)):
        monkeypatch.setattr(forests, "AT_HAND", at_hand)    # in a task, both ways
        tree = forests.decision_tree_regressor(f, task_rows=task_rows)._whole([0])[0]
        out, open_ = [], [0]
        while open_:
            node = open_.pop()
            inner = tree[2][node] >= 0
            out += [int(tree[0][node]), float(tree[1][node])] if inner else [float(tree[3][node, 0])]
            open_ += [tree[2][node] + 1, tree[2][node]] if inner else []
        trees.append(out)
    assert trees[0] == pytest.approx(trees[1], rel=1e-9) and trees[2] == pytest.approx(trees[1], rel=1e-9)


def test_nodes_found_by_searching_cuts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 1))
    feature, cut, left, _ = forests.grow(x, rng.normal(size=2000), np.ones(2000), 1, forests.Plan(0, 1, False, forests.ALL, False, 1))
    q = np.concatenate([x, rng.normal(size=(500, 1)) * 3, cut[left >= 0][:, None]])
    tree = (feature, cut, left)
    assert (forests.finder(tree)(q) == forests.reached(q, tree)).all()
