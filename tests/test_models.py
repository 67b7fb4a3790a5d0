"""Fitted models against numpy on the same rows, and on planted signals."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowsmith.operators.models import boosting, forests, gaussian, linear, margins, neighbors, online, stumps, trees, voting
from rowsmith.operators.models.base import Frame, load_fitted

RNG = np.random.default_rng(7)


def frame(spark, x, y, classes=0, parts=3):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k bigint, x array<double>, label double").repartition(parts)
    return Frame(df.select("k", array_to_vector("x").alias("features"), "label").persist(), "k", classes)


def predictions(model, f, column="prediction"):
    return np.array([r[0] for r in model.transform(f.df).orderBy("k").select(column).collect()])


@pytest.fixture(scope="module")
def line(spark):
    x = RNG.normal(size=(300, 4)) * [1, 10, 0.1, 3] + [0, 100, 5, -2]
    y = x @ [2.0, -0.3, 4.0, 0.0] + 7 + RNG.normal(size=300) * 0.5
    return frame(spark, x, y), x, y


@pytest.fixture(scope="module")
def blobs(spark):
    centres = np.array([[0, 0, 0], [3, 0, 1], [0, 3, -1]])
    y = np.arange(360) % 3
    x = centres[y] + RNG.normal(size=(360, 3)) * 0.9
    return frame(spark, x, y, 3), x, y


@pytest.fixture(scope="module")
def two(spark):
    y = np.arange(300) % 2
    x = np.column_stack([y * 2.0 + RNG.normal(size=300), 100 + 20 * RNG.normal(size=300), RNG.normal(size=300) - y])
    return frame(spark, x, y, 2), x, y


def centred(x, y):
    return x - x.mean(0), y - y.mean()


def test_ols_and_ridge(line):
    f, x, y = line
    xc, yc = centred(x, y)
    assert linear.ols(f).state["coefficients"] == pytest.approx(np.linalg.lstsq(xc, yc, rcond=None)[0], rel=1e-6)
    want = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(4), xc.T @ yc)
    assert linear.ridge(f, 2.5).state["coefficients"] == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize("alpha,l1", [(1.0, 1.0), (0.5, 0.5), (0.01, 0.3)])
def test_elastic_net_meets_its_optimality_conditions(line, alpha, l1):
    f, x, y = line
    xc, yc = centred(x, y)
    w = np.array(linear.elastic_net(f, alpha, l1).state["coefficients"])
    gradient = -xc.T @ (yc - xc @ w) / len(y) + alpha * (1 - l1) * w
    at_zero = w == 0
    assert gradient[~at_zero] == pytest.approx(-alpha * l1 * np.sign(w[~at_zero]), abs=1e-6)
    assert (np.abs(gradient[at_zero]) <= alpha * l1 + 1e-9).all()


def test_bayesian_ridge_is_at_its_fixed_point(line):
    f, x, y = line
    m = linear.bayesian_ridge(f)
    xc, yc = centred(x, y)
    want = np.linalg.solve(xc.T @ xc + m.state["weight"] / m.state["noise"] * np.eye(4), xc.T @ yc)
    assert m.state["coefficients"] == pytest.approx(want, rel=1e-6)
    assert 1 / m.state["noise"] == pytest.approx(0.25, rel=0.25)


def test_ard_drops_the_idle_feature(spark):
    x = RNG.normal(size=(400, 3))
    f = frame(spark, x, 3 * x[:, 0] + 1 + RNG.normal(size=400) * 0.1)
    w = linear.ard(f).state["coefficients"]
    assert w[0] == pytest.approx(3, abs=0.02) and abs(w[1]) < 0.02 and abs(w[2]) < 0.02


def test_huber_ignores_outliers(spark):
    x = RNG.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 3 + RNG.normal(size=300) * 0.05
    y[:20] += 100
    m = linear.huber(frame(spark, x, y))
    assert m.state["coefficients"] == pytest.approx([2, -1], abs=0.05) and m.state["intercept"] == pytest.approx(3, abs=0.05)


def log_density(x, mean, cov):
    d = x - mean
    return -0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]


def test_discriminants_and_naive_bayes(blobs):
    f, x, y = blobs
    means = np.array([x[y == c].mean(0) for c in range(3)])
    covs = [np.cov(x[y == c].T) for c in range(3)]
    pooled = sum((np.sum(y == c) - 1) * covs[c] for c in range(3)) / (len(y) - 3)
    for model, per_class in ((gaussian.lda(f), [pooled] * 3), (gaussian.qda(f), covs),
                             (gaussian.gaussian_nb(f), [np.diag(x[y == c].var(0)) for c in range(3)])):
        scores = np.column_stack([log_density(x, means[c], per_class[c]) + np.log(np.mean(y == c)) for c in range(3)])
        e = np.exp(scores - scores.max(1, keepdims=True))
        got = np.array([r[0] for r in model.transform(f.df).orderBy("k").select("probability").collect()])
        assert got == pytest.approx(e / e.sum(1, keepdims=True), abs=1e-6)
        assert (predictions(model, f) == scores.argmax(1)).all()


def test_constant_features_do_no_harm(spark):
    y = np.arange(200) % 2
    x = np.column_stack([np.full(200, 5.0), y * 1e-3 + RNG.normal(size=200) * 1e-4, RNG.normal(size=200) * 1e-3])
    f = frame(spark, x, y, 2)
    floor = 1e-9 * x.var(0).max()
    got = gaussian.gaussian_nb(f).state["variance"]
    assert got[0] == pytest.approx(x[y == 0].var(0) + floor, rel=1e-6)
    for fit in (gaussian.gaussian_nb, gaussian.lda, stumps.ada_boost_classifier, neighbors.knn_classifier):
        assert (predictions(fit(f), f) == y).mean() > 0.5
    # features this small hardly move a penalised score: only sound numbers can be asked for
    assert np.isfinite(np.array(margins.svc(f).state["weights"])).all()
    line_with_constant = frame(spark, x, 3 * x[:, 2] + 1)
    for fit in (linear.ols, linear.bayesian_ridge, linear.huber):
        assert np.isfinite(predictions(fit(line_with_constant), line_with_constant)).all()


def test_random_features_take_the_spread_of_all_cells(blobs):
    f, x, _ = blobs
    assert margins.fourier_settings(f, 10)["gamma"] == pytest.approx(1 / (3 * x.var()), rel=1e-9)


def test_logistic_regression_gradient_is_zero(two):
    f, x, y = two
    m = trees.logistic_regression(f).parts["model"]
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert x.T @ (p - y) + w == pytest.approx(np.zeros(3), abs=0.5)


def hinge_objective(x, s, w, b, cost):
    return 0.5 * w @ w + cost * np.maximum(1 - s * (x @ w + b), 0).sum()


def test_linear_svc_is_at_its_minimum(two):
    f, x, y = two
    m = margins.linear_svc(f)
    w, b, s = np.array(m.state["weights"][0]), m.state["constants"][0], 2.0 * y - 1
    over = np.maximum(1 - s * (x @ w + b), 0)
    assert w - 2 * x.T @ (s * over) == pytest.approx(np.zeros(3), abs=0.05)
    assert b - 2 * (s * over).sum() == pytest.approx(0, abs=1e-3)


def test_svc_is_near_the_hinge_minimum_and_gives_probabilities(two):
    f, x, y = two
    m = margins.svc(f)
    w, b, s = np.array(m.state["weights"][0]), m.state["constants"][0], 2.0 * y - 1
    here = hinge_objective(x, s, w, b, 1.0)
    for _ in range(200):
        near = hinge_objective(x, s, w + RNG.normal(size=3) * [0.2, 0.01, 0.2], b + RNG.normal() * 0.2, 1.0)
        assert near > here * 0.99
    p = np.array([r[0][1] for r in m.transform(f.df).orderBy("k").select("probability").collect()])
    assert ((p > 0) & (p < 1)).all() and np.corrcoef(p, x @ w + b)[0, 1] > 0.9
    assert abs(p.mean() - y.mean()) < 0.05


@pytest.mark.parametrize("fit,bound", [
    (margins.sgd_classifier, 0.85), (margins.svc, 0.9), (margins.nu_svc, 0.9), (margins.linear_svc, 0.85),
    (online.passive_aggressive_classifier, 0.75), (stumps.ada_boost_classifier, 0.85),
    (neighbors.knn_classifier, 0.9), (forests.decision_tree_classifier, 0.95), (forests.bagging_classifier, 0.95),
    (lambda f: forests.random_forest_classifier(f, 20), 0.95), (lambda f: forests.extra_trees_classifier(f, 20), 0.9),
    (lambda f: boosting.gradient_boosting_classifier(f, 5), 0.85), (online.network_classifier, 0.9),
    (lambda f: voting.voting_classifier(f, 10), 0.9),
])
def test_classifiers_find_overlapping_blobs(blobs, fit, bound):
    f, _, y = blobs
    model = fit(f)
    assert (predictions(model, f) == y).mean() >= bound
    out = model.transform(f.df)
    if "probability" in out.columns:
        assert all(abs(sum(r[0]) - 1) < 1e-9 for r in out.select("probability").collect())


@pytest.mark.parametrize("fit,bound", [
    (online.passive_aggressive_regressor, 0.9), (online.network_regressor, 0.95), (neighbors.knn_regressor, 0.5),
    (forests.decision_tree_regressor, 0.95), (lambda f: forests.random_forest_regressor(f, 10), 0.85),
    (lambda f: forests.extra_trees_regressor(f, 10), 0.85), (lambda f: trees.gradient_boosting_regressor(f, 30), 0.8),
    (lambda f: trees.ada_boost_regressor(f, 5), 0.6), (linear.sgd_regressor, 0.95),
])
def test_regressors_explain_a_line(line, fit, bound):
    f, _, y = line
    gap = y - predictions(fit(f), f)
    assert 1 - gap @ gap / ((y - y.mean()) @ (y - y.mean())) >= bound


def test_tube_regressors_follow_a_curve(spark):
    x = RNG.uniform(-3, 3, size=(300, 1))
    y = np.sin(x[:, 0]) + RNG.normal(size=300) * 0.05
    f = frame(spark, x, y)
    for model in (margins.svr(f, size=60), margins.nu_svr(f, size=60)):
        assert np.abs(y - predictions(model, f)).mean() < 0.15
    outside = np.abs(y - predictions(model, f)) > model.state["epsilon"]
    assert 0.35 < outside.mean() < 0.65  # nu = 0.5


def test_first_boosting_rounds_by_hand(spark):
    """Six points, one feature: stump errors and weights worked out on paper."""
    x, y = [[1], [2], [3], [4], [5], [6]], [0, 0, 1, 0, 1, 1]
    m = stumps.ada_boost_classifier(frame(spark, x, y, 2, parts=1), rounds=1)
    s = m.state["stumps"][0]
    assert (s["below"], s["above"]) == (0, 1) and (2 <= s["cut"] < 3 or 4 <= s["cut"] < 5)
    assert s["weight"] == pytest.approx(np.log((1 - 1 / 6) / (1 / 6)))
    perfect = stumps.ada_boost_classifier(frame(spark, x, [0, 0, 0, 1, 1, 1], 2, parts=1))
    assert len(perfect.state["stumps"]) == 1 and 3 <= perfect.state["stumps"][0]["cut"] < 4


def test_result_does_not_depend_on_partitioning(spark, blobs):
    _, x, y = blobs
    one, many = frame(spark, x, y, 3, parts=1), frame(spark, x, y, 3, parts=70)  # 70 tasks are added up in two steps
    assert many.parts > 64
    for fit in (gaussian.lda, margins.linear_svc):
        assert np.array(fit(one).state["weights"]) == pytest.approx(np.array(fit(many).state["weights"]), rel=1e-5, abs=1e-8)


def brute(x, y, q, k):
    d = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        d += (q[:, j][:, None] - x[:, j][None, :]) ** 2
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("leaf_rows,block", [(10_000, 20_000), (40, 20_000), (40, 25)])
def test_nearest_neighbours_are_exact_with_hot_duplicates(spark, monkeypatch, leaf_rows, block):
    """A third of the rows share one point; small leaves and blocks force every path."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    x = np.round(RNG.normal(size=(400, 2)), 1)
    x[::3] = x[0]
    y = np.arange(400) % 3
    f = frame(spark, x, y, 3)
    model = neighbors.knn_classifier(f, 5, leaf_rows)
    got = {r["k"]: [n["k"] for n in r["near"]] for r in model.nearest(f.df, "k").collect()}
    want = brute(x, y, x, 5)
    assert len(got) == 400
    assert all(got[i] == list(want[i]) for i in range(400))
    votes = np.array([np.bincount(y[w], minlength=3).argmax() for w in want])
    assert (predictions(model, f) == votes).all()


def test_fewer_rows_than_neighbours(spark):
    f = frame(spark, [[0.0], [1.0], [2.0]], [1.0, 2.0, 6.0])
    assert predictions(neighbors.knn_regressor(f), f) == pytest.approx([3.0] * 3)


@pytest.mark.parametrize("fit", [
    margins.svc, margins.nu_svc, gaussian.qda, stumps.ada_boost_classifier, neighbors.knn_classifier,
    trees.logistic_regression, lambda f: forests.extra_trees_classifier(f, 6),
    lambda f: boosting.gradient_boosting_classifier(f, 2), lambda f: voting.voting_classifier(f, 5),
])
def test_scores_survive_saving(spark, blobs, tmp_path, fit):
    f, _, _ = blobs
    model = fit(f)
    model.save(spark, str(tmp_path / "m"))
    again = load_fitted(spark, str(tmp_path / "m"))
    assert (predictions(again, f) == predictions(model, f)).all()


def test_regressors_survive_saving(spark, line, tmp_path):
    f, _, _ = line
    for i, fit in enumerate((online.network_regressor, margins.svr, lambda g: trees.ada_boost_regressor(g, 3))):
        model = fit(f)
        model.save(spark, str(tmp_path / str(i)))
        assert (predictions(load_fitted(spark, str(tmp_path / str(i))), f) == predictions(model, f)).all()


@pytest.mark.parametrize("classes", [False, True])
def test_gradients_of_networks_are_those_of_their_losses(classes):
    rng = np.random.default_rng(3)
    net = online.Network(3, 5, 2, classes, 0.1)
    z, v = rng.normal(size=(20, 3)), net.start(1)
    wanted = np.eye(2)[rng.integers(0, 2, 20)]

    def loss(v):
        w1, b1, w2, b2 = net.unpack(v)
        said = np.maximum(z @ w1 + b1, 0) @ w2 + b2
        fit = ((said - wanted) ** 2).sum() / 2 if not classes else (np.log(np.exp(said).sum(1)) - (said * wanted).sum(1)).sum()
        return (fit + 0.05 * ((w1**2).sum() + (w2**2).sum())) / 20

    step = 1e-6 * np.eye(len(v))
    assert net.gradient(v, z, wanted) == pytest.approx([(loss(v + e) - loss(v - e)) / 2e-6 for e in step], abs=1e-7)


def test_networks_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(online, "NETWORK_ROWS", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 2))
    f = frame(spark, x, np.sin(2 * x[:, 0]) + x[:, 1] ** 2)
    rings = frame(spark, x, np.digitize((x**2).sum(1), [0.6, 2.0]), 3)
    for given, fit in ((f, online.network_regressor), (rings, online.network_classifier)):
        learned = [fit(Frame(given.df.repartition(n), given.key, given.n_classes), epochs=2, rounds=6).state for n in (1, 4, 16)]
        for other in learned[1:]:
            assert all(np.allclose(learned[0][w], other[w], rtol=0, atol=1e-9) for w in ("w1", "b1", "w2", "b2"))


def test_networks_bend(spark):
    """Targets no linear model, mean or stump comes near: a wave and a bowl, and rings around each other."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    f = frame(spark, x, y)
    assert np.var(y - predictions(online.network_regressor(f), f)) < 0.01 * np.var(y)
    rings = np.digitize((x**2).sum(1), [0.6, 2.0])
    f = frame(spark, x, rings, 3)
    assert (predictions(online.network_classifier(f), f) == rings).mean() > 0.97


def test_wide_rows_use_array_functions(spark):
    """More features than are written out one by one."""
    x = RNG.normal(size=(200, 90))
    w = RNG.normal(size=90)
    f = frame(spark, x, x @ w + 1)
    assert predictions(linear.ols(f), f) == pytest.approx(x @ w + 1, abs=1e-6)


def test_unseen_label_values_are_not_invented(blobs):
    f, _, _ = blobs
    out = gaussian.gaussian_nb(f).transform(f.df)
    assert out.where(~F.col("prediction").isin(0.0, 1.0, 2.0)).count() == 0


def test_wide_classifiers_use_matrix_products(spark):
    """Features too many to be written out: scores come from Arrow batches and agree with numpy."""
    y = np.arange(400) % 2
    x = RNG.normal(size=(400, 70)) + 0.4 * y[:, None]
    f = frame(spark, x, y, 2)
    scores = np.column_stack([log_density(x, x[y == c].mean(0), np.cov(x[y == c].T)) for c in range(2)]) + np.log(0.5)
    assert (predictions(gaussian.qda(f), f) == scores.argmax(1)).all()
    assert (predictions(forests.extra_trees_classifier(f, 40), f) == y).mean() > 0.9


def test_many_problems_are_solved_some_at_a_time(blobs, monkeypatch):
    f, _, _ = blobs
    together, classes = margins.linear_svc(f), gaussian.qda(f)
    monkeypatch.setattr(margins, "MAX_SUMS", 20)
    monkeypatch.setattr(gaussian, "MAX_SUMS", 10)
    apart = margins.linear_svc(f)
    assert np.array(apart.state["weights"]) == pytest.approx(np.array(together.state["weights"]), rel=1e-6)
    assert gaussian.qda(f).state["constant"] == pytest.approx(classes.state["constant"], rel=1e-12)


@pytest.mark.parametrize("shard_rows, at_once", [(512, 64), (20, 3), (7, 1)])
def test_passive_aggressive_models_do_not_depend_on_partitions(spark, blobs, line, monkeypatch, shard_rows, at_once):
    """The same shards, learned from in the order of their keys' hashes, as a plain loop over rows gives."""
    monkeypatch.setattr(online, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(online, "SHARDS_AT_ONCE", at_once)
    _, x, y = line
    one, many = (online.passive_aggressive_regressor(frame(spark, x, y, parts=p), rounds=2).state for p in (1, 9))
    assert one["coefficients"] == pytest.approx(many["coefficients"], rel=1e-9)
    f = frame(spark, x, y)
    h = np.array([r["h"] for r in f.df.select("k", F.xxhash64("k").alias("h")).orderBy("k").collect()])
    shards = -(-len(y) // shard_rows)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(y))])
    w = np.append(np.zeros(4), y.mean())
    for _ in range(2):
        total = np.zeros(5)
        for s in range(shards):
            mine, rows = w.copy(), sorted(np.flatnonzero(h % shards == s), key=lambda i: h[i])
            for i in rows:
                gap = y[i] - mine @ z[i]
                mine += np.sign(gap) * min(1.0, max(abs(gap) - 0.1, 0) / (z[i] @ z[i])) * z[i]
            total += len(rows) * mine
        w = total / len(y)
    assert one["coefficients"] == pytest.approx(w[:-1] / x.std(0), rel=1e-6)
    _, bx, by = blobs
    a, b = (online.passive_aggressive_classifier(frame(spark, bx, by, 3, parts=p), rounds=2).state for p in (1, 9))
    assert np.array(a["weights"]) == pytest.approx(np.array(b["weights"]), rel=1e-9)


def test_tube_loss_is_smooth_where_its_corners_overlap():
    for epsilon in (0.0, 0.05, 1.0):
        loss = margins._tube_loss(epsilon)
        gap = np.linspace(-2, 2, 4001)[:, None]
        value, slope, bend = loss(gap, 0.0, 0.3)
        assert slope == pytest.approx(np.gradient(value[:, 0], gap[:, 0])[:, None], abs=2e-3)
        assert (np.abs(np.diff(slope[:, 0])) < 0.005).all() and (bend >= 0).all()
        assert (loss(gap, 0.0, 0.3, True) == value).all()


def test_large_tables_end_at_the_minimum_over_all_rows(two, monkeypatch):
    f, x, y = two
    whole, passes = margins.svc(f, probability=False).state, []
    monkeypatch.setattr("rowsmith.operators.models.base.START_ROWS", 60)
    counted = margins.sum_over_rows
    monkeypatch.setattr(margins, "sum_over_rows", lambda rows, part, size: passes.append(rows is f) or counted(rows, part, size))
    got = margins.svc(f, probability=False).state
    assert 0 < sum(passes) < len(passes)
    value, want = (hinge_objective(x, 2 * y - 1, np.array(s["weights"][0]), s["constants"][0], 1.0) for s in (got, whole))
    assert value == pytest.approx(want, rel=0.01)


def test_tube_regressors_need_few_passes_over_all_rows(spark, monkeypatch):
    x = RNG.uniform(0, 5, size=(2000, 2))
    y = x[:, 0] * 0.5 + x[:, 1] / 5 + RNG.normal(size=2000) * 0.1
    f, passes = frame(spark, x, y), []
    monkeypatch.setattr("rowsmith.operators.models.base.START_ROWS", 400)
    counted = margins.sum_over_rows
    monkeypatch.setattr(margins, "sum_over_rows", lambda rows, part, size: passes.append(rows is f) or counted(rows, part, size))
    fitted = margins.nu_svr(f, size=60)
    assert 0 < sum(passes) < 100
    assert np.abs(predictions(fitted, f) - x @ [0.5, 0.2]).max() < 0.3


def test_adaptive_boosting_reads_its_rows_once_a_use(spark):
    """Rounds go on from kept rows: the rows given are not worked through again in later rounds."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(200, numPartitions=2).selectExpr("id AS k", "array(cast(id % 17 AS double), cast(id % 5 AS double)) AS x", "cast(id * 7 % 23 AS double) AS label")
    df = rows.mapInArrow(counted, rows.schema).select("k", array_to_vector("x").alias("features"), "label")
    f = Frame(df, "k")
    f.rows
    before = read.value
    model = trees.ada_boost_regressor(f, 6)
    assert len(model.state["weights"]) > 3
    assert read.value - before <= 2 * 200


def test_sums_reach_the_driver_as_arrays(spark, monkeypatch):
    """2,000,000 numbers are 16 MB; four tasks give as many arrays, which as rows of Python numbers took more than 256 MB."""
    import tracemalloc

    from rowsmith.operators.models import base

    size = 2_000_000
    f = frame(spark, np.arange(40.0)[:, None], np.arange(40.0), parts=4)
    assert f.rows == 40
    tracemalloc.start()
    total = base.sum_over_rows(f, lambda x, y, h: np.full(size, x.sum()), size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total == 780).all() and peak < 128 << 20
