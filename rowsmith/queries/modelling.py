"""Queries that fit models on the whole part table and score all of it, with their SQL where there is one."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.split import key_bucket, poisson_draw
from ..operators import evaluate
from ..operators.profile import CLASSIFICATION, REGRESSION
from ..plans.prepare import Settings
from ..plans.score import score
from ..plans.train import cross_validate, fit_models, frame_of, prepare_run, reevaluate, refit_on_all
from ..plans.zoo import CLASSIFIERS, models_for
from ..session import scratch_path
from ..sources import registry
from ..streaming import score_stream as streaming
from .common import (
    CORNERS, LEVEL, LEVEL_X, LINEAR_EXACT, LINEAR_NOISY, NOISE_2, NOISY_CLASS, PLAIN, SIZE_CLASS, SIZE_ONLY,
    bucket_sql, fold_sql, holdout_sql, part_frame, table,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def _fitted(df, task, name, options=None):
    """Preparation and one model, learned from the rows that are not held out."""
    run = prepare_run(df, Settings("target", "p_partkey", task))
    model = models_for(task)[name](frame_of(run.learning_rows(), run.preparation), **(options or {}))
    run.close()
    return run.preparation, model


def _predicted(df, task, name, options=None):
    prep, model = _fitted(df, task, name, options)
    return score(df, prep, model, keep=["target"])


def _t(features: dict[str, str], target: str) -> str:
    """The table both engines see: key, features x1.., target, and whether the row is learned from."""
    columns = ", ".join(f"{e} AS x{i + 1}" for i, e in enumerate(features.values()))
    return (
        f"t AS (SELECT p_partkey, {columns}, {target} AS target, NOT {holdout_sql('p_partkey')} AS learn FROM part), "
        "l AS (SELECT * FROM t WHERE learn)"
    )


# -- linear models with a closed form ------------------------------------------------------------

SUMS_1 = "avg(x1) AS m, avg(target) AS my, var_pop(x1) AS a, covar_pop(x1, target) AS p, var_pop(target) AS yy, count(*) AS n"


def _one_feature(slope: str) -> str:
    return (
        f"WITH {_t(SIZE_ONLY, LINEAR_NOISY)}, s AS (SELECT {SUMS_1} FROM l), w AS (SELECT *, {slope} AS w FROM s) "
        "SELECT p_partkey, round(my + w * (x1 - m), 5) AS prediction FROM t, w"
    )


def _two_features(added: str) -> str:
    return (
        f"WITH {_t(PLAIN, LINEAR_NOISY)}, s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(target) AS my, count(*) AS n, "
        f"var_pop(x1) + {added} AS a, var_pop(x2) + {added} AS b, covar_pop(x1, x2) AS c, covar_pop(x1, target) AS p, "
        "covar_pop(x2, target) AS q FROM l), "
        "w AS (SELECT *, (p * b - q * c) / (a * b - c * c) AS w1, (q * a - p * c) / (a * b - c * c) AS w2 FROM s) "
        "SELECT p_partkey, round(my + w1 * (x1 - m1) + w2 * (x2 - m2), 5) AS prediction FROM t, w"
    )


def _regression(features, target, model, options=None, digits=5):
    def run(spark, sf):
        out = _predicted(part_frame(spark, sf, target, features), REGRESSION, model, options)
        return out.select("p_partkey", F.round("prediction", digits).alias("prediction"))

    return run


query(_two_features("0"), "ordinary_least_squares")(_regression(PLAIN, LINEAR_NOISY, "lr"))
query(_two_features("1e0 / count(*)"), "ridge")(_regression(PLAIN, LINEAR_NOISY, "ridge"))
query(_two_features("1e-4"), "sgd_regression")(_regression(PLAIN, LINEAR_NOISY, "SGDRegressor"))
query(_one_feature("sign(p) * greatest(abs(p) - 1, 0) / a"), "lasso")(_regression(SIZE_ONLY, LINEAR_NOISY, "lasso"))
query(_one_feature("sign(p) * greatest(abs(p) - 0.5, 0) / (a + 0.5)"), "elastic_net")(
    _regression(SIZE_ONLY, LINEAR_NOISY, "en")
)
query(
    f"WITH RECURSIVE {_t(SIZE_ONLY, LINEAR_NOISY)}, s AS (SELECT avg(x1) AS m, avg(target) AS my, var_pop(x1) * count(*) AS s, "
    "covar_pop(x1, target) * count(*) AS p, var_pop(target) * count(*) AS yy, count(*)::DOUBLE AS n FROM l), "
    "e(r, w, noise, weight, moved) AS (SELECT 0, 0e0, 1e0 / (yy / n + 2.220446049250313e-16), 1e0, 1e9 FROM s "
    "UNION ALL SELECT r + 1, w2, (n - g + 2e-6) / (greatest(yy - 2 * w2 * p + w2 * w2 * s, 0) + 2e-6), "
    "(g + 2e-6) / (w2 * w2 + 2e-6), abs(w2 - w) FROM (SELECT e.*, s.*, p / (s + weight / noise) AS w2, "
    "noise * s / (weight + noise * s) AS g FROM e, s WHERE r < 300 AND NOT (r > 1 AND moved < 1e-3))), "
    "f AS (SELECT * FROM e ORDER BY r DESC LIMIT 1), w AS (SELECT m, my, p / (s + weight / noise) AS w FROM f, s) "
    "SELECT p_partkey, round(my + w * (x1 - m), 5) AS prediction FROM t, w",
    "bayesian_ridge",
)(_regression(SIZE_ONLY, LINEAR_NOISY, "br"))
query(
    f"WITH RECURSIVE {_t(SIZE_ONLY, LINEAR_NOISY)}, s AS (SELECT avg(x1) AS m, avg(target) AS my, var_pop(x1) * count(*) AS s, "
    "covar_pop(x1, target) * count(*) AS p, var_pop(target) * count(*) AS yy, count(*)::DOUBLE AS n FROM l), "
    "e(r, w, noise, prec, moved) AS (SELECT 0, 0e0, 1e0 / (yy / n + 2.220446049250313e-16), 1e0, 1e9 FROM s "
    "UNION ALL SELECT r + 1, w2, (n - g + 2e-6) / (greatest(yy - 2 * w2 * p + w2 * w2 * s, 0) + 2e-6), "
    "(g + 2e-6) / (w2 * w2 + 2e-6), abs(w2 - w) FROM (SELECT e.*, s.*, noise * p / (prec + noise * s) AS w2, "
    "1 - prec / (prec + noise * s) AS g FROM e, s WHERE r < 300 AND NOT (r > 1 AND moved < 1e-3))), "
    "f AS (SELECT * FROM e ORDER BY r DESC LIMIT 1), w AS (SELECT m, my, noise * p / (prec + noise * s) AS w FROM f, s) "
    "SELECT p_partkey, round(my + w * (x1 - m), 5) AS prediction FROM t, w",
    "automatic_relevance",
)(_regression(SIZE_ONLY, LINEAR_NOISY, "ard"))
# a target without noise: the line itself is the answer
query(f"SELECT p_partkey, round({LINEAR_EXACT}, 2) AS prediction FROM part", "huber")(
    _regression(PLAIN, LINEAR_EXACT, "huber", digits=2)
)

# -- trees on a target with three levels and wide gaps ---------------------------------------------

LEVELS = {"x": LEVEL_X, "z": NOISE_2}
for _name, _model, _options in (
    ("decision_tree_regression", "dt", {}),
    ("random_forest_regression", "rf", {}),
    ("extra_trees_regression", "et", {}),
    ("gradient_boosting_regression", "gbr", {}),
    ("adaptive_boosting_regression", "ada", {}),
):
    query(f"SELECT p_partkey, {LEVEL} AS prediction FROM part", _name)(_regression(LEVELS, LEVEL, _model, _options, 4))

# -- approximate regressors: every row within a tolerance --------------------------------------------

SMOOTH = {"x": "p_size / 10e0", "z": NOISE_2}
SMOOTH_TARGET = f"p_size / 10e0 * 0.5e0 + {NOISE_2}"
for _name, _model, _target, _features, _tolerance in (
    ("passive_aggressive_regression", "par", LINEAR_EXACT, PLAIN, 2.0),
    ("network_regression", "mlp", SMOOTH_TARGET, SMOOTH, 0.25),
    ("support_vector_regression", "svm", SMOOTH_TARGET, SMOOTH, 0.35),
    ("nu_support_vector_regression", "NuSVR", SMOOTH_TARGET, SMOOTH, 0.35),
):
    def _close(spark, sf, model=_model, target=_target, features=_features, tolerance=_tolerance):
        out = _predicted(part_frame(spark, sf, target, features), REGRESSION, model)
        return out.select("p_partkey", (F.abs(F.col("prediction") - F.col("target")) <= tolerance).alias("close"))

    query("SELECT p_partkey, true AS close FROM part", _name)(_close)


# -- classifiers with a closed form --------------------------------------------------------------------

BY_CLASS = (
    f"WITH {_t(PLAIN, NOISY_CLASS)}, g AS (SELECT target AS c, count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, "
    "var_pop(x1) AS a, var_pop(x2) AS b, covar_pop(x1, x2) AS k FROM l GROUP BY 1), "
    "z AS (SELECT sum(n) AS n, count(*) AS classes FROM g)"
)
PICK = "SELECT p_partkey, target, arg_max(c, score) AS prediction_label FROM f GROUP BY ALL"
GNB_SCORES = (
    BY_CLASS + ", v AS (SELECT 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS v FROM l), "
    "f AS (SELECT p_partkey, target, c, ln(g.n / z.n) - 0.5 * (ln(2 * pi() * (a + v)) + ln(2 * pi() * (b + v))) "
    "- 0.5 * ((x1 - m1) * (x1 - m1) / (a + v) + (x2 - m2) * (x2 - m2) / (b + v)) AS score FROM t, g, z, v) "
)


def _noisy(spark, sf):
    return part_frame(spark, sf, NOISY_CLASS, PLAIN)


def _labels(name):
    def run(spark, sf):
        out = _predicted(_noisy(spark, sf), CLASSIFICATION, name)
        return out.select("p_partkey", "target", "prediction_label")

    return run


query(GNB_SCORES + PICK, "gaussian_naive_bayes")(_labels("Gaussian Naive Bayes"))
query(
    BY_CLASS + ", w AS (SELECT sum(g.n * a) / (any_value(z.n) - any_value(classes)) AS a, "
    "sum(g.n * b) / (any_value(z.n) - any_value(classes)) AS b, sum(g.n * k) / (any_value(z.n) - any_value(classes)) AS k FROM g, z), "
    "f AS (SELECT p_partkey, target, c, ln(g.n / z.n) - 0.5 * (w.b * (x1 - m1) * (x1 - m1) - 2 * w.k * (x1 - m1) * (x2 - m2) "
    "+ w.a * (x2 - m2) * (x2 - m2)) / (w.a * w.b - w.k * w.k) AS score FROM t, g, z, w) " + PICK,
    "linear_discriminant",
)(_labels("Linear Discriminant Analysis"))
query(
    BY_CLASS + ", q AS (SELECT c, n, m1, m2, a * n / (n - 1) AS a, b * n / (n - 1) AS b, k * n / (n - 1) AS k FROM g), "
    "f AS (SELECT p_partkey, target, c, ln(q.n / z.n) - 0.5 * ln(a * b - k * k) - 0.5 * (b * (x1 - m1) * (x1 - m1) "
    "- 2 * k * (x1 - m1) * (x2 - m2) + a * (x2 - m2) * (x2 - m2)) / (a * b - k * k) AS score FROM t, q, z) " + PICK,
    "quadratic_discriminant",
)(_labels("Quadratic Discriminant Analysis"))

CLASS_NUMBERS = "o AS (SELECT target AS c, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS number FROM t GROUP BY 1)"


@query(
    GNB_SCORES + f", {CLASS_NUMBERS}, h AS (SELECT p_partkey, max(score) AS top FROM f GROUP BY 1), "
    "e AS (SELECT p_partkey, number, exp(score - top) AS e FROM f JOIN h USING (p_partkey) JOIN o USING (c)) "
    "SELECT p_partkey, round(sum(e) FILTER (WHERE number = 1) / sum(e), 6) AS probability_1, "
    "round(max(e) / sum(e), 6) AS confidence FROM e GROUP BY 1"
)
def class_probabilities(spark, sf):
    out = _predicted(_noisy(spark, sf), CLASSIFICATION, "Gaussian Naive Bayes")
    return out.select("p_partkey", F.round("probability_1", 6).alias("probability_1"), F.round("confidence", 6).alias("confidence"))


def _boosting_round(k: int) -> str:
    """One stump per class on the slopes of round ``k``: both cuts are tried, leaves take a Newton step."""
    return (
        f"p{k} AS (SELECT x1, c, exp(raw) / sum(exp(raw)) OVER (PARTITION BY x1) AS p FROM r{k}), "
        f"g{k} AS (SELECT p.x1, p.c, m.m, coalesce(n, 0) - m.m * p AS g, m.m * p * (1 - p) AS h FROM p{k} p JOIN m ON m.x1 = p.x1 "
        "LEFT JOIN cells ON cells.x1 = p.x1 AND cells.c = p.c), "
        f"s{k} AS (SELECT c, z, sum(g) FILTER (WHERE x1 < z) AS gl, sum(m) FILTER (WHERE x1 < z) AS nl, sum(h) FILTER (WHERE x1 < z) AS hl, "
        "sum(g) FILTER (WHERE x1 > z) AS gr, sum(m) FILTER (WHERE x1 > z) AS nr, sum(h) FILTER (WHERE x1 > z) AS hr "
        f"FROM g{k}, (VALUES (2e0), (6e0)) AS cuts(z) GROUP BY c, z), "
        f"b{k} AS (SELECT * FROM s{k} QUALIFY row_number() OVER (PARTITION BY c ORDER BY gl * gl / nl + gr * gr / nr - (gl + gr) * (gl + gr) / (nl + nr) DESC, z) = 1), "
        f"r{k + 1} AS (SELECT x1, c, raw + 0.1e0 * 2 / 3 * CASE WHEN x1 < z THEN gl / hl ELSE gr / hr END AS raw FROM r{k} JOIN b{k} USING (c)), "
    )


THREE_STEPS = {"x": "CASE WHEN p_size < 17 THEN 0e0 WHEN p_size < 34 THEN 4e0 ELSE 8e0 END"}


@query(
    f"WITH {_t(THREE_STEPS, NOISY_CLASS)}, {CLASS_NUMBERS}, cells AS (SELECT x1, target AS c, count(*) AS n FROM l GROUP BY 1, 2), "
    "m AS (SELECT x1, sum(n) AS m FROM cells GROUP BY 1), w AS (SELECT c, sum(n) / (SELECT sum(n) FROM cells) AS share FROM cells GROUP BY 1), "
    "r0 AS (SELECT x1, c, ln(share) AS raw FROM m, w), " + _boosting_round(0) + _boosting_round(1) +
    "e AS (SELECT x1, c, number, exp(raw) / sum(exp(raw)) OVER (PARTITION BY x1) AS p FROM r2 JOIN o USING (c)) "
    "SELECT p_partkey, (max_by(e.c, p)) AS prediction_label, round(sum(p) FILTER (WHERE number = 1), 6) AS probability_1, round(max(p), 6) AS confidence "
    "FROM t JOIN e USING (x1) GROUP BY 1"
)
def boosting_two_rounds(spark, sf):
    """Two rounds of stumps for three classes that overlap."""
    out = _predicted(part_frame(spark, sf, NOISY_CLASS, THREE_STEPS), CLASSIFICATION, "Gradient Boosting Classifier", {"rounds": 2, "depth": 1})
    return out.select("p_partkey", "prediction_label", F.round("probability_1", 6).alias("probability_1"), F.round("confidence", 6).alias("confidence"))


@query(
    "WITH d AS (SELECT p_partkey, (p_size % 9) / 2e0 AS mean, (" + bucket_sql("p_partkey", 1 << 31, "42|draw|3") + " + 0.5e0) / 2147483648e0 AS u FROM part), "
    "terms AS (SELECT m / 2e0 AS mean, k, exp(-m / 2e0) * pow(m / 2e0, k) / factorial(k::INTEGER)::DOUBLE AS term FROM range(0, 9) a(m), range(0, 20) b(k)), "
    "upto AS (SELECT mean, k, sum(term) OVER (PARTITION BY mean ORDER BY k) AS upto FROM terms) "
    "SELECT p_partkey, count(*) FILTER (WHERE u >= upto)::INTEGER AS drawn FROM d JOIN upto USING (mean) GROUP BY 1"
)
def weighted_draws(spark, sf):
    """How often each row is in a weighted sample with replacement, drawn again from its key."""
    u = (key_bucket(F.col("p_partkey"), 1 << 31, "42|draw|3") + 0.5) / (1 << 31)
    return table(spark, sf, "part").select("p_partkey", poisson_draw((F.col("p_size") % 9) / 2, u).alias("drawn"))


SCATTERED = "cast(p_partkey * 7919 % 1009 AS double) * 1e0"


@query(f"WITH {_t({'x': 'cast(p_partkey AS double)'}, SCATTERED)} SELECT p_partkey, target AS by_tree, target AS by_extra_trees, 1e0 AS smallest_share FROM l")
def learning_rows_remembered(spark, sf):
    """A target without any order in it: only trees to pure leaves, however deep, give every learning row back."""
    df = part_frame(spark, sf, SCATTERED, {"x": "cast(p_partkey AS double)"})
    run = prepare_run(df, Settings("target", "p_partkey", REGRESSION))
    frame = frame_of(run.learning_rows(), run.preparation)
    tree, extra = models_for(REGRESSION)["dt"](frame), models_for(REGRESSION)["et"](frame, trees=10)
    told = tree.transform(frame.df).withColumnRenamed("prediction", "by_tree")
    told = extra.transform(told).withColumnRenamed("prediction", "by_extra_trees")
    as_class = replace_labels(frame)
    shares = models_for(CLASSIFICATION)["Extra Trees Classifier"](as_class, trees=10).transform(as_class.df)
    right = shares.select(F.col(frame.key), F.element_at("probability", (F.col("label") + 1).cast("int")).alias("smallest_share"))
    out = told.join(right, frame.key).select(F.col(frame.key).alias("p_partkey"), F.round("by_tree", 6).alias("by_tree"), F.round("by_extra_trees", 6).alias("by_extra_trees"), "smallest_share")
    run.close()
    return out


def replace_labels(frame):
    """The frame with two classes in place of its label."""
    return replace(frame, df=frame.df.withColumn("label", F.col("label") % 2), n_classes=2)


NEAREST = (
    "n AS (SELECT q.p_partkey, t.target, row_number() OVER (PARTITION BY q.p_partkey ORDER BY "
    "(q.x1 - t.x1) * (q.x1 - t.x1) + (q.x2 - t.x2) * (q.x2 - t.x2), t.p_partkey) AS place FROM t q, l t)"
)


@query(
    f"WITH {_t(PLAIN, NOISY_CLASS)}, {NEAREST}, {CLASS_NUMBERS}, v AS (SELECT p_partkey, c, number, count(*) AS votes "
    "FROM n JOIN o ON o.c = n.target WHERE place <= 5 GROUP BY ALL) "
    "SELECT p_partkey, arg_max(c, votes * 100 - number) AS prediction_label FROM v GROUP BY 1"
)
def nearest_neighbour_classes(spark, sf):
    out = _predicted(_noisy(spark, sf), CLASSIFICATION, "K-Nearest Neighbors", {"leaf_rows": 500})
    return out.select("p_partkey", "prediction_label")


@query(
    f"WITH {_t(PLAIN, LINEAR_NOISY)}, {NEAREST} SELECT p_partkey, round(avg(target), 5) AS prediction FROM n "
    "WHERE place <= 5 GROUP BY 1"
)
def nearest_neighbour_means(spark, sf):
    return _regression(PLAIN, LINEAR_NOISY, "knn", {"leaf_rows": 500})(spark, sf)


# -- every classifier on classes that are far apart ----------------------------------------------------

def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def _corners(spark, sf):
    return part_frame(spark, sf, SIZE_CLASS, CORNERS)


def _apart(name):
    def run(spark, sf):
        out = _predicted(_corners(spark, sf), CLASSIFICATION, name)
        return out.select("p_partkey", "target", "prediction_label")

    return run


for _name in CLASSIFIERS:
    query(f"SELECT p_partkey, {SIZE_CLASS} AS target, {SIZE_CLASS} AS prediction_label FROM part", f"classify_{slug(_name)}")(
        _apart(_name)
    )

# -- whole runs --------------------------------------------------------------------------------------------

SCORES = (
    "sqrt(avg((target - p) * (target - p))) AS rmse, avg(abs(target - p)) AS mae, "
    "1 - sum((target - p) * (target - p)) / (var_pop(target) * count(*)) AS r2, count(*)::BIGINT AS n"
)


def _line_run(spark, sf, names):
    run = prepare_run(part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY), Settings("target", "p_partkey", REGRESSION), "20240102030405")
    return fit_models(run, names)


@query(
    f"WITH {_t(SIZE_ONLY, LINEAR_NOISY)}, s AS (SELECT {SUMS_1} FROM l), w AS ("
    "SELECT 0 AS position, 'lr' AS model, p / a AS w, m, my FROM s UNION ALL SELECT 1, 'ridge', p / (a + 1e0 / n), m, my FROM s "
    "UNION ALL SELECT 2, 'lasso', sign(p) * greatest(abs(p) - 1, 0) / a, m, my FROM s "
    "UNION ALL SELECT 3, 'en', sign(p) * greatest(abs(p) - 0.5, 0) / (a + 0.5), m, my FROM s "
    "UNION ALL SELECT 4, 'Ridge', p / (a + 1e0 / n), m, my FROM s), "
    f"b AS (SELECT model, {SCORES} FROM (SELECT model, target, my + w * (x1 - m) AS p FROM t, w WHERE NOT learn) GROUP BY 1) "
    "SELECT model, 'fitted' AS status, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 5) AS r2, n, "
    "model || '_20240102030405' AS model_filename FROM b"
)
def regressor_leaderboard(spark, sf):
    run = _line_run(spark, sf, ["lr", "ridge", "lasso", "en", "Ridge"])
    run.close()
    return run.leaderboard().select(
        "model", "status", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 5).alias("r2"),
        "n", "model_filename",
    )


@query(
    GNB_SCORES + f", b AS ({PICK}), a AS (SELECT avg((target = prediction_label)::INTEGER) AS a, count(*) AS n FROM b "
    "JOIN t USING (p_partkey, target) WHERE NOT learn) SELECT 'Gaussian Naive Bayes' AS model, round(a, 6) AS accuracy, n::BIGINT AS n, "
    "'holdout' AS evaluated_on FROM a"
)
def classifier_run(spark, sf):
    run = prepare_run(_noisy(spark, sf), Settings("target", "p_partkey", CLASSIFICATION))
    fit_models(run, ["Gaussian Naive Bayes"])
    run.close()
    return run.board.select("model", F.round("accuracy", 6).alias("accuracy"), "n", "evaluated_on")


@query(
    f"SELECT m.model, m.position::INTEGER AS position, 1e0 AS accuracy, (SELECT count(*) FROM part)::BIGINT AS n FROM (VALUES "
    "(0, 'Logistic Regression'), (1, 'Decision Tree Classifier'), (2, 'Linear SVC'), (3, 'K-Nearest Neighbors'), "
    "(4, 'Gaussian Naive Bayes'), (5, 'Linear Discriminant Analysis')) AS m(position, model)"
)
def classifier_leaderboard(spark, sf):
    """Judged on the learning rows themselves, over classes that are far apart."""
    run = prepare_run(_corners(spark, sf), Settings("target", "p_partkey", CLASSIFICATION, evaluate_on="train"))
    fit_models(run, ["Logistic Regression", "Decision Tree Classifier", "Linear SVC", "K-Nearest Neighbors",
                     "Gaussian Naive Bayes", "Linear Discriminant Analysis"])
    run.close()
    return run.leaderboard().select("model", "position", "accuracy", "n")


@query(
    f"WITH {_t(SIZE_ONLY, LINEAR_NOISY)}, s AS (SELECT {SUMS_1} FROM t) "
    "SELECT p_partkey, round(my + p / a * (x1 - m), 5) AS prediction FROM t, s"
)
def refitted_on_all_rows(spark, sf):
    """A model fitted again on learning and held-out rows together."""
    df = part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY)
    run = prepare_run(df, Settings("target", "p_partkey", REGRESSION))
    prep, model = refit_on_all(run, "lr")
    run.close()
    return score(df, prep, model).select("p_partkey", F.round("prediction", 5).alias("prediction"))


@query(
    f"WITH {_t(SIZE_ONLY, LINEAR_NOISY)}, k AS (SELECT *, {fold_sql('p_partkey', 5)} AS fold FROM l), "
    f"s AS (SELECT f.fold, {SUMS_1} FROM k, (SELECT DISTINCT fold FROM k) f WHERE k.fold <> f.fold GROUP BY 1) "
    f"SELECT fold::INTEGER AS fold, round(rmse, 5) AS rmse, round(mae, 5) AS mae, n FROM (SELECT k.fold, {SCORES} FROM "
    "(SELECT k.fold, k.target, my + p / a * (x1 - m) AS p FROM k JOIN s USING (fold)) k GROUP BY 1)"
)
def cross_validated(spark, sf):
    run = prepare_run(part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY), Settings("target", "p_partkey", REGRESSION))
    scores = cross_validate(run, "lr", folds=5)
    run.close()
    return scores.select("fold", F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), "n")


LINE = f"WITH {_t(SIZE_ONLY, LINEAR_NOISY)}, s AS (SELECT {SUMS_1} FROM l)"


def _saved_line(spark, sf):
    """A line model saved and registered under a fresh base path."""
    base = scratch_path(spark, "base")
    run = _line_run(spark, sf, ["lr"])
    registry.save_run(run, base, "ana", "sizes")
    return base, run


@query(LINE + f" SELECT round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(r2, 6) AS r2, n FROM (SELECT {SCORES} FROM "
       "(SELECT target, my + p / a * (x1 - m) AS p FROM t, s WHERE NOT learn))")
def saved_model_judged_again(spark, sf):
    base, run = _saved_line(spark, sf)
    _, model = registry.load_model(spark, base, "ana", "sizes", "lr")
    again = reevaluate(run.judged_rows(), model, REGRESSION)
    return again.select(F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("r2", 6).alias("r2"), "n")


@query(LINE + " SELECT p_partkey, round(my + p / a * (x1 - m), 5) AS prediction FROM t, s")
def scored_by_reference(spark, sf):
    """Scored by user, project, model and run; columns in another order and one too many."""
    base, run = _saved_line(spark, sf)
    prep, model = registry.load_model(spark, base, "ana", "sizes", "lr", run.run_id)
    rows = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), "p_partkey")
    return score(rows, prep, model).select("p_partkey", F.round("prediction", 5).alias("prediction"))


@query(
    LINE + ", g AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE x1 END AS x1 FROM t) "
    "SELECT p_partkey, round(my + p / a * (coalesce(x1, (SELECT avg(x1) FROM g)) - m), 5) AS by_batch, "
    "round(my + p / a * (coalesce(x1, m) - m), 5) AS by_training FROM g, s"
)
def scored_with_gaps(spark, sf):
    """Missing cells filled with the batch's own means, and with the training means."""
    prep, model = _fitted(part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY), REGRESSION, "lr")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.expr("CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE cast(p_size as double) END").alias("p_size")
    )
    own = score(rows, prep, model, impute="batch").select("p_partkey", F.round("prediction", 5).alias("by_batch"))
    kept = score(rows, prep, model).select("p_partkey", F.round("prediction", 5).alias("by_training"))
    return own.join(kept, "p_partkey")


CODED = {"brand": "p_brand"}


@query(
    f"WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1), "
    f"t AS (SELECT p_partkey, code::DOUBLE AS x1, {LINEAR_NOISY} AS target, NOT {holdout_sql('p_partkey')} AS learn "
    f"FROM part JOIN b USING (p_brand)), s AS (SELECT {SUMS_1} FROM t WHERE learn) "
    "SELECT p_partkey, round(my + p / a * (x1 - m), 5) AS prediction FROM t, s"
)
def scored_on_category_codes(spark, sf):
    return _regression(CODED, LINEAR_NOISY, "lr")(spark, sf)


@query(LINE + " SELECT p_partkey, round(my + p / a * (x1 - m), 5) AS prediction FROM t, s")
def scored_stream(spark, sf):
    """The part table as JSON records, scored by a streaming job."""
    prep, model = _fitted(part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY), REGRESSION, "lr")
    source, out, state = (scratch_path(spark, n) for n in ("records", "scored", "progress"))
    table(spark, sf, "part").select(F.to_json(F.struct("p_partkey", "p_size")).alias("value")).write.text(source)
    lines = spark.readStream.schema("value string").text(source)
    records = streaming.parse_records(lines, streaming.record_schema(prep))
    streaming.score_stream(records, prep, model, out, state).awaitTermination()
    return streaming.read_scored(spark, out).select("p_partkey", F.round("prediction", 5).alias("prediction"))


@query(
    LINE + " SELECT cast(p_partkey AS VARCHAR) AS key, round(my + p / a * (x1 - m), 5) AS prediction, 'ana' AS \"user\", "
    "'lr' AS model, '20240102030405' AS run_id FROM t, s"
)
def prediction_log(spark, sf):
    base, run = _saved_line(spark, sf)
    scored = score(part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY), run.preparation, run.models["lr"])
    registry.log_predictions(scored, base, "ana", "lr", run.run_id, "p_partkey")
    return registry.predictions(spark, base).select("key", F.round("prediction", 5).alias("prediction"), "user", "model", "run_id")


@query(
    LINE + " SELECT 'ana' AS username, 'Regression' AS model_trainer_class, 'lr.pkl' AS model_name, 'target' AS target_column_name, "
    "'p_size' AS api_required_fields, 'Active' AS api_status, round((SELECT p / a FROM s), 5) AS slope"
)
def deployed_model(spark, sf):
    """A registered model deployed under a link; the slope shows which model it is."""
    base, _ = _saved_line(spark, sf)
    registry.deploy(spark, base, "ana", "sizes", "lr", link="/sizes")
    _, model = registry.load_model(spark, base, "ana", "sizes", "lr")
    return registry.deployments(spark, base).select(
        "username", "model_trainer_class", "model_name", "target_column_name",
        F.array_join("api_required_fields", ",").alias("api_required_fields"), "api_status",
        F.round(F.lit(model.state["coefficients"][0]), 5).alias("slope"),
    )


# -- the complete lists, with default options ------------------------------------------------------------


def _listed(names) -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"(VALUES {rows}) AS m(position, model)"


@query(
    "SELECT model, position::INTEGER AS position, 'fitted' AS status, true AS right, (SELECT count(*) FROM part)::BIGINT AS n "
    f"FROM {_listed(CLASSIFIERS)}"
)
def all_classifiers(spark, sf):
    """Every classifier of the list on one prepared table, its classes far apart."""
    run = prepare_run(_corners(spark, sf), Settings("target", "p_partkey", CLASSIFICATION, evaluate_on="train"))
    board = fit_models(run).leaderboard()
    run.close()
    return board.select("model", "position", "status", (F.col("accuracy") >= 0.9).alias("right"), "n")


@query(
    f"WITH {_t(SMOOTH, SMOOTH_TARGET)} SELECT model, position::INTEGER AS position, 'fitted' AS status, true AS right, "
    f"(SELECT count(*) FROM t WHERE NOT learn)::BIGINT AS n FROM {_listed(models_for(REGRESSION))}"
)
def all_regressors(spark, sf):
    """Every named regressor on one prepared table. All fit the surface but those whose penalty is as strong as its slope."""
    run = prepare_run(part_frame(spark, sf, SMOOTH_TARGET, SMOOTH), Settings("target", "p_partkey", REGRESSION))
    board = fit_models(run).leaderboard()
    run.close()
    return board.select("model", "position", "status", (F.col("r2") > _least_r2()).alias("right"), "n")


def _least_r2():
    """What a regressor must explain of the smooth surface."""
    return F.when(F.col("model").isin("lasso", "Lasso"), 0.0).when(F.col("model").isin("en", "ElasticNet"), 0.4).otherwise(0.94)


@query(
    LINE + f", b AS (SELECT {SCORES} FROM (SELECT target, my + p / a * (x1 - m) AS p FROM t, s WHERE NOT learn)) "
    "SELECT 'ana' AS \"user\", 'sizes' AS project, run_id, 'lr' AS model, round(rmse, 5) AS rmse, n FROM b, "
    "(VALUES ('20240102030405'), ('20240102030406')) AS r(run_id)"
)
def leaderboards_kept(spark, sf):
    """The boards of two runs, appended when the runs were saved."""
    base, run = _saved_line(spark, sf)
    registry.save_run(replace(run, run_id="20240102030406"), base, "ana", "sizes")
    kept = registry.leaderboards(spark, base, REGRESSION)
    return kept.select("user", "project", F.col("run_id").cast("string").alias("run_id"), "model", F.round("rmse", 5).alias("rmse"), "n")


@query(LINE + " SELECT p_partkey, round(my + p / a * (x1 - m), 5) AS prediction FROM t, s")
def scored_by_endpoint(spark, sf):
    """An endpoint keeps the model it was deployed with when a later run has another one of that name."""
    base, _ = _saved_line(spark, sf)
    registry.deploy(spark, base, "ana", "sizes", "lr", link="/sizes")
    later = prepare_run(part_frame(spark, sf, "100e0 - p_size", SIZE_ONLY), Settings("target", "p_partkey", REGRESSION), "20250102030405")
    registry.save_run(fit_models(later, ["lr"]), base, "ana", "sizes")
    prep, model = registry.load_deployed(spark, base, "lr_ana")
    rows = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_partkey")
    return score(rows, prep, model).select("p_partkey", F.round("prediction", 5).alias("prediction"))


@query(
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'no record ' || cast(p_partkey AS VARCHAR) "
    "ELSE '{\"p_size\":' || cast(p_size AS VARCHAR) || '}' END AS value FROM part WHERE p_partkey % 3 < 2"
)
def stream_rejects(spark, sf):
    """Lines of a stream that are no records, or have no key, are kept whole."""
    prep, model = _fitted(part_frame(spark, sf, LINEAR_NOISY, SIZE_ONLY), REGRESSION, "lr")
    source, out, rejects, state = (scratch_path(spark, n) for n in ("records", "scored", "rejects", "progress"))
    p = table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("no record "), F.col("p_partkey").cast("string"))).when(
        F.col("p_partkey") % 3 == 1, F.to_json(F.struct("p_size"))
    ).otherwise(F.to_json(F.struct("p_partkey", "p_size")))
    p.select(line.alias("value")).write.text(source)
    lines = spark.readStream.schema("value string").text(source)
    streaming.score_lines(lines, prep, model, out, rejects, state).awaitTermination()
    return spark.read.schema("value string").parquet(rejects).select("value")


@query(
    f"WITH {_t(PLAIN, LINEAR_NOISY)}, {NEAREST} SELECT p_partkey AS part, p_partkey % 10 AS p_partkey, round(avg(target), 5) AS prediction "
    "FROM n WHERE place <= 5 GROUP BY 1"
)
def nearest_neighbour_repeated_keys(spark, sf):
    """Scored rows whose keys repeat have the neighbours of their own features."""
    df = part_frame(spark, sf, LINEAR_NOISY, PLAIN)
    prep, model = _fitted(df, REGRESSION, "knn", {"leaf_rows": 500})
    rows = df.withColumn("part", F.col("p_partkey")).withColumn("p_partkey", F.col("p_partkey") % 10)
    return score(rows, prep, model, keep=["part"]).select("part", "p_partkey", F.round("prediction", 5).alias("prediction"))


def flagship(spark, sf):
    """Which model predicts the size class best: the leaderboard of a few quick models."""
    run = prepare_run(_noisy(spark, sf), Settings("target", "p_partkey", CLASSIFICATION))
    fit_models(run, ["Logistic Regression", "Gaussian Naive Bayes", "Linear Discriminant Analysis", "K-Nearest Neighbors"])
    run.close()
    return evaluate.add_rank(run.board, "accuracy", True).select("rank", "model", "status", "accuracy", "n", "model_filename")
