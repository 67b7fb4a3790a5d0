"""Large-margin models: one Newton solver over distributed sums, many problems at once.

Each problem is ``0.5 w'Rw + C sum(loss)``. A pass over the rows gives loss, gradient and
curvature of all problems together (one-vs-rest classes, class pairs, left-out folds, cost
grids), so the number of jobs does not grow with the number of problems. On large tables the steps
from far away are made on a part of the rows; the last ones are on all rows, until the same rule
says that the minimum over them is reached. The hinge is rounded
off over a small width that shrinks during the fit (Chapelle 2007); the squared hinge is
solved as it is (Keerthi and DeCoste 2005). Kernels are random Fourier features (Rahimi and
Recht 2007).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .base import MAX_SUMS, Fitted, Frame, dot, features_array, first_max, shares, sum_over_rows
from .gaussian import LinearScores

HINGE_WIDTHS = (2.0, 0.4, 0.1)  # half widths of the rounded corner, the last one is final
TUBE_WIDTHS = (2.0, 0.4, 0.08, 0.02)
STEPS = (1.6, 1.0, 0.7, 0.45, 0.3, 0.2, 0.12, 0.06, 0.03, 0.01, 0.003, 0.0005)  # tried in one pass
MAX_STEPS = 40
FAR = 0.2  # a problem whose first step over all rows would gain this share of its value is begun again on all rows


# -- losses ------------------------------------------------------------------------------


def _ramp(u, s, value_only=False):
    """Rounded max(u, 0) of half width s, with its first two derivatives unless told not to."""
    inner = np.clip(u, -s, s) + s
    value = inner * inner / (4 * s) + np.maximum(u - s, 0.0)
    return value if value_only else (value, inner / (2 * s), (np.abs(u) < s) / (2 * s))


def _square(u, _, value_only=False):
    over = np.maximum(u, 0.0)
    return over**2 if value_only else (over**2, 2 * over, 2.0 * (u > 0))


def _margin_loss(shape):
    """Loss of 1 - y f for targets y in {-1, 0, 1}; 0 leaves the row out of the problem."""

    def loss(scores, target, width, value_only=False):
        inside = target != 0
        if value_only:
            return shape(1 - target * scores, width, True) * inside
        value, slope, bend = shape(1 - target * scores, width)
        return value * inside, -target * slope, bend * inside

    return loss


def _tube_loss(epsilon):
    """Loss of |y - f| beyond epsilon, linear outside the tube; both corners are rounded, so that it is
    smooth where they overlap."""

    def loss(scores, target, width, value_only=False):
        gap = scores - target
        if value_only:
            return _ramp(gap - epsilon, width, True) + _ramp(-gap - epsilon, width, True)
        above, below = _ramp(gap - epsilon, width), _ramp(-gap - epsilon, width)
        return above[0] + below[0], above[1] - below[1], above[2] + below[2]

    return loss


# -- solver --------------------------------------------------------------------------------


def _scaled(frame: Frame, fourier: dict | None):
    """Map from raw rows to model columns with a trailing 1, and the penalty on raw weights.

    Raw features are centred and scaled for the solver; the penalty matrix undoes this, so the
    minimum is that of the unscaled problem.
    """
    if fourier:
        size = fourier["size"]
        return (lambda x: np.column_stack([fourier_map(x, fourier), np.ones(len(x))])), np.zeros(size), np.ones(size)
    mean, sd = frame.moments
    return (lambda x: np.column_stack([(x - mean) / sd, np.ones(len(x))])), mean, sd


def minimise(frame: Frame, targets, loss, cost, fourier=None, penalise_constant=False, widths=HINGE_WIDTHS, unit=1.0,
             start=None, settled=1e-4):
    """Weights (m x d) and constants (m) of the m problems with costs ``cost``.

    ``targets(y, h)`` gives the n x m targets of a batch. ``unit`` scales the hinge widths.
    A problem is done once a Newton step would gain less than ``settled`` of its value.
    ``start`` may bring weights and constants on random features to go on from.
    """
    columns, mean, sd = _scaled(frame, fourier)
    cost = np.asarray(cost, dtype=float)
    m, p = len(cost), len(mean) + 1
    frame.check_square(p)
    fits = max(1, MAX_SUMS // (p * p))
    if m > fits:  # too many problems for one array of sums: some at a time
        pieces = [
            minimise(frame, lambda y, h, at=at: targets(y, h)[:, at : at + fits], loss, cost[at : at + fits], fourier,
                     penalise_constant, widths, unit, start and tuple(a[at : at + fits] for a in start), settled)
            for at in range(0, m, fits)
        ]
        return np.concatenate([w for w, _ in pieces]), np.concatenate([b for _, b in pieces])
    back = np.append(-mean / sd, 1.0)  # raw constant as a function of scaled weights
    penalty = np.diag(np.append(1.0 / sd**2, 0.0)) + (np.outer(back, back) if penalise_constant else 0.0)

    def evaluate(rows, cost, w, live, width):
        """Value, Newton step and what it gains, of the problems ``live``: one pass."""
        here, n = w[live], len(live)

        def part(x, y, h):
            z = columns(x)
            value, slope, bend = loss(z @ here.T, targets(y, h)[:, live], width)
            curve = []
            for j in range(n):
                bent = np.flatnonzero(bend[:, j])  # few rows are near the corner
                near = z[bent]
                curve.append((near.T @ (near * bend[bent, j][:, None])).ravel())
            return np.concatenate([value.sum(0), (slope.T @ z).ravel(), *curve])

        s = sum_over_rows(rows, part, n + n * p + n * p * p)
        c = cost[live]
        value = c * s[:n] + 0.5 * np.einsum("mp,pq,mq->m", here, penalty, here)
        gradient = c[:, None] * s[n : n + n * p].reshape(n, p) + here @ penalty
        curve = c[:, None, None] * s[n + n * p :].reshape(n, p, p) + penalty
        ridge = 1e-10 * np.trace(curve, axis1=1, axis2=2)[:, None, None] / p * np.eye(p)
        step = -np.linalg.solve(curve + ridge, gradient[:, :, None])[:, :, 0]
        return value, step, -np.einsum("mp,mp->m", gradient, step) / np.maximum(np.abs(value), 1e-12)

    def along(rows, cost, w, live, step, width):
        """Values at ``w + t step`` for all trial sizes t: one pass without derivatives."""
        here, n = w[live], len(live)

        def part(x, y, h):
            z, t = columns(x), targets(y, h)[:, live]
            start, slope = z @ here.T, z @ step.T
            return np.concatenate([loss(start + size * slope, t, width, True).sum(0) for size in STEPS])

        sums = sum_over_rows(rows, part, len(STEPS) * n).reshape(len(STEPS), n)
        trials = here[None] + np.asarray(STEPS)[:, None, None] * step[None]
        return cost[live] * sums + 0.5 * np.einsum("smp,pq,smq->sm", trials, penalty, trials)

    def descend(rows, cost, w, live, widths):
        """Brings ``w`` of the problems ``live`` to the minimum over ``rows``, one width after the other."""
        for width in widths:
            enough = settled if width == widths[-1] else 3e-2
            todo = live
            for _ in range(MAX_STEPS):
                if not todo.size:
                    break
                value, step, gain = evaluate(rows, cost, w, todo, width)
                open_ = gain > enough
                todo, value, step = todo[open_], value[open_], step[open_]
                if not todo.size:
                    break
                values = along(rows, cost, w, todo, step, width)
                best = values.argmin(0)
                better = values[best, np.arange(len(todo))] < value
                w[todo[better]] += np.asarray(STEPS)[best[better]][:, None] * step[better]
                todo = todo[better]

    w = np.zeros((m, p)) if start is None else np.column_stack(start)
    every, widths = np.arange(m), np.asarray(widths) * unit
    with frame.start_rows() as few:
        if few is not None:
            descend(few, cost * (frame.rows / few.rows), w, every, widths)
            far = evaluate(frame, cost, w, every, widths[-1])[2] > FAR  # such as pairs of rare classes
            w[far] = 0.0 if start is None else np.column_stack(start)[far]
            descend(frame, cost, w, every[far], widths)
            descend(frame, cost, w, every[~far], widths[-1:])
        else:
            descend(frame, cost, w, every, widths)
    weights = w[:, :-1] / sd
    return weights, w[:, -1] - weights @ mean


# -- random Fourier features ------------------------------------------------------------------


def fourier_settings(frame: Frame, size: int) -> dict:
    """Features of the RBF kernel with gamma 1 / (d * variance over all cells)."""
    mean, _ = frame.moments
    variance = float(frame.variance.mean() + mean.var())  # over all cells together
    gamma = 1.0 / (frame.width * variance) if variance > 0 else 1.0
    return {"size": size, "width": frame.width, "gamma": float(gamma), "seed": frame.seed}


def fourier_map(x: np.ndarray, f: dict) -> np.ndarray:
    rng = np.random.default_rng(f["seed"])
    directions = rng.normal(size=(f["width"], f["size"])) * np.sqrt(2 * f["gamma"])
    phases = rng.uniform(0, 2 * np.pi, f["size"])
    return np.sqrt(2.0 / f["size"]) * np.cos(x @ directions + phases)


def _fourier_scores(f: dict, weights, constants) -> Column:
    w, b = np.asarray(weights, dtype=float), np.asarray(constants, dtype=float)

    @pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(fourier_map(np.stack(x.to_numpy()), f) @ w.T + b))

    return scores(features_array())


def _scores(df: DataFrame, state: dict) -> tuple[DataFrame, list[Column]]:
    """Add the score of each problem as a column; linear scores stay in the JVM."""
    m = len(state["constants"])
    if state.get("fourier"):
        df = df.withColumn("_f", _fourier_scores(state["fourier"], state["weights"], state["constants"]))
        return df, [F.col("_f")[j] for j in range(m)]
    df = df.withColumn("_x", features_array())
    df = df.withColumns({f"_f{j}": dot(F.col("_x"), state["weights"][j], state["constants"][j]) for j in range(m)})
    return df, [F.col(f"_f{j}") for j in range(m)]


# -- one-vs-rest ----------------------------------------------------------------------------


def _one_vs_rest(k: int):
    if k == 2:
        return 1, lambda y, h: np.where(y == 1, 1.0, -1.0)[:, None]
    return k, lambda y, h: np.where(np.equal.outer(y, np.arange(k)), 1.0, -1.0)


def linear_svc(frame: Frame, cost: float = 1.0) -> LinearScores:
    """Squared hinge, one class against the rest, the constant penalised like a weight."""
    m, targets = _one_vs_rest(frame.n_classes)
    w, b = minimise(frame, targets, _margin_loss(_square), [cost] * m, penalise_constant=True, widths=(1.0,),
                    settled=1e-10)
    return LinearScores({"weights": w.tolist(), "constants": b.tolist()})


def sgd_classifier(frame: Frame, alpha: float = 1e-4) -> LinearScores:
    """Minimum of mean(hinge) + 0.5 alpha |w|^2, one class against the rest."""
    m, targets = _one_vs_rest(frame.n_classes)
    w, b = minimise(frame, targets, _margin_loss(_ramp), [1.0 / (alpha * frame.rows)] * m)
    return LinearScores({"weights": w.tolist(), "constants": b.tolist()})


# -- class pairs with probabilities ---------------------------------------------------------


class PairwiseScores(Fitted):
    """One score per class pair, votes for the class, and a sigmoid of the score per pair."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        k, pairs = s["classes"], [tuple(p) for p in s["pairs"]]
        keep = df.columns
        df, f = _scores(df, s)
        if k == 2:
            votes = (f[0] > 0).cast("double")
        else:
            votes = first_max(
                [
                    sum((F.when(f[i] > 0, F.lit(float(b == c))).otherwise(F.lit(float(a == c)))
                         for i, (a, b) in enumerate(pairs)), F.lit(0.0))
                    for c in range(k)
                ]
            )
        if not s["sigmoid"]:
            return df.withColumn("prediction", votes).select(*keep, "prediction")
        # P(second of the pair), kept away from 0 and 1
        p = [
            F.least(F.greatest(1 / (1 + F.exp(F.lit(a) * x + F.lit(b))), F.lit(1e-7)), F.lit(1 - 1e-7))
            for x, (a, b) in zip(f, s["sigmoid"])
        ]
        if k == 2:
            probability = F.array(1 - p[0], p[0])
        else:  # coupling of pairwise probabilities (Price et al. 1994)
            each = []
            for c in range(k):
                inverse = sum(
                    (1 / (p[i] if b == c else 1 - p[i]) for i, (a, b) in enumerate(pairs) if c in (a, b)), F.lit(0.0)
                )
                each.append(1 / (inverse - (k - 2)))
            probability = shares(F.array(*each))
        return df.withColumns({"prediction": votes, "probability": probability}).select(*keep, "prediction", "probability")


def _pair_targets(pairs, folds, n_folds):
    """+1 for the second class of the pair, -1 for the first, 0 for others and for the left-out fold."""
    first = np.array([a for a, _ in pairs for _ in folds])
    second = np.array([b for _, b in pairs for _ in folds])
    left_out = np.array([g for _ in pairs for g in folds])

    def targets(y, h):
        t = np.equal.outer(y, second).astype(float) - np.equal.outer(y, first)
        t[np.equal.outer(h % n_folds, left_out)] = 0.0
        return t

    return targets


def _sigmoids(frame: Frame, pairs, columns, w, b, n_folds):
    """Platt's sigmoid per pair, fitted to scores of rows the scorer was not trained on.

    ``w[i, g]`` scores pair i without fold g. Newton steps on two numbers per pair.
    """
    n_pairs = len(pairs)
    first, second = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def sides(y, h):
        return np.equal.outer(y, second), np.equal.outer(y, first)

    counts = sum_over_rows(
        frame, lambda x, y, h: np.concatenate([s.sum(0) for s in sides(y, h)]).astype(float), 2 * n_pairs
    )
    plus, minus = counts[:n_pairs], counts[n_pairs:]
    high, low = (plus + 1) / (plus + 2), 1 / (minus + 2)
    ab = np.column_stack([np.zeros(n_pairs), np.log((minus + 1) / (plus + 1))])
    flat = w.reshape(n_pairs * n_folds, -1).T

    def evaluate(rows, ab):
        def part(x, y, h):
            f = (columns(x) @ flat).reshape(len(y), n_pairs, n_folds)[np.arange(len(y)), :, h % n_folds] + b[:, h % n_folds].T
            is_plus, is_minus = sides(y, h)
            use = (is_plus | is_minus).astype(float)
            t = np.where(is_plus, high, low)
            z = f * ab[:, 0] + ab[:, 1]
            # P = 1 / (1 + e^z); loss = t z + log(1 + e^-z)
            value = use * (t * z + np.logaddexp(0, -z))
            p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
            d1, d2 = use * (t - p), use * p * (1 - p)
            return np.concatenate([value.sum(0), (d1 * f).sum(0), d1.sum(0),
                                   (d2 * f * f).sum(0), (d2 * f).sum(0), d2.sum(0)])

        return sum_over_rows(rows, part, 6 * n_pairs).reshape(6, n_pairs)

    def descend(rows, ab):
        now = evaluate(rows, ab)
        for _ in range(30):
            step = np.zeros_like(ab)
            for i in range(n_pairs):
                hess = np.array([[now[3, i], now[4, i]], [now[4, i], now[5, i]]]) + 1e-10 * np.eye(2)
                step[i] = -np.linalg.solve(hess, now[1:3, i])
            size, trial_now = np.ones(n_pairs), None
            for _ in range(12):
                trial = ab + size[:, None] * step
                trial_now = evaluate(rows, trial)
                worse = trial_now[0] > now[0] + 1e-12
                if not worse.any():
                    break
                size[worse] *= 0.3
            take = trial_now[0] <= now[0] + 1e-12
            moved = np.abs(trial_now[0] - now[0])[take].max(initial=0.0)
            ab[take], now[:, take] = trial[take], trial_now[:, take]
            if moved < 1e-7 * max(now[0].max(), 1.0):
                break

    with frame.start_rows() as few:
        if few is not None:
            begun = ab.copy()
            descend(few, begun)
            # a pair with few rows in the part may be worse off for it
            better = evaluate(frame, begun)[0] < evaluate(frame, ab)[0]
            ab[better] = begun[better]
    descend(frame, ab)
    return ab


def _pairwise(frame: Frame, cost_of_pair, fourier, n_folds: int = 5, probability: bool = True) -> PairwiseScores:
    """All pairs, each on all rows and, for probabilities, without each fold, in the same passes."""
    pairs = list(combinations(range(frame.n_classes), 2))
    folds = [-1, *range(n_folds)] if probability else [-1]
    cost = np.repeat(np.asarray(cost_of_pair, dtype=float), len(folds))
    w, b = minimise(frame, _pair_targets(pairs, folds, n_folds), _margin_loss(_ramp), cost, fourier)
    w, b = w.reshape(len(pairs), len(folds), -1), b.reshape(len(pairs), len(folds))
    columns = (lambda x: fourier_map(x, fourier)) if fourier else (lambda x: x)
    sigmoid = _sigmoids(frame, pairs, columns, w[:, 1:], b[:, 1:], n_folds) if probability else np.zeros(0)
    return PairwiseScores(
        {
            "classes": frame.n_classes, "pairs": pairs, "weights": w[:, 0].tolist(), "constants": b[:, 0].tolist(),
            "sigmoid": sigmoid.tolist(), "fourier": fourier, "cost": [float(c) for c in cost_of_pair],
        }
    )


def svc(frame: Frame, cost: float = 1.0, probability: bool = True) -> PairwiseScores:
    """Linear hinge machine per class pair, with Platt probabilities if asked for."""
    pairs = frame.n_classes * (frame.n_classes - 1) // 2
    return _pairwise(frame, [cost] * pairs, None, probability=probability)


COST_GRID = tuple(10.0 ** (e / 2) for e in range(-2, 7))


def nu_svc(frame: Frame, nu: float = 0.5, size: int = 100, grid=COST_GRID) -> PairwiseScores:
    """RBF machine by random features; per pair the cost of ``grid`` whose share of rows
    inside the margin is closest to ``nu``."""
    fourier = fourier_settings(frame, size)
    pairs = list(combinations(range(frame.n_classes), 2))
    targets = _pair_targets(pairs, [-1] * len(grid), 1)
    w, b = minimise(frame, targets, _margin_loss(_ramp), list(grid) * len(pairs), fourier, widths=(2.0, 0.5))

    def inside(x, y, h):
        t = targets(y, h)
        margin = t * (fourier_map(x, fourier) @ w.T + b)
        return np.concatenate([((t != 0) & (margin < 1)).sum(0), (t != 0).sum(0)]).astype(float)

    counts = sum_over_rows(frame, inside, 2 * len(b)).reshape(2, len(pairs), len(grid))
    best = np.abs(counts[0] / np.maximum(counts[1], 1) - nu).argmin(1)
    return _pairwise(frame, [grid[g] for g in best], fourier)


# -- regression -------------------------------------------------------------------------------


class FourierModel(Fitted):
    """Regression on random Fourier features."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        score = _fourier_scores(s["fourier"], s["weights"], s["constants"])
        return df.withColumn("prediction", score[0])


def _spread_of_label(frame: Frame) -> tuple[float, float]:
    row = frame.df.agg(F.avg("label"), F.stddev_pop("label")).first()
    return row[0], row[1] or 1.0


def _tube(frame: Frame, fourier: dict, cost: float, epsilon: float, start: FourierModel | None = None) -> FourierModel:
    mean, sd = _spread_of_label(frame)
    known = None
    if start is not None:
        known = np.asarray(start.state["weights"]), np.asarray(start.state["constants"]) - mean
    # the label is centred for the solver; widths are in units of the label's spread
    w, b = minimise(
        frame, lambda y, h: (y - mean)[:, None], _tube_loss(epsilon), [cost], fourier,
        widths=TUBE_WIDTHS if start is None else TUBE_WIDTHS[-2:], unit=sd, start=known,
    )
    return FourierModel(
        {"fourier": fourier, "weights": w.tolist(), "constants": [float(b[0] + mean)], "epsilon": float(epsilon)}
    )


def svr(frame: Frame, cost: float = 1.0, epsilon: float = 0.1, size: int = 200) -> FourierModel:
    """RBF regression with a tube of half width ``epsilon``."""
    return _tube(frame, fourier_settings(frame, size), cost, epsilon)


def nu_svr(frame: Frame, nu: float = 0.5, cost: float = 1.0, size: int = 200, rounds: int = 3) -> FourierModel:
    """The tube's half width is the (1 - nu) quantile of the residuals, found in a few rounds."""
    fourier = fourier_settings(frame, size)
    model = _tube(frame, fourier, cost, 0.0)
    for _ in range(rounds):
        gap = F.abs(F.col("label") - F.col("prediction")).alias("gap")
        epsilon = model.transform(frame.df).select(gap).approxQuantile("gap", [1 - nu], 0.001)[0]
        if abs(epsilon - model.state["epsilon"]) <= 0.01 * max(epsilon, 1e-12):
            break
        model = _tube(frame, fourier, cost, epsilon, start=model)
    return model


