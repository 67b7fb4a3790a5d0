"""Linear regressors from one set of sums over the rows, and the MLlib linear regressors.

``gram`` runs two small passes and gives n, the means, and the centred matrix of products;
OLS, ridge, elastic net, SGD, Bayesian ridge and ARD all start from it.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame

from .base import Fitted, Frame, dot, features_array, sum_over_rows


class LinearModel(Fitted):
    """``prediction = intercept + coefficients . features``."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        return df.withColumn("prediction", dot(features_array(), s["coefficients"], s["intercept"]))


def _linear(coefficients, mean_x, mean_y, **more) -> LinearModel:
    w = np.asarray(coefficients, dtype=float)
    return LinearModel(
        {"coefficients": w.tolist(), "intercept": float(mean_y - w @ mean_x), **more}
    )


def gram(frame: Frame) -> dict:
    """n, mean of x and y, centred X'X, X'y and y'y. Kept on the frame for the next model."""
    if hasattr(frame, "_gram"):
        return frame._gram
    frame.check_square()
    n, d = frame.rows, frame.width
    sums = sum_over_rows(frame, lambda x, y, h: np.append(x.sum(0), y.sum()), d + 1) / n
    mean_x, mean_y = sums[:d], sums[d]

    def products(x, y, h):
        a = np.column_stack([x - mean_x, y - mean_y])
        return (a.T @ a).ravel()

    m = sum_over_rows(frame, products, (d + 1) ** 2).reshape(d + 1, d + 1)
    frame._gram = {"n": n, "mean_x": mean_x, "mean_y": mean_y, "xx": m[:d, :d], "xy": m[:d, d], "yy": m[d, d]}
    return frame._gram


def ols(frame: Frame) -> LinearModel:
    g = gram(frame)
    scale = np.sqrt(np.diag(g["xx"]))
    scale[scale == 0] = 1.0
    w = np.linalg.lstsq(g["xx"] / np.outer(scale, scale), g["xy"] / scale, rcond=1e-12)[0] / scale
    return _linear(w, g["mean_x"], g["mean_y"])


def ridge(frame: Frame, alpha: float = 1.0) -> LinearModel:
    g = gram(frame)
    w = np.linalg.solve(g["xx"] + alpha * np.eye(len(g["xy"])), g["xy"])
    return _linear(w, g["mean_x"], g["mean_y"])


def sgd_regressor(frame: Frame, alpha: float = 1e-4) -> LinearModel:
    """Minimum of mean(0.5 (y - f)^2) + 0.5 alpha |w|^2.

    That is the point stochastic descent moves towards; squared loss has it in closed form.
    """
    return ridge(frame, alpha * frame.rows)


def elastic_net(frame: Frame, alpha: float = 1.0, l1_ratio: float = 0.5, rounds: int = 10_000) -> LinearModel:
    """Coordinate descent on the matrix of products: d numbers per step, no pass over the rows."""
    g = gram(frame)
    xx, xy = g["xx"] / g["n"], g["xy"] / g["n"]
    w = np.zeros(len(xy))
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(w)):
            if xx[j, j] == 0:
                continue
            rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0) / (xx[j, j] + alpha * (1 - l1_ratio))
            largest = max(largest, abs(new - w[j]) * np.sqrt(xx[j, j]))
            w[j] = new
        if largest <= 1e-12 * max(np.sqrt(g["yy"] / g["n"]), 1e-300):
            break
    return _linear(w, g["mean_x"], g["mean_y"])


def lasso(frame: Frame, alpha: float = 1.0) -> LinearModel:
    return elastic_net(frame, alpha, 1.0)


def bayesian_ridge(frame: Frame, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> LinearModel:
    """Evidence maximisation for one weight precision and one noise precision (MacKay 1992)."""
    g = gram(frame)
    n, mean_x, mean_y = g["n"], g["mean_x"], g["mean_y"]
    values, vectors = np.linalg.eigh(g["xx"])
    values = np.maximum(values, 0.0)
    projected = vectors.T @ g["xy"]
    variance = g["yy"] / n
    noise, weight = 1.0 / (variance + np.finfo(float).eps), 1.0
    w = np.zeros(len(projected))
    for r in range(rounds):
        old = w
        w = vectors @ (projected / (values + weight / noise))
        residual = max(g["yy"] - 2 * w @ g["xy"] + w @ g["xx"] @ w, 0.0)
        gamma = np.sum(noise * values / (weight + noise * values))
        weight = (gamma + 2 * prior) / (w @ w + 2 * prior)
        noise = (n - gamma + 2 * prior) / (residual + 2 * prior)
        if r and np.abs(w - old).sum() < tol:
            break
    w = vectors @ (projected / (values + weight / noise))
    return _linear(w, mean_x, mean_y, noise=float(noise), weight=float(weight))


def ard(frame: Frame, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6, drop_above: float = 1e4) -> LinearModel:
    """One precision per weight; weights whose precision passes ``drop_above`` are set to 0.

    Sparse Bayesian learning (Tipping 2001) on the matrix of products.
    """
    g = gram(frame)
    n, xx, xy, yy = g["n"], g["xx"], g["xy"], g["yy"]
    d = len(xy)
    precision, kept, w = np.ones(d), np.ones(d, bool), np.zeros(d)
    noise = 1.0 / (yy / n + np.finfo(float).eps)
    for r in range(rounds):
        old = w.copy()
        covariance = np.linalg.pinv(np.diag(precision[kept]) + noise * xx[np.ix_(kept, kept)], hermitian=True)
        w = np.zeros(d)
        w[kept] = noise * covariance @ xy[kept]
        residual = max(yy - 2 * w @ xy + w @ xx @ w, 0.0)
        gamma = 1.0 - precision[kept] * np.diag(covariance)
        precision[kept] = (gamma + 2 * prior) / (w[kept] ** 2 + 2 * prior)
        noise = (n - gamma.sum() + 2 * prior) / (residual + 2 * prior)
        kept = precision < drop_above
        w[~kept] = 0.0
        if (r and np.abs(w - old).sum() < tol) or not kept.any():
            break
    if kept.any():
        covariance = np.linalg.pinv(np.diag(precision[kept]) + noise * xx[np.ix_(kept, kept)], hermitian=True)
        w[kept] = noise * covariance @ xy[kept]
    return _linear(w, g["mean_x"], g["mean_y"], noise=float(noise))


def huber(frame: Frame, epsilon: float = 1.35, alpha: float = 1e-4) -> LinearModel:
    """Huber loss with a learned scale, by MLlib.

    The features are centred and scaled first and the weights brought back after: the
    optimiser meets a well-conditioned problem and the small penalty acts on scaled weights.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    mean, sd = frame.moments
    x = features_array()
    scaled = frame.df.select(
        array_to_vector(F.array(*[(x[j] - float(mean[j])) / float(sd[j]) for j in range(frame.width)])).alias("features"),
        "label",
    )
    fitted = LinearRegression(
        loss="huber", epsilon=epsilon, regParam=alpha / frame.rows, elasticNetParam=0.0,
        standardization=False, maxIter=100, tol=1e-8,
    ).fit(scaled)
    w = fitted.coefficients.toArray() / sd
    return LinearModel(
        {"coefficients": w.tolist(), "intercept": float(fitted.intercept - w @ mean), "scale": float(fitted.scale)}
    )
