"""Models built on class means and covariances, from two passes of sums per class."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ...errors import UnsuitableTarget
from .base import MAX_SUMS, Fitted, Frame, dot, features_array, first_max, softmax, sum_over_rows

WIDE = 32  # quadratic scores of more features go through matrix products
VARIANCE_FLOOR = 1e-9  # share of the largest feature variance added to every variance


def class_means(frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Rows and mean per class."""
    k, d = frame.n_classes, frame.width

    def part(x, y, h):
        hot = np.equal.outer(np.arange(k), y).astype(float)
        return np.concatenate([hot.sum(1), (hot @ x).ravel()])

    sums = sum_over_rows(frame, part, k + k * d)
    count = sums[:k]
    if (count == 0).any():
        raise UnsuitableTarget("a class has no training rows")
    return count, sums[k:].reshape(k, d) / count[:, None]


def class_squares(frame: Frame, mean: np.ndarray) -> np.ndarray:
    """Sums of squares about the class mean (k x d)."""
    k, d = mean.shape

    def part(x, y, h):
        hot = np.equal.outer(np.arange(k), y).astype(float)
        return (hot @ (x - mean[y.astype(int)]) ** 2).ravel()

    return sum_over_rows(frame, part, k * d).reshape(k, d)


def class_products(frame: Frame, mean: np.ndarray, pooled: bool) -> np.ndarray:
    """Products about the class mean: d x d over all classes, or one d x d per class.

    Classes go some at a time where the matrices of all of them would not fit one array.
    """
    frame.check_square()
    k, d = mean.shape

    def within(x, y, classes):
        out = []
        for c in classes:
            a = x[y == c] - mean[c]
            out.append(a.T @ a)
        return out

    if pooled:
        return sum_over_rows(frame, lambda x, y, h: sum(within(x, y, range(k))).ravel(), d * d).reshape(d, d)
    at_once = max(1, MAX_SUMS // (d * d))
    pieces = []
    for at in range(0, k, at_once):
        classes = range(at, min(k, at + at_once))
        sums = sum_over_rows(
            frame, lambda x, y, h, classes=classes: np.concatenate(within(x, y, classes)).ravel(), len(classes) * d * d
        )
        pieces.append(sums.reshape(len(classes), d, d))
    return np.concatenate(pieces)


class LinearScores(Fitted):
    """One linear score per class; softmax of the scores where ``proba`` is set."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        df = df.withColumn("_x", features_array())
        scores = [dot(F.col("_x"), w, b) for w, b in zip(s["weights"], s["constants"])]
        if len(scores) == 1:  # one score, positive for class 1
            df = df.withColumn("prediction", (scores[0] > 0).cast("double"))
        else:
            df = df.withColumn("prediction", first_max(scores))
        if s.get("proba"):
            df = df.withColumn("probability", softmax(scores))
        return df.drop("_x")


def lda(frame: Frame) -> LinearScores:
    """Pooled covariance, class shares as priors."""
    count, mean = class_means(frame)
    n, k = count.sum(), frame.n_classes
    pooled = class_products(frame, mean, pooled=True) / max(n - k, 1)
    sd = np.sqrt(np.diag(pooled))
    sd[sd == 0] = 1.0
    inverse = np.linalg.pinv(pooled / np.outer(sd, sd), rcond=1e-10, hermitian=True) / np.outer(sd, sd)
    centre = (count / n) @ mean  # scores relative to the overall mean: better conditioned
    w = (mean - centre) @ inverse
    b = -0.5 * np.sum(w * (mean - centre), axis=1) + np.log(count / n) - w @ centre
    return LinearScores({"weights": w.tolist(), "constants": b.tolist(), "proba": True})


class QuadraticScores(Fitted):
    """Gaussian log density per class plus log prior; ``root`` whitens the class."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        k, names = len(s["mean"]), [f"_s{c}" for c in range(len(s["mean"]))]
        if len(s["mean"][0]) > WIDE:
            df = df.withColumn("_s", self._matrix_scores()).withColumns({n: F.col("_s")[c] for c, n in enumerate(names)})
            df = df.drop("_s")
        else:
            df = df.withColumn("_x", features_array())
            df = df.withColumns({
                f"_d{c}": F.array(*[F.col("_x")[j] - F.lit(m) for j, m in enumerate(s["mean"][c])]) for c in range(k)
            })
            scores = {}
            for c, n in enumerate(names):
                z = [dot(F.col(f"_d{c}"), row) for row in s["root"][c]]
                scores[n] = F.lit(s["constant"][c]) - 0.5 * sum((v * v for v in z), F.lit(0.0))
            df = df.withColumns(scores).drop("_x", *[f"_d{c}" for c in range(k)])
        cols = [F.col(n) for n in names]
        return df.withColumns({"prediction": first_max(cols), "probability": softmax(cols)}).drop(*names)

    def _matrix_scores(self):
        """Matrix products in Arrow batches, for features too many to be written out as expressions."""
        means = [np.asarray(m) for m in self.state["mean"]]
        roots = [np.asarray(r) for r in self.state["root"]]
        constants = self.state["constant"]

        @pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy())
            each = [c - 0.5 * (((rows - m) @ r.T) ** 2).sum(1) for m, r, c in zip(means, roots, constants)]
            return pd.Series(list(np.column_stack(each)))

        return scores(features_array())


def qda(frame: Frame) -> QuadraticScores:
    """One covariance per class, class shares as priors."""
    count, mean = class_means(frame)
    if (count < 2).any():
        raise UnsuitableTarget("a class has a single row: no covariance")
    scatter = class_products(frame, mean, pooled=False)
    state = {"mean": mean.tolist(), "root": [], "constant": []}
    for c in range(frame.n_classes):
        values, vectors = np.linalg.eigh(scatter[c] / (count[c] - 1))
        keep = values > max(values.max(), 0) * 1e-14
        state["root"].append((vectors[:, keep] / np.sqrt(values[keep])).T.tolist())
        state["constant"].append(float(np.log(count[c] / count.sum()) - 0.5 * np.log(values[keep]).sum()))
    return QuadraticScores(state)


class NaiveGaussian(Fitted):
    """Independent normal densities per feature and class."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        df = df.withColumn("_x", features_array())
        scores = []
        for prior, mean, var in zip(s["log_prior"], s["mean"], s["variance"]):
            # -0.5 sum((x - m)^2 / v): per class one fold over the array
            parts = F.transform(
                F.arrays_zip(
                    F.col("_x").alias("x"),
                    F.array(*[F.lit(m) for m in mean]).alias("m"),
                    F.array(*[F.lit(v) for v in var]).alias("v"),
                ),
                lambda p: (p["x"] - p["m"]) * (p["x"] - p["m"]) / p["v"],
            )
            constant = prior - 0.5 * float(np.sum(np.log(2 * np.pi * np.asarray(var))))
            scores.append(F.lit(constant) - 0.5 * F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))
        names = [f"_s{i}" for i in range(len(scores))]
        df = df.withColumns(dict(zip(names, scores)))
        cols = [F.col(n) for n in names]
        return df.withColumns({"prediction": first_max(cols), "probability": softmax(cols)}).drop("_x", *names)


def gaussian_nb(frame: Frame) -> NaiveGaussian:
    """Variances plus a 1e-9 share of the largest overall variance; class shares as priors."""
    count, mean = class_means(frame)
    squares = class_squares(frame, mean)
    floor = VARIANCE_FLOOR * float(frame.variance.max())
    variance = squares / count[:, None] + floor
    return NaiveGaussian(
        {
            "log_prior": np.log(count / count.sum()).tolist(),
            "mean": mean.tolist(),
            "variance": np.maximum(variance, 1e-300).tolist(),
        }
    )
