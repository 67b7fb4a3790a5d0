"""Boosted stumps: one pass over the rows per round.

A pass gathers class weights per feature and interval; the best cut, its error and the new
row weights all follow from that, and the weights are computed again in the tasks from the
stumps found so far. Nothing is carried between rounds but the list of stumps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Fitted, Frame, features_array, first_max, shares, sum_over_rows

CUTS = 64  # quantile cuts and as many evenly spaced ones, per feature


class BoostedStumps(Fitted):
    """Stumps vote with their weight; the class with the most weight wins."""

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        s, k = self.state["stumps"], self.state["classes"]
        df = df.withColumn("_x", features_array())
        votes = F.array(*[
            F.struct(
                F.when(F.col("_x")[m["feature"]] <= m["cut"], F.lit(float(m["below"])))
                .otherwise(F.lit(float(m["above"]))).alias("c"),
                F.lit(float(m["weight"])).alias("w"),
            )
            for m in s
        ])
        df = df.withColumn("_votes", votes)

        def total(c: int):
            return F.aggregate(
                "_votes", F.lit(0.0), lambda a, v: a + F.when(v["c"] == F.lit(float(c)), v["w"]).otherwise(F.lit(0.0))
            )

        df = df.withColumn("_each", F.array(*[total(c) for c in range(k)]))
        scores = [F.col("_each")[c] for c in range(k)]
        # class probabilities: softmax of the vote shares, spread over k - 1
        scale = float(sum(m["weight"] for m in s)) * max(k - 1, 1)
        raised = F.transform(F.col("_each"), lambda v: F.exp(v / F.lit(scale)))
        return df.select(*keep, first_max(scores).alias("prediction"), shares(raised).alias("probability"))


def _cuts(frame: Frame) -> list[np.ndarray]:
    x = features_array()
    d = frame.width
    columns = frame.df.select(*[x[j].alias(f"c{j}") for j in range(d)])
    probabilities = [i / CUTS for i in range(CUTS + 1)]
    found = columns.approxQuantile([f"c{j}" for j in range(d)], probabilities, 0.25 / CUTS)
    out = []
    for values in found:
        even = np.linspace(values[0], values[-1], CUTS + 2)[1:-1]
        inner = np.unique(np.concatenate([values, even]))
        out.append(inner[:-1] if len(inner) > 1 else inner)
    return out


def _gini_gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over both sides of (sum of squared class weights) / weight: larger is purer."""
    def side(v):
        total = v.sum(1)
        return np.divide((v * v).sum(1), total, out=np.zeros(len(v)), where=total > 0)

    return side(left) + side(right)


def ada_boost_classifier(frame: Frame, rounds: int = 50) -> BoostedStumps:
    """SAMME (Zhu et al. 2009) on stumps chosen by Gini impurity."""
    k, cuts = frame.n_classes, _cuts(frame)
    widths = [len(c) + 1 for c in cuts]
    size = sum(widths) * k
    stumps: list[dict] = []
    shift = 0.0  # keeps the mean row weight at 1
    for _ in range(rounds):
        known, here = list(stumps), shift

        def part(x, y, h, known=known, here=here):
            log_weight = np.full(len(y), -here)
            for m in known:
                said = np.where(x[:, m["feature"]] <= m["cut"], m["below"], m["above"])
                log_weight += m["weight"] * (said != y)
            weight, label = np.exp(log_weight), y.astype(int)
            return np.concatenate([
                np.bincount(np.searchsorted(c, x[:, j]) * k + label, weights=weight, minlength=widths[j] * k)
                for j, c in enumerate(cuts)
            ])

        sums, at, best = sum_over_rows(frame, part, size), 0, None
        for j, c in enumerate(cuts):
            table = sums[at : at + widths[j] * k].reshape(widths[j], k)
            at += widths[j] * k
            left = table.cumsum(0)[:-1]
            right = table.sum(0) - left
            gain = _gini_gain(left, right)
            i = int(gain.argmax())
            if best is None or gain[i] > best[0]:
                best = (gain[i], j, float(c[i]), left[i], right[i])
        _, j, cut, left, right = best
        total = left.sum() + right.sum()
        overall = int((left + right).argmax())
        below = int(left.argmax()) if left.sum() > 0 else overall
        above = int(right.argmax()) if right.sum() > 0 else overall
        error = max(1 - (left[below] + right[above]) / total, 0.0)
        stump = {"feature": j, "cut": cut, "below": below, "above": above, "weight": 1.0}
        if error <= 1e-12:  # a perfect stump needs no others
            stumps.append(stump)
            break
        if error >= 1 - 1 / k - 1e-12:
            if not stumps:
                stumps.append(stump)
            break
        stump["weight"] = float(np.log((1 - error) / error) + np.log(k - 1))
        stumps.append(stump)
        shift += float(np.log((total / frame.rows) * (1 + error * (np.exp(stump["weight"]) - 1))))
    return BoostedStumps({"stumps": stumps, "classes": k})
