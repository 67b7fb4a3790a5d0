"""Models that learn row by row or batch by batch: passive-aggressive and a small network.

Both learn on shards of rows fixed by the rows' keys. The parameters are averaged after each round, so the result is
an approximation of one sequential pass order, but the same however rows lie. Features are centred and scaled inside; scores come back in terms of the raw features.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ...session import cut_lineage
from .base import Fitted, Frame, _gather, features_array, rows_of
from .gaussian import LinearScores
from .linear import LinearModel

SHARD_ROWS = 512        # about so many rows are learned from one after another
SHARDS_AT_ONCE = 64     # shards whose rows are learned from side by side
NETWORK_ROWS = 4_096    # about so many rows a network learns from between two averages


def _shard_groups(batches, at_once: int):
    """``(x, y, first)`` of up to ``at_once`` whole shards: their rows after each other, and where each begins."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        x, y, _ = rows_of(batch)
        shard = batch.column("shard").to_numpy()
        return x, y, np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        shards = [h.column("shard").to_numpy() for h in held]
        if sum(1 + np.count_nonzero(s[1:] != s[:-1]) for s in shards) > 2 * at_once:
            table = pa.Table.from_batches(held)
            shard = np.concatenate(shards)
            begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            whole = [*begins[::at_once], begins[-1]] if (len(begins) - 1) % at_once else begins[::at_once]
            for start, end in zip(whole, whole[1:]):
                if end > start:
                    yield out(table.slice(start, end - start))
            held = table.slice(int(begins[-1])).to_batches()    # the last shard may go on
    if held:
        table = pa.Table.from_batches(held)
        shard = table.column("shard").to_numpy()
        begins = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        for i in range(0, len(begins) - 1, at_once):
            end = begins[min(i + at_once, len(begins) - 1)]
            yield out(table.slice(int(begins[i]), int(end - begins[i])))


def sharded_rounds(frame: Frame, start: np.ndarray, step, rounds: int, settle: float = 1e-4) -> np.ndarray:
    """Rounds in which every shard of rows improves its copy of the parameters row by row, and the copies are
    averaged by row count (parameter mixing).

    A row's shard and its place in it come from a hash of its key, so the result does not depend on how rows lie.
    ``step(params, x, y)`` learns one row of each of many shards at once: arrays (shard, ..), changed in place.
    """
    shards = max(1, -(-frame.rows // SHARD_ROWS))
    rows = frame.arrays.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    rows = cut_lineage(rows.repartition("shard").sortWithinPartitions("shard", "h", "y"))
    layout = SimpleNamespace(parts=rows.rdd.getNumPartitions())
    params = start
    for _ in range(rounds):

        def each(batches, here=params):
            total = np.zeros(here.size + 1)
            for x, y, first in _shard_groups(batches, SHARDS_AT_ONCE):
                sizes = np.diff(np.append(first, len(y)))
                order = np.argsort(-sizes, kind="stable")   # the longest first, so that those still open stand together
                first, sizes = first[order], sizes[order]
                copies = np.repeat(here[None], len(first), axis=0)
                for place in range(sizes[0]):
                    open_ = int(np.searchsorted(-sizes, -place, side="left"))
                    at = first[:open_] + place
                    step(copies[:open_], x[at], y[at])
                total[:-1] += np.tensordot(sizes.astype(float), copies, 1).ravel()
                total[-1] += sizes.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

        total = _gather(layout, rows.mapInArrow(each, "v array<double>"), start.size + 1)
        new = (total[:-1] / total[-1]).reshape(start.shape)
        moved = np.linalg.norm(new - params) / max(np.linalg.norm(params), 1e-12)
        params = new
        if moved < settle:
            break
    return params


def passive_aggressive_classifier(frame: Frame, cost: float = 1.0, rounds: int = 10) -> LinearScores:
    """PA-I (Crammer et al. 2006), one class against the rest."""
    mean, sd = frame.moments
    k = 1 if frame.n_classes == 2 else frame.n_classes

    def step(w, x, y):
        z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
        side = np.where(y == 1, 1.0, -1.0)[:, None] if k == 1 else np.where(np.equal.outer(y, np.arange(k)), 1.0, -1.0)
        loss = np.maximum(1 - side * np.einsum("skp,sp->sk", w, z), 0)
        tau = np.minimum(cost, loss / np.einsum("sp,sp->s", z, z)[:, None])
        w += (tau * side)[:, :, None] * z[:, None, :]

    w = sharded_rounds(frame, np.zeros((k, frame.width + 1)), step, rounds)
    raw = w[:, :-1] / sd
    return LinearScores({"weights": raw.tolist(), "constants": (w[:, -1] - raw @ mean).tolist()})


def passive_aggressive_regressor(frame: Frame, cost: float = 1.0, epsilon: float = 0.1, rounds: int = 10) -> LinearModel:
    """PA-I with a tube of half width ``epsilon``; the constant starts at the mean label."""
    mean, sd = frame.moments
    start = np.zeros(frame.width + 1)
    start[-1] = frame.df.agg(F.avg("label")).first()[0]

    def step(w, x, y):
        z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
        gap = y - np.einsum("sp,sp->s", w, z)
        over = np.maximum(np.abs(gap) - epsilon, 0)
        w += (np.sign(gap) * np.minimum(cost, over / np.einsum("sp,sp->s", z, z)))[:, None] * z

    w = sharded_rounds(frame, start, step, rounds)
    raw = w[:-1] / sd
    return LinearModel({"coefficients": raw.tolist(), "intercept": float(w[-1] - raw @ mean)})


class Network:
    """One hidden rectifier layer in one flat array, with the gradients of its two losses."""

    def __init__(self, width: int, hidden: int, outputs: int, classes: bool, alpha: float):
        self.shapes = [(width, hidden), (hidden,), (hidden, outputs), (outputs,)]
        self.ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        self.classes, self.alpha = classes, alpha

    def unpack(self, v: np.ndarray) -> list[np.ndarray]:
        return [part.reshape(s) for part, s in zip(np.split(v, self.ends[:-1]), self.shapes)]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        w1, b1, w2, b2 = [rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s)) if len(s) == 2 else np.zeros(s) for s in self.shapes]
        return np.concatenate([w1.ravel(), b1, w2.ravel(), b2])

    def gradient(self, v: np.ndarray, z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of half the mean squared gap, or of the mean cross-entropy, with a penalty on the weights."""
        w1, b1, w2, b2 = self.unpack(v)
        before = z @ w1 + b1
        shown = np.maximum(before, 0)
        said = shown @ w2 + b2
        if self.classes:
            said = np.exp(said - said.max(1, keepdims=True))
            said /= said.sum(1, keepdims=True)
        gap = (said - wanted) / len(z)
        back = (gap @ w2.T) * (before > 0)
        decay = self.alpha / len(z)
        return np.concatenate([(z.T @ back + decay * w1).ravel(), back.sum(0), (shown.T @ gap + decay * w2).ravel(), gap.sum(0)])


def network_rounds(
    frame: Frame, net: Network, wanted, rate: float, batch: int, epochs: int, rounds: int,
) -> np.ndarray:
    """Rounds in which every shard of rows goes ``epochs`` times over its mini-batches by Adam, and the parameters
    and Adam's two moments are averaged by row count.

    Shards, and the order of rows and batches in them, come from hashes of the rows' keys, so the result does not
    depend on how rows lie. A shard has about NETWORK_ROWS rows at every size of the table. The rate falls
    linearly to nothing over the rounds. ``wanted(y)`` is what the outputs should be.
    """
    mean, sd = frame.moments
    shards = max(1, -(-frame.rows // NETWORK_ROWS))
    rows = frame.arrays.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    tasks = min(shards, max(frame.parts, frame.df.sparkSession.sparkContext.defaultParallelism))
    rows = cut_lineage(rows.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "y"))
    layout = SimpleNamespace(parts=rows.rdd.getNumPartitions())
    start, seed = net.start(frame.seed), frame.seed
    state = np.stack([start, np.zeros_like(start), np.zeros_like(start)])   # parameters, and Adam's moments
    for number in range(rounds):

        def each(batches, here=state, number=number):
            total = np.zeros(here.size + 1)
            for x, y, _ in _shard_groups(batches, 1):
                v, first, second = here.copy()
                z, t, n = (x - mean) / sd, wanted(y), len(y)
                order, begins = np.random.default_rng([seed, number]), range(0, n, batch)
                for epoch in range(epochs):
                    pick = order.permutation(n)
                    now = rate * (1 - (number * epochs + epoch) / (rounds * epochs))
                    for place, at in enumerate(begins):
                        step = (number * epochs + epoch) * len(begins) + place + 1
                        g = net.gradient(v, z[pick[at:at + batch]], t[pick[at:at + batch]])
                        first = 0.9 * first + 0.1 * g
                        second = 0.999 * second + 0.001 * g * g
                        v = v - now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                total[:-1] += n * np.concatenate([v, first, second])
                total[-1] += n
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

        total = _gather(layout, rows.mapInArrow(each, "v array<double>"), state.size + 1)
        state = (total[:-1] / total[-1]).reshape(state.shape)
    return state[0]


def _outputs(s: dict[str, np.ndarray], x: pd.Series) -> np.ndarray:
    z = (np.stack(x.to_numpy()) - s["mean"]) / s["sd"]
    return np.maximum(z @ s["w1"] + s["b1"], 0) @ s["w2"] + s["b2"]


class NetworkModel(Fitted):
    """One hidden rectifier layer and one output."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = {n: np.asarray(v) for n, v in self.state.items()}

        @pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(_outputs(s, x).ravel() * s["scale"] + s["centre"])

        return df.withColumn("prediction", score(features_array()))


class NetworkClasses(Fitted):
    """One hidden rectifier layer and an output for each class, brought to probabilities by softmax."""

    def transform(self, df: DataFrame) -> DataFrame:
        s = {n: np.asarray(v) for n, v in self.state.items()}

        @pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            said = _outputs(s, x)
            said = np.exp(said - said.max(1, keepdims=True))
            return pd.Series(list(said / said.sum(1, keepdims=True)))

        scored = df.withColumn("probability", score(features_array()))
        most = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", most.cast("double"))


def _layers(frame: Frame, net: Network, v: np.ndarray) -> dict:
    mean, sd = frame.moments
    return {"mean": mean.tolist(), "sd": sd.tolist()} | {n: p.tolist() for n, p in zip(("w1", "b1", "w2", "b2"), net.unpack(v))}


def network_regressor(
    frame: Frame, hidden: int = 100, alpha: float = 1e-4, rate: float = 5e-3, batch: int = 50, epochs: int = 5, rounds: int = 30,
) -> NetworkModel:
    """Rectifier network with squared loss on the scaled label; ``epochs`` x ``rounds`` times over all rows."""
    row = frame.df.agg(F.avg("label"), F.stddev_pop("label")).first()
    centre, scale = float(row[0]), float(row[1] or 1.0)
    net = Network(frame.width, hidden, 1, False, alpha)
    v = network_rounds(frame, net, lambda y: ((y - centre) / scale)[:, None], rate, batch, epochs, rounds)
    return NetworkModel(_layers(frame, net, v) | {"centre": centre, "scale": scale})


def network_classifier(
    frame: Frame, hidden: int = 100, alpha: float = 1e-4, rate: float = 5e-3, batch: int = 50, epochs: int = 5, rounds: int = 20,
) -> NetworkClasses:
    """Rectifier network with one output a class and cross-entropy; ``epochs`` x ``rounds`` times over all rows."""
    k = max(frame.n_classes, 2)
    net = Network(frame.width, hidden, k, True, alpha)
    v = network_rounds(frame, net, lambda y: np.equal.outer(y, np.arange(k)).astype(float), rate, batch, epochs, rounds)
    return NetworkClasses(_layers(frame, net, v))
