"""Hard vote over fitted members: most votes win, ties go to the smallest class."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Fitted, Frame, first_max
from .forests import random_forest_classifier
from .margins import svc
from .neighbors import knn_classifier


def majority(votes: list[Column], classes: int) -> Column:
    said = F.array(*votes)

    def count(c: int) -> Column:
        return F.size(F.filter(said, lambda v: v == c))

    return first_max([count(c) for c in range(classes)])


class Voting(Fitted):
    """Members add their prediction to the same row, so the vote itself needs no join."""

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        votes = []
        for name, member in self.parts.items():
            df = member.transform(df).withColumnRenamed("prediction", f"_{name}").drop("probability")
            votes.append(F.col(f"_{name}"))
        return df.select(*keep, majority(votes, self.state["classes"]).alias("prediction"))


def voting_classifier(frame: Frame, trees: int = 100, members: dict[str, Fitted] | None = None) -> Voting:
    """Random forest, linear hinge machine and nearest neighbours.

    ``members`` may bring models already fitted on the same frame; the others are fitted side by side.
    """
    have = members or {}
    wanted = {
        "rf": partial(random_forest_classifier, frame, trees), "svc": partial(svc, frame, probability=False), "knn": partial(knn_classifier, frame),
    }
    frame.rows, frame.parts  # counted once, before the threads start
    inherit = inheritable_thread_target(frame.df.sparkSession)
    with ThreadPoolExecutor(len(wanted)) as pool:
        jobs = {name: pool.submit(inherit(fit)) for name, fit in wanted.items() if name not in have}
        fitted = {name: have[name] if name in have else jobs[name].result() for name in wanted}
    return Voting({"classes": frame.n_classes}, fitted)
