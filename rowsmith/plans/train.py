"""Train the models of a task, rank them, name the best, and fit it again on all rows."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelNotFound, UnsuitableTarget
from ..functions.split import fold_number, is_holdout
from ..operators import evaluate
from ..operators.models.base import Fitted, Frame, spread
from ..operators.models.voting import voting_classifier
from ..operators.profile import CLASSIFICATION
from ..session import cut_lineage, scratch_path
from .prepare import Preparation, Settings, fit_preparation
from .zoo import models_for

BOARD = {
    CLASSIFICATION: (
        "accuracy double, n bigint, classes array<double>, confusion_matrix array<array<bigint>>, "
        "classification_report array<struct<entry string, precision double, recall double, f1 double, support bigint>>"
    ),
    "Regression": "rmse double, mae double, r2 double, n bigint",
}


def metric_of(task: str) -> tuple[str, bool]:
    """Ranking metric and whether more is better."""
    return ("accuracy", True) if task == CLASSIFICATION else ("rmse", False)


@dataclass
class Run:
    settings: Settings
    run_id: str
    preparation: Preparation
    prepared: DataFrame                    # key, features, label, held_out
    source: DataFrame | None = None        # the rows as given
    models: dict[str, Fitted] = field(default_factory=dict)
    board: DataFrame | None = None

    @property
    def task(self) -> str:
        return self.settings.task

    def leaderboard(self) -> DataFrame:
        return evaluate.rank_models(self.board, *metric_of(self.task))

    def best(self) -> DataFrame:
        """One row: model_name, best metric, model_filename, headers. The name is NULL if no model worked."""
        row = evaluate.best_model(self.board, *metric_of(self.task))
        return row.withColumns(
            {
                "model_filename": F.concat_ws("_", "model_name", F.lit(self.run_id)),
                "headers": F.array(*[F.lit(f) for f in self.preparation.features]),
            }
        ).withColumn("model_filename", F.when(F.col("model_name").isNotNull(), F.col("model_filename")))

    def learning_rows(self) -> DataFrame:
        rows = self.prepared
        return rows.where(~F.col("held_out")) if self.settings.evaluate_on == "holdout" else rows

    def judged_rows(self) -> DataFrame:
        rows = self.prepared
        return rows.where("held_out") if self.settings.evaluate_on == "holdout" else rows

    def close(self) -> None:
        self.prepared.unpersist()


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")


def frame_of(df: DataFrame, prep: Preparation) -> Frame:
    return Frame(df, prep.settings.key, len(prep.classes), prep.settings.seed, prep.settings.widest_square)


def prepare_run(df: DataFrame, settings: Settings, run_id: str | None = None, keep: str = "memory") -> Run:
    """Fit the preparation and keep the prepared rows for all models.

    ``keep="memory"`` persists them (spilling to disk); ``keep="table"`` writes them to the
    shared folder, so that a lost executor costs no second preparation of a large table.
    """
    spark = df.sparkSession
    prep = fit_preparation(df, settings)
    prepared = prep.apply(df, with_label=True).withColumn(
        "held_out", is_holdout(F.col(settings.key), settings.holdout, settings.seed)
    )
    if keep == "table":
        path = scratch_path(spark, "prepared")
        prepared.write.parquet(path)
        prepared = spark.read.parquet(path)
    else:
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    rows = prepared.count()
    if not rows:
        raise UnsuitableTarget("no rows with a target")
    spread_out = spread(prepared, rows)
    if spread_out is not prepared:
        spread_out = spread_out.persist(StorageLevel.MEMORY_AND_DISK)
        spread_out.count()
        prepared.unpersist()
    return Run(settings, run_id or new_run_id(), prep, spread_out, df)


def _judge(predicted: DataFrame, task: str) -> list[tuple]:
    """At most one row per (label, prediction) pair of classes, or one row of regression sums."""
    if task == CLASSIFICATION:
        return [tuple(r) for r in evaluate.confusion_counts(predicted).collect()]
    return [tuple(evaluate.regression_scores(predicted).select("rmse", "mae", "r2", "n").first())]


def _scores(spark: SparkSession, task: str, judged: dict[str, list[tuple]]) -> DataFrame:
    """(model, metrics..) from the few rows per model that ``_judge`` returned."""
    if task != CLASSIFICATION:
        return spark.createDataFrame([(m, *r) for m, rows in judged.items() for r in rows],
                                     f"model string, {BOARD['Regression']}")
    counts = spark.createDataFrame(
        [(m, *r) for m, rows in judged.items() for r in rows], "model string, label double, prediction double, n bigint"
    )
    accuracy = counts.groupBy("model").agg(
        (F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"),
    )
    matrix = evaluate.confusion_matrix(counts, ["model"]).withColumnRenamed("matrix", "confusion_matrix")
    report = evaluate.classification_report(counts, ["model"]).groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("entry", "precision", "recall", "f1", "support"))).alias("classification_report")
    )
    return accuracy.join(matrix, "model").join(report, "model")


def _voters(run: Run, options: dict[str, dict], given: dict) -> dict[str, Fitted]:
    """Models of this run that are what a vote's members would be."""
    same = {"rf": ("Random Forest Classifier", {"trees": given.get("trees", 100)}),
            "svc": ("Support Vector Classifier", {}), "knn": ("K-Nearest Neighbors", {})}
    usable = {}
    for member, (name, settings) in same.items():
        own = dict(options.get(name, {}))
        if member == "rf":
            own.setdefault("trees", 100)
        if name in run.models and own == settings:
            usable[member] = run.models[name]
    return usable


def fit_models(
    run: Run,
    names: list[str] | None = None,
    options: dict[str, dict] | None = None,
    at_once: int = 4,
    fail_fast: bool = False,
) -> Run:
    """Fit and judge each named model (all by default); a failing model is a row with its error.

    Names that stand for the same algorithm and options share one fit. A few models are
    fitted at a time so that one model's short driver phases do not leave the cluster idle;
    results keep the fixed order.
    """
    known = models_for(run.task)
    names = list(known) if names is None else names
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ModelNotFound(f"unknown models: {unknown}")
    options = options or {}
    frame = frame_of(run.learning_rows(), run.preparation)
    frame.rows, frame.parts  # counted once, before the threads start
    judged_rows = run.judged_rows()
    groups: dict[tuple, list[str]] = {}
    for n in names:
        groups.setdefault((known[n], tuple(sorted(options.get(n, {}).items()))), []).append(n)
    judged, errors, lock = {}, {}, threading.Lock()

    def work(key, members):
        factory, settings = key
        try:
            given = dict(settings)
            if factory is voting_classifier:
                given["members"] = _voters(run, options, given)
            model = factory(frame, **given)
            rows = _judge(model.transform(judged_rows), run.task)
        except Exception as error:  # one model's failure must not end the run
            if fail_fast:
                raise
            with lock:
                errors.update({m: f"{type(error).__name__}: {error}" for m in members})
            return
        with lock:
            for m in members:
                run.models[m] = model
                judged[m] = rows

    spark = run.prepared.sparkSession
    inherit = inheritable_thread_target(spark)
    # the vote comes last: its members are likely fitted by then
    for late in (False, True):
        turn = {k: v for k, v in groups.items() if (k[0] is voting_classifier) == late}
        with ThreadPoolExecutor(at_once) as pool:
            for job in [pool.submit(inherit(work), key, members) for key, members in turn.items()]:
                job.result()
    listing = spark.createDataFrame(
        [(i, n, "failed" if n in errors else "fitted", errors.get(n)) for i, n in enumerate(names)],
        "position int, model string, status string, error string",
    )
    scores = _scores(spark, run.task, judged)
    s = run.settings
    run.board = listing.join(scores, "model", "left").withColumns(
        {
            "target_column": F.lit(s.target),
            "time": F.lit(run.run_id),
            "model_filename": F.concat_ws("_", "model", F.lit(run.run_id)),
            "evaluated_on": F.lit(s.evaluate_on),
        }
    )
    return run


def train(df: DataFrame, settings: Settings, names=None, options=None, at_once: int = 4, run_id=None) -> Run:
    return fit_models(prepare_run(df, settings, run_id), names, options, at_once)


def refit_on_all(run: Run, name: str | None = None, options: dict | None = None) -> tuple[Preparation, Fitted]:
    """Fit a model (the best by default) and its preparation again on learning and held-out rows together."""
    if name is None:
        name = run.best().first()["model_name"]
        if name is None:
            raise ModelNotFound("no model is best")
    prep = fit_preparation(run.source, replace(run.settings, evaluate_on="train"))
    rows = cut_lineage(prep.apply(run.source, with_label=True))
    return prep, models_for(run.task)[name](frame_of(rows, prep), **(options or {}))


def reevaluate(run_rows: DataFrame, model: Fitted, task: str) -> DataFrame:
    """Metrics of a (loaded) model on prepared rows: one row with all that a leaderboard has of it."""
    predicted = model.transform(run_rows)
    return _scores(run_rows.sparkSession, task, {"model": _judge(predicted, task)}).drop("model")


def cross_validate(run: Run, name: str, folds: int = 10, options: dict | None = None, at_once: int = 4) -> DataFrame:
    """(fold, metrics..) of one model, each fold judged by a fit on the others."""
    s = run.settings
    rows = run.learning_rows().withColumn("_fold", fold_number(F.col(s.key), folds, s.seed))
    factory = models_for(run.task)[name]

    def one(fold: int) -> list[tuple]:
        model = factory(frame_of(rows.where(F.col("_fold") != fold).drop("_fold"), run.preparation), **(options or {}))
        return _judge(model.transform(rows.where(F.col("_fold") == fold).drop("_fold")), run.task)

    spark = run.prepared.sparkSession
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(inherit(one), f) for f in range(folds)]
        judged = {str(f): j.result() for f, j in enumerate(jobs)}
    return _scores(spark, run.task, judged).withColumn("fold", F.col("model").cast("int")).drop("model")
