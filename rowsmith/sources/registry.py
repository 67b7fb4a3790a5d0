"""Saved models, deployments and the prediction log, as tables under one base path.

base/models/<user>/<project>/<run>/preparation, .../<model>_<run>    fitted state
base/registry/models, deployments, predictions                      append-only tables
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelNotFound
from ..functions.display import readable
from ..operators.models.base import Fitted, load_fitted
from ..plans.prepare import Preparation
from ..plans.train import Run
from ..plans.zoo import models_for

MODEL_SUFFIX = ".pkl"  # fixed value: the suffix of model files in listings
MODELS = "user string, project string, model_name string, run_id string, task string, target string, " \
         "position int, path string, created_at timestamp"
DEPLOYMENTS = "username string, project string, date_of_deployment string, model_trainer_class string, " \
              "model_name string, target_column_name string, api_required_fields array<string>, " \
              "api_endpoint string, api_status string, endpoint_name string, run_id string, model_key string, deployed_at timestamp"


def _safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name)


def _run_path(base: str, user: str, project: str, run_id: str) -> str:
    return f"{base}/models/{_safe(user)}/{_safe(project)}/{run_id}"


# -- saving and loading -------------------------------------------------------------------


def save_run(
    run: Run, base: str, user: str, project: str, names: list[str] | None = None, at_once: int = 4
) -> DataFrame:
    """Save the preparation, the fitted models and the leaderboard of a run and register them.

    The board's rows are appended to those of earlier runs; see ``leaderboards``.
    """
    spark = run.prepared.sparkSession
    folder = _run_path(base, user, project, run.run_id)
    run.preparation.save(spark, f"{folder}/preparation")
    rows, written, saves = [], {}, []
    for position, name in enumerate(models_for(run.task)):
        if name not in run.models or (names is not None and name not in names):
            continue
        model = run.models[name]
        if id(model) not in written:  # names that share one fit share one folder
            written[id(model)] = f"{folder}/{_safe(name)}_{run.run_id}"
            saves.append((model, written[id(model)]))
        rows.append((user, project, name, run.run_id, run.task, run.settings.target, position, written[id(model)]))
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(at_once) as pool:
        for job in [pool.submit(inherit(model.save), spark, path) for model, path in saves]:
            job.result()
    table = spark.createDataFrame(rows, MODELS.rsplit(",", 1)[0]).withColumn("created_at", F.current_timestamp())
    table.write.mode("append").partitionBy("user", "project").parquet(f"{base}/registry/models")
    if run.board is not None:
        board = run.leaderboard().withColumns({"user": F.lit(user), "project": F.lit(project), "run_id": F.lit(run.run_id)})
        board.write.mode("append").partitionBy("user", "project").parquet(f"{base}/registry/leaderboards/{_safe(run.task)}")
    return models(spark, base)


def leaderboards(spark: SparkSession, base: str, task: str) -> DataFrame:
    """The leaderboard rows of all saved runs of a task."""
    return spark.read.option("mergeSchema", True).parquet(f"{base}/registry/leaderboards/{_safe(task)}")


def models(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MODELS).parquet(f"{base}/registry/models")


def latest(registry: DataFrame) -> DataFrame:
    """The newest run of each (user, project, model)."""
    return registry.groupBy("user", "project", "model_name").agg(
        F.max_by(F.struct("run_id", "task", "target", "path"), F.struct("created_at", "run_id")).alias("r")
    ).select("user", "project", "model_name", "r.*")


def _registered(spark: SparkSession, base: str, user: str, project: str, name: str, run_id: str | None):
    """The registry row of a model, of the newest run unless one is named; None if there is none."""
    try:
        rows = models(spark, base).where(
            (F.col("user") == user) & (F.col("project") == project) & (F.col("model_name") == name)
        )
        return latest(rows if run_id is None else rows.where(F.col("run_id") == run_id)).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ModelNotFound(f"no registry under {base}") from error


def load_model(
    spark: SparkSession, base: str, user: str, project: str, name: str, run_id: str | None = None
) -> tuple[Preparation, Fitted]:
    """Preparation and model by reference; the newest run unless one is named."""
    found = _registered(spark, base, user, project, name, run_id)
    if found is None:
        raise ModelNotFound(f"{user}/{project}/{name}" + (f" of run {run_id}" if run_id else ""))
    folder = _run_path(base, user, project, found["run_id"])
    return Preparation.load(spark, f"{folder}/preparation"), load_fitted(spark, found["path"])


# -- deployments and predictions -----------------------------------------------------------


def deployment_columns(user: Column, model: Column, link: Column, at: Column) -> dict[str, Column]:
    """The derived columns of a deployment record."""
    return {
        "endpoint_name": F.concat_ws("_", model, user),
        "date_of_deployment": readable(at),
        "model_file": F.concat(model, F.lit(MODEL_SUFFIX)),
        "api_status": F.when(link.isNotNull(), F.lit("Active")).otherwise(F.lit("Inactive")),
    }


def deploy(
    spark: SparkSession, base: str, user: str, project: str, name: str,
    link: str | None = None, required_fields: list[str] | None = None, run_id: str | None = None,
) -> DataFrame:
    """Append a deployment record for a saved model; returns that record.

    The run is fixed when the model is deployed: a later run of the same name changes nothing.
    """
    found = _registered(spark, base, user, project, name, run_id)
    if found is None:
        raise ModelNotFound(f"{user}/{project}/{name}" + (f" of run {run_id}" if run_id else ""))
    prep = Preparation.load(spark, f"{_run_path(base, user, project, found['run_id'])}/preparation")
    derived = deployment_columns(F.lit(user), F.lit(name), F.lit(link).cast("string"), F.current_timestamp())
    record = spark.range(1).select(
        F.lit(user).alias("username"),
        F.lit(project).alias("project"),
        derived["date_of_deployment"].alias("date_of_deployment"),
        F.lit(prep.settings.task).alias("model_trainer_class"),
        derived["model_file"].alias("model_name"),
        F.lit(prep.settings.target).alias("target_column_name"),
        F.array(*[F.lit(f) for f in required_fields or prep.features]).alias("api_required_fields"),
        F.lit(link).cast("string").alias("api_endpoint"),
        derived["api_status"].alias("api_status"),
        derived["endpoint_name"].alias("endpoint_name"),
        F.lit(found["run_id"]).alias("run_id"),
        F.lit(name).alias("model_key"),
        F.current_timestamp().alias("deployed_at"),
    )
    record.write.mode("append").json(f"{base}/registry/deployments", ignoreNullFields=False)
    return record


def deployments(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(DEPLOYMENTS).json(f"{base}/registry/deployments")


def load_deployed(spark: SparkSession, base: str, endpoint_name: str) -> tuple[Preparation, Fitted]:
    """Preparation and model of an endpoint, ``<model>_<user>``: of its newest deployment, with the run it was made for."""
    try:
        found = deployments(spark, base).where(F.col("endpoint_name") == endpoint_name).agg(
            F.max_by(F.struct("username", "project", "model_key", "run_id"), F.struct("deployed_at", "run_id")).alias("r")
        ).first()["r"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        raise ModelNotFound(f"no endpoint {endpoint_name!r}")
    return load_model(spark, base, found["username"], found["project"], found["model_key"], found["run_id"])


def log_predictions(scored: DataFrame, base: str, user: str, model: str, run_id: str, key: str) -> None:
    """Append scored rows to the prediction log."""
    scored.select(
        F.col(key).cast("string").alias("key"), F.col("prediction").cast("double"),
        F.current_timestamp().alias("predicted_at"),
        F.lit(user).alias("user"), F.lit(model).alias("model"), F.lit(run_id).alias("run_id"),
    ).write.mode("append").partitionBy("user", "model", "run_id").parquet(f"{base}/registry/predictions")


def predictions(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(
        "key string, prediction double, predicted_at timestamp, user string, model string, run_id string"
    ).parquet(f"{base}/registry/predictions")


# -- listings ----------------------------------------------------------------------------------


def counts_by_user(deployed: DataFrame, registered: DataFrame) -> DataFrame:
    """(user, deployments, models, projects); users of either table."""
    d = deployed.groupBy(F.col("username").alias("user")).agg(F.count(F.lit(1)).alias("deployments"))
    m = registered.groupBy("user").agg(
        F.countDistinct("project", "model_name", "run_id").alias("models"), F.countDistinct("project").alias("projects")
    )
    return d.join(m, "user", "full").na.fill(0, ["deployments", "models", "projects"])


def list_models(files: DataFrame, column: str = "filename") -> DataFrame:
    """(name, filename) of model files; other files are left out."""
    name = F.col(column)
    return files.where(name.endswith(MODEL_SUFFIX)).select(
        F.regexp_replace(name, r"\.pkl$", "").alias("name"), name.alias("filename")
    ).distinct()


def list_projects(registered: DataFrame, user: str | None = None) -> DataFrame:
    rows = registered if user is None else registered.where(F.col("user") == user)
    return rows.select("user", "project").distinct()


def unused_projects(wanted: DataFrame, registered: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (user, project) whose name the user has not taken yet."""
    return wanted.join(registered.select("user", "project").distinct(), ["user", "project"], "left_anti")
