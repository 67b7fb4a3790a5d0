"""Fit preprocessing on training rows, keep it, and apply it to any later rows.

``Preparation`` holds everything learned: the feature contract, the category codes,
the training means and the classes of the target. Applying it gives
``(key, features, label)`` with ``features`` an ML vector.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractViolation, UnsuitableTarget
from ..functions.split import is_holdout
from ..functions.text import finite_or_null, to_number
from ..operators.encode import MapSize, category_codes, encode, map_sizes, place_of, text_columns
from ..operators.impute import exact_median
from ..operators.profile import CLASSIFICATION, REGRESSION
from ..session import cut_lineage

RESERVED = frozenset(("features", "label", "held_out", "prediction", "probability"))  # columns a run adds


@dataclass(frozen=True)
class Settings:
    """What a training run is asked to do; no job is started by making one."""

    target: str
    key: str
    task: str
    order_by: tuple[str, ...] = ()
    seed: int = 42
    holdout: float = 0.2
    evaluate_on: str = "holdout"        # or "train"
    coerce_numeric: tuple[str, ...] = ()  # mixed columns read as numbers, other cells missing
    most_classes: int = 1_000     # a target with more values is taken to be a number
    widest_square: int = 2_000    # features beyond which no square matrix of sums is gathered

    def __post_init__(self):
        if self.task not in (REGRESSION, CLASSIFICATION):
            raise UnsuitableTarget(f"unknown task {self.task!r}")
        if self.key in RESERVED:
            raise ContractViolation(f"a key cannot be named {self.key!r}")


@dataclass
class Preparation:
    settings: Settings
    features: list[str]                   # the contract: names and order
    kinds: dict[str, str]                 # feature -> "number" or "category"
    types: dict[str, str]                 # feature -> type seen in training
    means: dict[str, float | None]
    codes: DataFrame | None = None        # (column, value, code, rows)
    sizes: dict[str, MapSize] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)  # class text by label number
    class_type: str = "string"
    target_median: float | None = None
    missing_target: int = 0

    # -- contract ---------------------------------------------------------------

    @property
    def used(self) -> list[str]:
        """Features that reach the models: those with at least one present training cell."""
        return [f for f in self.features if self.kinds[f] == "category" or self.means.get(f) is not None]

    def contract(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{f}` {self.types[f]}" for f in self.features))

    def check(self, df: DataFrame) -> dict[str, list[str]]:
        """Missing and extra columns of ``df``; missing ones raise."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ContractViolation(f"missing columns: {missing}")
        return {"missing": missing, "extra": [c for c in df.columns if c not in self.features]}

    # -- apply --------------------------------------------------------------------

    def apply(
        self, df: DataFrame, with_label: bool = False, impute: str = "train", keep: list[str] | None = None
    ) -> DataFrame:
        """(key, keep.., features[, label]).

        ``impute="batch"`` fills missing numbers with the means of ``df`` itself first.
        """
        self.check(df)
        s = self.settings
        keep = keep or []
        if taken := sorted(RESERVED & set(keep)):
            raise ContractViolation(f"kept columns cannot be named {taken}")
        # names for the features that no key or kept column has
        prefix = "c"
        while any(name.startswith(prefix) for name in (s.key, *keep)):
            prefix = f"_{prefix}"
        inner = {f: f"{prefix}{i}" for i, f in enumerate(self.used)}
        target = [F.col(f"`{s.target}`").alias("_target")] if with_label else []
        have_key = [F.col(f"`{s.key}`").alias(s.key)] if s.key in df.columns else []
        frame = df.select(
            *have_key, *[F.col(f"`{c}`").alias(c) for c in keep], *target,
            *[self._cell(f).alias(c) for f, c in inner.items()],
        )
        categories = [f for f in self.used if self.kinds[f] == "category"]
        numbers = [f for f in self.used if self.kinds[f] == "number"]
        if categories:
            as_inner = self.codes.replace(inner, subset=["column"])
            frame = encode(
                frame, as_inner, [inner[f] for f in categories],
                {inner[f]: self.sizes[f] for f in categories if f in self.sizes},
                {inner[f]: f"{inner[f]}_code" for f in categories},
            )
        means = {f: self.means[f] for f in numbers}
        if impute == "batch" and numbers:
            own = frame.agg(*[F.avg(inner[f]).alias(inner[f]) for f in numbers]).first()
            means = {f: own[inner[f]] if own[inner[f]] is not None else means[f] for f in numbers}
        values = [
            F.coalesce(F.col(inner[f]), F.lit(float(means[f])))
            if f in means else F.col(f"{inner[f]}_code").cast("double")
            for f in self.used
        ]
        out = [*[s.key for _ in have_key], *keep, array_to_vector(F.array(*values)).alias("features")]
        if not with_label:
            return frame.select(*out)
        frame = frame.select(*out, self._label().alias("label"))
        return frame.where(F.col("label").isNotNull())

    def _cell(self, name: str):
        cell = F.col(f"`{name}`")
        if self.kinds[name] == "category":
            return cell.cast("string")
        if name in self.settings.coerce_numeric or self.types[name] == "string":
            number = to_number(cell.cast("string"))
            return F.when(~F.isnan(number), number)
        return finite_or_null(cell)

    def _label(self):
        if self.settings.task == REGRESSION:
            value = finite_or_null(F.col("_target"))
            return value if self.target_median is None else F.coalesce(value, F.lit(self.target_median))
        pairs = [x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(i)))]
        return F.create_map(*pairs)[F.col("_target").cast("string")]

    def class_of(self, number):
        """Original class of a label number; NULL outside the known classes."""
        values = F.array(*[F.lit(c) for c in self.classes])
        return F.get(values, number.cast("int")).cast(self.class_type)

    # -- save and load --------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        state = {
            "settings": asdict(self.settings), "features": self.features, "kinds": self.kinds,
            "types": self.types, "means": self.means, "classes": self.classes,
            "class_type": self.class_type, "target_median": self.target_median,
            "missing_target": self.missing_target,
            "sizes": {c: [m.values, m.bytes] for c, m in self.sizes.items()},
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/state")
        if self.codes is not None:
            self.codes.write.mode("overwrite").partitionBy("column").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        s = state["settings"]
        settings = Settings(**{**s, "order_by": tuple(s["order_by"]), "coerce_numeric": tuple(s["coerce_numeric"])})
        categories = any(k == "category" for k in state["kinds"].values())
        codes = None
        if categories:
            codes = spark.read.schema("value string, code bigint, rows bigint, column string").parquet(f"{path}/codes")
        return cls(
            settings=settings, features=state["features"], kinds=state["kinds"], types=state["types"],
            means=state["means"], codes=codes,
            sizes={c: MapSize(*m) for c, m in state["sizes"].items()},
            classes=state["classes"], class_type=state["class_type"],
            target_median=state["target_median"], missing_target=state["missing_target"],
        )


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features and target as two views of one table."""
    if target not in df.columns:
        raise UnsuitableTarget(f"no column {target!r}")
    return df.drop(target), df.select(F.col(f"`{target}`"))


def _target_classes(df: DataFrame, s: Settings) -> tuple[list[str], str]:
    """Class texts in label order: first appearance for text, value order for numbers."""
    kind = dict(df.dtypes)[s.target]
    target = F.col(f"`{s.target}`")
    if kind in ("double", "float"):
        target = F.when(~F.isnan(target), target)
    text = kind == "string"
    order = F.min(place_of(list(s.order_by or (s.key,)))) if text else F.first(target)
    seen = (
        df.where(target.isNotNull()).groupBy(target.cast("string").alias("value")).agg(order.alias("first"))
        .orderBy("first").limit(s.most_classes + 1).collect()
    )
    if len(seen) > s.most_classes:
        raise UnsuitableTarget(f"{s.target!r} has more than {s.most_classes} classes: a number to be regressed?")
    if len(seen) < 2:
        raise UnsuitableTarget(f"{s.target!r} has fewer than two classes")
    return [r["value"] for r in seen], kind


def fit_preparation(df: DataFrame, settings: Settings) -> Preparation:
    """Learn codes, means and classes from ``df``: one aggregation, one job for the codes."""
    s = settings
    left_out = {s.target, s.key, *[c for c in s.order_by if c.startswith("_")]}
    features = [c for c in df.columns if c not in left_out]
    texts = set(text_columns(df)) - set(s.coerce_numeric)
    types = dict(df.dtypes)
    kinds = {f: "category" if f in texts else "number" for f in features}
    prep = Preparation(
        settings=s, features=features, kinds=kinds, types={f: types[f] for f in features}, means={}
    )
    numbers = [f for f in features if kinds[f] == "number"]
    categories = [f for f in features if kinds[f] == "category"]
    target = finite_or_null(F.col(f"`{s.target}`")) if s.task == REGRESSION else F.col(f"`{s.target}`")
    # means come from the rows the models learn from; codes say nothing about the target
    # and are given to the categories of all rows
    learns = ~is_holdout(F.col(f"`{s.key}`"), s.holdout, s.seed) if s.evaluate_on == "holdout" else F.lit(True)
    row = df.agg(
        F.count_if(target.isNull()).alias("missing"),
        *[F.avg(F.when(learns, prep._cell(f))).alias(f"m{i}") for i, f in enumerate(numbers)],
        *[F.approx_count_distinct(prep._cell(f)).alias(f"d{i}") for i, f in enumerate(categories)],
    ).first()
    prep.means = {f: row[f"m{i}"] for i, f in enumerate(numbers)}
    prep.missing_target = row["missing"]
    if categories:
        codes = category_codes(
            df, categories, list(s.order_by or (s.key,)),
            sizes={f: row[f"d{i}"] for i, f in enumerate(categories)},
        )
        prep.codes = cut_lineage(codes)
        prep.sizes = map_sizes(prep.codes)
    if s.task == CLASSIFICATION:
        prep.classes, prep.class_type = _target_classes(df, s)
    elif prep.missing_target:
        prep.target_median = exact_median(df, s.target)
    return prep
