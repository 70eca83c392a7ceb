"""Feature selection as stages of a model pipeline, on a vector column (FEA1-FEA3, FEA5-FEA8, MOD1, MOD4, MOD6)."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.ranking import with_row_number
from millrace.operators.features import gram, prune_correlated
from millrace.operators.models import REGISTRY, forest


class _OnVectors(Params, DefaultParamsReadable, DefaultParamsWritable):
    source = Param(Params._dummy(), "source", "vector column read", TypeConverters.toString)
    made = Param(Params._dummy(), "made", "vector column made", TypeConverters.toString)

    def _settle(self, given: dict, **defaults) -> None:
        self._setDefault(source="features", made="selected", **defaults)
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _kept(self, indices: list[int]) -> KeptFeatures:
        if not indices:
            raise ValueError("no feature is left")
        return KeptFeatures(source=self.getOrDefault("source"), made=self.getOrDefault("made"), indices=[int(i) for i in indices])


class KeptFeatures(Model, _OnVectors):
    """The features that a fit kept, by their places in the vector."""

    indices = Param(Params._dummy(), "indices", "places of the features that stay", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, source: str | None = None, made: str | None = None, indices: list[int] | None = None):
        super().__init__()
        self._settle(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorSlicer(inputCol=self.getOrDefault("source"), outputCol=self.getOrDefault("made"), indices=self.getOrDefault("indices")).transform(dataset)


class VaryingFeatures(Estimator, _OnVectors):
    """Keeps features with more than one value (FEA1)."""

    @keyword_only
    def __init__(self, *, source: str | None = None, made: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KeptFeatures:
        found = dataset.select(Summarizer.metrics("min", "max").summary(F.col(self.getOrDefault("source"))).alias("s")).select("s.*").first()
        return self._kept([i for i, (lo, hi) in enumerate(zip(found["min"], found["max"], strict=True)) if lo < hi])


class UncorrelatedFeatures(Estimator, _OnVectors):
    """Drops the later feature of pairs with |r| of cutoff or more, the strongest pair first (FEA2, WIN7)."""

    cutoff = Param(Params._dummy(), "cutoff", "absolute correlation from which a feature goes", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, source: str | None = None, made: str | None = None, cutoff: float | None = None):
        super().__init__()
        self._settle(self._input_kwargs, cutoff=0.9)

    def _fit(self, dataset: DataFrame) -> KeptFeatures:
        arrays = dataset.select(vector_to_array(self.getOrDefault("source")).alias("z"))
        one = arrays.select(F.size("z")).first()
        if one is None:
            raise ValueError("no rows to learn from")
        names = [f"x{i}" for i in range(one[0])]
        products, sums, n = gram(arrays.select(*[F.get("z", F.lit(i)).alias(c) for i, c in enumerate(names)]), names)
        cov = products / n - np.outer(sums, sums) / n**2
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        pairs = [(names[i], names[j], float(cov[i, j] / (sd[i] * sd[j])) if sd[i] and sd[j] else None) for i in range(len(names)) for j in range(i + 1, len(names))]
        gone = set(prune_correlated(pairs, names, self.getOrDefault("cutoff")))
        return self._kept([i for i, c in enumerate(names) if c not in gone])


class PopulationScaler(Estimator, _OnVectors):
    """Mean 0 and population deviation 1 (FEA3); a constant feature becomes 0."""

    @keyword_only
    def __init__(self, *, source: str | None = None, made: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        source, made = self.getOrDefault("source"), self.getOrDefault("made")
        model = StandardScaler(inputCol=source, outputCol=f"{made}_sample", withMean=True).fit(dataset)
        n = dataset.count()
        factor = [float(np.sqrt(n / (n - 1))) if n > 1 else 1.0] * len(model.mean)
        return PipelineModel([model, ElementwiseProduct(scalingVec=Vectors.dense(factor), inputCol=f"{made}_sample", outputCol=made)])


class RecursiveElimination(Estimator, _OnVectors):
    """Drops the feature of least forest importance, one fit after another, until keep are left (FEA5)."""

    keep = Param(Params._dummy(), "keep", "number of features that stay", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "trees of the forests", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the forests", TypeConverters.toInt)
    regression = Param(Params._dummy(), "regression", "whether the target is a number", TypeConverters.toBoolean)
    label = Param(Params._dummy(), "label", "target column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, source: str | None = None, made: str | None = None, keep: int | None = None, trees: int | None = None, seed: int | None = None, regression: bool | None = None, label: str | None = None):
        super().__init__()
        self._settle(self._input_kwargs, keep=1, trees=100, seed=56, regression=True, label="y")

    def _forest(self, rows: DataFrame, left: list[int]):
        sliced = VectorSlicer(inputCol=self.getOrDefault("source"), outputCol="_sliced", indices=left)
        model = forest(self.getOrDefault("regression"), trees=self.getOrDefault("trees"), seed=self.getOrDefault("seed"), y=self.getOrDefault("label"), features="_sliced").fit(sliced.transform(rows))
        return sliced, model

    def _narrowed(self, rows: DataFrame, width: int, keep: int) -> list[int]:
        left = list(range(width))
        while len(left) > max(keep, 1):
            left.pop(int(self._forest(rows, left)[1].featureImportances.toArray().argmin()))
        return left

    def _width(self, rows: DataFrame) -> int:
        one = rows.select(F.size(vector_to_array(self.getOrDefault("source")))).first()
        if one is None:
            raise ValueError("no rows to learn from")
        return one[0]

    def _fit(self, dataset: DataFrame) -> KeptFeatures:
        rows = dataset.select(self.getOrDefault("source"), self.getOrDefault("label")).persist()
        try:
            return self._kept(self._narrowed(rows, self._width(rows), self.getOrDefault("keep")))
        finally:
            rows.unpersist()


class CrossValidatedElimination(RecursiveElimination):
    """RecursiveElimination to the number of features, keep at least, of best mean score over folds of the training rows (FEA6).

    The score is R2, or accuracy for classes. A row's fold comes from its place in the order of the
    hash of its id; stratified folds count in each class apart.
    """

    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)
    stratified = Param(Params._dummy(), "stratified", "whether folds are dealt by class", TypeConverters.toBoolean)
    id = Param(Params._dummy(), "id", "column that tells rows apart", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, source: str | None = None, made: str | None = None, keep: int | None = None, trees: int | None = None, seed: int | None = None, regression: bool | None = None, label: str | None = None,
        folds: int | None = None, stratified: bool | None = None, id: str | None = None,
    ):
        Estimator.__init__(self)
        self._settle(self._input_kwargs, keep=1, trees=100, seed=56, regression=True, label="y", folds=5, stratified=False, id="id")

    def with_folds(self, dataset: DataFrame) -> DataFrame:
        """source, label and fold of each row."""
        source, label, key = (self.getOrDefault(k) for k in ("source", "label", "id"))
        drawn = dataset.select(source, F.col(label).alias("_label"), F.col(key).alias("_key"), F.md5(F.concat_ws(":", F.lit(str(self.getOrDefault("seed"))), F.col(key).cast("string"))).alias("_draw"))
        placed = with_row_number(drawn, ["_draw", "_key"], "_place", 0, ["_label"] if self.getOrDefault("stratified") else [])
        return placed.select(source, F.col("_label").alias(label), (F.col("_place") % self.getOrDefault("folds")).cast("int").alias("_fold"))

    def _fit(self, dataset: DataFrame) -> KeptFeatures:
        label, least = self.getOrDefault("label"), max(self.getOrDefault("keep"), 1)
        judge = RegressionEvaluator(labelCol=label, metricName="r2") if self.getOrDefault("regression") else MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        rows = self.with_folds(dataset).persist()
        try:
            width, scores = self._width(rows), {}
            for fold in range(self.getOrDefault("folds")):
                train, test, left = rows.where(F.col("_fold") != fold), rows.where(F.col("_fold") == fold), list(range(width))
                while True:
                    sliced, model = self._forest(train, left)
                    scores.setdefault(len(left), []).append(judge.evaluate(model.transform(sliced.transform(test))))
                    if len(left) <= least:
                        break
                    left.pop(int(model.featureImportances.toArray().argmin()))
            best = max(sorted(scores), key=lambda n: float(np.mean(scores[n])))
            return self._kept(self._narrowed(rows, width, best))
        finally:
            rows.unpersist()


#: Stages by name; parameters are '<stage>__<param>'.
STAGES = {"varying": VaryingFeatures, "uncorrelated": UncorrelatedFeatures, "scale": PopulationScaler, "eliminate": RecursiveElimination, "eliminate_cv": CrossValidatedElimination}
#: Pipelines by name: their stages and the model behind them, a name of models.REGISTRY (MOD1-MOD8).
PIPELINES: dict[str, tuple[list[str], str]] = {
    "neighbours": (["varying", "scale"], "neighbours"),
    "svr": (["varying", "scale"], "svr"),
    "svc": (["varying", "scale"], "svc"),
    "neighbours_uncorrelated": (["varying", "uncorrelated", "scale"], "neighbours"),
    "forest_uncorrelated": (["varying", "uncorrelated"], "forest"),
    "forest_eliminate": (["varying", "eliminate"], "forest"),
    "forest_eliminate_cv": (["varying", "eliminate_cv"], "forest"),
    "ridge_eliminate": (["varying", "eliminate"], "ridge"),
    "ridge_eliminate_cv": (["varying", "eliminate_cv"], "ridge"),
    "svr_uncorrelated": (["varying", "uncorrelated", "scale"], "svr"),
    "svr_eliminate": (["varying", "eliminate", "scale"], "svr"),
    "svc_uncorrelated": (["varying", "uncorrelated", "scale"], "svc"),
}


def staged_pipeline(columns: list[str], name: str, y: str = "y", **params) -> Pipeline:
    """The named pipeline over columns; params are '<stage>__<param>', '<model>__<param>' or the model's own. Another stage's name is an error."""
    stages, model = PIPELINES[name]
    told: dict[str, dict] = {k: {} for k in [*stages, model]}
    for key, value in params.items():
        part, _, own = key.rpartition("__")
        if (part or model) not in told:
            raise ValueError(f"{name} has no stage {part}")
        told[part or model][own] = value
    at, steps = "_assembled", [VectorAssembler(inputCols=columns, outputCol="_assembled")]
    for i, stage in enumerate(stages):
        made = "features" if i == len(stages) - 1 else f"_{stage}"
        target = {"label": y} if stage.startswith("eliminate") else {}
        steps.append(STAGES[stage](source=at, made=made, **target, **told[stage]))
        at = made
    return Pipeline(stages=[*steps, REGISTRY[model](y=y, **told[model])])
