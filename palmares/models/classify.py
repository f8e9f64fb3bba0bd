"""Medal or no medal from body measures: training frame, classifiers, batch scoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from palmares.functions.recode import flag, unflag
from palmares.operators.encode import label_index
from palmares.schemas import NO_MEDAL

FOREST_INPUTS = ("sport_at", "sex_at", "height", "weight", "age", "bmi")
TREE_INPUTS = ("height", "weight", "age", "bmi", "sport_at")


def labelled_profiles(groups: DataFrame) -> DataFrame:
    """Profiles with alphabetical integer codes for sport and sex and the 0/1 ``actual`` class."""
    return label_index(groups, {"sport": "sport_at", "sex": "sex_at"}).withColumn("actual", flag("medal", NO_MEDAL))


def fit_classifier(train: DataFrame, classifier, inputs: Sequence[str]) -> PipelineModel:
    """Train on the rows whose inputs are complete; the model passes incomplete rows on for ``score``."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="keep")
    stages = [assembler, classifier.copy().setFeaturesCol("features").setLabelCol("actual")]
    return Pipeline(stages=stages).fit(train.na.drop(subset=list(inputs)))


def forest(trees: int = 100, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=12, seed=seed)


def tree(seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=12, seed=seed)


def score(model: PipelineModel, profiles: DataFrame) -> DataFrame:
    """The input columns with the ``predicted`` 0/1 class and the names of both classes.

    Every row stays; one with a missing input has a null prediction.
    """
    numbers = [F.col(c).cast("double") for c in model.stages[0].getInputCols()]
    complete = reduce(and_, [x.isNotNull() & ~F.isnan(x) for x in numbers])
    scored = model.transform(profiles).withColumn("predicted", F.when(complete, F.col("prediction").cast("int")))
    return scored.select(
        *profiles.columns,
        "predicted",
        unflag("actual", "Medal", NO_MEDAL).alias("actual_name"),
        F.when(F.col("predicted").isNotNull(), unflag("predicted", "Medal", NO_MEDAL)).alias("predicted_name"),
    )
