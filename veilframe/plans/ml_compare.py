"""How much a model loses when it is trained on the released table instead of the original."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import values as V
from veilframe.functions.rng import KeyedNoise
from veilframe.operators.utility import NOISY
from veilframe.plans.anonymize import AnonymizationPlan
from veilframe.session import table_store

TEST_SHARE = 0.2
SEED = 42
TREES = 100
ITERATIONS = 1000
MODELS = ("random_forest", "logistic_regression")


def _feature_frame(paired: DataFrame, plan: AnonymizationPlan, target: str, side: str, skip: Sequence[str]) -> DataFrame:
    """Features of one side under common names: numbers as doubles, the rest as text."""
    out = [F.col(target).cast("string").alias("target"), F.col("is_test")]
    for p in plan.columns:
        if p.column == target or p.column in skip or p.released == "null":
            continue
        name = p.column + side
        dtype = paired.schema[name].dataType
        if p.semantic_type in ("age", "year", "monetary", "numeric", "count"):
            feature = F.coalesce(V.to_number(F.col(name), dtype), F.lit(0.0))
        else:
            feature = F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append(feature.alias(p.column))
    return paired.select(*out)


def _pipeline(frame: DataFrame, model: str, trees: int, iterations: int) -> Pipeline:
    features = [f for f in frame.schema.fields if f.name not in ("target", "is_test")]
    texts = [f.name for f in features if V.is_text(f.dataType)]
    stages = [StringIndexer(inputCol="target", outputCol="label", handleInvalid="keep")]
    if texts:
        stages.append(
            StringIndexer(inputCols=texts, outputCols=[f"i_{t}" for t in texts], handleInvalid="keep")
        )
    names = [f"i_{f.name}" if f.name in texts else f.name for f in features]
    stages.append(VectorAssembler(inputCols=names, outputCol="raw"))
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    if model == "random_forest":
        stages.append(RandomForestClassifier(numTrees=trees, seed=SEED))
    else:
        stages.append(LogisticRegression(maxIter=iterations))
    return Pipeline(stages=stages)


def change_grade(difference: Column) -> Column:
    size = F.abs(difference)
    return F.when(size < 0.05, F.lit("Excellent")).when(size < 0.10, F.lit("Good")).otherwise(F.lit("Poor"))


def split_rows(paired: DataFrame, split: KeyedNoise | None = None) -> DataFrame:
    """Adds is_test: a fifth of the rows, by a draw on the row key."""
    split = split or KeyedNoise("split", "__key")
    return paired.withColumn("is_test", split.uniform("split") < TEST_SHARE)


def compare_models(
    df: DataFrame,
    plan: AnonymizationPlan,
    target: str,
    skip: Sequence[str] = (),
    split: KeyedNoise | None = None,
    models: Sequence[str] = MODELS,
    trees: int = TREES,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """(model, train_rows, test_rows, classes, original_accuracy, anonymised_accuracy, change, grade).

    Both sides hold out the same rows, chosen by a draw on the row key. `skip` names columns
    that are no features, such as identifiers. The pair is written once, since every fit reads it
    several times.
    """
    paired = table_store(df.sparkSession)(split_rows(plan.paired(df), split), "paired")
    sizes = paired.agg(
        F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"), F.count_distinct(target).alias("classes")
    ).first()
    evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    rows = []
    for model in models:
        accuracy = []
        for side in ("", NOISY):
            frame = _feature_frame(paired, plan, target, side, skip)
            fitted = _pipeline(frame, model, trees, iterations).fit(frame.where("NOT is_test"))
            accuracy.append(float(evaluator.evaluate(fitted.transform(frame.where("is_test")))))
        rows.append((model, sizes["train"], sizes["test"], sizes["classes"], accuracy[0], accuracy[1]))
    spark = df.sparkSession
    found = spark.createDataFrame(
        rows,
        "model string, train_rows bigint, test_rows bigint, classes bigint, original_accuracy double, anonymised_accuracy double",
    )
    change = F.col("anonymised_accuracy") - F.col("original_accuracy")
    return found.withColumn("change", change).withColumn("grade", change_grade(change))
