"""Training, scoring and judging the classifier over task features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .features import LABEL
from .numbering import running_totals

CLASSES = (0, 1)


@dataclass(frozen=True)
class Trained:
    """The fitted model, its feature columns, the rows kept out of training, the label's name,
    and how many training rows lacked a feature."""

    model: PipelineModel
    features: tuple[str, ...]
    holdout: DataFrame
    label: str = LABEL
    filled: int = 0


def feature_columns(table: DataFrame, label: str = LABEL, key: str = "task_id") -> list[str]:
    return [c for c in table.columns if c not in (label, key)]


def split_by_key(table: DataFrame, key: str = "task_id", train_share: float = 0.8, seed: int = 17):
    """Train and hold-out rows. The key decides, so the rows of a task stay together and
    the split does not depend on how the table is partitioned."""
    in_train = key_place(key, seed) < int(train_share * 1000)
    return table.filter(in_train), table.filter(~in_train)


def key_place(key: str, seed: int) -> Column:
    """A number from 0 to 999 by the MD5 of seed and key, which any engine can compute."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8)
    return F.coalesce(F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(1000)), F.lit(0))


_STOPPING = "__stopping"


def train(
    table: DataFrame, label: str = LABEL, seed: int = 17, rounds: int = 10, key: str = "task_id"
) -> Trained:
    """Gradient-boosted trees on the feature columns, with a hold-out for evaluation.

    A fifth of the tasks is held out (see ``evaluation``). Of the others a tenth decides after
    which round boosting stops, because trees no longer gain on them. No row is left out: a
    missing feature takes the mean of the training rows, and ``filled`` counts such rows.
    Labels must be known.
    """
    features = feature_columns(table, label, key)
    fitted, holdout = split_by_key(table, key, seed=seed)
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in features])
    means = fitted.agg(
        *[F.avg(c).alias(c) for c in features], F.sum(missing.cast("int")).alias("__filled"),
        F.sum(F.col(label).isNull().cast("int")).alias("__unlabelled"),
    ).first()
    if means["__unlabelled"]:
        raise ValueError(f"{means['__unlabelled']} training rows have no {label}")
    # a feature that no row has is 0 everywhere
    prepared = fitted.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)) for c in features}
    ).withColumn(_STOPPING, key_place(key, seed + 1) < 100)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    trees = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        maxIter=rounds,
        maxDepth=4,
        seed=seed,
        validationIndicatorCol=_STOPPING,
        validationTol=0.001,
    )
    # Boosting reads the rows once per round.
    prepared = prepared.persist()
    try:
        if prepared.where(_STOPPING).isEmpty() or prepared.where(f"NOT {_STOPPING}").isEmpty():
            trees = trees.copy()
            trees.clear(trees.validationIndicatorCol)
        model = Pipeline(stages=[assembler, trees]).fit(prepared)
    finally:
        prepared.unpersist()
    return Trained(model, tuple(features), holdout, label, int(means["__filled"] or 0))


@dataclass(frozen=True)
class Evaluation:
    """Predictions for the tasks held out, and the reports on them."""

    scored: DataFrame
    classes: DataFrame
    overall: DataFrame
    thresholds: DataFrame
    confusion: DataFrame


def evaluation(trained: Trained) -> Evaluation:
    """How the model does on the rows that were kept out of its training.

    Rows without a prediction, because a feature is missing, are in ``scored`` only.
    """
    scored = durable(unpack(predict(trained, trained.holdout)))
    known = scored.where(F.col("prediction").isNotNull()).select(
        F.col(trained.label).cast("int").alias("label"),
        F.col("class").cast("int").alias("predicted"),
        F.col("probability_true").alias("probability"),
    )
    return Evaluation(
        scored,
        class_metrics(known, "label", "predicted"),
        global_metrics(known, "label", "predicted", "probability"),
        threshold_metrics(known, "label", "probability"),
        confusion_matrix(known, "label", "predicted"),
    )


def predict(trained: Trained, rows: DataFrame) -> DataFrame:
    """Every row with a ``prediction`` of its class and the probability of each class.

    Rows with a missing feature are kept, with a NULL prediction.
    """
    complete = F.lit(True)
    for c in trained.features:
        complete = complete & F.col(c).isNotNull()
    assembler, trees = trained.model.stages
    filled = rows.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in trained.features})
    assembler = VectorAssembler(
        inputCols=[f"__{c}" for c in trained.features], outputCol=trees.getFeaturesCol()
    )
    scored = trees.transform(assembler.transform(filled))
    share = vector_to_array("probability")
    prediction = prediction_object(share[1])
    return scored.select(*rows.columns, F.when(complete, prediction).alias("prediction_object")).withColumnRenamed(
        "prediction_object", "prediction"
    )


def prediction_object(probability_true: Column) -> Column:
    """Class and class probabilities as one value."""
    winner = F.when(probability_true > 0.5, "1").otherwise("0")
    return F.struct(
        winner.alias("class"),
        F.create_map(
            F.lit("0"), F.lit(1.0) - probability_true, F.lit("1"), probability_true
        ).alias("probability"),
    )


def unpack(predicted: DataFrame) -> DataFrame:
    """Class as a boolean and the probability of either class as columns."""
    return predicted.withColumns(
        {
            "class": F.col("prediction.class").cast("int").cast("boolean"),
            "probability_false": F.col("prediction.probability")["0"],
            "probability_true": F.col("prediction.probability")["1"],
        }
    )


def feature_importance(trained: Trained, spark) -> DataFrame:
    """One row per feature; the shares sum to 1."""
    weights = trained.model.stages[-1].featureImportances.toArray()
    rows = [(i + 1, f, float(w)) for i, (f, w) in enumerate(zip(trained.features, weights))]
    table = spark.createDataFrame(rows, "position int, feature string, score double")
    return table.orderBy(F.col("score").desc(), "position")


# -- reports on scored rows: a 0/1 label and the probability of class 1 ------------------


def confusion_matrix(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    return scored.groupBy(
        F.col(label).alias("actual_class"), F.col(predicted).alias("predicted_class")
    ).agg(F.count("*").alias("count"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def class_metrics(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from four counts."""
    matrix = confusion_matrix(scored, label, predicted)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))

    classes = F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class")
    actual, guessed = F.col("actual_class") == F.col("class"), F.col("predicted_class") == F.col("class")
    counts = matrix.select("*", classes).groupBy("class").agg(
        total(actual & guessed).alias("hits"),
        total(guessed).alias("guessed"),
        total(actual).alias("support"),
    )
    precision = _ratio(F.col("hits"), F.col("guessed"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return counts.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        "support",
    )


def area_under_curve(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Share of (positive, negative) row pairs ranked rightly, ties counting half."""
    per_score = scored.groupBy(F.col(probability).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
    )
    ranked = running_totals(per_score, ["score"], {"neg_below": F.col("neg")})
    right = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ranked.agg(
        F.try_divide(right, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc")
    )


def global_metrics(
    scored: DataFrame, label: str, predicted: str, probability: str, floor: float = 1e-15
) -> DataFrame:
    """Macro and weighted averages of the class metrics, accuracy, AUC and log loss."""
    names = ("precision", "recall", "f1")
    by_class = class_metrics(scored, label, predicted)
    averages = by_class.agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[
            F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}")
            for n in names
        ],
    )
    p = F.greatest(F.least(F.col(probability), F.lit(1 - floor)), F.lit(floor))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    overall = scored.agg(
        F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"),
        F.avg(loss).alias("log_loss"),
    )
    auc = area_under_curve(scored, label, probability)
    # Three single rows side by side.
    tagged = [t.withColumn("__one", F.lit(1)) for t in (averages, overall, auc)]
    return tagged[0].join(tagged[1], "__one").join(tagged[2], "__one").drop("__one")


def threshold_metrics(
    scored: DataFrame, label: str, probability: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of class 1 at each threshold.

    Rows are first counted per interval between thresholds, so a row is counted once
    and not once per threshold.
    """
    cuts = sorted(thresholds or [i / 10 for i in range(11)])
    levels = F.array(*[F.lit(float(c)) for c in cuts])
    passed = F.size(F.filter(levels, lambda c: F.col(probability) >= c))
    counted = scored.groupBy(passed.alias("passed")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
    )
    level = F.posexplode(levels).alias("level", "threshold")
    above = F.col("passed") > F.col("level")

    def total(column: str, condition: Column | None = None) -> Column:
        value = F.col(column) if condition is None else F.when(condition, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0))

    sums = counted.select("*", level).groupBy("threshold").agg(
        total("pos", above).alias("true_positives"),
        total("neg", above).alias("false_positives"),
        total("pos").alias("positives"),
        total("neg").alias("negatives"),
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, F.col("positives"))
    return sums.select(
        "threshold",
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        _ratio(fp, F.col("negatives")).alias("false_positive_rate"),
    )


def confidence_band(
    probability: str = "probability",
    high: tuple[float, float] = (0.07, 0.95),
    low: tuple[float, float] = (0.30, 0.70),
) -> Column:
    """HIGH near 0 or 1, LOW around the middle, MEDIUM between."""
    p = F.col(probability)
    return (
        F.when((p < high[0]) | (p >= high[1]), "HIGH")
        .when((p >= low[0]) & (p < low[1]), "LOW")
        .when(p.isNotNull(), "MEDIUM")
    )
