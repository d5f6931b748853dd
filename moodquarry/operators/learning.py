"""Models on tables: training, prediction, evaluation, and any Python model in batches."""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodquarry.functions.labels import EMOTIONS, SENTIMENTS
from moodquarry.operators.features import tokenize
from moodquarry.plans.scratch import remove, rename

# Weights of the two losses.
LOSS_WEIGHTS = (1.0, 0.5)
HEADS = {"sentiment": list(SENTIMENTS), "emotion": list(EMOTIONS)}
DEFAULT_GRID = [{"regParam": 0.01}, {"regParam": 0.1}]


@dataclass
class TwoHeads:
    """Features shared by a sentiment and an emotion classifier, with the validation history."""

    features: PipelineModel
    sentiment: LogisticRegressionModel
    emotion: LogisticRegressionModel
    history: list[dict]


def _position(c: str, labels: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1).cast("double")


def _with_features(features: PipelineModel, df: DataFrame) -> DataFrame:
    return features.transform(df.withColumn("_tokens", tokenize("text"))).drop("_tokens", "_tf")


def _head(model: LogisticRegressionModel, df: DataFrame, head: str, labels: list[str]) -> DataFrame:
    """Add `head`_prediction, `head`_confidence and the map `head`_scores."""
    n = min(len(labels), model.numClasses)
    out = model.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y").transform(df)
    scores = vector_to_array(F.col("_p"))
    entries = [x for i, label in enumerate(labels) for x in (F.lit(label), scores[i] if i < n else F.lit(0.0))]
    return out.withColumns(
        {
            f"{head}_prediction": F.array(*[F.lit(x) for x in labels])[F.col("_y").cast("int")],
            f"{head}_confidence": F.array_max(scores),
            f"{head}_scores": F.create_map(*entries),
        }
    ).drop("_p", "_r", "_y")


def train_two_heads(
    train: DataFrame, val: DataFrame, grid: list[dict] | None = None, num_features: int = 1 << 16, max_iter: int = 20
) -> TwoHeads:
    """Fit both heads for each entry of `grid` and keep the one of the lowest validation loss.

    `train` and `val` have text, sentiment and emotion. The model's size is bounded by
    `num_features` times the number of labels, whatever the number of rows.
    """
    heads = HEADS
    need = ["text", *heads]
    train, val = (df.select(*need).na.drop().where(F.col("sentiment").isin(SENTIMENTS) & F.col("emotion").isin(EMOTIONS)) for df in (train, val))
    steps = Pipeline(
        stages=[
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
            IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        ]
    )
    features = steps.fit(train.withColumn("_tokens", tokenize("text")))
    rows = _with_features(features, train).drop("text")
    rows = rows.withColumns({f"{h}_label": _position(h, labels) for h, labels in heads.items()}).persist()
    held = _with_features(features, val).drop("text").persist()
    best, history = None, []
    try:
        for number, options in enumerate(grid or DEFAULT_GRID):
            fitted = {
                h: LogisticRegression(
                    featuresCol="_features", labelCol=f"{h}_label", family="multinomial", maxIter=max_iter, **options
                ).fit(rows)
                for h in heads
            }
            out = held
            for h, labels in heads.items():
                out = _head(fitted[h], out, h, labels)
            metrics = evaluate(_true_probability(out)).first().asDict()
            history.append({"trial": number, **metrics})
            # Without a validation row there is no loss, and the first trial stays.
            if best is None or (metrics["val_loss"] is not None and (best[0] is None or metrics["val_loss"] < best[0])):
                best = (metrics["val_loss"], fitted)
    finally:
        rows.unpersist()
        held.unpersist()
    return TwoHeads(features, best[1]["sentiment"], best[1]["emotion"], history)


def save_model(spark: SparkSession, model: TwoHeads, path: str) -> None:
    """Keep a model: features, both heads, and the order of the labels with the metrics of all trials.

    It takes its place whole, by a rename, and an older one there goes first, so what loads it never sees half a model.
    """
    stage = f"{path.rstrip('/')}.saving"
    remove(spark, stage)
    for name in ("features", *HEADS):
        getattr(model, name).write().save(f"{stage}/{name}")
    notes = {"labels": HEADS, "history": model.history}
    spark.createDataFrame([(json.dumps(notes),)], "notes string").coalesce(1).write.json(f"{stage}/notes")
    remove(spark, path)
    rename(spark, stage, path)


def load_model(spark: SparkSession, path: str) -> TwoHeads:
    """A model that `save_model` kept; it predicts as before. One whose labels are not those of this library is an error."""
    notes = json.loads(spark.read.schema("notes string").json(f"{path}/notes").first().notes)
    if notes["labels"] != HEADS:
        raise ValueError(f"a model of other labels: {notes['labels']}")
    heads = (LogisticRegressionModel.load(f"{path}/{h}") for h in HEADS)
    return TwoHeads(PipelineModel.load(f"{path}/features"), *heads, notes["history"])


def best_trial(model: TwoHeads) -> dict:
    """The trial that the heads are of: that of the lowest loss, the first of equal ones."""
    return min(model.history, key=lambda t: (t["val_loss"] is None, t["val_loss"] or 0.0, t["trial"]))


def _true_probability(df: DataFrame) -> DataFrame:
    """Predictions with the probability each head gave to the true label."""
    return df.withColumns({f"{h}_p": F.col(f"{h}_scores")[F.col(h)] for h in ("sentiment", "emotion")})


def predict(model: TwoHeads, df: DataFrame) -> DataFrame:
    """All columns of `df` plus prediction, confidence and score map of both heads."""
    out = _head(model.sentiment, _with_features(model.features, df), "sentiment", SENTIMENTS)
    return _head(model.emotion, out, "emotion", EMOTIONS).drop("_features")


def evaluate(df: DataFrame, weights: tuple[float, float] = LOSS_WEIGHTS) -> DataFrame:
    """One row: val_loss, sentiment_acc, emotion_acc and n.

    `df` has sentiment, emotion, their predictions and the probabilities sentiment_p and emotion_p
    of the true labels. The loss is the weighted mean over rows.
    """
    floor = 1e-15
    loss = sum(w * F.avg(-F.log(F.greatest(F.col(f"{h}_p"), F.lit(floor)))) for h, w in zip(("sentiment", "emotion"), weights))
    right = lambda h: F.count_if(F.col(h) == F.col(f"{h}_prediction")) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(
        loss.alias("val_loss"), right("sentiment").alias("sentiment_acc"), right("emotion").alias("emotion_acc"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall and F1 per class, then rows `macro` and `weighted` that average them.

    Everything follows from the counts of label and prediction pairs; a class never predicted
    or never present has 0 where its share is not defined.
    """
    cells = confusion(df, label, prediction)
    sides = cells.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("right")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("right")),
            )
        ).alias("s"),
    ).select("s.*")
    counts = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "right")])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    one = counts.select(
        "class", "support",
        ratio(F.col("right"), F.col("predicted")).alias("precision"),
        ratio(F.col("right"), F.col("support")).alias("recall"),
        ratio(F.lit(2.0) * F.col("right"), F.col("predicted") + F.col("support")).alias("f1"),
    )
    names = ("precision", "recall", "f1")
    means = one.agg(
        F.sum("support").alias("support"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
    )
    rows = F.array(
        *[F.struct(F.lit(kind).alias("class"), "support", *[F.col(f"{kind}_{c}").alias(c) for c in names]) for kind in ("macro", "weighted")]
    )
    return one.unionByName(means.select(F.explode(rows).alias("r")).select("r.*"))


def apply_model(
    df: DataFrame,
    loader: Callable[[], Callable[[pd.Series], pd.DataFrame]],
    schema: T.StructType,
    text: str = "text",
    error: dict | None = None,
) -> DataFrame:
    """All columns of `df` plus the columns of `schema`, from any Python model.

    `loader` runs once per task in the worker and returns a function from a batch of texts to a
    frame with the columns of `schema`. A batch that fails is tried row by row, and a row that fails
    gets the values of `error`; without `error` it fails the task. Only the text goes to Python; the other columns stay as they are.
    """
    names = [f.name for f in schema.fields]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()

        def one(text_value) -> dict:
            try:
                return model(pd.Series([text_value])).iloc[0].to_dict()
            except Exception:
                return dict(error)

        for batch in batches:
            try:
                found = model(batch)
            except Exception:
                if error is None:
                    raise
                found = pd.DataFrame([one(t) for t in batch], columns=names)
            yield found[names].reset_index(drop=True)

    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), run(F.col(text)).alias("found"))
    return whole.select("row.*", "found.*")
