"""Training, prediction, evaluation, and Python models in batches."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodquarry.functions.labels import EMOTIONS, SENTIMENTS
from moodquarry.operators import learning as L
from moodquarry.operators import prepare as P
from moodquarry.plans.scratch import new_folder
from moodquarry.queries import query
from moodquarry.queries.tables import posts, r6, samples, sql, text_table


def _predictions(spark, sf):
    """Posts with a made-up prediction from their number of likes."""
    k = F.col("k")
    return posts(spark, sf).select(
        "sentiment",
        F.when(k % 7 == 0, "neutral").when(k > 45, "positive").otherwise("negative").alias("sentiment_prediction"),
        ((k + 1) / F.lit(101.0)).alias("sentiment_p"),
        F.col("source").alias("emotion"),
        F.when(k % 3 == 0, "news").otherwise("reddit").alias("emotion_prediction"),
        ((F.lit(100) - k) / F.lit(100.0)).alias("emotion_p"),
    )


_PREDICTIONS = """
    SELECT sentiment, CASE WHEN k % 7 = 0 THEN 'neutral' WHEN k > 45 THEN 'positive' ELSE 'negative' END AS sentiment_prediction,
           (k + 1) / 101.0::DOUBLE AS sentiment_p, source AS emotion,
           CASE WHEN k % 3 = 0 THEN 'news' ELSE 'reddit' END AS emotion_prediction, (100 - k) / 100.0::DOUBLE AS emotion_p FROM posts"""


@query(
    "evaluate",
    sql(
        "posts",
        """SELECT round(avg(-ln(sentiment_p)) + 0.5 * avg(-ln(greatest(emotion_p, 1e-15))), 6) AS val_loss,
                  round(count(*) FILTER (sentiment = sentiment_prediction) / count(*), 6) AS sentiment_acc,
                  round(count(*) FILTER (emotion = emotion_prediction) / count(*), 6) AS emotion_acc, count(*) AS n FROM predictions""",
        predictions=_PREDICTIONS,
    ),
)
def evaluate(spark, sf):
    return L.evaluate(_predictions(spark, sf)).select(r6("val_loss"), r6("sentiment_acc"), r6("emotion_acc"), "n")


@query(
    "class_metrics",
    sql(
        "posts",
        """SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (
               SELECT * FROM one
               UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM one
               UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), sum(precision * support) / sum(support),
                                sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM one)""",
        predictions=_PREDICTIONS,
        one="""SELECT class, support, coalesce(hit / nullif(predicted, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
                      coalesce(2 * hit / nullif(predicted + support, 0), 0) AS f1
               FROM (SELECT c AS class, count(*) FILTER (emotion = c) AS support, count(*) FILTER (emotion_prediction = c) AS predicted,
                            count(*) FILTER (emotion = c AND emotion_prediction = c) AS hit
                     FROM predictions, (SELECT unnest(['twitter', 'reddit', 'news']) AS c) GROUP BY c)""",
    ),
)
def class_metrics(spark, sf):
    df = L.class_metrics(_predictions(spark, sf), "emotion", "emotion_prediction")
    return df.select("class", "support", r6("precision"), r6("recall"), r6("f1"))


def _training(spark, sf):
    """Labelled samples, and the documents without a label as neutral ones, split by hash."""
    df = samples(spark, sf, text_table(spark, sf, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    df = P.normalize_labels(df, sentiment="sentiment", emotion="emotion")
    return P.stratified_split(df, "sentiment", "doc_id", (0.8, 0.2), 0, mode="hash")


@query("train_two_heads")
def train_two_heads(spark, sf):
    """Validation metrics of each trial."""
    df = _training(spark, sf)
    model = L.train_two_heads(df.where("split = 'train'"), df.where("split = 'val'"))
    return spark.createDataFrame(model.history).select("trial", r6("val_loss"), r6("sentiment_acc"), r6("emotion_acc"), "n")


@query("predict")
def predict(spark, sf):
    """Labels and confidences of all documents by a model trained on the labelled ones."""
    df = _training(spark, sf)
    model = L.train_two_heads(
        df.where("split = 'train'"), df.where("split = 'val'"), [{"regParam": 0.1}]
    )
    out = L.predict(model, text_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "sentiment_prediction", r6("sentiment_confidence"), "emotion_prediction", r6("emotion_confidence"))


@query("reloaded_model", "SELECT doc_id, true AS same, true AS noted FROM documents")
def reloaded_model(spark, sf):
    """Predictions of a model that was kept and read again, row by row those of the model itself."""
    df = _training(spark, sf)
    model = L.train_two_heads(df.where("split = 'train'"), df.where("split = 'val'"), [{"regParam": 0.1}], 1 << 12, 3)
    path = f"{new_folder(spark, 'model')}/two_heads"
    for _ in range(2):
        L.save_model(spark, model, path)
    again = L.load_model(spark, path)
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    shown = lambda m: L.predict(m, docs).select(
        "doc_id", F.to_json(F.struct("sentiment_prediction", "sentiment_scores", "emotion_prediction", "emotion_scores", "emotion_confidence")).alias("all")
    )
    both = shown(model).join(shown(again).withColumnRenamed("all", "other"), "doc_id")
    noted = again.history == model.history and L.best_trial(again)["trial"] == 0
    return both.select("doc_id", (F.col("all") == F.col("other")).alias("same"), F.lit(noted).alias("noted"))


_HELD = "CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT) / 4294967296.0 >= 0.8"


@query(
    "train_two_heads_counts",
    f"""SELECT unnest(range({len(L.DEFAULT_GRID)})) AS trial, (SELECT count(*) FROM documents WHERE {_HELD}) AS n, true AS sound""",
)
def train_two_heads_counts(spark, sf):
    """Each trial's validation rows, and whether its loss and shares can be such."""
    out = train_two_heads(spark, sf)
    share = lambda c: F.col(c).between(0, 1)
    return out.select("trial", "n", ((F.col("val_loss") > 0) & share("sentiment_acc") & share("emotion_acc")).alias("sound"))


@query("predict_domains", "SELECT doc_id, true AS labels, true AS confidences FROM documents")
def predict_domains(spark, sf):
    """Every document has labels of the two domains, with the confidence of a largest share."""
    out = predict(spark, sf)
    known = F.col("sentiment_prediction").isin(SENTIMENTS) & F.col("emotion_prediction").isin(EMOTIONS)
    least = lambda c, labels: F.col(c).between(1 / len(labels) - 1e-6, 1)
    return out.select(
        "doc_id", known.alias("labels"), (least("sentiment_confidence", SENTIMENTS) & least("emotion_confidence", EMOTIONS)).alias("confidences")
    )


@query(
    "apply_model",
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id + 9007199254740993 ELSE -1 END AS big, CASE WHEN n > 50000 THEN 'error' WHEN n % 3 = 0 THEN 'positive' WHEN n % 3 = 1 THEN 'negative' ELSE 'neutral' END AS label,
              CASE WHEN n > 50000 THEN 0 ELSE CAST(n % 10 AS DOUBLE) / 10 END AS score
       FROM (SELECT doc_id, length(text) AS n FROM documents)""",
)
def apply_model(spark, sf):
    """A stand-in model that refuses some texts, whose rows are marked."""

    def load():
        def model(texts: pd.Series) -> pd.DataFrame:
            n = texts.str.len()
            if (n > 50_000).any():
                raise ValueError("text too long for this model")
            label = n.map(lambda v: "positive" if v % 3 == 0 else "negative" if v % 3 == 1 else "neutral")
            return pd.DataFrame({"label": label, "score": n % 10 / 10.0})

        return model

    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    big = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") + 9007199254740993)  # neither exact nor null in a double
    df = text_table(spark, sf, "documents").select("doc_id", big.alias("big"), "text")
    return L.apply_model(df, load, schema, error={"label": "error", "score": 0.0}).drop("text").na.fill(-1, ["big"])
