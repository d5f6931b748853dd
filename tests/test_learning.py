import math

import pandas as pd
import pytest
from pyspark.sql import types as T

from moodquarry.operators import learning as L


def test_two_heads_learn(frame):
    words = {"positive": ("sunny bright smile", "joy"), "negative": ("storm broken tears", "sadness"), "neutral": ("table chair desk", "neutral")}
    rows = [(i, f"{w} number{i % 5}", s, e) for i in range(60) for s, (w, e) in words.items()]
    df = frame("id int, text string, sentiment string, emotion string", rows)
    model = L.train_two_heads(df.where("id < 45"), df.where("id >= 45"), num_features=256, max_iter=15)
    assert len(model.history) == 2 and min(h["sentiment_acc"] for h in model.history) == 1.0
    out = L.predict(model, frame("text string", [("sunny smile",), ("broken storm",)])).collect()
    assert [(r.sentiment_prediction, r.emotion_prediction) for r in out] == [("positive", "joy"), ("negative", "sadness")]
    assert abs(sum(out[0].sentiment_scores.values()) - 1) < 1e-9 and len(out[0].emotion_scores) == 7
    assert out[0].sentiment_confidence == max(out[0].sentiment_scores.values())


def test_evaluate_by_hand(frame):
    df = frame("sentiment string, sentiment_prediction string, sentiment_p double, emotion string, emotion_prediction string, emotion_p double",
               [("a", "a", 0.5, "x", "y", 0.25), ("b", "a", 0.25, "x", "x", 0.5)])
    row = L.evaluate(df).first()
    ce = (math.log(2) + math.log(4)) / 2
    assert abs(row.val_loss - 1.5 * ce) < 1e-12 and (row.sentiment_acc, row.emotion_acc, row.n) == (0.5, 0.5, 2)
    assert L.evaluate(df.limit(0)).first().sentiment_acc == 0.0


def test_class_metrics_of_missing_classes(frame):
    df = frame("y string, p string", [("a", "a"), ("a", "b"), ("never predicted", "a"), ("a", "a")])
    rows = {r["class"]: r for r in L.class_metrics(df, "y", "p").collect()}
    assert (rows["a"].precision, rows["a"].recall) == (2 / 3, 2 / 3)
    assert rows["never predicted"].f1 == 0.0 and rows["b"].recall == 0.0 and rows["b"].support == 0
    assert rows["macro"].support == 4 and abs(rows["weighted"].f1 - 0.75 * 2 / 3) < 1e-12


SCHEMA = T.StructType([T.StructField("label", T.StringType())])


def test_apply_model_marks_only_failing_rows(frame):
    def loader():
        def model(texts):
            if (texts == "bad").any():
                raise ValueError("bad")
            return pd.DataFrame({"label": texts.str.upper()})

        return model

    df = frame("id int, text string", [(1, "a"), (2, "bad"), (3, "c")]).coalesce(1)
    rows = L.apply_model(df, loader, SCHEMA, error={"label": "error"}).orderBy("id").collect()
    assert [r.label for r in rows] == ["A", "error", "C"]
    with pytest.raises(Exception):
        L.apply_model(df, loader, SCHEMA).collect()
