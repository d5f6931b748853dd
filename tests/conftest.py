import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodquarry.plans.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def frame(spark):
    """frame(schema, rows) -> DataFrame"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture
def value(spark):
    """The values of one expression over rows of one text column t."""

    def run(expression, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [row[0] for row in df.orderBy("i").select(expression).collect()]

    return run


@pytest.fixture
def lexicons(frame):
    mood = frame(
        "term string, valence double",
        [("love", 3.0), ("great", 3.1), ("amazing", 2.8), ("happy", 2.7), ("good", 1.9), ("hate", -2.7), ("terrible", -2.1),
         ("awful", -2.0), ("worst", -3.1), ("bad", -2.5)],
    )
    feeling = frame(
        "term string, emotion string, weight double",
        [("love", "joy", 2.0), ("happy", "joy", 1.0), ("hate", "anger", 1.0), ("terrible", "fear", 1.0), ("awful", "disgust", 1.0),
         ("terrible", "sadness", 1.0)],
    )
    return mood, feeling
