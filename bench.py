"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodquarry.plans.session import build_session  # noqa: E402

HEADLINE = [
    "clean_text", "score_sentiment", "score_posts", "score_emotion", "analyze_full", "analyze_table", "score_sentiment_large_lexicon",
    "map_back", "score_with_cache", "tokenize", "build_vocab", "encode", "screen_text", "match_keywords",
    "hourly_source_stats", "hourly_stats", "daily_emotion", "realtime_view", "trending_hashtags", "top_keywords",
    "sentiment_distribution", "batch_summary", "user_stats", "user_activity", "job_counters", "best_epoch", "profile_columns",
    "attach_authors", "upsert_hourly", "insert_new", "dedup_text", "dedup_key", "stratified_split", "split_metadata",
    "top_n_per_group", "history", "job_metrics", "evaluate", "class_metrics", "apply_model", "trend_windows", "trend_stream",
    "score_stream", "dedup_stream", "read_text_csv", "prepare_dataset", "train_two_heads",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    from moodquarry.queries import QUERIES, load_all
    from moodquarry.queries.tables import common_lexicons, lexicons

    load_all()
    lexicons(spark, sf)  # inputs of the scoring queries
    common_lexicons(spark, sf)
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The first run of a query also compiles its code.
        times[name] = round(min(runs), 3)
    texts = spark.read.parquet(f"{sf}/documents.parquet").count()
    posts = spark.read.parquet(f"{sf}/events.parquet").count()
    line = {
        "metric": "total seconds of the headline queries, better of two runs each",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "texts_per_second": {"score_posts": round(posts / times["score_posts"]), "score_sentiment": round(texts / times["score_sentiment"]), "analyze_full": round(texts / times["analyze_full"])},
    }
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
