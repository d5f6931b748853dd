"""Sources, sinks and whole jobs, as round trips through the shared folder."""

from pyspark.sql import functions as F

from moodquarry.operators import stats as ST
from moodquarry.plans import flows
from moodquarry.plans.scratch import new_folder
from moodquarry.queries import query
from moodquarry.queries.aggregates import UPSERTED, hourly_rows
from moodquarry.queries.scoring import _both_sql, _turns
from moodquarry.queries.tables import (
    END, START, STAND_IN_RULES, epochs, lexicons, ntz, posts, samples, sql, sql_strip, stamp, table,
)
from moodquarry.operators import jobs as J
from moodquarry.sinks import batches as B
from moodquarry.sinks import files as W
from moodquarry.sources import files as R
from moodquarry.sources.search_pages import flatten_search_pages


@query("read_text_csv", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text AS Content FROM conversations")
def read_text_csv(spark, sf):
    path = new_folder(spark, "csv")
    W.write_result_csv(table(spark, sf, "conversations").withColumnRenamed("text", "Content"), path)
    df, name = R.read_text_csv(spark, path)
    assert name == "Content"
    return df


@query("write_result_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def write_result_csv(spark, sf):
    path = new_folder(spark, "csv")
    W.write_result_csv(table(spark, sf, "documents"), path)
    return R.read_csv(spark, path)


@query("read_dataset", "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations")
def read_dataset(spark, sf):
    path = new_folder(spark, "lines") + ".jsonl"
    table(spark, sf, "conversations").write.json(path)
    lines = R.read_dataset(spark, path).select("conv_id", "turn", "role", "text")
    return R.read_dataset(spark, f"{sf}/conversations.parquet").unionByName(lines)


@query(
    "read_sample_tree",
    sql(
        "samples",
        """SELECT text, sentiment, emotion, source FROM samples
           UNION ALL SELECT text, NULL, NULL, 'streamed' FROM conversations""",
    ),
)
def read_sample_tree(spark, sf):
    root = new_folder(spark, "tree")
    samples(spark, sf).drop("doc_id").write.partitionBy("sentiment").parquet(f"{root}/partitioned")
    spark.read.parquet(f"{root}/partitioned").write.parquet(f"{root}/static/deep/er")
    table(spark, sf, "conversations").select("text").write.parquet(f"{root}/streamed/2024")
    return R.read_sample_tree(spark, [f"{root}/static", f"{root}/streamed"], None)


@query("count_by_directory", "SELECT source, 1 AS n_files, count(*) AS n_rows, true AS has_bytes FROM documents GROUP BY source")
def count_by_directory(spark, sf):
    path = new_folder(spark, "tree")
    table(spark, sf, "documents").repartition("source").write.partitionBy("source").parquet(path)
    found = R.count_by_directory(spark.read.parquet(path))
    source = F.regexp_extract("directory", "source=(.*)$", 1).alias("source")
    return found.select(source, F.col("n_files").cast("int").alias("n_files"), "n_rows", (F.col("n_bytes") > 100).alias("has_bytes"))


def _pages(spark, sf):
    """Pages of 100 events each; users whose id ends in 0 are missing, every third is verified."""
    e = table(spark, sf, "events").withColumn("u", F.col("user_id").cast("string"))
    post = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"), F.col("u").alias("author_id"),
        F.col("ts").cast("string").alias("created_at"), F.lit("en").alias("lang"), F.col("event_type").alias("source"),
        F.create_map(F.lit("retweet_count"), F.floor("value").cast("bigint")).alias("public_metrics"),
    )
    user = F.when(
        F.col("user_id") % 10 != 0,
        F.struct(
            F.col("u").alias("id"), F.concat(F.lit("Name "), "u").alias("name"), F.concat(F.lit("n"), "u").alias("username"),
            F.when(F.col("user_id") % 3 == 0, F.lit(True)).alias("verified"),
        ),
    )
    pages = e.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(
        F.collect_list(post).alias("data"), F.collect_set(user).alias("users")
    )
    return pages.select("data", F.struct("users").alias("includes"))


@query(
    "flatten_search_pages",
    """SELECT CAST(event_id AS VARCHAR) AS id, props AS text, event_type AS source,
              CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS author_id,
              CASE WHEN user_id % 10 <> 0 THEN 'n' || user_id END AS username,
              user_id % 10 <> 0 AND user_id % 3 = 0 AS verified,
              CAST(floor(value) AS BIGINT) AS retweets, CAST(0 AS BIGINT) AS likes FROM events""",
)
def search_pages(spark, sf):
    df = flatten_search_pages(_pages(spark, sf))
    return df.select("id", "text", "source", "author_id", "username", "verified", "retweets", "likes")


@query(
    "write_partitioned",
    sql(
        "posts",
        """SELECT id, source, strftime(created_at, '%Y-%m-%d') AS date, CAST(hour(created_at) AS INT) AS hour, sentiment FROM posts""",
    ),
)
def write_partitioned(spark, sf):
    path = new_folder(spark, "posts")
    W.write_partitioned(posts(spark, sf).select("id", "source", "created_at", "sentiment"), path)
    return spark.read.parquet(path).select("id", "source", F.col("date").cast("string").alias("date"), "hour", "sentiment")


@query(
    "pruned_read",
    sql("posts", "SELECT id, sentiment FROM posts WHERE source = 'reddit' AND CAST(created_at AS DATE) = DATE '2024-01-07'"),
)
def pruned_read(spark, sf):
    """A read of the post archive that opens only the folders of one source and day."""
    path = new_folder(spark, "posts")
    W.write_partitioned(posts(spark, sf).select("id", "source", "created_at", "sentiment"), path, ["source", "date"])
    day = F.col("date") == F.lit("2024-01-07").cast("date")
    return spark.read.parquet(path).where((F.col("source") == "reddit") & day).select("id", "sentiment")


@query("batch_writer", sql("posts", "SELECT id, source, sentiment, CAST(id % 2 AS INT) AS batch_id FROM posts"))
def batch_writer(spark, sf):
    """Two batches, the second delivered twice, into two sinks."""
    root = new_folder(spark, "batches")
    write = B.make_batch_writer([B.parquet_sink(f"{root}/a", ["source", "date"]), B.table_sink(f"{root}/b")])
    p = posts(spark, sf).select("id", "source", "created_at", "sentiment")
    for batch in (0, 1, 1):
        write(p.where(F.col("id") % 2 == batch), batch)
    write(p.where("id < 0"), 2)
    one, two = (spark.read.parquet(f"{root}/{x}").select("id", "source", "sentiment", "batch_id") for x in "ab")
    return one.join(two, ["id", "source", "sentiment", "batch_id"])


@query(
    "write_upsert",
    sql(
        "posts",
        f"""SELECT * , CASE WHEN hour_bucket >= TIMESTAMP '{START}' OR hour(hour_bucket) % 3 = 2 THEN strftime(hour_bucket, '%Y-%m-%d')
                       WHEN hour(hour_bucket) % 3 = 1 THEN 'early' ELSE 'none' END AS day FROM ({UPSERTED})""",
    ),
)
def write_upsert(spark, sf):
    """The hourly table on disk, renewed from START on. Some old rows lie in other folders than new ones of their key, or in that of null."""
    path, day = new_folder(spark, "hourly"), F.date_format("hour_bucket", "yyyy-MM-dd")
    old = hourly_rows(posts(spark, sf).where(F.col("created_at") < stamp(END))).withColumn("total_count", -F.col("total_count"))
    third = F.hour("hour_bucket") % 3
    old = old.withColumn("day", F.when(third == 1, "early").when(third == 2, day))
    old.write.partitionBy("day").parquet(path)
    fresh = hourly_rows(posts(spark, sf).where(F.col("created_at") >= stamp(START))).withColumn("day", day)
    W.write_upsert(spark, path, fresh.unionByName(fresh), ["source", "hour_bucket"], "day")
    return spark.read.schema(old.schema).parquet(path).withColumn("day", F.coalesce("day", F.lit("none")))


@query(
    "prepare_dataset",
    sql(
        "samples",
        """SELECT 'split' AS metric, split AS key, count(*) AS count FROM parts GROUP BY split
           UNION ALL SELECT 'source', source, count(*) FROM samples GROUP BY source""",
        trimmed=f"SELECT {sql_strip('text')} AS text, sentiment FROM samples WHERE sentiment IS NOT NULL AND length({sql_strip('text')}) > 3",
        dedup="SELECT sha256(text) AS text_hash, min(sentiment) AS sentiment FROM trimmed GROUP BY text",
        parts="""SELECT CASE WHEN n < 10 OR r <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                             WHEN r <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
                 FROM (SELECT count(*) OVER (PARTITION BY sentiment) AS n,
                              row_number() OVER (PARTITION BY sentiment ORDER BY md5(text_hash || ':42')) AS r FROM dedup)""",
    ),
)
def prepare_dataset(spark, sf):
    root = new_folder(spark, "raw")
    # Copies share one label, so that which copy is kept does not matter here.
    lowest = samples(spark, sf).where("sentiment IS NOT NULL").groupBy(F.md5(F.trim("text")).alias("h")).agg(F.min("sentiment").alias("one"))
    df = samples(spark, sf).withColumn("h", F.md5(F.trim("text"))).join(lowest, "h", "left")
    df.select("text", F.when(F.col("sentiment").isNotNull(), F.col("one")).alias("sentiment"), "emotion", "source").write.parquet(f"{root}/hf")
    counts = flows.prepare_dataset(spark, [f"{root}/hf"], new_folder(spark, "processed"))
    return counts.where("metric <> 'train_sentiment'")


@query("csv_to_parquet", "SELECT text, source AS split, lang AS emotion FROM documents")
def csv_to_parquet(spark, sf):
    source, target = new_folder(spark, "csv"), new_folder(spark, "parquet")
    df = table(spark, sf, "documents").withColumnsRenamed({"text": "body", "source": "split", "lang": "emotion"})
    W.write_result_csv(df, source)
    return flows.csv_to_parquet(spark, source, target, "body")


@query(
    "score_csv",
    _both_sql(
        """SELECT 'total' AS metric, 'records' AS key, count(*) AS count, CAST(NULL AS DOUBLE) AS value FROM scored
           UNION ALL SELECT 'sentiment', s, count(*) FILTER (sentiment = s), round(count(*) FILTER (sentiment = s) / count(*) * 100, 2)
           FROM scored, (SELECT unnest(['positive', 'negative', 'neutral']) AS s) GROUP BY s
           UNION ALL SELECT 'emotion', primary_emotion, count(*), round(count(*) / (SELECT count(*) FROM scored) * 100, 2)
           FROM scored GROUP BY primary_emotion""",
        rel="turns", key="id", turns="SELECT conv_id || '.' || turn AS id, role, text FROM conversations",
    ).replace("SELECT 'total' AS metric", ", scored AS (SELECT * FROM sentiments JOIN emotions USING (key))\nSELECT 'total' AS metric", 1),
)
def score_csv(spark, sf):
    source, target = new_folder(spark, "csv"), new_folder(spark, "csv")
    W.write_result_csv(_turns(spark, sf), source)
    return flows.score_csv(spark, source, target, lexicons(spark, sf), rules=STAND_IN_RULES).where("metric <> 'average'")


@query("log_runs", sql("epochs", "SELECT epoch, 'val' AS phase, val_loss, sentiment_acc, emotion_acc FROM epochs WHERE run_id = 3"))
def log_runs(spark, sf):
    """Epochs appended to the epoch table in two steps, then one run read back."""
    path = new_folder(spark, "epochs")
    df = epochs(spark, sf).withColumnRenamed("run_id", "training_run_id").withColumn("phase", F.lit("val"))
    J.log_epoch(df.where("epoch % 2 = 0"), path)
    J.log_epoch(df.where("epoch % 2 = 1"), path)
    return J.epoch_series(spark.read.parquet(path), 3)
