"""The canonical relations and the adapters that make them from plain tables.

comments(url, pos, author, text, us, likes, source, action): one row per comment or event. `us` is the
event time in microseconds since 1970 without any zone, null where a time is missing or unreadable;
`pos` breaks ties of time. posts(url, pos, source, text, us, reactions, comments_count, shares).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

COMMENT = T.StructType([T.StructField("author", T.StringType()), T.StructField("text", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("likes", T.LongType())])

POST = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("source", T.StringType()), T.StructField("source_handle", T.StringType()),
    T.StructField("source_category", T.StringType()), T.StructField("source_ciudad", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("timestamp_raw", T.StringType()), T.StructField("reactions", T.LongType()),
    T.StructField("comments_count", T.LongType()), T.StructField("shares", T.LongType()), T.StructField("engagement_total", T.LongType()),
    T.StructField("scraped_at", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("post_type", T.StringType()),
    T.StructField("query", T.StringType()), T.StructField("comments", T.ArrayType(COMMENT)),
])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def parsed_micros(text: Column) -> Column:
    """ISO text, or ten or more epoch digits; null where neither."""
    epoch = F.when(text.rlike(r"^\d{10,}$"), text.cast("double").cast("long") * 1_000_000)
    naive = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")
    return F.coalesce(epoch, micros(naive.try_cast("timestamp_ntz")))


def comments_of(posts: DataFrame) -> DataFrame:
    """Explodes the nested comments of posts; an author that is missing is "?"."""
    c = posts.select("url", "source", F.posexplode("comments").alias("pos", "c"))
    return c.select("url", "pos", F.coalesce(F.nullif(F.trim("c.author"), F.lit("")), F.lit("?")).alias("author"), F.coalesce("c.text", F.lit("")).alias("text"), parsed_micros(F.col("c.timestamp")).alias("us"), F.coalesce("c.likes", F.lit(0)).alias("likes"), "source", F.lit("comment").alias("action"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Saved posts: JSON arrays of objects or line-delimited objects, with a fixed schema; bad rows are dropped."""
    posts = spark.read.schema(POST).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return posts.withColumn("us", parsed_micros(F.coalesce("timestamp", "timestamp_raw")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_comments(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_comments(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as comments: a thread is an event type and the key in props."""
    url = F.concat_ws("#", "event_type", F.get_json_object("props", "$.k"))
    return e.select(url.alias("url"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("author"), F.lit("").alias("text"), micros(F.col("ts")).alias("us"), F.col("value").cast("int").alias("likes"), F.col("event_type").alias("source"), F.col("event_type").alias("action"))


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the event stream as posts: reactions are clicks and views' values, comments other events, shares sign-ups."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    kind = lambda *names: F.count_if(F.col("event_type").isin(*names))
    return e.groupBy(F.col("k").alias("url")).agg(
        F.min("event_id").alias("pos"), F.min_by("event_type", "event_id").alias("source"), F.min(micros(F.col("ts"))).alias("us"),
        kind("click", "view").alias("reactions"), kind("error", "purchase").alias("comments_count"), kind("signup").alias("shares"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of their sources, one author per source and language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("url"), F.col("doc_id").alias("pos"), F.concat_ws("/", "source", "lang").alias("author"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("long").alias("us"), F.col("n_chars").cast("int").alias("likes"), "source", F.lit("comment").alias("action"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as comments: a conversation is a thread, a role an author."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("url"), F.col("turn").alias("pos"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("long").alias("us"), F.lit(0).alias("likes"), F.col("role").alias("source"), F.lit("comment").alias("action"))
