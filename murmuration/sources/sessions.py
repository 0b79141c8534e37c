"""Saved sessions and other files of the collection side, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.sources.tables import POST, micros, parsed_micros


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all sessions, root/slug/time/session.json, with the time from the folder's name."""
    s = spark.read.option("multiLine", True).json(f"{root}/*/*/session.json")
    at = F.regexp_extract(F.input_file_name(), r"/(\d{8}_\d{6})/", 1)
    return s.withColumn("session_us", micros(F.try_to_timestamp(F.nullif(at, F.lit("")), F.lit("yyyyMMdd_HHmmss"))))


def read_session_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of one session: posts_latest.json, else posts.json, else the newest posts_*.json."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    first = [n for n in ("posts_latest.json", "posts.json") if n in names] + sorted((n for n in names if n.startswith("posts_") and n.endswith(".json")), reverse=True)
    if not first:
        return spark.createDataFrame([], POST)
    return spark.read.schema(POST).option("multiLine", True).json(f"{folder}/{first[0]}")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets: an array of objects, or an object with `targets`."""
    kind = "array<struct<name:string,handle:string,url:string,category:string,ciudad:string>>"
    t = spark.read.option("wholetext", True).text(path)
    v = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(v, "$.targets", kind), F.try_variant_get(v, "$", kind))
    return t.select(F.explode(listed).alias("t")).select("t.*")


def read_api_bodies(spark: SparkSession, path: str) -> DataFrame:
    """API bodies as VARIANT rows: a whole body, else its lines; what is no JSON is dropped."""
    t = spark.read.option("wholetext", True).text(path)
    whole = F.try_parse_json("value")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    return t.select(F.explode(F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)).alias("body"))


def stories(bodies: DataFrame) -> DataFrame:
    """Search edges of API bodies as posts: url, source, text and time by several paths each."""
    edges = bodies.select(F.explode(F.try_variant_get("body", "$.data.serpResponse.results.edges", "array<variant>")).alias("e"))
    at = lambda *paths: F.coalesce(*[F.try_variant_get("e", p, "string") for p in paths])
    story = lambda rest: f"$.rendering_strategy.view_model.click_model.story.{rest}"
    s = edges.select(at(story("url"), "$.story.url", "$.node.url", "$.url").alias("url"), at(story("actors[0].name"), "$.story.actors[0].name", "$.node.actor.name").alias("source"), at(story("message.text"), "$.story.message.text", "$.node.message.text", "$.story.text", "$.text").alias("text"), at(story("creation_time"), "$.story.creation_time", "$.node.creation_time").alias("timestamp"))
    return s.filter(F.col("url").isNotNull()).withColumn("us", parsed_micros(F.col("timestamp")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(posts: DataFrame, path: str) -> None:
    """Posts as CSV: nested comments left out, arrays joined by a bar, structs flattened."""
    columns = []
    for name, kind in posts.dtypes:
        if kind.startswith("array<struct"):
            continue
        if kind.startswith("array"):
            columns.append(F.array_join(F.col(name).cast("array<string>"), "|").alias(name))
        elif kind.startswith("struct"):
            columns += [F.col(f"{name}.{f.name}").cast("string").alias(f"{name}_{f.name}") for f in posts.schema[name].dataType.fields]
        else:
            columns.append(F.col(name))
    posts.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_urls(posts: DataFrame, path: str) -> None:
    posts.filter(F.length(F.coalesce("url", F.lit(""))) > 0).select("url").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, most_nodes: int = 500, most_edges: int = 2000) -> None:
    """Node and edge JSON of the nodes of highest degree and the heaviest edges among them: a report, so limited."""
    top = nodes.orderBy(F.desc("degree"), "node").limit(most_nodes)
    among = edges.join(top.select(F.col("node").alias("a")), "a", "left_semi").join(top.select(F.col("node").alias("b")), "b", "left_semi")
    top.write.mode("overwrite").json(f"{path}/nodes")
    among.orderBy(F.desc("weight"), "a", "b").limit(most_edges).write.mode("overwrite").json(f"{path}/edges")


def session_rows(posts: DataFrame, session: list[str], queries: list[str], mode: str, days: int, at: str) -> DataFrame:
    """posts (label and the columns of `session`) -> a session's row: posts, negative and aggressive ones, and what was asked for when."""
    bad = F.col("label").isin("NEGATIVE", "AGGRESSIVE")
    n = posts.groupBy(*session).agg(F.count(F.lit(1)).alias("post_count"), F.count_if(F.coalesce(bad, F.lit(False))).alias("neg_count"))
    asked = F.array(*map(F.lit, queries)) if queries else F.array().cast("array<string>")
    return n.select(*session, asked.alias("queries"), F.lit(mode).alias("mode"), F.lit(at).alias("timestamp"), F.lit(days).alias("days"), "post_count", "neg_count")


def append_sessions(rows: DataFrame, path: str) -> None:
    """Adds the rows to the table of sessions; one that is written again stands twice, and the later timestamp is its state (`last_sessions`)."""
    rows.write.mode("append").parquet(path)


def last_sessions(rows: DataFrame, session: list[str]) -> DataFrame:
    """The latest row of every session."""
    last = rows.groupBy(*session).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in session]), F.struct("timestamp", "post_count", "neg_count")).alias("row"))
    return last.select(*session, "row.*")
