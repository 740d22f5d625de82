"""Streams over the given tables; each is drained and must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import classify, filters
from parlance.plans.classify_queries import labelled_texts
from parlance.plans.inputs import DATED, MESSAGES, POSTS, REPEATED_POSTS, r6, repeated_posts, table, with_ctes
from parlance.plans.registry import query
from parlance.plans.text_queries import STOPWORDS, normal_ctes
from parlance.session import scratch_path
from parlance.streaming import streams


def events_stream(spark, sf):
    """The events table as a stream of posts."""
    schema = table(spark, sf, "events").schema
    rows = streams.read_table_stream(spark, f"{sf}/events.parquet", schema)
    return rows.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("group_name"), streams.as_moment("ts").alias("ts"),
        F.col("value").alias("score"),
    )


def documents_stream(spark, sf):
    """The documents table as a stream of messages."""
    schema = table(spark, sf, "documents").schema
    i = F.col("doc_id")
    return streams.read_table_stream(spark, f"{sf}/documents.parquet", schema).select(
        i.alias("id"), F.col("source").alias("group_name"), "text", "lang",
        (F.lit(1704067200) + (i * 7919 % 366) * 86400 + (i * 104729 % 86400)).alias("timestamp"),
    )


@query(
    "k01_incremental_ingest",
    with_ctes(
        MESSAGES,
        normal_ctes("messages", 'id, group_name, "timestamp"'),
        select="""SELECT id, group_name, clean_text, month(make_timestamp("timestamp" * 1000000)) AS month FROM normal
        WHERE length(clean_text) > 20""",
    ),
)
def _(spark, sf):
    path, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    for _run in range(2):  # the second run finds nothing new
        streams.ingest(
            documents_stream(spark, sf), "text", "timestamp", path, state, STOPWORDS, spark.sparkContext.defaultParallelism
        )
    return spark.read.parquet(path).select("id", "group_name", "clean_text", "month")


@query("k02_stream_duplicates", with_ctes(REPEATED_POSTS, select="SELECT DISTINCT id, group_name FROM repeated_posts"))
def _(spark, sf):
    source, path = scratch_path(spark, "repeated"), scratch_path(spark, "unique")
    rows = repeated_posts(spark, sf).select("id", "group_name", streams.as_moment("ts").alias("ts"))
    rows.write.parquet(source)
    unique = streams.drop_duplicates(streams.read_stream(spark, source, rows.schema), "ts", ["id", "group_name"], "1 hour")
    streams.drain(unique, scratch_path(spark, "state"), streams.batch_writer(path))
    return streams.read_appended(spark, path, rows.schema).select("id", "group_name")


ARRIVALS = """arrivals AS (SELECT id, group_name, ts, id % 5 AS file FROM repeated_posts),
  marks AS (SELECT file, (SELECT max(ts) FROM arrivals b WHERE b.file < a.file) - INTERVAL 6 HOUR AS mark FROM (SELECT DISTINCT file FROM arrivals) a),
  judged AS (SELECT id, group_name, ts, a.file, mark IS NOT NULL AND date_trunc('milliseconds', ts) < date_trunc('milliseconds', mark) AS late
    FROM arrivals a JOIN marks USING (file)),
  fates AS (SELECT id, group_name, CASE WHEN late THEN 'late' WHEN row_number() OVER (PARTITION BY id, group_name, late ORDER BY ts) = 1 THEN 'first'
    ELSE 'repeated' END AS fate FROM judged)"""


@query("k02_late_and_repeated", with_ctes(REPEATED_POSTS, ARRIVALS, select='SELECT id, group_name, fate, count(*) AS "rows" FROM fates GROUP BY 1, 2, 3'))
def _(spark, sf):
    """Posts arrive in five files, each of which spans all days; only the last six hours before the newest row seen are in time."""
    source, path, state = (scratch_path(spark, n) for n in ("arriving", "sorted-out", "state"))
    rows = repeated_posts(spark, sf).select("id", "group_name", streams.as_moment("ts").alias("ts"))
    for file in range(5):
        rows.filter(F.col("id") % 5 == file).coalesce(1).write.mode("append").parquet(source)
        arriving = streams.read_stream(spark, source, rows.schema)
        judged = streams.sort_out(arriving, "ts", ["id", "group_name"], "6 hours")
        streams.drain(judged, state, streams.batch_writer(path, ["fate"]), one_batch=True)
    return spark.read.parquet(path).groupBy("id", "group_name", "fate").agg(F.count("*").alias("rows"))


def _counts(name, width, offset, start_sql):
    @query(
        name,
        with_ctes(POSTS, select=f"""SELECT strftime({start_sql}, '%Y-%m-%d') AS window_start, group_name, count(*) AS "rows"
        FROM posts GROUP BY 1, 2"""),
    )
    def _(spark, sf):
        path = scratch_path(spark, "counts")
        counts = streams.tumbling_counts(events_stream(spark, sf), "ts", ["group_name"], "2 days", width, offset)
        streams.drain(counts, scratch_path(spark, "state"), streams.batch_writer(path), "update")
        latest = streams.read_updated(spark, path, ["window_start", "group_name"])
        return latest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


_counts("k03_daily_counts", "1 day", None, "CAST(ts AS DATE)")
_counts("k03_weekly_counts", "7 days", "4 days", "date_trunc('week', ts)")


@query(
    "k04_sliding_mean",
    with_ctes(
        POSTS,
        select=f"""SELECT strftime(CAST(ts AS DATE) - k, '%Y-%m-%d') AS window_start, group_name, {r6('avg(score)')} AS mean_score,
        count(*) AS "rows" FROM posts, (SELECT CAST(unnest(range(7)) AS INTEGER) AS k) GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "means")
    means = streams.sliding_mean(events_stream(spark, sf), "ts", ["group_name"], "score", "2 days")
    streams.drain(means, scratch_path(spark, "state"), streams.batch_writer(path), "update")
    latest = streams.read_updated(spark, path, ["window_start", "group_name"])
    return latest.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "group_name",
        rounded(F.col("mean_score")).alias("mean_score"), "rows",
    )


@query(
    "k05_stream_inference",
    with_ctes(MESSAGES, DATED, select="SELECT year, month, count(*) AS n, count(*) AS predicted FROM dated GROUP BY 1, 2"),
)
def _(spark, sf):
    stages = [*classify.text_features("text", 1 << 12), classify.logistic_regression(table(spark, sf, "labels").count(), max_iter=10)]
    model = classify.fit_pipeline(labelled_texts(spark, sf), stages)
    path = scratch_path(spark, "stream-predicted")
    arriving = filters.add_period(documents_stream(spark, sf).withColumn("text", F.coalesce("text", F.lit(""))))
    streams.infer(arriving, model, ["clean", "toxic"], "predicted", path, scratch_path(spark, "state"))
    return spark.read.parquet(path).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.count_if(F.col("predicted").isin("clean", "toxic")).alias("predicted")
    )
