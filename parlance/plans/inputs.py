"""Views of the given tables in the shape the message operators expect.

Every adapter exists twice, as a DataFrame and as the SQL the check uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: id, group, text, language, epoch seconds over 2024."""
    i = F.col("doc_id")
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        i.alias("id"),
        F.col("source").alias("group_name"),
        "text",
        "lang",
        (F.lit(1704067200) + (i * 7919 % 366) * 86400 + (i * 104729 % 86400)).alias("timestamp"),
    )


MESSAGES = """messages AS (SELECT doc_id AS id, source AS group_name, text, lang,
  1704067200 + (doc_id * 7919 % 366) * 86400 + (doc_id * 104729 % 86400) AS "timestamp" FROM documents)"""


def web_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages: the address, a mention, a tag and the markup in one text."""
    host = F.regexp_extract("url", r"//([^/]+)", 1)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        host.alias("group_name"),
        F.concat("url", F.lit(" @joão_"), host, F.lit(" #"), host, F.lit(" sooooo "), "html").alias("text"),
    )


WEB_MESSAGES = """web_messages AS (SELECT page_id AS id, regexp_extract(url, '//([^/]+)', 1) AS group_name,
  concat(url, ' @joão_', regexp_extract(url, '//([^/]+)', 1), ' #', regexp_extract(url, '//([^/]+)', 1),
         ' sooooo ', html) AS text FROM pages)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: id, author (missing for every 11th), group, time, score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"),
        F.col("event_type").alias("group_name"),
        "ts",
        F.col("value").alias("score"),
        "props",
    )


POSTS = """posts AS (SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id,
  event_type AS group_name, ts, value AS score, props FROM events)"""


def repeated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with every row of one kind twice."""
    base = posts(spark, sf_dir)
    return base.unionByName(base.filter(F.col("group_name") == "error"))


REPEATED_POSTS = POSTS + """, repeated_posts AS (SELECT * FROM posts UNION ALL SELECT * FROM posts WHERE group_name = 'error')"""


def post_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that have a vector, with a topic; every seventh is an outlier."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("topic")
    )
    return messages(spark, sf_dir).join(vectors, "id").select("id", "group_name", "text", "timestamp", "topic")


POST_TOPICS = MESSAGES + """, post_topics AS (SELECT m.id, m.group_name, m.text, m."timestamp",
  CAST(CASE WHEN e.vec_id % 7 = 0 THEN -1 ELSE e.label END AS INTEGER) AS topic
  FROM messages m JOIN embeddings e ON m.id = e.vec_id)"""


DATED = """dated AS (SELECT id, group_name, year(t) AS year, month(t) AS month FROM (
  SELECT id, group_name, make_timestamp("timestamp" * 1000000) AS t FROM messages))"""


def macro_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic to macro topic, political for even topics, derived from the labels in use."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(label.alias("topic")).distinct().select(
        "topic",
        F.concat(F.lit("MACRO_"), F.col("topic") % 4).alias("macro_topic"),
        (F.col("topic") % 2 == 0).alias("is_political"),
    )


MACRO_MAP = """macro_map AS (SELECT DISTINCT label AS topic, concat('MACRO_', label % 4) AS macro_topic,
  label % 2 = 0 AS is_political FROM embeddings)"""


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a label and six scores in [0, 1]."""
    i = F.col("id")
    names = {"severe_toxicity": 7, "obscene": 11, "threat": 13, "insult": 17, "identity_attack": 19}
    return posts(spark, sf_dir).select(
        "id",
        "group_name",
        "ts",
        F.concat(F.lit("macro_"), F.col("group_name")).alias("macro_topic"),
        (F.pmod(F.col("score") * 7, F.lit(100.0)) / 100).alias("toxicity"),
        *[(F.pmod(i * k, F.lit(1000)) / 1000).alias(n) for n, k in names.items()],
    )


SCORED_POSTS = POSTS + """, scored_posts AS (SELECT id, group_name, ts, concat('macro_', group_name) AS macro_topic,
  ((score * 7) % 100.0::DOUBLE) / 100.0::DOUBLE AS toxicity,
  ((id * 7) % 1000) / 1000.0::DOUBLE AS severe_toxicity, ((id * 11) % 1000) / 1000.0::DOUBLE AS obscene,
  ((id * 13) % 1000) / 1000.0::DOUBLE AS threat, ((id * 17) % 1000) / 1000.0::DOUBLE AS insult,
  ((id * 19) % 1000) / 1000.0::DOUBLE AS identity_attack FROM posts)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted class of every vector; each fifth is predicted wrongly."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        label.alias("y_true"),
        F.when(F.col("vec_id") % 5 == 0, (label + 1) % 10).otherwise(label).alias("y_pred"),
    )


PREDICTIONS = """predictions AS (SELECT vec_id AS id, label AS y_true,
  CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS y_pred FROM embeddings)"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


def grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as parameter-search results: one row per parameter tuple with three metrics.

    Metrics are ratios of whole-number sums, so they do not depend on the order of addition.
    """
    n = F.count(F.lit(1))
    size = F.col("min_cluster_size")
    cents = F.floor(F.col("l_discount") * 100 + 0.5).cast("long")
    tax = F.floor(F.col("l_tax") * 100 + 0.5).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("enc_"), F.col("l_returnflag")).alias("embedding_model"),
        F.col("l_linenumber").alias("n_neighbors"),
        F.col("l_quantity").cast("int").alias("min_cluster_size"),
    ).agg(
        (F.sum(cents) / n / 100).alias("silhouette"),
        (F.sum(tax) / n / 100).alias("diversity"),
        (F.sum(F.col("l_partkey") % 1000) / n / 1000).alias("coherence_cv"),
        n.alias("n_topics"),
    )
    failed = size % 17 == 0
    return rows.withColumns({m: F.when(~failed, F.col(m)) for m in ("silhouette", "diversity", "coherence_cv")})


GRID_RESULTS = """grid_results AS (SELECT embedding_model, n_neighbors, min_cluster_size, n_topics,
  CASE WHEN min_cluster_size % 17 <> 0 THEN a / n_topics::DOUBLE / 100::DOUBLE END AS silhouette,
  CASE WHEN min_cluster_size % 17 <> 0 THEN b / n_topics::DOUBLE / 100::DOUBLE END AS diversity,
  CASE WHEN min_cluster_size % 17 <> 0 THEN c / n_topics::DOUBLE / 1000::DOUBLE END AS coherence_cv
  FROM (SELECT concat('enc_', l_returnflag) AS embedding_model, l_linenumber AS n_neighbors,
    CAST(l_quantity AS INTEGER) AS min_cluster_size, count(*) AS n_topics,
    CAST(sum(CAST(floor(l_discount * 100 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) AS a,
    CAST(sum(CAST(floor(l_tax * 100 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) AS b,
    CAST(sum(l_partkey % 1000) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2, 3))"""


def r6(expression: str) -> str:
    """The SQL of the shared rounding rule."""
    return f"floor(({expression}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"
