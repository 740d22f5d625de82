"""Joins and lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import filters, joins
from parlance.plans.inputs import (
    GRID_RESULTS,
    MACRO_MAP,
    MESSAGES,
    POST_TOPICS,
    POSTS,
    grid_results,
    macro_map,
    messages,
    post_topics,
    posts,
    r6,
    table,
    with_ctes,
)
from parlance.plans.registry import query


@query(
    "d01_stratum_size",
    with_ctes(
        MESSAGES,
        """strata AS (SELECT id, concat_ws('_', month(make_timestamp("timestamp" * 1000000)), group_name) AS strat_key
        FROM messages)""",
        select="""SELECT s.id, s.strat_key, c.n AS stratum_size FROM strata s
        JOIN (SELECT strat_key, count(*) AS n FROM strata GROUP BY 1) c ON s.strat_key = c.strat_key""",
    ),
)
def _(spark, sf):
    keyed = filters.add_stratum(filters.add_period(messages(spark, sf)), ["month", "group_name"])
    return joins.with_stratum_size(keyed, "strat_key").select("id", "strat_key", "stratum_size")


@query(
    "d02_keep_sampled_keys",
    with_ctes(
        MESSAGES,
        select="""SELECT id, group_name, lang FROM messages m WHERE EXISTS (
        SELECT 1 FROM labels l WHERE l.doc_id = m.id)""",
    ),
)
def _(spark, sf):
    base = messages(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    ids = base.join(labelled, "id").select("id", "group_name")
    return joins.keep_keys(base, ids, ["id", "group_name"]).select("id", "group_name", "lang")


@query(
    "d03_join_labels",
    with_ctes(
        MESSAGES,
        select="""SELECT m.id, m.group_name, l.quality, l.toxic FROM messages m
        JOIN (SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE toxic = 1) l ON m.id = l.doc_id""",
    ),
)
def _(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    labels = labels.unionByName(labels.filter("toxic = 1"))
    return joins.join_labels(messages(spark, sf), labels, ["id"]).select("id", "group_name", "quality", "toxic")


LOG_METRICS = """log_metrics AS (SELECT embedding_model, n_neighbors::DOUBLE AS n_neighbors,
  min_cluster_size::DOUBLE AS min_cluster_size, n_topics * 2 AS n_outliers FROM grid_results)"""


@query(
    "d04_grid_with_log",
    with_ctes(
        GRID_RESULTS,
        LOG_METRICS,
        select="""SELECT g.embedding_model, g.n_neighbors, g.min_cluster_size, g.n_topics,
        coalesce(l.n_outliers, -1) AS n_outliers FROM grid_results g LEFT JOIN log_metrics l
        ON g.embedding_model = l.embedding_model AND g.n_neighbors = l.n_neighbors
        AND g.min_cluster_size = l.min_cluster_size""",
    ),
)
def _(spark, sf):
    grid = grid_results(spark, sf).select("embedding_model", "n_neighbors", "min_cluster_size", "n_topics")
    log = grid.select(
        "embedding_model",
        F.col("n_neighbors").cast("double"),
        F.col("min_cluster_size").cast("string"),
        (F.col("n_topics") * 2).alias("n_outliers"),
    )
    keys = ["embedding_model", "n_neighbors", "n_components", "min_cluster_size"]
    return joins.join_on_shared(grid, log, keys).fillna(-1, ["n_outliers"])


@query(
    "d05_outer_counts",
    with_ctes(
        POSTS,
        select="""SELECT strftime(coalesce(t.day, k.day), '%Y-%m-%d') AS day, coalesce(total, 0) AS total,
        coalesce(kept, 0) AS kept FROM
        (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM posts GROUP BY 1) t FULL JOIN
        (SELECT CAST(ts AS DATE) AS day, count(*) AS kept FROM posts WHERE group_name = 'click' GROUP BY 1) k ON t.day = k.day""",
    ),
)
def _(spark, sf):
    dated = posts(spark, sf).withColumn("day", F.col("ts").cast("date"))
    total = dated.groupBy("day").agg(F.count("*").alias("total"))
    kept = dated.filter(F.col("group_name") == "click")
    kept = kept.groupBy("day").agg(F.count("*").alias("kept"))
    return joins.outer_counts(total, kept, "day").withColumn("day", F.col("day").cast("string"))


@query(
    "d06_drop_done",
    with_ctes(MESSAGES, select="SELECT id, group_name FROM messages WHERE id NOT IN (SELECT doc_id FROM labels)"),
)
def _(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return joins.drop_keys(messages(spark, sf), done, ["id"]).select("id", "group_name")


@query(
    "d07_macro_topics",
    with_ctes(
        POST_TOPICS,
        MACRO_MAP,
        select="""SELECT id, group_name, topic, coalesce(macro, 'none') AS macro_topic,
        coalesce(CASE WHEN macro = 'OUTLIERS' THEN 'Outliers' WHEN is_political THEN 'Politic'
        WHEN NOT is_political THEN 'Non Politic' END, 'none') AS political_category FROM (
        SELECT p.id, p.group_name, p.topic, m.is_political,
        CASE WHEN p.topic = -1 THEN 'OUTLIERS' ELSE m.macro_topic END AS macro
        FROM post_topics p LEFT JOIN macro_map m ON p.topic = m.topic)""",
    ),
)
def _(spark, sf):
    lookup = macro_map(spark, sf)
    macro_flags = lookup.groupBy("macro_topic").agg(F.first("is_political").alias("is_political"))
    mapped = joins.map_macro_topics(post_topics(spark, sf), lookup.select("topic", "macro_topic"), macro_flags)
    filled = mapped.fillna("none", ["macro_topic", "political_category"])
    return filled.select("id", "group_name", "topic", "macro_topic", "political_category")


@query(
    "d08_topic_by_text",
    """SELECT d.doc_id AS id, coalesce(u.topic, -1) AS topic FROM documents d LEFT JOIN
    (SELECT text, min(doc_id) AS topic FROM documents JOIN labels USING (doc_id) GROUP BY text) u
    ON d.text = u.text""",
)
def _(spark, sf):
    docs = messages(spark, sf)
    labelled = docs.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")
    unique = labelled.groupBy("text").agg(F.min("id").alias("topic"))
    return joins.lookup_by_text(docs, unique, "text", "topic").fillna(-1, ["topic"]).select("id", "topic")


ALIGNMENT_PAIR = """a AS (SELECT event_id AS id, event_type AS label, CASE WHEN value > 2 THEN value END AS score
  FROM events), b AS (SELECT event_id AS id, CASE WHEN value > 20 THEN 'other' ELSE event_type END AS label,
  CASE WHEN value > 2 AND event_type <> 'click' THEN value END AS score FROM events WHERE event_type <> 'view')"""


def alignment_pair(spark, sf):
    events = table(spark, sf, "events")
    i, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    left = events.select(i.alias("id"), F.col("event_type").alias("label"), F.when(v > 2, v).alias("score"))
    right = events.filter(kind != "view").select(
        i.alias("id"),
        F.when(v > 20, "other").otherwise(kind).alias("label"),
        F.when((v > 2) & (kind != "click"), v).alias("score"),
    )
    return left, right


@query(
    "d09_count_differences",
    with_ctes(
        ALIGNMENT_PAIR,
        """j AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(a.label = b.label, false)) AS d1,
        count(*) FILTER (NOT coalesce(a.score = b.score, false)) AS d2 FROM a JOIN b ON a.id = b.id)""",
        select="""SELECT n AS "rows", 'label' AS "column", d1 AS differences FROM j
        UNION ALL SELECT n, 'score', d2 FROM j""",
    ),
)
def _(spark, sf):
    return joins.count_differences(*alignment_pair(spark, sf), ["id"])


@query(
    "d09_count_differences_null_safe",
    with_ctes(
        ALIGNMENT_PAIR,
        """j AS (SELECT count(*) AS n, count(*) FILTER (a.label IS DISTINCT FROM b.label) AS d1,
        count(*) FILTER (a.score IS DISTINCT FROM b.score) AS d2 FROM a JOIN b ON a.id = b.id)""",
        select="""SELECT n AS "rows", 'label' AS "column", d1 AS differences FROM j
        UNION ALL SELECT n, 'score', d2 FROM j""",
    ),
)
def _(spark, sf):
    return joins.count_differences(*alignment_pair(spark, sf), ["id"], null_safe=True)


@query(
    "d10_key_difference",
    """SELECT CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right' ELSE 'both' END AS side,
    count(*) AS "rows" FROM (SELECT doc_id AS id FROM labels) l
    FULL JOIN (SELECT vec_id AS id FROM embeddings) r ON l.id = r.id GROUP BY 1""",
)
def _(spark, sf):
    left = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    right = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return joins.key_difference(left, right, ["id"])


@query(
    "d11_parameter_grid",
    """SELECT * FROM (SELECT DISTINCT p_size AS n_neighbors FROM part)
    CROSS JOIN (SELECT DISTINCT p_type AS metric FROM part) CROSS JOIN (SELECT DISTINCT p_brand AS model FROM part)""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    lists = parts.agg(F.collect_set("p_type").alias("metric"), F.collect_set("p_brand").alias("model"))
    return joins.spread_grid(parts.select(F.col("p_size").alias("n_neighbors")).distinct(), lists)


FOLD_SCORES = """fold_scores AS (SELECT concat(l_returnflag, l_linestatus, '_', l_linenumber % 2) AS model,
  CAST(l_orderkey % 5 + 1 AS INTEGER) AS fold,
  CAST(sum(CAST(floor(l_discount * 100 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / count(*)::DOUBLE AS accuracy,
  CAST(sum(CAST(floor(l_tax * 100 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / count(*)::DOUBLE AS f1_macro
  FROM lineitem GROUP BY 1, 2)"""


def fold_scores(spark, sf):
    """Line items as experiment log: one row per model and fold with two metrics."""
    n = F.count(F.lit(1))
    model = F.concat("l_returnflag", "l_linestatus", F.lit("_"), (F.col("l_linenumber") % 2).cast("string"))
    return table(spark, sf, "lineitem").groupBy(
        model.alias("model"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("fold")
    ).agg(
        (F.sum(F.floor(F.col("l_discount") * 100 + 0.5)) / n).alias("accuracy"),
        (F.sum(F.floor(F.col("l_tax") * 100 + 0.5)) / n).alias("f1_macro"),
    )


@query(
    "d12_model_pairs",
    with_ctes(
        FOLD_SCORES,
        select=f"""SELECT a.fold, a.model AS model_a, b.model AS model_b, {r6('a.accuracy')} AS accuracy_a,
        {r6('b.accuracy')} AS accuracy_b FROM fold_scores a JOIN fold_scores b
        ON a.fold = b.fold AND a.model < b.model""",
    ),
)
def _(spark, sf):
    pairs = joins.model_pairs(fold_scores(spark, sf).drop("f1_macro"))
    return pairs.withColumns({c: rounded(F.col(c)) for c in ("accuracy_a", "accuracy_b")})


@query(
    "d13_enrich_predictions",
    with_ctes(
        MESSAGES,
        select="""SELECT m.id, m.group_name, m.lang, e.label AS predicted FROM embeddings e
        JOIN messages m ON e.vec_id = m.id""",
    ),
)
def _(spark, sf):
    predicted = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("predicted"))
    return joins.join_labels(predicted, messages(spark, sf).select("id", "group_name", "lang"), ["id"])


@query(
    "d14_stack",
    """SELECT doc_id AS id, lang, 'none' AS role FROM documents
    UNION ALL SELECT conv_id, 'none', role FROM conversations""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role")
    return joins.stack([docs, turns]).fillna("none")
