"""Report queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import bitmaps, filters, reports
from parlance.plans.inputs import (
    GRID_RESULTS,
    MACRO_MAP,
    MESSAGES,
    POST_TOPICS,
    POSTS,
    REPEATED_POSTS,
    SCORED_POSTS,
    grid_results,
    macro_map,
    messages,
    post_topics,
    posts,
    r6,
    repeated_posts,
    scored_posts,
    table,
    with_ctes,
)
from parlance.plans.registry import query
from parlance.schemas import TOXICITY_SCORES
from parlance.session import scratch_path


def day_text(column):
    return F.col(column).cast("string").alias(column)


def round_all(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


@query(
    "e01_monthly_unique",
    with_ctes(
        REPEATED_POSTS,
        select="""SELECT month, count(*) AS messages FROM (SELECT DISTINCT group_name, strftime(ts, '%Y-%m') AS month, id
        FROM repeated_posts) GROUP BY month""",
    ),
)
def _(spark, sf):
    dated = repeated_posts(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return reports.monthly_unique(dated, "group_name", "month")


@query(
    "e01_unique_by_increments",
    with_ctes(
        REPEATED_POSTS,
        select="""SELECT 'day' AS level, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, group_name, count(DISTINCT id) AS messages,
          count(DISTINCT user_id) AS users FROM repeated_posts GROUP BY 2, 3
        UNION ALL SELECT 'week', CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR), group_name, count(DISTINCT id), count(DISTINCT user_id)
          FROM repeated_posts GROUP BY 2, 3
        UNION ALL SELECT 'all', 'all', group_name, count(DISTINCT id), count(DISTINCT user_id) FROM repeated_posts GROUP BY 3""",
    ),
)
def _(spark, sf):
    """Daily bitmaps filled by two increments that overlap; weeks and the whole are united from days, not counted from rows."""
    days = repeated_posts(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = None
    for number, name in (("id", "messages"), ("user_id", "users")):
        path = scratch_path(spark, f"bitmaps-{name}")
        for part in (days.filter("id % 3 > 0"), days.filter("id % 3 < 2")):
            bitmaps.add_to_bitmaps(part, ["day"], ["group_name"], number, path)
        stored = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
        levels = {"day": F.col("day"), "week": F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd"), "all": F.lit("all")}
        counts = None
        for level, period in levels.items():
            keyed = stored.withColumns({"level": F.lit(level), "period": period})
            some = bitmaps.counted(keyed, ["level", "period", "group_name"]).withColumnRenamed("n", name)
            counts = some if counts is None else counts.unionByName(some)
        found = counts if found is None else found.join(counts, ["level", "period", "group_name"], "left").fillna(0, [name])
    return found


@query(
    "e02_daily_unique",
    with_ctes(
        REPEATED_POSTS,
        select="""SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS messages FROM (
        SELECT group_name, user_id AS k, CAST(min(ts) AS DATE) AS day FROM repeated_posts GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def _(spark, sf):
    return reports.daily_unique(repeated_posts(spark, sf), "group_name", "ts", "user_id").select(day_text("day"), "messages")


@query(
    "e03_total_and_kept",
    with_ctes(
        MESSAGES,
        select="""SELECT strftime(make_timestamp("timestamp" * 1000000), '%Y-%m') AS period, count(*) AS total,
        count(*) FILTER (CAST(substr(group_name, 4) AS INTEGER) % 2 = 0) AS kept FROM messages GROUP BY 1""",
    ),
)
def _(spark, sf):
    dated = messages(spark, sf).withColumn("period", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM"))
    allowed = F.substring("group_name", 4, 10).cast("int") % 2 == 0
    return reports.total_and_kept(dated, "period", allowed)


@query(
    "e04_rows_per_month",
    with_ctes(
        MESSAGES,
        select="""SELECT year(t) AS year, month(t) AS month, count(*) AS "rows", strftime(t, '%Y-%m') AS period
        FROM (SELECT make_timestamp("timestamp" * 1000000) AS t FROM messages) GROUP BY 1, 2, 4""",
    ),
)
def _(spark, sf):
    return reports.rows_per_month(filters.add_period(messages(spark, sf)))


@query(
    "e05_distinct_keys",
    with_ctes(
        REPEATED_POSTS,
        select="""SELECT count(*) AS distinct_keys FROM (SELECT DISTINCT id, group_name FROM repeated_posts)""",
    ),
)
def _(spark, sf):
    return reports.distinct_keys(repeated_posts(spark, sf), ["id", "group_name"])


@query(
    "e06_validate_key",
    with_ctes(
        REPEATED_POSTS,
        select="""SELECT 'posts' AS name, count(*) AS "rows", CAST(sum((user_id IS NULL)::INT) AS BIGINT) AS null_parts,
        count(*) - count(DISTINCT (user_id, id)) AS duplicates, false AS valid FROM repeated_posts""",
    ),
)
def _(spark, sf):
    return reports.validate_key(repeated_posts(spark, sf), ["user_id", "id"], "posts")


@query(
    "e07_rows_and_distinct",
    with_ctes(
        POST_TOPICS,
        MACRO_MAP,
        select="""SELECT m.macro_topic, count(*) AS "rows", count(DISTINCT p.topic) AS distinct_members
        FROM post_topics p JOIN macro_map m ON p.topic = m.topic GROUP BY 1""",
    ),
)
def _(spark, sf):
    joined = post_topics(spark, sf).join(macro_map(spark, sf), "topic")
    return reports.rows_and_distinct(joined, "macro_topic", "topic")


@query(
    "e08_value_shares",
    with_ctes(
        POSTS,
        select=f"""SELECT user_id, count(*) AS n, {r6('count(*) * 100.0::DOUBLE / (SELECT count(user_id) FROM posts)')}
        AS percent FROM posts WHERE user_id IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, sf):
    return round_all(reports.value_shares(posts(spark, sf), "user_id"), "percent")


@query(
    "e09_counts_in_order",
    """SELECT n.n_name AS label, coalesce(c.n, -1) AS n FROM nation n LEFT JOIN (
    SELECT concat('NATION_', s_nationkey) AS label, count(*) AS n FROM supplier GROUP BY 1) c
    ON n.n_name = c.label""",
)
def _(spark, sf):
    order = table(spark, sf, "nation").select(F.col("n_name").alias("label"))
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("label")
    )
    return reports.counts_in_order(rows, "label", order).fillna(-1, ["n"])


@query(
    "e10_user_activity",
    with_ctes(
        REPEATED_POSTS,
        select=f"""SELECT count(*) AS messages, count(*) - count(user_id) AS without_user,
        count(DISTINCT user_id) AS users, {r6('count(user_id)::DOUBLE / count(DISTINCT user_id)')} AS mean_per_user,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM repeated_posts WHERE user_id IS NOT NULL GROUP BY user_id))
        AS max_per_user, {r6('(count(*) - count(user_id)) * 100.0::DOUBLE / count(*)')} AS percent_without_user,
        count(DISTINCT group_name) AS groups FROM repeated_posts""",
    ),
)
def _(spark, sf):
    return round_all(reports.user_activity(repeated_posts(spark, sf)), "mean_per_user", "percent_without_user")


def ordered_posts(spark, sf):
    """Orders as posts: the customer writes to the group of the order's priority."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("group_name")
    )


@query(
    "e11_bridge_users",
    with_ctes(
        "g AS (SELECT o_custkey AS user_id, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1)",
        select=f"""SELECT count(*) FILTER (k = 1) AS one_group, count(*) FILTER (k > 1) AS several_groups,
        {r6('count(*) FILTER (k > 1) * 100.0::DOUBLE / count(*)')} AS percent_several, max(k) AS max_groups FROM g""",
    ),
)
def _(spark, sf):
    rows = ordered_posts(spark, sf)
    return round_all(reports.bridge_users(rows), "percent_several")


@query(
    "e11b_bridge_users_per_group",
    with_ctes(
        "p AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS group_name FROM orders)",
        select="""SELECT group_name, count(*) AS users, count(*) FILTER (k > 1) AS shared_users FROM p
        JOIN (SELECT user_id, count(*) AS k FROM p GROUP BY 1) USING (user_id) GROUP BY 1""",
    ),
)
def _(spark, sf):
    return reports.bridge_users_per_group(ordered_posts(spark, sf))


DAILY = """daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (group_name = 'click') AS kept
  FROM posts GROUP BY 1)"""


def daily(spark, sf):
    dated = posts(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return reports.total_and_kept(dated, "day", F.col("group_name") == "click")


@query(
    "e12_series_statistics",
    with_ctes(
        POSTS,
        DAILY,
        """long AS (SELECT 'total' AS series, total AS v FROM daily WHERE day >= DATE '2024-01-08'
        UNION ALL SELECT 'kept', kept FROM daily WHERE day >= DATE '2024-01-08')""",
        select=f"""SELECT series, CAST(sum(v) AS BIGINT) AS total, {r6('avg(v)')} AS mean, {r6('var_samp(v)')} AS variance,
        {r6('stddev_samp(v)')} AS deviation FROM long GROUP BY 1""",
    ),
)
def _(spark, sf):
    stats = reports.series_statistics(daily(spark, sf), "day", "2024-01-08", ["total", "kept"])
    return round_all(stats, "mean", "variance", "deviation")


ORDER_DAYS = """SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total,
  count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders GROUP BY 1"""


@query(
    "e13_monthly_resample",
    f"""WITH d AS ({ORDER_DAYS}), m AS (SELECT date_trunc('month', day)::DATE AS month, sum(total) AS total,
    sum(kept) AS kept FROM d GROUP BY 1) SELECT strftime(s.month, '%Y-%m-%d') AS month,
    CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(kept, 0) AS BIGINT) AS kept FROM (
    SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH))::DATE
    AS month) s LEFT JOIN m ON s.month = m.month""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    days = reports.total_and_kept(
        orders.withColumn("day", F.col("o_orderdate").cast("date")), "day", F.col("o_orderstatus") == "F"
    )
    return reports.monthly_resample(days, "day", ["total", "kept"]).withColumn("month", F.col("month").cast("string"))


WEEK_SQL = "strftime(CAST(date_trunc('week', ts) AS DATE) + 6, '%Y-%m-%d')"


@query(
    "e14_weekly_counts",
    with_ctes(POSTS, select=f"""SELECT {WEEK_SQL} AS week, group_name, count(*) AS "rows" FROM posts GROUP BY 1, 2"""),
)
def _(spark, sf):
    return reports.weekly_counts(posts(spark, sf), "ts", "group_name").withColumn("week", F.col("week").cast("string"))


@query(
    "e14_weekly_pivot",
    with_ctes(
        POSTS,
        select=f"""SELECT {WEEK_SQL} AS week, count(*) FILTER (group_name = 'click') AS click,
        count(*) FILTER (group_name = 'error') AS error, count(*) FILTER (group_name = 'absent') AS absent
        FROM posts GROUP BY 1""",
    ),
)
def _(spark, sf):
    pivoted = reports.weekly_pivot(posts(spark, sf), "ts", "group_name", ["click", "error", "absent"])
    return pivoted.withColumn("week", F.col("week").cast("string"))


@query(
    "e15_weekly_mean_score",
    with_ctes(
        SCORED_POSTS,
        select=f"""SELECT week, macro_topic, {r6('avg(toxicity)')} AS mean_score FROM (SELECT DISTINCT ts, {WEEK_SQL}
        AS week, macro_topic, id, group_name, toxicity FROM (SELECT * FROM scored_posts UNION ALL
        SELECT * FROM scored_posts WHERE toxicity > 0.5)) GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    scored = scored_posts(spark, sf)
    repeated = scored.unionByName(scored.filter("toxicity > 0.5"))
    weekly = reports.weekly_mean(repeated, "ts", "macro_topic", "toxicity", ["id", "group_name"])
    return round_all(weekly, "mean_score").withColumn("week", F.col("week").cast("string"))


def _text2(expression: str) -> str:
    units = f"CAST(floor(({expression}) * 100::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    return f"concat({units} // 100, '.', lpad(CAST({units} % 100 AS VARCHAR), 2, '0'))"


@query(
    "e16_mean_deviation",
    with_ctes(
        SCORED_POSTS,
        select="SELECT macro_topic, "
        + ", ".join(
            f"concat({_text2(f'avg({s})')}, ' ± ', {_text2(f'stddev_samp({s})')}) AS {s}" for s in TOXICITY_SCORES
        )
        + " FROM scored_posts GROUP BY 1",
    ),
)
def _(spark, sf):
    return reports.mean_deviation_table(scored_posts(spark, sf), "macro_topic", TOXICITY_SCORES)


@query(
    "e17_mean_matrix",
    with_ctes(
        SCORED_POSTS,
        select="SELECT macro_topic, "
        + ", ".join(f"{r6(f'avg({s})')} AS {s}" for s in TOXICITY_SCORES)
        + " FROM scored_posts GROUP BY 1",
    ),
)
def _(spark, sf):
    matrix = reports.mean_matrix(scored_posts(spark, sf), "macro_topic", TOXICITY_SCORES, "toxicity")
    return round_all(matrix, *TOXICITY_SCORES)


@query(
    "e18_box_statistics",
    with_ctes(
        SCORED_POSTS,
        """q AS (SELECT macro_topic, count(*) AS n, quantile_cont(toxicity, 0.25) AS q1,
        quantile_cont(toxicity, 0.5) AS median, quantile_cont(toxicity, 0.75) AS q3 FROM scored_posts GROUP BY 1)""",
        """m AS (SELECT s.macro_topic, s.toxicity AS v, s.toxicity BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE
        AND q3 + (q3 - q1) * 1.5::DOUBLE AS inside, q.* EXCLUDE (macro_topic) FROM scored_posts s
        JOIN q ON s.macro_topic = q.macro_topic)""",
        select=f"""SELECT macro_topic, n, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
        {r6('min(v) FILTER (inside)')} AS whisker_low, {r6('max(v) FILTER (inside)')} AS whisker_high,
        count(*) FILTER (NOT inside) AS outliers FROM m GROUP BY macro_topic, n, q1, median, q3""",
    ),
)
def _(spark, sf):
    box = reports.box_statistics(scored_posts(spark, sf), "macro_topic", "toxicity")
    return round_all(box, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "e18_box_statistics_heavy_tail",
    f"""WITH q AS (SELECT event_type AS label, count(*) AS n, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    m AS (SELECT q.*, value AS v, value BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE AS inside
    FROM events JOIN q ON event_type = label)
    SELECT label, n, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
    {r6('min(v) FILTER (inside)')} AS whisker_low, {r6('max(v) FILTER (inside)')} AS whisker_high,
    count(*) FILTER (NOT inside) AS outliers FROM m GROUP BY label, n, q1, median, q3""",
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_type", "label")
    return round_all(reports.box_statistics(events, "label", "value"), "q1", "median", "q3", "whisker_low", "whisker_high")


@query("e19_median", f"SELECT count(value) AS n, {r6('median(value)')} AS median FROM events")
def _(spark, sf):
    return round_all(reports.median_of(table(spark, sf, "events"), "value"), "median")


@query(
    "e20_histogram",
    """SELECT CAST(least(floor((value - lo) / (hi - lo) * 30::DOUBLE) + 1, 30) AS INTEGER) AS bin, count(*) AS "rows"
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""",
)
def _(spark, sf):
    return reports.histogram(table(spark, sf, "events"), "value", 30)


DESCRIBE_SQL = f"""count(silhouette) AS count, {r6('avg(silhouette)')} AS mean, {r6('stddev_samp(silhouette)')} AS std,
  {r6('min(silhouette)')} AS min, {r6('quantile_cont(silhouette, 0.25)')} AS q1,
  {r6('quantile_cont(silhouette, 0.5)')} AS median, {r6('quantile_cont(silhouette, 0.75)')} AS q3,
  {r6('max(silhouette)')} AS max"""
DESCRIBED = ["mean", "std", "min", "q1", "median", "q3", "max"]


@query("e21_describe", with_ctes(GRID_RESULTS, select=f"SELECT {DESCRIBE_SQL} FROM grid_results"))
def _(spark, sf):
    return round_all(reports.describe(grid_results(spark, sf), "silhouette"), *DESCRIBED)


@query(
    "e21_describe_per_group",
    with_ctes(GRID_RESULTS, select=f"SELECT embedding_model, {DESCRIBE_SQL} FROM grid_results GROUP BY 1"),
)
def _(spark, sf):
    described = reports.describe(grid_results(spark, sf), "silhouette", ["embedding_model"])
    return round_all(described, *DESCRIBED)


@query(
    "e22_melt_metrics",
    with_ctes(
        GRID_RESULTS,
        select=" UNION ALL ".join(
            f"""SELECT embedding_model, n_neighbors, min_cluster_size, '{n}' AS metric,
            {r6(f'coalesce({c}, -1::DOUBLE)')} AS value FROM grid_results"""
            for c, n in (("silhouette", "Silhouette"), ("diversity", "Diversity"), ("coherence_cv", "Coherence"))
        ),
    ),
)
def _(spark, sf):
    names = {"silhouette": "Silhouette", "diversity": "Diversity", "coherence_cv": "Coherence"}
    keys = ["embedding_model", "n_neighbors", "min_cluster_size"]
    return round_all(reports.melt_metrics(grid_results(spark, sf), keys, names).fillna(-1.0, ["value"]), "value")


@query(
    "e23_topic_model_summary",
    with_ctes(
        """t AS (SELECT concat('run_', l_linenumber) AS model, CAST(CASE WHEN l_partkey % 6 = 0 THEN -1
        ELSE l_suppkey % 23 END AS INTEGER) AS topic FROM lineitem)""",
        "s AS (SELECT model, topic, count(*) AS n FROM t GROUP BY 1, 2)",
        select=f"""SELECT model, count(*) FILTER (topic <> -1) AS valid_topics,
        {r6('coalesce(sum(n) FILTER (topic = -1), 0)::DOUBLE * 100 / sum(n)::DOUBLE')} AS percent_outliers,
        {r6('max(n) FILTER (topic <> -1)::DOUBLE * 100 / sum(n)::DOUBLE')} AS percent_largest,
        CAST(sum(n) AS BIGINT) AS messages FROM s GROUP BY 1""",
    ),
)
def _(spark, sf):
    topic = F.when(F.col("l_partkey") % 6 == 0, -1).otherwise(F.col("l_suppkey") % 23)
    runs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("run_"), F.col("l_linenumber")).alias("model"), topic.cast("int").alias("topic")
    )
    return round_all(reports.topic_model_summary(runs, "model"), "percent_outliers", "percent_largest")


@query(
    "e24_scaled_group_mean",
    with_ctes(
        SCORED_POSTS,
        "m AS (SELECT macro_topic, avg(toxicity) AS mean FROM scored_posts GROUP BY 1)",
        select=f"""SELECT macro_topic, {r6('mean')} AS mean,
        {r6('(mean - (SELECT min(mean) FROM m)) / ((SELECT max(mean) FROM m) - (SELECT min(mean) FROM m))')} AS scaled
        FROM m""",
    ),
)
def _(spark, sf):
    return round_all(reports.scaled_group_mean(scored_posts(spark, sf), "macro_topic", "toxicity"), "mean", "scaled")


@query(
    "e25_rows_and_groups",
    with_ctes(MESSAGES, select="""SELECT count(*) AS "rows", count(DISTINCT group_name) AS groups FROM messages"""),
)
def _(spark, sf):
    return reports.rows_and_groups(messages(spark, sf), "group_name")
