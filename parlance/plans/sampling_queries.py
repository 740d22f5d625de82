"""Samples, duplicates and rankings over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import filters, ranking, sampling
from parlance.plans.inputs import (
    GRID_RESULTS,
    MESSAGES,
    POST_TOPICS,
    POSTS,
    REPEATED_POSTS,
    SCORED_POSTS,
    grid_results,
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

KEY = ["id", "group_name"]
PARAMS = ["embedding_model", "n_neighbors", "min_cluster_size"]


@query(
    "f01_stratified_sample",
    with_ctes(
        MESSAGES,
        """s AS (SELECT id, group_name, concat_ws('_', month(make_timestamp("timestamp" * 1000000)), group_name)
        AS strat_key FROM messages)""",
        "t AS (SELECT count(*) AS total FROM s)",
        """r AS (SELECT *, count(*) OVER (PARTITION BY strat_key) AS size, row_number() OVER (PARTITION BY strat_key
        ORDER BY md5(concat_ws('_', '42', id, group_name)), id, group_name) AS rn FROM s)""",
        select="""SELECT id, group_name, strat_key FROM r, t
        WHERE rn <= floor(size::DOUBLE / total * 300::DOUBLE + 0.5::DOUBLE)""",
    ),
)
def _(spark, sf):
    keyed = filters.add_stratum(filters.add_period(messages(spark, sf)), ["month", "group_name"])
    return sampling.stratified_sample(keyed, "strat_key", 300, KEY).select("id", "group_name", "strat_key")


@query(
    "f01_stratified_sample_few_strata",
    with_ctes(
        POSTS,
        "t AS (SELECT count(*) AS total FROM posts)",
        """r AS (SELECT id, group_name, count(*) OVER (PARTITION BY group_name) AS size, row_number() OVER (
        PARTITION BY group_name ORDER BY md5(concat_ws('_', '7', id, group_name)), id, group_name) AS rn FROM posts)""",
        select="""SELECT id, group_name FROM r, t
        WHERE rn <= floor(size::DOUBLE / total * 2500::DOUBLE + 0.5::DOUBLE)""",
    ),
)
def _(spark, sf):
    return sampling.stratified_sample(posts(spark, sf), "group_name", 2500, KEY, seed=7).select(*KEY)


@query(
    "f02_exact_fraction",
    with_ctes(
        MESSAGES,
        """r AS (SELECT id, group_name, row_number() OVER (ORDER BY md5(concat_ws('_', '42', id, group_name)), id) AS rn,
        count(*) OVER () AS n FROM messages)""",
        select="SELECT id, group_name FROM r WHERE rn <= floor(n * 0.1::DOUBLE + 0.5::DOUBLE)",
    ),
)
def _(spark, sf):
    return sampling.exact_fraction(messages(spark, sf), 0.1, KEY).select(*KEY)


@query(
    "f02_approximate_fraction",
    with_ctes(
        MESSAGES,
        select=f"""SELECT id, group_name FROM messages
        WHERE substr(md5(concat_ws('_', '42', id, group_name)), 1, 8) < '{int(0.1 * 2**32):08x}'""",
    ),
)
def _(spark, sf):
    return sampling.approximate_fraction(messages(spark, sf), 0.1, KEY).select(*KEY)


@query(
    "f03_random_rows",
    with_ctes(MESSAGES, select="SELECT id, group_name FROM messages ORDER BY md5('42_' || id), id LIMIT 5"),
)
def _(spark, sf):
    return sampling.random_rows(messages(spark, sf), 5, ["id"]).select(*KEY)


@query(
    "f04_drop_duplicate_texts",
    with_ctes(MESSAGES, select="SELECT min(id) AS id, arg_min(group_name, id) AS group_name FROM messages GROUP BY text"),
)
def _(spark, sf):
    return sampling.drop_duplicate_texts(messages(spark, sf), "text", ["id"]).select(*KEY)


@query(
    "f05_drop_duplicate_keys",
    with_ctes(REPEATED_POSTS, select="SELECT DISTINCT id, group_name, score FROM repeated_posts"),
)
def _(spark, sf):
    return sampling.drop_duplicate_keys(repeated_posts(spark, sf), KEY).select("id", "group_name", "score")


EXTREMES = """hi AS (SELECT *, row_number() OVER (PARTITION BY macro_topic ORDER BY toxicity DESC, id) AS rank
  FROM scored_posts), lo AS (SELECT *, row_number() OVER (PARTITION BY macro_topic ORDER BY toxicity, id) AS rank
  FROM scored_posts)"""


@query(
    "f06_extremes",
    with_ctes(
        SCORED_POSTS,
        EXTREMES,
        select=f"""SELECT macro_topic, 'highest' AS side, rank, id, {r6('toxicity')} AS toxicity FROM hi WHERE rank <= 10
        UNION ALL SELECT macro_topic, 'lowest', rank, id, {r6('toxicity')} FROM lo WHERE rank <= 10""",
    ),
)
def _(spark, sf):
    rows = sampling.extremes(scored_posts(spark, sf), "macro_topic", "toxicity", ["id"])
    return rows.select("macro_topic", "side", "rank", "id", rounded(F.col("toxicity")).alias("toxicity"))


@query(
    "f06_extremes_nested",
    with_ctes(
        SCORED_POSTS,
        EXTREMES,
        select="""SELECT macro_topic, (SELECT string_agg(id, ',' ORDER BY rank) FROM hi WHERE rank <= 10
        AND hi.macro_topic = s.macro_topic) AS highest, (SELECT string_agg(id, ',' ORDER BY rank) FROM lo
        WHERE rank <= 10 AND lo.macro_topic = s.macro_topic) AS lowest
        FROM (SELECT DISTINCT macro_topic FROM scored_posts) s""",
    ),
)
def _(spark, sf):
    rows = sampling.extremes(scored_posts(spark, sf), "macro_topic", "toxicity", ["id"])
    nested = sampling.nest_extremes(rows, "macro_topic", ["id", "group_name", "toxicity"])
    return nested.select(
        "macro_topic", *[F.array_join(F.transform(s, lambda r: r["id"].cast("string")), ",").alias(s) for s in ("highest", "lowest")]
    )


@query(
    "f07_best_per_group",
    with_ctes(
        GRID_RESULTS,
        select=f"""SELECT embedding_model, n_neighbors, min_cluster_size, {r6('coherence_cv')} AS coherence_cv FROM (
        SELECT *, row_number() OVER (PARTITION BY embedding_model ORDER BY coherence_cv DESC NULLS LAST, n_neighbors,
        min_cluster_size) AS rn FROM grid_results) WHERE rn = 1""",
    ),
)
def _(spark, sf):
    best = sampling.best_per_group(
        grid_results(spark, sf), ["embedding_model"], "coherence_cv", ["n_neighbors", "min_cluster_size"]
    )
    return best.select(*PARAMS, rounded(F.col("coherence_cv")).alias("coherence_cv"))


@query(
    "f08_top_n",
    with_ctes(
        GRID_RESULTS,
        select=f"""SELECT embedding_model, n_neighbors, min_cluster_size, {r6('coherence_cv')} AS coherence_cv
        FROM grid_results ORDER BY coherence_cv DESC NULLS LAST, 1, 2, 3 LIMIT 20""",
    ),
)
def _(spark, sf):
    best = sampling.top_n(grid_results(spark, sf), "coherence_cv", 20, PARAMS)
    return best.select(*PARAMS, rounded(F.col("coherence_cv")).alias("coherence_cv"))


@query(
    "f09_sample_per_topic",
    with_ctes(
        POST_TOPICS,
        "ex AS (SELECT DISTINCT topic, text FROM post_topics JOIN labels ON id = doc_id WHERE toxic = 1)",
        """d AS (SELECT DISTINCT topic, text FROM post_topics p WHERE NOT EXISTS (SELECT 1 FROM ex
        WHERE ex.topic = p.topic AND ex.text = p.text))""",
        select="""SELECT topic, rank, md5(text) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY topic
        ORDER BY md5(concat_ws('_', '42', text)), text) AS rank FROM d) WHERE rank <= 7""",
    ),
)
def _(spark, sf):
    topics = post_topics(spark, sf)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    rows = sampling.sample_per_group(topics, "topic", "text", 7, exclude=topics.join(toxic, "id"))
    return rows.select("topic", "rank", F.md5("text").alias("text_hash"))


def _scores_sql(over: str) -> str:
    def norm(m):
        lo, hi = f"min({m}) OVER ({over})", f"max({m}) OVER ({over})"
        return f"CASE WHEN {hi} > {lo} THEN ({m} - {lo}) / ({hi} - {lo}) ELSE 0::DOUBLE END"

    return f"""SELECT embedding_model, n_neighbors, min_cluster_size, {norm('silhouette')} AS s,
    {norm('diversity')} AS d, {norm('coherence_cv')} AS c FROM grid_results"""


SCORED_SELECT = f"""SELECT embedding_model, n_neighbors, min_cluster_size,
  {r6('coalesce(s, -1::DOUBLE)')} AS silhouette_norm, {r6('coalesce((s + d + c) / 3::DOUBLE, -1::DOUBLE)')} AS score_sdc,
  {r6('coalesce((s + c) / 2::DOUBLE, -1::DOUBLE)')} AS score_sc FROM scored"""


def _scored(df):
    return df.fillna(-1.0).select(
        *PARAMS, *[rounded(F.col(c)).alias(c) for c in ("silhouette_norm", "score_sdc", "score_sc")]
    )


@query("f10_normalised_scores", with_ctes(GRID_RESULTS, f"scored AS ({_scores_sql('')})", select=SCORED_SELECT))
def _(spark, sf):
    return _scored(sampling.add_normalised_scores(grid_results(spark, sf)))


@query(
    "f10_normalised_scores_per_model",
    with_ctes(GRID_RESULTS, f"scored AS ({_scores_sql('PARTITION BY embedding_model')})", select=SCORED_SELECT),
)
def _(spark, sf):
    return _scored(sampling.add_normalised_scores(grid_results(spark, sf), group=["embedding_model"]))


BEST_METRICS = {
    "silhouette": "silhouette",
    "diversity": "diversity",
    "coherence": "coherence_cv",
    "combined_sdc": "score_sdc",
    "combined_sc": "score_sc",
}
BEST_SQL = f"""scored AS ({_scores_sql('')}),
  full_scores AS (SELECT g.*, (s + d + c) / 3::DOUBLE AS score_sdc, (s + c) / 2::DOUBLE AS score_sc FROM grid_results g
    JOIN scored USING (embedding_model, n_neighbors, min_cluster_size)),
  long AS ({" UNION ALL ".join(f"SELECT embedding_model, n_neighbors, min_cluster_size, '{m}' AS metric, {c} AS value FROM full_scores WHERE {c} IS NOT NULL" for m, c in BEST_METRICS.items())}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, embedding_model, n_neighbors,
    min_cluster_size) AS rank FROM long)"""


@query(
    "f11_best_configurations",
    with_ctes(
        GRID_RESULTS,
        BEST_SQL,
        select=f"""SELECT concat('best_', metric, '_rank', rank) AS config, embedding_model, n_neighbors,
        min_cluster_size, {r6('value')} AS value FROM ranked WHERE rank <= 3""",
    ),
)
def _(spark, sf):
    scored = sampling.add_normalised_scores(grid_results(spark, sf))
    best = sampling.best_configurations(scored, BEST_METRICS, 3, PARAMS)
    return best.select("config", *PARAMS, rounded(F.col("value")).alias("value"))


@query(
    "f12_best_config",
    with_ctes(
        GRID_RESULTS,
        BEST_SQL,
        select=f"""SELECT CASE metric WHEN 'coherence' THEN 'coherence_cv' ELSE 'score_sdc' END AS metric,
        embedding_model, n_neighbors, min_cluster_size * 10 AS min_cluster_size, {r6('value')} AS value FROM ranked
        WHERE rank = 1 AND metric IN ('coherence', 'combined_sdc')""",
    ),
)
def _(spark, sf):
    scored = sampling.add_normalised_scores(grid_results(spark, sf))
    integers = ["n_neighbors", "min_cluster_size"]
    best = sampling.best_config(scored, ["coherence_cv", "score_sdc"], PARAMS, integers)
    return best.select("metric", *PARAMS, rounded(F.col("value")).alias("value"))


@query(
    "f01_hash_row_number",
    with_ctes(
        POSTS,
        select="""SELECT id, group_name, row_number() OVER (PARTITION BY group_name
        ORDER BY md5(concat_ws('_', '42', id)), id) AS rn FROM posts""",
    ),
)
def _(spark, sf):
    hashed = posts(spark, sf).withColumn("h", ranking.hash_order(42, "id"))
    return ranking.hash_row_number(hashed, ["group_name"], "h", ["id"]).select("id", "group_name", "rn")
