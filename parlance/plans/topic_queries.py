"""Topic modelling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import vectors as vec
from parlance.functions.numbers import rounded
from parlance.operators import clustering, coherence, hierarchy, joins, topics
from parlance.operators.neighbours import nearest_neighbours
from parlance.operators.reduction import leading_components, reduce_randomised
from parlance.operators.lemmas import normalise
from parlance.plans.inputs import MACRO_MAP, POST_TOPICS, macro_map, post_topics, r6, table, with_ctes
from parlance.plans.registry import ORACLES, query
from parlance.plans.text_queries import STOPWORDS, normal_ctes
from parlance.session import saved, scratch_path
from parlance.sources import sinks

KEY = ["id", "group_name"]
TERMS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')"


def clean_topics(spark, sf):
    """Messages with a topic and normalised text."""
    return normalise(post_topics(spark, sf), "text", KEY, stopwords=STOPWORDS)


CLEAN = POST_TOPICS + ", " + normal_ctes("post_topics", "id, group_name, topic")


def vector_topics(spark, sf):
    """Vectors with a topic; every seventh is an outlier."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).cast("int").alias("topic"),
    )


VECTOR_TOPICS = """vector_topics AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding,
  CAST(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS INTEGER) AS topic FROM embeddings),
  long_v AS (SELECT id, topic, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM vector_topics),
  norms AS (SELECT id, sqrt(sum(x * x)) AS len FROM long_v GROUP BY 1),
  units AS (SELECT v.id, v.topic, v.d, v.x / n.len AS u, v.x FROM long_v v JOIN norms n USING (id))"""


@query(
    "g01_document_vectors",
    with_ctes(POST_TOPICS, select="SELECT count(*) AS documents, count(*) AS with_vector, 64 AS dimensions FROM post_topics"),
)
def _(spark, sf):
    """Encode, then encode again with other rows added: the second run reads the cache."""
    cache = scratch_path(spark, "vector-cache")
    rows = clean_topics(spark, sf)

    def encode(missing):
        return clustering.hashed_vectors(missing, "text", dimensions=64).select("text_hash", "vector")

    clustering.document_vectors(rows.filter("topic <> -1"), "clean_text", "hashed-64", encode, cache)
    found = clustering.document_vectors(rows, "clean_text", "hashed-64", encode, cache)
    return found.agg(
        F.count("*").alias("documents"), F.count("vector").alias("with_vector"), F.max(F.size("vector")).alias("dimensions")
    )


@query("g02_reduce_dimensions")
def _(spark, sf):
    reduced = clustering.reduce_dimensions(vector_topics(spark, sf), "embedding", 3)
    return reduced.select("id", *[rounded(F.abs(F.col("reduced")[i]), 4).alias(f"c{i}") for i in range(3)])


def signed_sum_sql(run: int) -> str:
    """The cell of the sum of all coordinates, runs of ``run`` of them counting up and down in turn."""
    signed = f"list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN (i - 1) // {run} % 2 = 0 THEN 1 ELSE -1 END)"
    return f"CAST(floor(list_reduce({signed}, lambda p, q: p + q) / 8::DOUBLE / 0.1::DOUBLE) AS BIGINT)"


CELLS = f"""pts AS (SELECT vec_id AS id, {signed_sum_sql(1)} AS a, {signed_sum_sql(2)} AS b, {signed_sum_sql(4)} AS c FROM embeddings),
  cells AS (SELECT a, b, c, count(*) AS n, min(id) AS first FROM pts GROUP BY ALL),
  sides AS (SELECT x.a, x.b, x.c, x.first, y.n AS ny, y.first AS fy FROM cells x JOIN cells y
    ON abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) = 1),
  weighed AS (SELECT x.*, n + coalesce((SELECT sum(ny) FROM sides s WHERE s.first = x.first), 0) >= 20 AS dense FROM cells x),
  edges AS (SELECT s.first AS src, s.fy AS dst FROM sides s JOIN weighed p ON p.first = s.first AND p.dense
    JOIN weighed q ON q.first = s.fy AND q.dense),
  reach(node, label) AS (SELECT first, first FROM weighed WHERE dense
    UNION SELECT e.dst, r.label FROM reach r JOIN edges e ON r.node = e.src),
  comps AS (SELECT node, min(label) AS label FROM reach GROUP BY 1),
  border AS (SELECT s.first AS node, min(k.label) AS label FROM sides s JOIN weighed p ON p.first = s.first AND NOT p.dense
    JOIN comps k ON k.node = s.fy GROUP BY 1),
  assigned AS (SELECT * FROM comps UNION ALL SELECT * FROM border),
  sized AS (SELECT label, sum(n) AS n FROM assigned JOIN weighed ON node = first GROUP BY 1),
  clustered AS (SELECT p.id, coalesce(k.label, -1) AS cluster FROM pts p JOIN cells USING (a, b, c)
    LEFT JOIN (SELECT node, label FROM assigned JOIN sized USING (label) WHERE sized.n >= 8) k ON k.node = first)"""


def clustered(spark, sf):
    """Density clusters over three signed sums of all coordinates of the vectors."""

    def signed_sum(run):
        signed = f"transform(embedding, (x, i) -> CAST(x AS DOUBLE) * IF(i div {run} % 2 = 0, 1, -1))"
        return F.expr(f"aggregate({signed}, CAST(0 AS DOUBLE), (p, q) -> p + q) / 8")

    points = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.array(signed_sum(1), signed_sum(2), signed_sum(4)).alias("v")
    )
    return clustering.density_clusters(points, "id", "v", 0.1, 20, 8)


@query("g03_density_clusters", "WITH RECURSIVE " + CELLS + " SELECT id, cluster FROM clustered")
def _(spark, sf):
    return clustered(spark, sf).select("id", "cluster")


@query(
    "g03_numbered_topics",
    "WITH RECURSIVE " + CELLS + """, numbers AS (SELECT cluster, row_number() OVER (ORDER BY n DESC, cluster) - 1 AS topic
    FROM (SELECT cluster, count(*) AS n FROM clustered WHERE cluster <> -1 GROUP BY 1))
    SELECT id, CAST(coalesce(topic, -1) AS INTEGER) AS topic FROM clustered LEFT JOIN numbers USING (cluster)""",
)
def _(spark, sf):
    return clustering.number_topics(clustered(spark, sf), "cluster").select("id", "topic")


def coordinate_sql(run: int) -> str:
    signed = f"list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN (i - 1) // {run} % 2 = 0 THEN 1 ELSE -1 END)"
    return f"list_reduce({signed}, lambda p, q: p + q) / 8::DOUBLE"


def reduced_points(spark, sf):
    """Three signed sums of all coordinates of every vector."""

    def coordinate(run):
        signed = f"transform(embedding, (x, i) -> CAST(x AS DOUBLE) * IF(i div {run} % 2 = 0, 1, -1))"
        return F.expr(f"aggregate({signed}, CAST(0 AS DOUBLE), (p, q) -> p + q) / 8")

    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[coordinate(r) for r in (1, 2, 4)]).alias("v"))


@query(
    "g02_reduction_variance",
    f"""WITH long_v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
    units AS (SELECT vec_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM long_v),
    spread AS (SELECT sum(variance) AS total, max(variance) AS widest FROM (SELECT d, avg(u * u) - avg(u) * avg(u) AS variance FROM units GROUP BY d))
    SELECT {r6('total')} AS total_variance, true AS between_bounds, true AS descending FROM spread""",
)
def _(spark, sf):
    """The variances of the leading components lie between that of the widest coordinate and that of all; all of them add up to the total."""
    vectors = table(spark, sf, "embeddings").select(F.col("embedding").alias("v"))
    wide = vectors.select(F.posexplode("v").alias("d", "x"), F.sqrt(F.expr("aggregate(v, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)")).alias("l"))
    widest = wide.groupBy("d").agg(F.var_pop(F.col("x") / F.col("l")).alias("s")).agg(F.max("s")).first()[0]
    units = saved(vectors.select(F.expr("transform(v, x -> CAST(x AS DOUBLE) / sqrt(aggregate(v, 0D, (a, y) -> a + CAST(y AS DOUBLE) * y)))").alias("v")), "units")
    _, every = leading_components(units, 64, 64, passes=1)
    _, leading = leading_components(units, 64, 3, passes=12)
    facts = (float(every.sum()), bool(widest * 0.99 <= leading[0] <= every[0] * 1.000001), bool((leading[:-1] >= leading[1:]).all()))
    rows = spark.createDataFrame([facts], "total_variance double, between_bounds boolean, descending boolean")
    return rows.withColumn("total_variance", rounded(F.col("total_variance")))


@query("g02_randomised_reduction")
def _(spark, sf):
    reduced = reduce_randomised(vector_topics(spark, sf), "embedding", 3)
    return reduced.select("id", *[rounded(F.abs(F.col("reduced")[i]), 4).alias(f"c{i}") for i in range(3)])


N_NEAR, MIN_SAMPLES = 10, 4
NEAR = f"""spots AS (SELECT vec_id AS id, {coordinate_sql(1)} AS a, {coordinate_sql(2)} AS b, {coordinate_sql(4)} AS c FROM embeddings),
  gaps AS (SELECT x.id, y.id AS other, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) AS distance
    FROM spots x JOIN spots y ON x.id <> y.id),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS place FROM gaps QUALIFY place <= {N_NEAR}),
  cores AS (SELECT id, max(distance) FILTER (place < {MIN_SAMPLES}) AS core FROM near GROUP BY 1)"""


@query("g03_nearest_neighbours", with_ctes(NEAR, select=f"SELECT id, other, {r6('distance')} AS distance FROM near"))
def _(spark, sf):
    found = nearest_neighbours(reduced_points(spark, sf), "id", "v", N_NEAR, cell_rows=64)
    return found.select("id", "other", rounded(F.col("distance")).alias("distance"))


@query(
    "g03_reachability_edges",
    with_ctes(
        NEAR,
        select=f"""SELECT DISTINCT least(n.id, other) AS u, greatest(n.id, other) AS v, {r6('greatest(distance, p.core, q.core)')} AS weight
        FROM near n JOIN cores p USING (id) JOIN cores q ON q.id = other""",
    ),
)
def _(spark, sf):
    points = saved(reduced_points(spark, sf), "points")
    near = nearest_neighbours(points, "id", "v", N_NEAR, cell_rows=64)
    edges = hierarchy.reachability_edges(saved(near, "near"), points.select("id", F.lit(1).alias("n")), MIN_SAMPLES)
    return edges.select("u", "v", rounded(F.col("weight")).alias("weight"))


@query("g03_hierarchical_clusters")
def _(spark, sf):
    """Clusters of all densities; tests compare them with the whole tree on small fixtures."""
    found = hierarchy.hierarchical_clusters(reduced_points(spark, sf), "id", "v", 8, MIN_SAMPLES, N_NEAR, cell_rows=64)
    return found.select("id", "cluster")


@query("g03b_centroid_clusters")
def _(spark, sf):
    rows = clustering.centroid_clusters(vector_topics(spark, sf).drop("topic"), "embedding", 6)
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query("g03b_bisecting_clusters")
def _(spark, sf):
    rows = clustering.centroid_clusters(vector_topics(spark, sf).drop("topic"), "embedding", 4, bisecting=True)
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query(
    "g04_term_counts",
    with_ctes(
        POST_TOPICS,
        select=f"SELECT topic, term, count(*) AS n FROM (SELECT topic, unnest({TERMS_SQL}) AS term FROM post_topics) "
        f"WHERE term NOT IN ({', '.join(repr(w) for w in STOPWORDS)}) GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    return topics.term_counts(post_topics(spark, sf), ["topic"], "text", STOPWORDS)


def weight_ctes(source: str = "normal", column: str = "topic") -> str:
    return f"""counts AS (SELECT {column} AS topic, term, count(*) AS n FROM
  (SELECT {column}, unnest(regexp_extract_all(lower(clean_text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}) GROUP BY 1, 2),
  per_topic AS (SELECT topic, CAST(sum(n) AS DOUBLE) AS words FROM counts GROUP BY 1),
  per_term AS (SELECT term, CAST(sum(n) AS DOUBLE) AS freq FROM counts GROUP BY 1),
  weights AS (SELECT topic, term, n, ln(1::DOUBLE + (SELECT avg(words) FROM per_topic) / freq) AS idf,
    n / words * ln(1::DOUBLE + (SELECT avg(words) FROM per_topic) / freq) AS weight
    FROM counts JOIN per_topic USING (topic) JOIN per_term USING (term)),
  top_words AS (SELECT topic, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY
    floor(weight * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE DESC, term) AS rank FROM weights) WHERE rank <= 10)"""


def weights_of(spark, sf):
    return topics.topic_weights(clean_topics(spark, sf), "topic", "clean_text")


@query(
    "g05_class_tfidf",
    with_ctes(CLEAN, weight_ctes(), select=f"SELECT topic, rank, term, {r6('weight')} AS weight FROM top_words"),
)
def _(spark, sf):
    words = topics.top_words(weights_of(spark, sf))
    return words.select("topic", "rank", "term", rounded(F.col("weight")).alias("weight"))


@query(
    "g06_silhouette_exact",
    with_ctes(
        VECTOR_TOPICS,
        """dist AS (SELECT a.id, a.topic AS ta, b.topic AS tb, b.id AS other, 1::DOUBLE - sum(a.u * b.u) AS d
        FROM units a JOIN units b ON a.d = b.d AND a.id <> b.id WHERE a.topic <> -1 AND b.topic <> -1 GROUP BY 1, 2, 3, 4)""",
        "means AS (SELECT id, ta, tb, avg(d) AS m FROM dist GROUP BY 1, 2, 3)",
        """ab AS (SELECT id, max(m) FILTER (ta = tb) AS a, min(m) FILTER (ta <> tb) AS b FROM means GROUP BY 1)""",
        select=f"""SELECT {r6('avg(CASE WHEN a IS NULL THEN 0::DOUBLE ELSE (b - a) / greatest(a, b) END)')} AS silhouette
        FROM ab""",
    ),
)
def _(spark, sf):
    return topics.silhouette_exact(vector_topics(spark, sf), "embedding").select(
        rounded(F.col("silhouette")).alias("silhouette")
    )


@query("g06_silhouette", ORACLES["g06_silhouette_exact"])
def _(spark, sf):
    rows = vector_topics(spark, sf)
    return spark.range(1).select(rounded(F.lit(topics.silhouette(rows, "embedding"))).alias("silhouette"))


@query(
    "g07_diversity",
    with_ctes(
        CLEAN,
        weight_ctes(),
        select=f"""SELECT {r6('count(DISTINCT term)::DOUBLE / count(*)')} AS diversity FROM top_words WHERE topic <> -1""",
    ),
)
def _(spark, sf):
    return topics.diversity(topics.top_words(weights_of(spark, sf))).select(rounded(F.col("diversity")).alias("diversity"))


COHERENCE = """tw AS (SELECT topic, rank, term FROM top_words WHERE topic <> -1),
  total AS (SELECT CAST(sum(greatest(len(words) - 109, 1)) AS DOUBLE) AS t FROM normal),
  occ AS (SELECT id, term, p, n FROM (SELECT id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS p,
    len(words) AS n FROM normal) WHERE term IN (SELECT term FROM tw)),
  win AS (SELECT DISTINCT id, term, unnest(range(greatest(p - 109, 0), least(p, greatest(n - 110, 0)) + 1)) AS s FROM occ),
  hit AS (SELECT win.id, win.s, tw.topic, tw.rank FROM win JOIN tw USING (term)),
  pair AS (SELECT a.topic, a.rank AS i, b.rank AS j, CAST(count(*) AS DOUBLE) AS n FROM hit a JOIN hit b
    ON a.id = b.id AND a.s = b.s AND a.topic = b.topic GROUP BY 1, 2, 3),
  one AS (SELECT topic, i AS k, n FROM pair WHERE i = j),
  npmi AS (SELECT x.topic, x.k AS i, y.k AS j, ln((coalesce(p.n, 0::DOUBLE) / t + 1e-12::DOUBLE) / ((x.n / t) * (y.n / t)))
    / -ln(coalesce(p.n, 0::DOUBLE) / t + 1e-12::DOUBLE) AS v FROM one x JOIN one y ON x.topic = y.topic
    LEFT JOIN pair p ON p.topic = x.topic AND p.i = x.k AND p.j = y.k, total),
  vsum AS (SELECT topic, j, sum(v) AS s FROM npmi GROUP BY 1, 2),
  cosines AS (SELECT topic, i, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS c FROM npmi
    JOIN vsum USING (topic, j) GROUP BY 1, 2)"""


def coherence_words(spark, sf):
    rows = saved(clean_topics(spark, sf), "clean-topics")
    return rows, topics.top_words(topics.topic_weights(rows, "topic", "clean_text"))


@query(
    "g08_topic_coherence",
    with_ctes(CLEAN, weight_ctes(), COHERENCE, select=f"SELECT topic, {r6('avg(c)')} AS coherence FROM cosines GROUP BY 1"),
)
def _(spark, sf):
    rows, words = coherence_words(spark, sf)
    return coherence.topic_coherence(rows, KEY, "clean_text", words).select("topic", rounded(F.col("coherence")).alias("coherence"))


@query(
    "g08_coherence_cv",
    with_ctes(
        CLEAN,
        weight_ctes(),
        COHERENCE,
        select=f"SELECT {r6('avg(c)')} AS coherence_cv FROM (SELECT topic, avg(c) AS c FROM cosines GROUP BY 1)",
    ),
)
def _(spark, sf):
    rows, words = coherence_words(spark, sf)
    return coherence.coherence_cv(rows, KEY, "clean_text", words).select(rounded(F.col("coherence_cv")).alias("coherence_cv"))


@query(
    "g09_topic_counts",
    with_ctes(
        POST_TOPICS,
        select=f"""SELECT count(*) AS documents, count(*) FILTER (topic = -1) AS outliers,
        count(DISTINCT topic) FILTER (topic <> -1) AS n_topics,
        {r6('count(*) FILTER (topic = -1) * 100.0::DOUBLE / count(*)')} AS outliers_pct FROM post_topics""",
    ),
)
def _(spark, sf):
    return topics.topic_counts(post_topics(spark, sf)).withColumn("outliers_pct", rounded(F.col("outliers_pct")))


@query("g10_grid_search")
def _(spark, sf):
    """A small search over the cluster number; a second call finds everything done."""
    rows = saved(vector_topics(spark, sf).drop("topic"), "grid-rows")
    sizes = table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("k"))
    path = scratch_path(spark, "grid")

    def run(settings):
        found = clustering.centroid_clusters(rows, "embedding", settings["k"])
        value = topics.silhouette_exact(found, "embedding").first()["silhouette"]
        return {"n_topics": settings["k"], "silhouette": value}

    topics.grid_search(spark, sizes, run, path)
    results = topics.grid_search(spark, sizes, run, path)
    return results.select("k", "n_topics", rounded(F.col("silhouette"), 4).alias("silhouette"), "error")


REDUCED = """means AS (SELECT topic, d, avg(x) AS m FROM long_v WHERE topic <> -1 GROUP BY 1, 2),
  mlen AS (SELECT topic, sqrt(sum(m * m)) AS len FROM means GROUP BY 1),
  sims AS (SELECT u.id, m.topic, sum(u.u * m.m / l.len) AS s FROM units u JOIN means m ON u.d = m.d
    JOIN mlen l ON l.topic = m.topic WHERE u.topic = -1 GROUP BY 1, 2),
  nearest AS (SELECT id, arg_max(topic, s) AS topic, max(s) AS s FROM sims GROUP BY 1),
  reduced AS (SELECT v.id, CAST(CASE WHEN v.topic <> -1 THEN v.topic WHEN n.s >= 0.1::DOUBLE THEN n.topic ELSE -1 END
    AS INTEGER) AS topic, n.s AS similarity FROM vector_topics v LEFT JOIN nearest n ON v.id = n.id AND v.topic = -1)"""


@query(
    "g11_reduce_outliers",
    with_ctes(
        VECTOR_TOPICS, REDUCED, select=f"SELECT id, topic, {r6('coalesce(similarity, 9::DOUBLE)')} AS similarity FROM reduced"
    ),
)
def _(spark, sf):
    moved = topics.reduce_outliers(vector_topics(spark, sf), "embedding", 0.1)
    return moved.select("id", "topic", rounded(F.coalesce("similarity", F.lit(9.0))).alias("similarity"))


@query(
    "g12_refreshed_words",
    with_ctes(
        CLEAN,
        VECTOR_TOPICS,
        REDUCED,
        "renewed AS (SELECT n.id, r.topic, n.clean_text FROM normal n JOIN reduced r ON n.id = r.id)",
        weight_ctes("renewed"),
        select=f"SELECT topic, rank, term, {r6('weight')} AS weight FROM top_words",
    ),
)
def _(spark, sf):
    moved = saved(topics.reduce_outliers(vector_topics(spark, sf), "embedding", 0.1).select("id", "topic"), "moved")
    renewed = clean_topics(spark, sf).drop("topic").join(moved, "id")
    words = topics.top_words(topics.topic_weights(renewed, "topic", "clean_text"))
    return words.select("topic", "rank", "term", rounded(F.col("weight")).alias("weight"))


REPRESENTATIVES = """first_docs AS (SELECT min(id) AS id, arg_min(group_name, id) AS group_name, arg_min(topic, id) AS topic,
    clean_text FROM normal GROUP BY clean_text),
  doc_terms AS (SELECT id, group_name, topic, term, count(*) AS n FROM (SELECT id, group_name, topic,
    unnest(regexp_extract_all(clean_text, '[\\p{L}\\p{N}_]{2,}')) AS term FROM first_docs) GROUP BY ALL),
  tnorm AS (SELECT topic, sqrt(sum(weight * weight)) AS tn FROM weights GROUP BY 1),
  dsim AS (SELECT d.id, d.group_name, d.topic, floor(1e9::DOUBLE * sum(d.n * w.idf * w.weight)
    / (sqrt(sum(d.n * w.idf * d.n * w.idf)) * any_value(tn)) + 0.5::DOUBLE) / 1e9::DOUBLE AS similarity FROM doc_terms d
    JOIN weights w ON d.topic = w.topic AND d.term = w.term JOIN tnorm ON tnorm.topic = d.topic GROUP BY 1, 2, 3),
  reps AS (SELECT topic, rank, id, group_name, similarity FROM (SELECT *, row_number() OVER (PARTITION BY topic
    ORDER BY similarity DESC, id, group_name) AS rank FROM dsim) WHERE rank <= 3)"""


@query(
    "g13_representatives",
    with_ctes(
        CLEAN,
        weight_ctes(),
        REPRESENTATIVES,
        select=f"""SELECT r.topic, r.rank, r.id, {r6('r.similarity')} AS similarity, md5(n.text) AS text_hash FROM reps r
        JOIN normal n ON n.id = r.id""",
    ),
)
def _(spark, sf):
    rows = saved(clean_topics(spark, sf), "clean-topics")
    unique = topics.drop_duplicate_texts(rows, "clean_text", KEY)
    weights = topics.topic_weights(rows, "topic", "clean_text")
    chosen = topics.representative_documents(unique, KEY, "clean_text", weights)
    texts = topics.with_original_text(chosen, rows, KEY, "text")
    return texts.select(
        "topic", "rank", "id", rounded(F.col("similarity")).alias("similarity"), F.md5("text").alias("text_hash")
    )


def dictionary(spark, sf):
    return topics.topic_dictionary(clean_topics(spark, sf), KEY, "clean_text", "text")


DICTIONARY = """rep_text AS (SELECT r.topic, r.rank, n.text FROM reps r JOIN normal n ON n.id = r.id WHERE r.topic <> -1),
  pool AS (SELECT DISTINCT topic, text FROM normal n WHERE NOT EXISTS (SELECT 1 FROM rep_text r WHERE r.topic = n.topic
    AND r.text = n.text)),
  samp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(concat_ws('_', '42', text)), text)
    AS rank FROM pool) WHERE rank <= 7),
  dict AS (SELECT s.topic, s.n, (SELECT list(term ORDER BY rank) FROM top_words t WHERE t.topic = s.topic) AS words,
    (SELECT list(text ORDER BY rank) FROM rep_text t WHERE t.topic = s.topic) AS reps,
    (SELECT list(text ORDER BY rank) FROM samp t WHERE t.topic = s.topic) AS samples
    FROM (SELECT topic, count(*) AS n FROM normal GROUP BY 1) s)"""


@query(
    "g14_topic_dictionary",
    with_ctes(
        CLEAN,
        weight_ctes(),
        REPRESENTATIVES,
        DICTIONARY,
        select="""SELECT topic AS Topic, n AS Count, concat_ws('_', topic, words[1], words[2], words[3], words[4]) AS Name,
        array_to_string(words, ' ') AS words, md5(coalesce(array_to_string(reps, '|'), '')) AS reps_hash,
        md5(coalesce(array_to_string(samples, '|'), '')) AS samples_hash FROM dict""",
    ),
)
def _(spark, sf):
    return dictionary(spark, sf).select(
        "Topic", "Count", "Name", F.array_join("Representation", " ").alias("words"),
        F.md5(F.array_join("Representative_Docs", "|")).alias("reps_hash"),
        F.md5(F.array_join("Sample_Docs", "|")).alias("samples_hash"),
    )


@query(
    "g15_topic_per_message",
    with_ctes(
        CLEAN,
        select="""SELECT n.id, n.group_name, u.topic FROM normal n JOIN (SELECT clean_text, arg_min(topic, id) AS topic
        FROM normal GROUP BY 1) u ON n.clean_text = u.clean_text""",
    ),
)
def _(spark, sf):
    rows = clean_topics(spark, sf)
    unique = topics.drop_duplicate_texts(rows.select("id", "clean_text", "topic"), "clean_text", ["id"])
    return joins.lookup_by_text(rows.drop("topic"), unique, "clean_text", "topic").select(*KEY, "topic")


SIMILARITY = """m AS (SELECT topic, d, avg(x) AS m FROM long_v WHERE topic <> -1 GROUP BY 1, 2),
  l AS (SELECT topic, sqrt(sum(m * m)) AS len FROM m GROUP BY 1),
  sim AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.m * b.m / (la.len * lb.len)) AS similarity FROM m a
    JOIN m b ON a.d = b.d JOIN l la ON la.topic = a.topic JOIN l lb ON lb.topic = b.topic GROUP BY 1, 2)"""


def similarity(spark, sf):
    members = vector_topics(spark, sf).filter("topic <> -1")
    return topics.topic_similarity(saved(vec.group_vectors(members, "topic", "embedding"), "topic-vectors"))


@query(
    "g16_topic_similarity",
    with_ctes(VECTOR_TOPICS, SIMILARITY, select=f"SELECT topic_a, topic_b, {r6('similarity')} AS similarity FROM sim"),
)
def _(spark, sf):
    return similarity(spark, sf).select("topic_a", "topic_b", rounded(F.col("similarity")).alias("similarity"))


@query(
    "g16_merge_order",
    "WITH RECURSIVE " + ", ".join([VECTOR_TOPICS, SIMILARITY]) + f""", links(step, a, b, s, na, nb) AS (
      SELECT 1, topic_a, topic_b, similarity, 1::BIGINT, 1::BIGINT FROM sim WHERE topic_a < topic_b
      UNION ALL
      SELECT step + 1, least(x, y), greatest(x, y), sum(s * na * nb) / sum(na * nb),
        any_value(CASE WHEN x < y THEN nx ELSE ny END), any_value(CASE WHEN x < y THEN ny ELSE nx END)
      FROM (SELECT *, CASE WHEN a IN (ka, kb) THEN ka ELSE a END AS x, CASE WHEN a IN (ka, kb) THEN size ELSE na END AS nx,
              CASE WHEN b IN (ka, kb) THEN ka ELSE b END AS y, CASE WHEN b IN (ka, kb) THEN size ELSE nb END AS ny
            FROM (SELECT *, first_value(a) OVER best AS ka, first_value(b) OVER best AS kb, first_value(na + nb) OVER best AS size
                  FROM links WINDOW best AS (ORDER BY -round(s, 9), a, b)))
      WHERE x <> y GROUP BY step, least(x, y), greatest(x, y))
    SELECT step, a AS kept, b AS merged, {r6('s')} AS similarity, CAST(na + nb AS INTEGER) AS topics
    FROM links QUALIFY row_number() OVER (PARTITION BY step ORDER BY -round(s, 9), a, b) = 1""",
)
def _(spark, sf):
    return topics.merge_order(similarity(spark, sf)).withColumn("similarity", rounded(F.col("similarity")))


@query(
    "g17_topic_blocks",
    with_ctes(
        CLEAN,
        weight_ctes(),
        REPRESENTATIVES,
        DICTIONARY,
        select="""SELECT topic AS Topic, md5(concat('### TÓPICO ', topic, ' ###', chr(10), 'top_10_words: [',
        array_to_string(words, ', '), ']', chr(10), chr(10), 'top_3_transcriptions: ', chr(10),
        coalesce(array_to_string(list_transform(reps, lambda x: concat('  - ', x)), chr(10)), '  - [Nenhum texto representativo]'),
        chr(10), chr(10), 'sample_transcriptions: ', chr(10),
        coalesce(array_to_string(list_transform(samples, lambda x: concat('  - ', x)), chr(10)), '  - [Nenhuma amostra adicional]'),
        chr(10), repeat('-', 80), chr(10))) AS block_hash FROM dict WHERE topic <> -1""",
    ),
)
def _(spark, sf):
    return topics.topic_blocks(dictionary(spark, sf)).select("Topic", F.md5("block").alias("block_hash"))


@query(
    "g18_macro_topics",
    with_ctes(
        POST_TOPICS,
        MACRO_MAP,
        select="""SELECT year(t) AS year, month(t) AS month, coalesce(CASE WHEN topic = -1 THEN 'OUTLIERS' ELSE macro_topic
        END, 'none') AS macro_topic, count(*) AS n FROM (SELECT p.*, m.macro_topic,
        make_timestamp(p."timestamp" * 1000000) AS t FROM post_topics p LEFT JOIN macro_map m ON p.topic = m.topic) GROUP BY 1, 2, 3""",
    ),
)
def _(spark, sf):
    from parlance.operators import filters

    lookup = macro_map(spark, sf)
    flags = lookup.groupBy("macro_topic").agg(F.first("is_political").alias("is_political"))
    mapped = joins.map_macro_topics(post_topics(spark, sf), lookup.select("topic", "macro_topic"), flags)
    path = scratch_path(spark, "macro")
    sinks.overwrite_periods(filters.add_period(mapped), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("year", "month", F.coalesce("macro_topic", F.lit("none")).alias("macro_topic")).agg(F.count("*").alias("n"))


@query(
    "g19_top_topics",
    with_ctes(
        CLEAN,
        weight_ctes(),
        "s AS (SELECT topic, count(*) AS n FROM normal WHERE topic <> -1 GROUP BY 1)",
        select="""SELECT 'run' AS model, s.topic, s.n, (SELECT string_agg(term, ', ' ORDER BY rank) FROM top_words t
        WHERE t.topic = s.topic AND rank <= 7) AS words, row_number() OVER (ORDER BY n DESC, topic) AS rank FROM s
        QUALIFY rank <= 3""",
    ),
)
def _(spark, sf):
    rows = saved(clean_topics(spark, sf), "clean-topics")
    words = topics.top_words(topics.topic_weights(rows, "topic", "clean_text")).groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]).alias("words")
    )
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n")).join(words, "topic")
    return topics.top_topics(sizes.withColumn("model", F.lit("run")), "model")
