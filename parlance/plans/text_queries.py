"""Filters, scalar expressions and text normalisation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import filters, lemmas, tagging
from parlance.plans.inputs import (
    MACRO_MAP,
    MESSAGES,
    POST_TOPICS,
    WEB_MESSAGES,
    macro_map,
    messages,
    post_topics,
    posts,
    table,
    web_messages,
    with_ctes,
)
from parlance.plans.registry import query
from parlance.session import saved

# The stop words the registered queries pass in.
STOPWORDS = ["the", "and", "of", "that", "with", "les", "des", "und", "der", "que", "los"]
STOPWORD_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"

# Character-run capping without back-references: with c the list of characters, drop character i
# when it equals the two before it.
CAP_SQL = """list_transform([string_split({0}, '')], lambda c: array_to_string(list_filter(c,
  lambda x, i: NOT (i > 2 AND x = c[i - 1] AND x = c[i - 2])), ''))[1]"""

LOWER_SQL = "lower(coalesce(text, ''))"
LINKS_SQL = "regexp_replace({0}, 'http\\S+|www\\.\\S+', '', 'g')"
TAGS_SQL = "regexp_replace({0}, '[#@][\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')"
PUNCTUATION_SQL = "translate({0}, " + PUNCT_SQL.replace("{", "{{").replace("}", "}}") + ", '')"
DIGITS_SQL = "regexp_replace({0}, '\\p{{Nd}}+', '', 'g')"
TOKENS_SQL = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"

STRIPPED_SQL = DIGITS_SQL.format(PUNCTUATION_SQL.format(TAGS_SQL.format(LINKS_SQL.format(LOWER_SQL))))


def normal_ctes(source: str, columns: str) -> str:
    """CTEs that normalise ``text`` of ``source`` into ``words`` and ``clean_text``."""
    return f"""stripped AS (SELECT {columns}, text, {STRIPPED_SQL} AS s FROM {source}),
capped AS (SELECT {columns}, text, {CAP_SQL.format('s')} AS s FROM stripped),
worded AS (SELECT {columns}, text, list_filter({TOKENS_SQL.format('s')},
  lambda t: NOT list_contains({STOPWORD_SQL}, t) AND length(t) >= 3) AS words FROM capped),
normal AS (SELECT {columns}, text, words, array_to_string(words, ' ') AS clean_text FROM worded)"""


# ---------------------------------------------------------------- filters and scalar expressions


@query(
    "b01_strip_urls_mentions",
    with_ctes(
        WEB_MESSAGES,
        select="""SELECT id, regexp_replace(regexp_replace(text, 'http\\S+', '', 'g'), '@\\w+', '', 'g') AS text_clean
        FROM web_messages""",
    ),
)
def _(spark, sf):
    return web_messages(spark, sf).select("id", tx.strip_urls_and_mentions(F.col("text")).alias("text_clean"))


@query(
    "b02_keep_min_length",
    with_ctes(
        MESSAGES,
        select="""SELECT id, group_name, text_clean FROM (SELECT id, group_name,
        regexp_replace(regexp_replace(text, 'http\\S+', '', 'g'), '@\\w+', '', 'g') AS text_clean FROM messages)
        WHERE length(text_clean) >= 20""",
    ),
)
def _(spark, sf):
    return filters.clean_and_keep_long(messages(spark, sf)).select("id", "group_name", "text_clean")


@query(
    "b03_epoch_period",
    with_ctes(
        MESSAGES,
        select="""SELECT id, strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime, year(t) AS year, month(t) AS month
        FROM (SELECT id, make_timestamp("timestamp" * 1000000) AS t FROM messages)""",
    ),
)
def _(spark, sf):
    return filters.add_period(messages(spark, sf)).select("id", "datetime", "year", "month")


@query(
    "b04_epoch_unit_detection",
    with_ctes(
        MESSAGES,
        select="""SELECT id, strftime(make_timestamp(CASE WHEN n > 100000000000 THEN n * 1000 ELSE n * 1000000 END),
        '%Y-%m-%d %H:%M:%S') AS moment, n IS NULL AS bad FROM (SELECT id, TRY_CAST(
        CASE WHEN lang = 'de' THEN concat("timestamp", '000') WHEN lang = 'es' THEN 'x' || id
        ELSE CAST("timestamp" AS VARCHAR) END AS BIGINT) AS n FROM messages)""",
    ),
)
def _(spark, sf):
    raw = (
        F.when(F.col("lang") == "de", F.concat("timestamp", F.lit("000")))
        .when(F.col("lang") == "es", F.concat(F.lit("x"), "id"))
        .otherwise(F.col("timestamp").cast("string"))
    )
    moment = tx.epoch_to_timestamp(F.col("raw"))
    return messages(spark, sf).select("id", raw.alias("raw")).select(
        "id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment"), moment.isNull().alias("bad")
    )


@query(
    "b05_keep_clean_longer",
    with_ctes(
        MESSAGES,
        normal_ctes("messages", "id, group_name"),
        select="SELECT id, group_name, clean_text FROM normal WHERE clean_text <> '' AND length(clean_text) > 20",
    ),
)
def _(spark, sf):
    cleaned = lemmas.normalise(messages(spark, sf), "text", ["id", "group_name"], stopwords=STOPWORDS)
    return filters.keep_longer_than(cleaned, "clean_text").select("id", "group_name", "clean_text")


@query(
    "b06_keep_equal",
    with_ctes(MESSAGES, select="SELECT id, group_name, lang FROM messages WHERE lang = 'en'"),
)
def _(spark, sf):
    return filters.keep_equal(messages(spark, sf), "lang", "en").select("id", "group_name", "lang")


@query(
    "b07_keep_valid_period",
    """SELECT event_id AS id, year(ts) AS year, month(ts) AS month FROM events
    WHERE event_type <> 'error' AND year(ts) = 2024""",
)
def _(spark, sf):
    dated = posts(spark, sf).select(
        "id",
        F.when(F.col("group_name") != "error", F.year("ts")).alias("year"),
        F.month("ts").alias("month"),
    )
    return filters.keep_valid_period(dated, 2024)


@query(
    "b08_stratum_key",
    with_ctes(
        MESSAGES,
        select="""SELECT id, concat_ws('_', month(make_timestamp("timestamp" * 1000000)),
        CASE WHEN lang <> 'es' THEN group_name END) AS strat_key FROM messages""",
    ),
)
def _(spark, sf):
    dated = filters.add_period(messages(spark, sf)).withColumn(
        "group_name", F.when(F.col("lang") != "es", F.col("group_name"))
    )
    return filters.add_stratum(dated, ["month", "group_name"]).select("id", "strat_key")


@query(
    "b09_coerce_timestamp",
    """SELECT id, strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime, value FROM (SELECT event_id AS id,
    TRY_CAST(CASE WHEN event_type = 'error' THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS t,
    CASE WHEN event_type <> 'view' THEN value END AS value FROM events) WHERE t IS NOT NULL AND value IS NOT NULL""",
)
def _(spark, sf):
    raw = posts(spark, sf).select(
        "id",
        F.when(F.col("group_name") == "error", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("datetime"),
        F.when(F.col("group_name") != "view", F.col("score")).alias("value"),
    )
    kept = filters.coerce_timestamp(raw, "datetime", ["datetime", "value"])
    return kept.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))


@query(
    "b10_pretty_label",
    """SELECT p_partkey AS id, array_to_string(list_transform(string_split(replace(label, '_', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label_pretty
    FROM (SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_', p_type) AS label FROM part)""",
)
def _(spark, sf):
    label = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.pretty_label(label).alias("label_pretty"))


@query("b11_keep_labels", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def _(spark, sf):
    return filters.keep_labels(table(spark, sf, "events"), "event_type", ["click", "error"]).select(
        "event_id", "event_type"
    )


@query("b12_rename_if_present", "SELECT doc_id AS id, source AS group_name, lang AS language FROM documents")
def _(spark, sf):
    names = {"doc_id": "id", "source": "group_name", "lang": "language", "predicted": "macro_topic"}
    return filters.rename_if_present(table(spark, sf, "documents"), names).select("id", "group_name", "language")


@query("b13_slug", "SELECT page_id, replace(replace(concat(url, ' ', page_id), '/', '_'), ' ', '_') AS slug FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.slug(F.concat("url", F.lit(" "), F.col("page_id").cast("string"))).alias("slug")
    )


@query(
    "b14_row_type",
    with_ctes(
        POST_TOPICS,
        MACRO_MAP,
        select="""SELECT p.id, p.group_name, coalesce(CASE WHEN p.topic = -1 THEN 'Outlier'
        WHEN m.is_political THEN 'Political' WHEN NOT m.is_political THEN 'Non-political' END, 'none') AS row_type
        FROM post_topics p LEFT JOIN macro_map m ON p.topic = m.topic""",
    ),
)
def _(spark, sf):
    joined = post_topics(spark, sf).join(macro_map(spark, sf), "topic", "left")
    kind = F.coalesce(filters.row_type(F.col("topic"), F.col("is_political")), F.lit("none"))
    return joined.select("id", "group_name", kind.alias("row_type"))


@query(
    "b15_merge_keys",
    """SELECT l.p_size_key AS size_key, count(*) AS pairs FROM
    (SELECT CAST(p_size AS VARCHAR) AS p_size_key FROM part) l
    JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS n_key FROM nation) r
    ON l.p_size_key = r.n_key GROUP BY ALL""",
)
def _(spark, sf):
    sizes = table(spark, sf, "part").select(
        filters.merge_key(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("size_key")
    )
    nations = table(spark, sf, "nation").select(filters.merge_key(F.col("n_nationkey").cast("double")).alias("size_key"))
    return sizes.join(nations, "size_key").groupBy("size_key").agg(F.count("*").alias("pairs"))


@query(
    "b16_reactions",
    """SELECT event_id AS id, key AS reaction, CAST(props ->> ('$.' || key) AS INTEGER) AS reaction_count
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
)
def _(spark, sf):
    return filters.explode_reactions(posts(spark, sf), "props").select("id", "reaction", "reaction_count")


# ---------------------------------------------------------------- text normalisation, step by step


def _step(name, expression, sql):
    statement = with_ctes(WEB_MESSAGES, select=f"SELECT id, {sql} AS value FROM web_messages")

    @query(name, statement)
    def _(spark, sf):
        return web_messages(spark, sf).select("id", expression(F.col("text")).alias("value"))


_step("c01_lower", tx.safe_lower, LOWER_SQL)
_step("c02_strip_links", tx.strip_links, LINKS_SQL.format("text"))
_step("c03_strip_tags", tx.strip_tags, TAGS_SQL.format("text"))
_step("c04_strip_punctuation", tx.strip_punctuation, PUNCTUATION_SQL.format("text"))
_step("c05_strip_digits", tx.strip_digits, DIGITS_SQL.format("text"))
_step("c06_cap_repetitions", tx.cap_repetitions, CAP_SQL.format("text"))
_step("c13_light_clean", tx.light_clean,
      "trim(regexp_replace(regexp_replace(coalesce(text, ''), 'http\\S+|www.\\S+', '', 'g'), '\\s+', ' ', 'g'))")


@query(
    "c07_tokens",
    f"""SELECT doc_id AS id, len(t) AS n_tokens, array_to_string(t, '|') AS joined
    FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)""",
)
def _(spark, sf):
    words = tx.tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.size(words).alias("n_tokens"), F.array_join(words, "|").alias("joined")
    )


@query(
    "c08_stopwords",
    f"""SELECT doc_id AS id, array_to_string(list_filter({TOKENS_SQL.format('lower(text)')},
    lambda t: NOT list_contains({STOPWORD_SQL}, t)), ' ') AS kept FROM documents""",
)
def _(spark, sf):
    words = tx.drop_stopwords(tx.tokens(F.lower("text")), STOPWORDS)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(words, " ").alias("kept"))


@query(
    "c09_short_words",
    f"""SELECT doc_id AS id, array_to_string(list_filter({TOKENS_SQL.format('lower(text)')},
    lambda t: length(t) >= 3), ' ') AS kept FROM documents""",
)
def _(spark, sf):
    words = tx.drop_short(tx.tokens(F.lower("text")), 3)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(words, " ").alias("kept"))


def lemma_dictionary(spark, sf):
    """A dictionary learned from the benchmark texts: each word form maps to its form without plural or verb ending."""
    words = table(spark, sf, "benchmark").select(F.explode(tx.normalised_tokens(F.col("text"), STOPWORDS)).alias("token"))
    return words.distinct().select("token", F.regexp_replace("token", "(ing|ed|s)$", "").alias("lemma")).filter(
        F.length("lemma") >= 2
    )


LEMMA_DICTIONARY = f"""b_stripped AS (SELECT item_id, {STRIPPED_SQL} AS s FROM benchmark),
b_capped AS (SELECT item_id, {CAP_SQL.format('s')} AS s FROM b_stripped),
b_words AS (SELECT DISTINCT unnest(list_filter({TOKENS_SQL.format('s')},
  lambda t: NOT list_contains({STOPWORD_SQL}, t) AND length(t) >= 3)) AS token FROM b_capped),
dictionary AS (SELECT token, regexp_replace(token, '(ing|ed|s)$', '') AS lemma FROM b_words
  WHERE length(regexp_replace(token, '(ing|ed|s)$', '')) >= 2)"""


@query(
    "c10_lemmatise",
    with_ctes(
        MESSAGES,
        normal_ctes("messages", "id"),
        LEMMA_DICTIONARY,
        select="""SELECT lemma, count(*) AS n, count(DISTINCT w.id) AS docs FROM (
        SELECT w.id, coalesce(d.lemma, w.token) AS lemma FROM (SELECT id, unnest(words) AS token FROM normal) w
        LEFT JOIN dictionary d ON w.token = d.token) w GROUP BY lemma""",
    ),
)
def _(spark, sf):
    rows = lemmas.explode_tokens(messages(spark, sf), ["id"], tx.normalised_tokens(F.col("text"), STOPWORDS))
    found = lemmas.lemmatise(rows, lemma_dictionary(spark, sf))
    return found.groupBy("lemma").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


TAG_NAMES = ["adj", "adv", "noun", "verb"]
ENDINGS = {"adj": "(er|est)$", "adv": "ly$", "noun": "s$", "verb": "(ing|ed|s)$"}


def tagged_words(spark, sf):
    """The words of the benchmark texts with a tag that depends on the word and on the one before it."""
    words = table(spark, sf, "benchmark").select("item_id", tx.normalised_tokens(F.col("text"), STOPWORDS).alias("w"))
    spelt = words.select("item_id", F.posexplode("w").alias("position", "token"), "w")
    before = F.when(F.col("position") > 0, F.length(F.expr("w[position - 1]"))).otherwise(0)
    names = F.array(*[F.lit(t) for t in TAG_NAMES])
    return spelt.select("item_id", "position", "token", names[(F.length("token") + before % 2) % 4].alias("tag"))


def tagged_dictionary(tagged):
    """Word and tag to the word without the ending that its part of speech has."""
    lemma = F.col("token")
    for tag, ending in ENDINGS.items():
        lemma = F.when(F.col("tag") == tag, F.regexp_replace("token", ending, "")).otherwise(lemma)
    return tagged.select("token", "tag").distinct().withColumn("lemma", lemma).filter(F.length("lemma") >= 2)


TAGGED = f"""b_stripped AS (SELECT item_id, {STRIPPED_SQL} AS s FROM benchmark),
b_capped AS (SELECT item_id, {CAP_SQL.format('s')} AS s FROM b_stripped),
b_lists AS (SELECT item_id, list_filter({TOKENS_SQL.format('s')},
  lambda t: NOT list_contains({STOPWORD_SQL}, t) AND length(t) >= 3) AS w FROM b_capped),
b_spelt AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS position, w FROM b_lists),
tagged AS (SELECT item_id, position, token,
  {TAG_NAMES}[(length(token) + CASE WHEN position > 1 THEN length(w[position - 1]) ELSE 0 END % 2) % 4 + 1] AS tag FROM b_spelt),
by_tag AS (SELECT DISTINCT token, tag, CASE tag {" ".join(f"WHEN '{t}' THEN regexp_replace(token, '{e}', '')" for t, e in ENDINGS.items())} END AS lemma
  FROM tagged),
dictionary AS (SELECT * FROM by_tag WHERE length(lemma) >= 2)"""


@query(
    "c10_lemmatise_by_tag",
    with_ctes(
        TAGGED,
        select="""SELECT item_id, string_agg(coalesce(lemma, t.token), ' ' ORDER BY position) AS lemmas
        FROM tagged t LEFT JOIN dictionary d ON t.token = d.token AND t.tag = d.tag GROUP BY item_id""",
    ),
)
def _(spark, sf):
    tagged = tagged_words(spark, sf)
    found = tagging.lemmatise_tagged(tagged, tagged_dictionary(tagged))
    return lemmas.collect_text(found, ["item_id"], "lemma", "lemmas")


def log_share_sql(count: str, total: str) -> str:
    return f"CAST(floor(1000::DOUBLE * ln(({count})::DOUBLE / ({total}))) AS BIGINT)"


TAGS_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TAG_NAMES))
VITERBI = f"""names(k, tag) AS (VALUES {TAGS_SQL}),
per_tag AS (SELECT k, count(tagged.tag) AS n FROM names LEFT JOIN tagged USING (tag) GROUP BY k),
chained AS (SELECT item_id, tag, lag(tag) OVER (PARTITION BY item_id ORDER BY position) AS before FROM tagged),
starts AS (SELECT k, count(c.tag) AS n FROM names LEFT JOIN (SELECT tag FROM chained WHERE before IS NULL) c USING (tag) GROUP BY k),
start AS (SELECT list({log_share_sql('n + 1', '(SELECT sum(n) FROM starts) + 4')} ORDER BY k) AS start FROM starts),
pairs AS (SELECT a.k AS i, b.k AS j, count(c.tag) AS n FROM names a CROSS JOIN names b
  LEFT JOIN chained c ON c.before = a.tag AND c.tag = b.tag GROUP BY 1, 2),
arrive AS (SELECT j, list({log_share_sql('n + 1', 'leaving + 4')} ORDER BY i) AS row
  FROM (SELECT *, sum(n) OVER (PARTITION BY i) AS leaving FROM pairs) GROUP BY j),
follow AS (SELECT list(row ORDER BY j) AS follow FROM arrive),
of_word AS (SELECT token, k, count(*) FILTER (t.tag = names.tag) AS n, count(*) AS total FROM tagged t CROSS JOIN names GROUP BY 1, 2),
vocabulary AS (SELECT count(DISTINCT token) AS v, count(*) AS total FROM tagged),
rare AS (SELECT k, sum(n) FILTER (total = 1) AS n FROM of_word GROUP BY 1),
scores AS (SELECT token, list({log_share_sql('o.n + 1', 'p.n + v + 1')} ORDER BY k) AS e FROM of_word o JOIN per_tag p USING (k), vocabulary GROUP BY 1),
unknown AS (SELECT list({log_share_sql('coalesce(r.n, 0) + 1', '(SELECT coalesce(sum(n), 0) FROM rare) + 4')}
  - {log_share_sql('p.n + 1', 'total + 4')} + {log_share_sql('1', 'v + 1')} ORDER BY k) AS u FROM rare r JOIN per_tag p USING (k), vocabulary),
spelt AS (SELECT id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM normal),
paths AS (SELECT id, list(coalesce(e, u) ORDER BY pos) AS es FROM spelt LEFT JOIN scores USING (token), unknown GROUP BY id),
forward(id, pos, n, s, backs, es) AS (
  SELECT id, 1, len(es), list_transform(start, lambda x, i: x + es[1][i]), CAST([] AS BIGINT[][]), es FROM paths, start
  UNION ALL
  SELECT id, pos + 1, n, list_transform(m, lambda x, j: list_max(x) + es[pos + 1][j]),
    list_append(backs, list_transform(m, lambda x: CAST(list_position(x, list_max(x)) AS BIGINT))), es
  FROM (SELECT f.*, list_transform(follow, lambda row: list_transform(row, lambda x, i: x + f.s[i])) AS m FROM forward f, follow WHERE pos < n)),
backward(id, pos, k, backs, found) AS (
  SELECT id, n, CAST(list_position(s, list_max(s)) AS BIGINT), backs, [CAST(list_position(s, list_max(s)) AS BIGINT)] FROM forward WHERE pos = n
  UNION ALL
  SELECT id, pos - 1, backs[pos - 1][k], backs, list_prepend(backs[pos - 1][k], found) FROM backward WHERE pos > 1),
paths_found AS (SELECT id, list_transform(found, lambda k: {TAG_NAMES}[k]) AS tags FROM backward WHERE pos = 1)"""


def words_and_model(spark, sf):
    words = messages(spark, sf).select("id", tx.normalised_tokens(F.col("text"), STOPWORDS).alias("words"))
    tagged = saved(tagged_words(spark, sf), "tagged-words")
    return words, tagging.learn_tags(tagged, ["item_id"]), tagged


@query(
    "c10_viterbi_tags",
    "WITH RECURSIVE "
    + ", ".join([MESSAGES, normal_ctes("messages", "id"), TAGGED, VITERBI])
    + " SELECT normal.id, coalesce(array_to_string(tags, ' '), '') AS tags FROM normal LEFT JOIN paths_found USING (id)",
)
def _(spark, sf):
    words, model, _ = words_and_model(spark, sf)
    return tagging.tag_words(words, "words", model).select("id", F.array_join("tags", " ").alias("tags"))


@query(
    "c12_normalise_tagged_lemmas",
    "WITH RECURSIVE "
    + ", ".join([MESSAGES, normal_ctes("messages", "id"), TAGGED, VITERBI])
    + """, both_lists AS (SELECT spelt.id, pos, token, tags[pos] AS tag FROM spelt JOIN paths_found USING (id)),
    texts AS (SELECT id, string_agg(coalesce(lemma, b.token), ' ' ORDER BY pos) AS clean_text
      FROM both_lists b LEFT JOIN dictionary d ON b.token = d.token AND b.tag = d.tag GROUP BY id)
    SELECT normal.id, coalesce(texts.clean_text, '') AS clean_text FROM normal LEFT JOIN texts USING (id)""",
)
def _(spark, sf):
    """Words tagged by the model of the benchmark texts, then replaced by their lemma for that tag."""
    words, model, tagged = words_and_model(spark, sf)
    cleaned = tagging.normalise_tagged(words, "words", ["id"], model, tagged_dictionary(tagged))
    return cleaned.select("id", "clean_text")


@query(
    "c11_join_tokens",
    f"SELECT doc_id AS id, array_to_string({TOKENS_SQL.format('text')}, ' ') AS joined FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.array_join(tx.tokens(F.col("text")), " ").alias("joined")
    )


@query(
    "c12_normalise",
    with_ctes(
        MESSAGES, normal_ctes("messages", "id, group_name"), select="SELECT id, group_name, clean_text FROM normal"
    ),
)
def _(spark, sf):
    cleaned = lemmas.normalise(messages(spark, sf), "text", ["id", "group_name"], stopwords=STOPWORDS)
    return cleaned.select("id", "group_name", "clean_text")


@query(
    "c12_normalise_lemmas",
    with_ctes(
        MESSAGES,
        normal_ctes("messages", "id, group_name"),
        LEMMA_DICTIONARY,
        select="""SELECT n.id, n.group_name, coalesce(t.clean_text, '') AS clean_text FROM normal n LEFT JOIN (
        SELECT w.id, w.group_name, string_agg(coalesce(d.lemma, w.token), ' ' ORDER BY w.pos) AS clean_text
        FROM (SELECT id, group_name, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM normal) w
        LEFT JOIN dictionary d ON w.token = d.token GROUP BY w.id, w.group_name) t
        ON n.id = t.id AND n.group_name = t.group_name""",
    ),
)
def _(spark, sf):
    cleaned = lemmas.normalise(
        messages(spark, sf), "text", ["id", "group_name"], lemma_dictionary(spark, sf), STOPWORDS
    )
    return cleaned.select("id", "group_name", "clean_text")


@query(
    "c12_messages_per_month_and_group",
    with_ctes(
        MESSAGES,
        normal_ctes("messages", 'id, group_name, lang, "timestamp"'),
        select="""SELECT year(t) AS year, month(t) AS month, group_name, count(*) AS messages FROM (
        SELECT group_name, make_timestamp("timestamp" * 1000000) AS t FROM normal
        WHERE lang = 'en' AND length(clean_text) > 20) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    english = filters.keep_equal(messages(spark, sf), "lang", "en")
    cleaned = lemmas.normalise(english, "text", ["id", "group_name"], stopwords=STOPWORDS)
    kept = filters.add_period(filters.keep_longer_than(cleaned, "clean_text"))
    return kept.groupBy("year", "month", "group_name").agg(F.count("*").alias("messages"))
