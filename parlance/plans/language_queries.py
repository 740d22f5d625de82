"""Language identification over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.numbers import rounded
from parlance.operators import language
from parlance.plans.inputs import MESSAGES, messages, r6, table, with_ctes
from parlance.plans.registry import query

PLAIN_SQL = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


def grams_sql(source: str, columns: str) -> str:
    return f"""SELECT {columns}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
    FROM (SELECT {columns}, string_split({PLAIN_SQL}, '') AS c FROM {source})"""


PROFILES = f"""g AS (SELECT lang, gram, count(*) AS n FROM ({grams_sql('messages', 'lang')}) GROUP BY 1, 2),
v AS (SELECT count(DISTINCT gram) AS v FROM g),
t AS (SELECT lang, CAST(sum(n) AS DOUBLE) + (SELECT v FROM v) AS total FROM g GROUP BY 1)"""


@query(
    "c14_language_profiles",
    with_ctes(
        MESSAGES,
        PROFILES,
        select=f"""SELECT k.gram, string_agg(CAST({r6('ln(coalesce(g.n, 0)::DOUBLE + 1::DOUBLE)')} AS VARCHAR), ' '
        ORDER BY t.lang) AS weights FROM (SELECT DISTINCT gram FROM g) k CROSS JOIN t
        LEFT JOIN g ON g.gram = k.gram AND g.lang = t.lang GROUP BY 1""",
    ),
)
def _(spark, sf):
    profiles = language.fit_profiles(messages(spark, sf), "text", "lang")
    texts = F.transform("weights", lambda w: rounded(w).cast("string"))
    return profiles.select("gram", F.array_join(texts, " ").alias("weights"))


@query(
    "c14_detect_language",
    with_ctes(
        MESSAGES,
        PROFILES,
        f"d AS (SELECT id, gram, count(*) AS n FROM ({grams_sql('messages', 'id')}) GROUP BY 1, 2)",
        "size AS (SELECT id, sum(n) AS n FROM d GROUP BY 1)",
        """seen AS (SELECT d.id, g.lang, sum(d.n * ln(g.n::DOUBLE + 1::DOUBLE)) AS s FROM d JOIN g ON d.gram = g.gram
        GROUP BY 1, 2)""",
        """scores AS (SELECT size.id, t.lang, coalesce(seen.s, 0::DOUBLE) / size.n - ln(t.total) AS score FROM size
        CROSS JOIN t LEFT JOIN seen ON seen.id = size.id AND seen.lang = t.lang)""",
        """best AS (SELECT id, lang, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS rn
        FROM scores)""",
        select=f"""SELECT m.id, m.group_name, coalesce(b.lang, 'unknown') AS language,
        {r6('coalesce(b.score, 0::DOUBLE)')} AS log_likelihood FROM messages m LEFT JOIN best b ON m.id = b.id AND b.rn = 1""",
    ),
)
def _(spark, sf):
    docs = messages(spark, sf)
    found = language.detect_language(docs, language.fit_profiles(docs, "text", "lang"), "text", ["id", "group_name"])
    score = rounded(F.coalesce("log_likelihood", F.lit(0.0)))
    return found.select("id", "group_name", "language", score.alias("log_likelihood"))


@query("c15_language_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return language.language_distribution(table(spark, sf, "documents"), "lang")


@query(
    "c16_language_share",
    f"""SELECT count(*) AS "rows", count(*) FILTER (lang = 'en') AS matching,
    {r6("count(*) FILTER (lang = 'en') * 100.0::DOUBLE / count(*)")} AS percent FROM documents""",
)
def _(spark, sf):
    return language.language_share(table(spark, sf, "documents"), "lang", "en").withColumn("percent", rounded(F.col("percent")))


@query(
    "c16_sample_rows",
    """SELECT doc_id, lang, inside FROM (SELECT doc_id, lang, coalesce(lang = 'en', false) AS inside,
    row_number() OVER (PARTITION BY coalesce(lang = 'en', false) ORDER BY md5('42_' || doc_id), doc_id) AS rn FROM documents)
    WHERE rn <= 10""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return language.sample_in_and_outside(docs, "lang", "en", ["doc_id"], 10)
