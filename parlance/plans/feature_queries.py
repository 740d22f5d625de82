"""Toxicity scores, linguistic features and feature selection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.numbers import rounded
from parlance.operators import entities
from parlance.operators import features as ft
from parlance.operators import filters, joins, selection, toxicity
from parlance.plans.inputs import MESSAGES, macro_map, messages, post_topics, r6, table, with_ctes
from parlance.plans.registry import query
from parlance.session import scratch_path, spread
from parlance.plans.text_queries import STOPWORDS
from parlance.schemas import TOXICITY_SCORES

KEY = ["doc_id"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
TAG_CYCLE = ["noun", "verb", "adj", "det", "adp", "pron", "propn"]
ENTITY_CYCLE = ["person", "org", "gpe"]


def round_all(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def items(spark, sf):
    return spread(table(spark, sf, "lineitem").select(*FEATURES, "l_returnflag"), "l_extendedprice")


def lookup(spark, sf):
    """Dictionary, word norms and gazetteer derived from the words of the benchmark texts."""
    words = table(spark, sf, "benchmark").select(F.explode(ft.words_of(F.col("text"))).alias("token")).distinct()
    size = F.length("token")
    tag = F.array(*[F.lit(t) for t in TAG_CYCLE])[size % len(TAG_CYCLE)]
    dictionary = words.select("token", tag.alias("tag"), F.regexp_replace("token", "(ing|ed|s)$", "").alias("lemma"))
    norms = words.filter(size >= 3).select(
        "token", (size * 0.5).alias("kup"), (size + 1.0).alias("bry"), (7.0 - size * 0.25).alias("subtlex_us_zipf")
    )
    entity = F.array(*[F.lit(e) for e in ENTITY_CYCLE])[size % len(ENTITY_CYCLE)]
    gazetteer = words.filter(size >= 9).select("token", entity.alias("entity"))
    return ft.token_lookup(dictionary, norms, gazetteer)


def _case(expression, values):
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


WORD_SQL = "[\\p{L}\\p{M}\\p{N}_]+"
LOOKUP = f"""lk AS (SELECT token, {_case(f'length(token) % {len(TAG_CYCLE)}', TAG_CYCLE)} AS tag,
  regexp_replace(token, '(ing|ed|s)$', '') AS lemma,
  CASE WHEN length(token) >= 3 THEN length(token) * 0.5::DOUBLE END AS kup,
  CASE WHEN length(token) >= 3 THEN length(token) + 1.0::DOUBLE END AS bry,
  CASE WHEN length(token) >= 3 THEN 7.0::DOUBLE - length(token) * 0.25::DOUBLE END AS subtlex_us_zipf,
  CASE WHEN length(token) >= 9 THEN {_case(f'length(token) % {len(ENTITY_CYCLE)}', ENTITY_CYCLE)} END AS entity
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS token FROM benchmark))"""

COUNTS = f"""w AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS words FROM documents),
  syl AS (SELECT *, list_transform(words, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1)) AS s FROM w),
  counts AS (SELECT doc_id, text, len(words) AS t_word,
    len(list_filter(words, lambda x: x IN ({STOP_SQL}))) AS t_stopword,
    len(regexp_extract_all(coalesce(text, ''), '[!-/:-@\\[-`{{-~]')) AS t_punct,
    CAST(coalesce(list_sum(s), 0) AS BIGINT) AS t_syll, len(list_filter(s, lambda x: x >= 2)) AS t_syll2,
    len(list_filter(s, lambda x: x >= 3)) AS t_syll3, len(list_distinct(words)) AS t_uword,
    len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda x: trim(x, ' ') <> '')) AS t_sent,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS t_char FROM syl)"""

PUNCT_CLASS = "[!-/:-@\\[-`{-~]"
TOKENS = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')),
    '{WORD_SQL}|[!-/:-@\\[-^`{{-~]')) AS token FROM documents),
  tok_n AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2),
  tagged AS (SELECT t.doc_id, t.token, t.n, coalesce(lk.tag, CASE WHEN regexp_matches(t.token, '^\\p{{Nd}}+$') THEN 'num'
    WHEN instr('$+<=>^`|~', t.token) > 0 THEN 'sym' WHEN regexp_matches(t.token, '^{PUNCT_CLASS}$') THEN 'punct'
    ELSE 'noun' END) AS tag, coalesce(lk.lemma, t.token) AS lemma, kup, bry, subtlex_us_zipf, entity
    FROM tok_n t LEFT JOIN lk ON t.token = lk.token),
  tfeat AS (SELECT doc_id,
    {", ".join(f"CAST(coalesce(sum(n) FILTER (tag = '{t}'), 0) AS BIGINT) AS n_{t}, count(*) FILTER (tag = '{t}') AS n_u{t}" for t in ft.TAGS)},
    {", ".join(f"coalesce(sum({m} * n), 0::DOUBLE) AS t_{m}" for m in ft.NORMS)},
    {", ".join(f"CAST(coalesce(sum(n) FILTER (entity = '{e}'), 0) AS BIGINT) AS t_n_ent_{e}" for e in ft.ENTITIES if e not in ft.ENTITY_PATTERNS)},
    CAST(coalesce(sum(n) FILTER (tag NOT IN ('punct', 'sym', 'space')), 0) AS BIGINT) AS tokens,
    count(*) FILTER (tag NOT IN ('punct', 'sym', 'space')) AS types,
    count(DISTINCT lemma) FILTER (tag NOT IN ('punct', 'sym', 'space')) AS lemmas FROM tagged GROUP BY 1)"""



def entity_steps() -> str:
    """One step per pattern: count its matches, blank them out."""
    steps, before = ["pat0 AS (SELECT doc_id, lower(coalesce(text, '')) AS rest FROM documents)"], "pat0"
    for k, p in ft.ENTITY_PATTERNS.items():
        steps.append(
            f"pat_{k} AS (SELECT * EXCLUDE (rest), len(regexp_extract_all(rest, '{p}')) AS t_n_ent_{k}, "
            f"regexp_replace(rest, '{p}', ' ', 'g') AS rest FROM {before})"
        )
        before = f"pat_{k}"
    return ", ".join(steps) + f", pat AS (SELECT * EXCLUDE (rest) FROM {before})"


ALL = f"""{entity_steps()},
  base AS (SELECT c.* EXCLUDE (text), pat.* EXCLUDE (doc_id),
    {", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in [*[f"n_{t}" for t in ft.TAGS], *[f"n_u{t}" for t in ft.TAGS], *[f"t_{m}" for m in ft.NORMS], *[f"t_n_ent_{e}" for e in ft.ENTITIES if e not in ft.ENTITY_PATTERNS], "tokens", "types", "lemmas"])}
    FROM counts c JOIN pat USING (doc_id) LEFT JOIN tfeat f USING (doc_id)),
  total AS (SELECT *, {" + ".join(f"t_n_ent_{e}" for e in ft.ENTITIES)} AS t_n_ent FROM base)"""


def _ratio(n, d):
    return f"CASE WHEN {d} <> 0 THEN {n}::DOUBLE / {d} ELSE 0::DOUBLE END"


def feature_sql() -> dict[str, str]:
    """SQL of every derived feature over the ``total`` CTE."""
    d = {}
    for name, (n, by) in {
        "a_word_ps": ("t_word", "t_sent"), "a_char_ps": ("t_char", "t_sent"), "a_char_pw": ("t_char", "t_word"),
        "a_syll_ps": ("t_syll", "t_sent"), "a_syll_pw": ("t_syll", "t_word"),
        "a_stopword_ps": ("t_stopword", "t_sent"), "a_stopword_pw": ("t_stopword", "t_word"),
    }.items():
        d[name] = _ratio(n, by)
    for m in ft.NORMS:
        d[f"a_{m}_pw"], d[f"a_{m}_ps"] = _ratio(f"t_{m}", "t_word"), _ratio(f"t_{m}", "t_sent")
    for e in ["", *[f"_{e}" for e in ft.ENTITIES]]:
        d[f"a_n_ent{e}_pw"], d[f"a_n_ent{e}_ps"] = _ratio(f"t_n_ent{e}", "t_word"), _ratio(f"t_n_ent{e}", "t_sent")
    for t in ft.TAGS:
        d[f"simp_{t}_var"] = _ratio(f"n_u{t}", f"n_{t}")
        d[f"root_{t}_var"] = _ratio(f"n_u{t}", f"sqrt(n_{t})")
        d[f"corr_{t}_var"] = _ratio(f"n_u{t}", f"sqrt(2 * n_{t})")
        d[f"a_{t}_pw"], d[f"a_{t}_ps"] = _ratio(f"n_{t}", "t_word"), _ratio(f"n_{t}", "t_sent")
    for s, u in (("", "lemmas"), ("_no_lem", "types")):
        d[f"simp_ttr{s}"] = _ratio(u, "tokens")
        d[f"root_ttr{s}"] = _ratio(u, "sqrt(tokens)")
        d[f"corr_ttr{s}"] = _ratio(u, "sqrt(2 * tokens)")
        d[f"bilog_ttr{s}"] = f"CASE WHEN tokens > 1 THEN ln(greatest({u}, 1)) / ln(tokens) ELSE 0::DOUBLE END"
        d[f"uber_ttr{s}"] = (
            f"CASE WHEN tokens > 1 AND {u} < tokens AND {u} > 0 THEN ln(tokens) * ln(tokens) / ln(tokens::DOUBLE / {u}) ELSE 0::DOUBLE END"
        )
    w, s = "t_word::DOUBLE", "greatest(t_sent, 1)::DOUBLE"
    for name, f in {
        "fkre": f"206.835::DOUBLE - 1.015::DOUBLE * ({w} / {s}) - 84.6::DOUBLE * (t_syll / {w})",
        "fkgl": f"0.39::DOUBLE * ({w} / {s}) + 11.8::DOUBLE * (t_syll / {w}) - 15.59::DOUBLE",
        "fogi": f"0.4::DOUBLE * ({w} / {s} + 100 * t_syll3 / {w})",
        "smog": f"1.043::DOUBLE * sqrt(t_syll3 * 30 / {s}) + 3.1291::DOUBLE",
        "cole": f"5.88::DOUBLE * (t_char / {w}) - 29.6::DOUBLE * {s} / {w} - 15.8::DOUBLE",
        "auto": f"4.71::DOUBLE * (t_char / {w}) + 0.5::DOUBLE * ({w} / {s}) - 21.43::DOUBLE",
    }.items():
        d[name] = f"CASE WHEN t_word > 0 THEN {f} ELSE 0::DOUBLE END"
    d["rt_fast"], d["rt_average"], d["rt_slow"] = "t_word / 300::DOUBLE", "t_word / 240::DOUBLE", "t_word / 175::DOUBLE"
    return d


def features_query(name, columns, needs_tokens=True):
    """Register some of the feature columns, derived ones rounded."""
    derived = feature_sql()
    ctes = [LOOKUP, COUNTS, TOKENS, ALL]
    listed = ", ".join(f"{r6(derived[c])} AS {c}" if c in derived else (f"{r6(c)} AS {c}" if c in NORM_TOTALS else c) for c in columns)
    to_round = [c for c in columns if c in derived or c in NORM_TOTALS]

    @query(name, with_ctes(*ctes, select=f"SELECT doc_id, {listed} FROM total"))
    def _(spark, sf):
        rows = ft.linguistic_features(docs(spark, sf), KEY, "text", lookup(spark, sf), STOPWORDS)
        exact = [c for c in columns if c not in to_round]
        return rows.selectExpr("doc_id", *exact, *[f"floor({c} * 1e6D + 0.5D) / 1e6D AS {c}" for c in to_round])


NORM_TOTALS = [f"t_{m}" for m in ft.NORMS]
COUNT_COLUMNS = "t_word t_stopword t_punct t_syll t_syll2 t_syll3 t_uword t_sent t_char".split()


@query("j01_counts", with_ctes(COUNTS, select=f"SELECT doc_id, {', '.join(COUNT_COLUMNS)} FROM counts"))
def _(spark, sf):
    return ft.add_counts(docs(spark, sf), "text", STOPWORDS).select("doc_id", *COUNT_COLUMNS)


_SIMPLE = {
    "j02_averages": (ft.add_averages, "a_word_ps a_char_ps a_char_pw a_syll_ps a_syll_pw a_stopword_ps a_stopword_pw".split()),
    "j08_readability": (ft.add_readability, "fkre fkgl fogi smog cole auto".split()),
    "j09_reading_time": (ft.add_reading_time, "rt_fast rt_average rt_slow".split()),
}


def _register_simple(name, function, columns):
    derived = feature_sql()
    listed = ", ".join(f"{r6(derived[c])} AS {c}" for c in columns)

    @query(name, with_ctes(COUNTS, select=f"SELECT doc_id, {listed} FROM counts"))
    def _(spark, sf):
        rows = function(ft.add_counts(docs(spark, sf), "text", STOPWORDS))
        return round_all(rows.select("doc_id", *columns), *columns)


for _name, (_function, _columns) in _SIMPLE.items():
    _register_simple(_name, _function, _columns)

features_query("j03_word_norms", [c for c in ft.feature_names() if any(m in c for m in ft.NORMS)])
features_query("j04_entities", [c for c in ft.feature_names() if "n_ent" in c])
TOKEN_SQL = WORD_SQL + "|[!-/:-@\\[-^`{-~]"


def gazetteer(spark, sf):
    """Names of one to three words taken from the benchmark texts: runs that begin with a long word, so that many overlap."""
    words = table(spark, sf, "benchmark").select(ft.tokens_of(F.col("text")).alias("w"))
    runs = words.select("w", F.posexplode("w").alias("i", "first")).filter(F.length("first") >= 8)
    names = runs.select(F.explode(F.array(*[F.array_join(F.slice("w", F.col("i") + 1, n), " ") for n in (1, 2, 3)])).alias("name"))
    entity = F.array(*[F.lit(e) for e in ENTITY_CYCLE])[F.length("name") % len(ENTITY_CYCLE)]
    return names.distinct().withColumn("entity", entity)


def spans_sql(source: str, key: str) -> str:
    """Every word of the texts with the runs of one, two and three words that begin at it."""
    return f"""(SELECT {key}, i - 1 AS start, t1, unnest([t1, t1 || ' ' || t2, t1 || ' ' || t2 || ' ' || t3]) AS name, unnest([1, 2, 3]) AS words
    FROM (SELECT {key}, i, t1, lead(t1, 1) OVER ahead AS t2, lead(t1, 2) OVER ahead AS t3
      FROM (SELECT {key}, unnest(w) AS t1, generate_subscripts(w, 1) AS i
        FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_SQL}') AS w FROM {source}))
      WINDOW ahead AS (PARTITION BY {key} ORDER BY i)))"""


NAMES = f"""gazetteer AS (SELECT DISTINCT name, {_case(f"length(name) % {len(ENTITY_CYCLE)}", ENTITY_CYCLE)} AS entity
    FROM {spans_sql('benchmark', 'item_id')} WHERE length(t1) >= 8 AND name IS NOT NULL),
  hits AS (SELECT doc_id, start, words, name, entity FROM {spans_sql('documents', 'doc_id')} JOIN gazetteer USING (name)),
  listed AS (SELECT doc_id, list(struct_pack(start := start, words := words, name := name, entity := entity) ORDER BY start, words DESC) AS ms
    FROM hits GROUP BY doc_id),
  walk(doc_id, m, ms) AS (SELECT doc_id, ms[1], ms FROM listed
    UNION ALL SELECT doc_id, rest[1], rest FROM (SELECT doc_id, list_filter(ms, lambda x: x.start >= m.start + m.words) AS rest FROM walk)
    WHERE len(rest) > 0),
  found AS (SELECT doc_id, m.start AS start, m.words AS words, m.name AS name, m.entity AS entity FROM walk)"""


@query(
    "j04_named_entities",
    f"WITH RECURSIVE {NAMES} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(words AS INTEGER) AS words, name, entity FROM found",
)
def _(spark, sf):
    return entities.find_entities(docs(spark, sf), KEY, "text", gazetteer(spark, sf))


@query(
    "j04_named_entity_counts",
    f"WITH RECURSIVE {NAMES}, d_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_SQL}') AS w FROM documents), per AS (SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (entity = '{e}') AS t_n_ent_{e}" for e in ENTITY_CYCLE)
    + f" FROM found GROUP BY 1), totals AS (SELECT doc_id, len(w) AS tokens, "
    + ", ".join(f"coalesce(t_n_ent_{e}, 0) AS t_n_ent_{e}" for e in ENTITY_CYCLE)
    + " FROM d_words LEFT JOIN per USING (doc_id)) SELECT *, " + " + ".join(f"t_n_ent_{e}" for e in ENTITY_CYCLE) + " AS t_n_ent, "
    + r6(f"CASE WHEN tokens > 0 THEN ({' + '.join(f't_n_ent_{e}' for e in ENTITY_CYCLE)})::DOUBLE / tokens ELSE 0::DOUBLE END") + " AS a_n_ent_pt FROM totals",
)
def _(spark, sf):
    return round_all(entities.entity_counts(docs(spark, sf), KEY, "text", gazetteer(spark, sf), ENTITY_CYCLE), "a_n_ent_pt")


features_query("j05_tag_variation", [c for c in ft.feature_names() if c.endswith("_var")])
features_query("j06_type_token_ratios", [c for c in ft.feature_names() if "_ttr" in c])
features_query(
    "j07_tag_counts",
    [f"n_{t}" for t in ft.TAGS] + [f"n_u{t}" for t in ft.TAGS] + [f"a_{t}_{p}" for t in ft.TAGS for p in ("pw", "ps")],
)
features_query("j10_all_features", ft.feature_names())


@query("j10_resume_features", with_ctes(COUNTS, select=f"SELECT doc_id, {', '.join(COUNT_COLUMNS)}, 1 AS times FROM counts"))
def _(spark, sf):
    """Half of the documents, then all of them: the second run adds the other half."""
    path, rows, known = scratch_path(spark, "features"), docs(spark, sf), lookup(spark, sf)
    ft.resume_features(rows.filter("doc_id % 2 = 0"), KEY, "text", known, STOPWORDS, path)
    ft.resume_features(rows, KEY, "text", known, STOPWORDS, path)
    found = spark.read.parquet(path).groupBy("doc_id", *COUNT_COLUMNS).agg(F.count("*").cast("int").alias("times"))
    return found.select("doc_id", *COUNT_COLUMNS, "times")


# ---------------------------------------------------------------- feature selection


@query(
    "j11_language_features",
    with_ctes(
        COUNTS,
        select=f"""SELECT round(sum(t_word))::BIGINT AS t_word, CAST(sum(t_uword) AS BIGINT) AS t_uword,
        {r6('sum(t_word / 300::DOUBLE)')} AS rt_fast, count(*) AS "rows" FROM counts""",
    ),
)
def _(spark, sf):
    rows = ft.add_reading_time(ft.add_readability(ft.add_counts(docs(spark, sf), "text", STOPWORDS)))
    kept = ft.language_features(["t_word", "t_uword", "fkre", "fogi", "rt_fast"], ft.feature_metadata(spark), "pt")
    sums = rows.agg(*[F.sum(c).alias(c) for c in kept], F.count("*").alias("rows"))
    return round_all(sums, "rt_fast")


GINI_COUNTS = f"""long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, l_returnflag AS label FROM lineitem" for f in FEATURES)}),
  vc AS (SELECT feature, value, label, count(*) AS n FROM long GROUP BY 1, 2, 3),
  vals AS (SELECT DISTINCT feature, value FROM vc),
  labs AS (SELECT DISTINCT label FROM vc),
  grid AS (SELECT v.feature, v.value, l.label, coalesce(vc.n, 0) AS n FROM vals v CROSS JOIN labs l
    LEFT JOIN vc ON vc.feature = v.feature AND vc.value = v.value AND vc.label = l.label),
  run AS (SELECT feature, value, label, sum(n) OVER (PARTITION BY feature, label ORDER BY value)::DOUBLE AS l,
    sum(n) OVER (PARTITION BY feature, label)::DOUBLE AS t FROM grid),
  agg AS (SELECT feature, value, sum(l) AS nl, sum(l * l) AS l2, sum(t - l) AS nr, sum((t - l) * (t - l)) AS r2,
    sum(t) AS n, sum(t * t) AS t2 FROM run GROUP BY 1, 2),
  gain AS (SELECT feature AS attribute, value AS split, (1 - t2 / (n * n)) - (nl / n * (1 - l2 / (nl * nl)) +
    CASE WHEN nr > 0 THEN nr / n * (1 - r2 / (nr * nr)) ELSE 0::DOUBLE END) AS gini_gain FROM agg)"""


def _r8(expression):
    return f"floor(({expression}) * 100000000::DOUBLE + 0.5::DOUBLE) / 100000000::DOUBLE"


@query(
    "j12_gini_ranking",
    with_ctes(GINI_COUNTS, select=f"SELECT attribute, {r6('split')} AS split, {_r8('gini_gain')} AS gini_gain FROM gain"),
)
def _(spark, sf):
    ranking = selection.gini_ranking(items(spark, sf), FEATURES, "l_returnflag")
    return ranking.select("attribute", rounded(F.col("split")).alias("split"), rounded(F.col("gini_gain"), 8).alias("gini_gain"))


@query(
    "j12_gini_ranking_percentiles",
    with_ctes(
        GINI_COUNTS,
        "uniq AS (SELECT attribute, list(split ORDER BY split) AS u FROM gain GROUP BY 1)",
        """thr AS (SELECT attribute, CASE WHEN len(u) <= 50 THEN u ELSE list_transform(range(0, 50), lambda j:
          u[CAST(floor((len(u) - 1) * j / 49.0::DOUBLE) AS BIGINT) + 1] + coalesce(
          u[CAST(floor((len(u) - 1) * j / 49.0::DOUBLE) AS BIGINT) + 2] - u[CAST(floor((len(u) - 1) * j / 49.0::DOUBLE) AS BIGINT) + 1],
          0::DOUBLE) * ((len(u) - 1) * j / 49.0::DOUBLE - floor((len(u) - 1) * j / 49.0::DOUBLE))) END AS t FROM uniq)""",
        "each AS (SELECT attribute, unnest(t) AS split FROM thr)",
        select=f"""SELECT e.attribute, {r6('e.split')} AS split, {_r8('g.gini_gain')} AS gini_gain FROM each e ASOF JOIN gain g
        ON e.attribute = g.attribute AND e.split >= g.split""",
    ),
)
def _(spark, sf):
    ranking = selection.gini_ranking(items(spark, sf), FEATURES, "l_returnflag", n_thresholds=50)
    return ranking.select("attribute", rounded(F.col("split")).alias("split"), rounded(F.col("gini_gain"), 8).alias("gini_gain"))


@query(
    "j13_best_splits",
    with_ctes(
        GINI_COUNTS,
        select=f"""SELECT attribute, {r6('split')} AS split, {_r8('gini_gain')} AS gini_gain FROM (SELECT *, row_number() OVER (
        PARTITION BY attribute ORDER BY floor(gini_gain * 1e12::DOUBLE + 0.5::DOUBLE) DESC, split) AS rn FROM gain) WHERE rn = 1""",
    ),
)
def _(spark, sf):
    best = selection.best_splits(selection.gini_ranking(items(spark, sf), FEATURES, "l_returnflag"))
    return best.select("attribute", rounded(F.col("split")).alias("split"), rounded(F.col("gini_gain"), 8).alias("gini_gain"))


@query("j13_select_top")
def _(spark, sf):
    rows = items(spark, sf)
    ranking = selection.gini_ranking(rows, FEATURES, "l_returnflag", n_thresholds=50)
    return round_all(selection.select_top(rows, FEATURES, ranking, 3, 0.7), "split", "gini_gain")


@query(
    "j14_spearman",
    "WITH r AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS {f}" for f in FEATURES)
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({a}, {b})')} AS correlation FROM r" for a in FEATURES for b in FEATURES
    ),
)
def _(spark, sf):
    return round_all(selection.spearman_matrix(items(spark, sf), FEATURES), "correlation")


# ---------------------------------------------------------------- token quality

TAG_TABLE = f"""tt AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}|[!-/:-@\\[-^`{{-~]')) AS token,
    generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}|[!-/:-@\\[-^`{{-~]'), 1) - 1 AS idx FROM documents),
  tagged AS (SELECT t.doc_id, t.idx, t.token, coalesce(lk.tag, CASE WHEN regexp_matches(t.token, '^\\p{{Nd}}+$') THEN 'num'
    WHEN instr('$+<=>^`|~', t.token) > 0 THEN 'sym' WHEN regexp_matches(t.token, '^{PUNCT_CLASS}$') THEN 'punct'
    ELSE 'noun' END) AS tag, coalesce(lk.lemma, t.token) AS lemma FROM tt t LEFT JOIN lk ON t.token = lk.token)"""


def tag_table(spark, sf):
    return ft.tagged_tokens(docs(spark, sf), KEY, "text", lookup(spark, sf))


@query(
    "j15_token_quality",
    with_ctes(
        LOOKUP,
        TAG_TABLE,
        select=f"""SELECT count(DISTINCT doc_id) AS documents, count(*) AS tokens,
        {r6('count(*)::DOUBLE / count(DISTINCT doc_id)')} AS mean_tokens,
        {r6("count(*) FILTER (tag = 'verb')::DOUBLE / count(*)")} AS verb_share,
        {r6("count(*) FILTER (tag = 'noun')::DOUBLE / count(*)")} AS noun_share,
        {r6("count(*) FILTER (tag = 'propn')::DOUBLE / count(*)")} AS propn_share,
        {r6("count(*) FILTER (tag IN ('x', 'space'))::DOUBLE / count(*)")} AS noise_share FROM tagged""",
    ),
)
def _(spark, sf):
    report = ft.token_quality(tag_table(spark, sf), KEY)
    return round_all(report, "mean_tokens", "verb_share", "noun_share", "propn_share", "noise_share")


@query("j15_tag_distribution", with_ctes(LOOKUP, TAG_TABLE, select="SELECT tag, count(*) AS n FROM tagged GROUP BY 1"))
def _(spark, sf):
    return ft.tag_distribution(tag_table(spark, sf))


@query(
    "j15_empty_lemmas",
    with_ctes(
        LOOKUP.replace("FROM benchmark))", "FROM documents))"),
        TAG_TABLE,
        select="SELECT DISTINCT token, lemma FROM tagged WHERE lemma IN ('', '-PRON-') ORDER BY 1, 2 LIMIT 40",
    ),
)
def _(spark, sf):
    words = docs(spark, sf).select(F.explode(ft.words_of(F.col("text"))).alias("token")).distinct()
    tag = F.array(*[F.lit(t) for t in TAG_CYCLE])[F.length("token") % len(TAG_CYCLE)]
    dictionary = words.select("token", tag.alias("tag"), F.regexp_replace("token", "(ing|ed|s)$", "").alias("lemma"))
    rows = ft.tagged_tokens(docs(spark, sf), KEY, "text", ft.token_lookup(dictionary))
    return ft.empty_lemma_examples(rows, 40)


@query(
    "j15_sample_token_tables",
    with_ctes(
        LOOKUP,
        TAG_TABLE,
        "chosen AS (SELECT doc_id FROM documents ORDER BY md5('42_' || doc_id), doc_id LIMIT 5)",
        select="SELECT doc_id, idx, token, tag, lemma FROM tagged WHERE doc_id IN (SELECT doc_id FROM chosen)",
    ),
)
def _(spark, sf):
    return ft.sample_token_tables(docs(spark, sf), KEY, "text", lookup(spark, sf), 5)


@query(
    "j16_feature_corpus",
    with_ctes(
        MESSAGES,
        select="""SELECT m.id, m.group_name, trim(regexp_replace(regexp_replace(text, 'http\\S+|www.\\S+', '', 'g'), '\\s+', ' ', 'g'))
        AS text_clean FROM messages m JOIN labels l ON m.id = l.doc_id WHERE l.quality = 1""",
    ),
)
def _(spark, sf):
    labels = filters.keep_equal(table(spark, sf, "labels"), "quality", 1).select(F.col("doc_id").alias("id"))
    joined = joins.join_labels(messages(spark, sf), labels, ["id"])
    return joined.select("id", "group_name", tx.light_clean(F.col("text")).alias("text_clean"))


# ---------------------------------------------------------------- toxicity


@query(
    "i01_fitted_scores",
    f"SELECT count(*) AS documents, {', '.join(f'count(*) AS {s}' for s in TOXICITY_SCORES)} FROM documents",
)
def _(spark, sf):
    """Six models fitted on the label table, applied to every message."""
    size = F.length("text")
    flags = {
        "toxicity": F.col("toxic") == 1, "severe_toxicity": (F.col("toxic") == 1) & (F.col("quality") == 0),
        "obscene": F.col("quality") == 0, "threat": size > 1000, "insult": size < 300, "identity_attack": F.col("lang") == "de",
    }
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    rows = messages(spark, sf).join(labels, "id").withColumns({k: v.cast("double") for k, v in flags.items()})
    features, models = toxicity.fit_scorer(rows, "text", dimensions=1 << 12, max_iter=8)
    scored = toxicity.score(messages(spark, sf), "text", features, models)
    return scored.agg(
        F.count("*").alias("documents"),
        *[F.count_if(F.col(s).between(0.0, 1.0)).alias(s) for s in TOXICITY_SCORES],
    )


LEXICON = f"""lex AS (SELECT token, {", ".join(f"(length(token) * {i + 3} % 10) / 10.0::DOUBLE AS {s}" for i, s in enumerate(TOXICITY_SCORES))}
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM benchmark) WHERE length(token) >= 5)"""


def lexicon(spark, sf):
    """Weighted words derived from the benchmark texts."""
    words = table(spark, sf, "benchmark").select(F.explode(tx.terms(F.col("text"))).alias("token")).distinct()
    weights = [(F.length("token") * (i + 3) % 10 / 10).alias(s) for i, s in enumerate(TOXICITY_SCORES)]
    return words.filter(F.length("token") >= 5).select("token", *weights)


LEXICON_SCORES = f"""words AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM messages),
  sums AS (SELECT id, count(*) AS n, {", ".join(f"coalesce(sum({s}), 0::DOUBLE) AS {s}" for s in TOXICITY_SCORES)}
    FROM words LEFT JOIN lex USING (token) GROUP BY 1),
  tox AS (SELECT m.id, m.group_name, {", ".join(f"coalesce(sums.{s} / n, 0::DOUBLE) AS {s}" for s in TOXICITY_SCORES)}
    FROM messages m LEFT JOIN sums ON m.id = sums.id)"""


@query(
    "i02_lexicon_scores",
    with_ctes(
        MESSAGES, LEXICON, LEXICON_SCORES,
        select="SELECT id, group_name, " + ", ".join(f"{r6(s)} AS {s}" for s in TOXICITY_SCORES) + " FROM tox",
    ),
)
def _(spark, sf):
    rows = toxicity.lexicon_scores(messages(spark, sf), ["id", "group_name"], "text", lexicon(spark, sf))
    return round_all(rows.select("id", "group_name", *TOXICITY_SCORES), *TOXICITY_SCORES)


TOPIC_JOIN = """topic_rows AS (SELECT m.id, m.group_name, m."timestamp", CAST(CASE WHEN e.vec_id % 7 = 0 THEN -1 ELSE e.label END
  AS INTEGER) AS topic FROM messages m JOIN embeddings e ON m.id = e.vec_id),
  macro_map AS (SELECT DISTINCT label AS topic, concat('MACRO_', label % 4) AS macro_topic FROM embeddings)"""


@query(
    "i03_scores_with_topics",
    with_ctes(
        MESSAGES, LEXICON, LEXICON_SCORES, TOPIC_JOIN,
        select=f"""SELECT t.id, t.group_name, t.topic, {r6('x.toxicity')} AS toxicity FROM topic_rows t
        JOIN tox x ON t.id = x.id AND t.group_name = x.group_name""",
    ),
)
def _(spark, sf):
    scored = toxicity.lexicon_scores(messages(spark, sf), ["id", "group_name"], "text", lexicon(spark, sf))
    rows = joins.join_labels(post_topics(spark, sf), scored.select("id", "group_name", "toxicity"), ["id", "group_name"])
    return rows.select("id", "group_name", "topic", rounded(F.col("toxicity")).alias("toxicity"))


@query(
    "i04_weekly_toxicity_profile",
    with_ctes(
        MESSAGES, LEXICON, LEXICON_SCORES, TOPIC_JOIN,
        select=f"""SELECT strftime(CAST(date_trunc('week', make_timestamp("timestamp" * 1000000)) AS DATE) + 6, '%Y-%m-%d') AS week,
        macro_topic, {r6('avg(toxicity)')} AS mean_score FROM topic_rows t JOIN tox x ON t.id = x.id
        JOIN macro_map m ON m.topic = t.topic GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    """Weekly mean toxicity per macro topic: scoring, topic mapping and report in one plan."""
    from parlance.operators import reports

    keys = ["id", "group_name"]
    scored = toxicity.lexicon_scores(messages(spark, sf), keys, "text", lexicon(spark, sf)).select(*keys, "toxicity")
    rows = joins.join_labels(post_topics(spark, sf), scored, keys).join(macro_map(spark, sf), "topic")
    dated = rows.withColumn("moment", F.timestamp_seconds("timestamp"))
    weekly = reports.weekly_mean(dated, "moment", "macro_topic", "toxicity", keys)
    return weekly.select(F.col("week").cast("string").alias("week"), "macro_topic", rounded(F.col("mean_score")).alias("mean_score"))
