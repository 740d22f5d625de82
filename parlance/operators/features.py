"""Linguistic features per document.

Plain counts are column expressions on the text. Everything that needs a dictionary explodes the
tokens once, joins one merged lookup table and aggregates back to the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.numbers import safe_ratio
from parlance.operators.filters import with_computed
from parlance.operators.sampling import random_rows
from parlance.session import broadcast_if_small, saved
from parlance.sources import sinks

# The names of the tags, entity types and word norms features are built for.
TAGS = "adj adp adv aux cconj det intj noun num part pron propn punct sconj sym verb space".split()
ENTITIES = (
    "person norp fac org gpe loc product event art law language date time percent money quantity ordinal cardinal".split()
)
NORMS = ["kup", "bry", "subtlex_us_zipf"]

# Words per minute of fast, average and slow readers.
READING_SPEED = {"fast": 300, "average": 240, "slow": 175}

# Entity types that are recognised by their form.
ENTITY_PATTERNS = {
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    "percent": r"\d+(?:\.\d+)?%",
    "money": r"[$€£]\d+(?:[.,]\d+)*",
    "quantity": r"\b\d+(?:\.\d+)?\s?(?:kg|km|cm|mm|mb|gb|lb)\b",
    "ordinal": r"\b\d+(?:st|nd|rd|th)\b",
    "cardinal": r"\b\d+\b",
}

WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[!-/:-@\[-^`{-~]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SYMBOLS = "$+<=>^`|~"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(tx.safe_lower(text), F.lit(f"({WORD})"))


def tokens_of(text: Column) -> Column:
    """Words and single punctuation characters, lower-cased."""
    return F.regexp_extract_all(tx.safe_lower(text), F.lit(f"({TOKEN})"))


def syllables(word: Column) -> Column:
    """Groups of vowel letters, at least one per word."""
    return F.greatest(F.regexp_count(word, F.lit(tx.VOWEL_GROUP)), F.lit(1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def add_counts(df: DataFrame, text: str, stopwords: Sequence[str]) -> DataFrame:
    """Words, stop words, punctuation, syllables, unique words, sentences and characters.

    A sentence is a non-blank stretch between ``.``, ``!`` and ``?``.
    """
    listed = sorted({w.lower() for w in stopwords})
    prepared = df.withColumn("__w", words_of(F.col(text)))
    prepared = prepared.withColumn("__s", F.transform("__w", syllables))
    stop = F.size(F.filter("__w", lambda w: w.isin(listed))) if listed else F.lit(0)
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), tx.SENTENCE_END), lambda s: F.trim(s) != "")
    return prepared.withColumns(
        {
            "t_word": F.size("__w"),
            "t_stopword": stop,
            "t_punct": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PUNCTUATION)),
            "t_syll": _total(F.col("__s")),
            "t_syll2": F.size(F.filter("__s", lambda s: s >= 2)),
            "t_syll3": F.size(F.filter("__s", lambda s: s >= 3)),
            "t_uword": F.size(F.array_distinct("__w")),
            "t_sent": F.size(sentences),
            "t_char": _total(F.transform("__w", lambda w: F.length(w))),
        }
    ).drop("__w", "__s")


def add_averages(df: DataFrame) -> DataFrame:
    """Counts per sentence and per word."""
    sent, word = F.col("t_sent"), F.col("t_word")
    pairs = {
        "a_word_ps": ("t_word", sent), "a_char_ps": ("t_char", sent), "a_char_pw": ("t_char", word),
        "a_syll_ps": ("t_syll", sent), "a_syll_pw": ("t_syll", word),
        "a_stopword_ps": ("t_stopword", sent), "a_stopword_pw": ("t_stopword", word),
    }
    return df.withColumns({name: safe_ratio(F.col(n), d) for name, (n, d) in pairs.items()})


def add_readability(df: DataFrame) -> DataFrame:
    """Flesch reading ease and grade, Gunning fog, SMOG, Coleman-Liau, automated readability; 0 without words."""
    words, sents = F.col("t_word").cast("double"), F.greatest(F.col("t_sent"), F.lit(1)).cast("double")
    per_sentence, per_word = words / sents, F.col("t_syll") / words
    letters, hard = F.col("t_char") / words, F.col("t_syll3").cast("double")
    formulas = {
        "fkre": 206.835 - 1.015 * per_sentence - 84.6 * per_word,
        "fkgl": 0.39 * per_sentence + 11.8 * per_word - 15.59,
        "fogi": 0.4 * (per_sentence + 100.0 * hard / words),
        "smog": 1.043 * F.sqrt(hard * 30.0 / sents) + 3.1291,
        "cole": 5.88 * letters - 29.6 * sents / words - 15.8,
        "auto": 4.71 * letters + 0.5 * per_sentence - 21.43,
    }
    return df.withColumns({n: F.when(words > 0, f).otherwise(F.lit(0.0)) for n, f in formulas.items()})


def add_reading_time(df: DataFrame) -> DataFrame:
    """Minutes to read at three speeds."""
    return df.withColumns({f"rt_{n}": F.col("t_word") / F.lit(float(v)) for n, v in READING_SPEED.items()})


def type_token_ratios(types: Column, total: Column, suffix: str = "") -> dict[str, Column]:
    """Simple, root, corrected, bi-logarithmic and Uber type-token ratio; 0 where undefined."""
    u, n = types.cast("double"), total.cast("double")
    return {
        f"simp_ttr{suffix}": safe_ratio(u, n),
        f"root_ttr{suffix}": safe_ratio(u, F.sqrt(n)),
        f"corr_ttr{suffix}": safe_ratio(u, F.sqrt(2 * n)),
        f"bilog_ttr{suffix}": F.when(n > 1, F.log(F.greatest(u, F.lit(1.0))) / F.log(n)).otherwise(F.lit(0.0)),
        f"uber_ttr{suffix}": F.when((n > 1) & (u < n) & (u > 0), F.log(n) * F.log(n) / F.log(n / u)).otherwise(F.lit(0.0)),
    }


def add_pattern_entities(df: DataFrame, text: str) -> DataFrame:
    """Entity counts of the types that are recognised by their form.

    A match is blanked out before the next type is looked for, so a date is not three cardinals as well. Every pattern is about digits and
    sees at most five characters behind and two before them, so longer stretches without a digit are shortened once, and the
    patterns pass over short texts only.
    """
    rows = with_computed(df, "__rest", F.regexp_replace(tx.safe_lower(F.col(text)), r"(\D{5})\D+(\D{2})", "$1$2"))
    for k, p in ENTITY_PATTERNS.items():
        columns = [c for c in rows.columns if c != "__rest"]
        step = F.struct(
            F.regexp_count("__rest", F.lit(p)).alias(f"t_n_ent_{k}"), F.regexp_replace("__rest", p, " ").alias("__rest")
        )
        rows = rows.select(*columns, F.inline(F.array(step)))
    return rows.drop("__rest")


def token_lookup(
    dictionary: DataFrame | None = None, norms: DataFrame | None = None, gazetteer: DataFrame | None = None
) -> DataFrame:
    """One lookup row per token: ``tag``, ``lemma``, the word norms, and ``entity``.

    Of several dictionary or gazetteer entries for a token the alphabetically first is used.
    """
    parts = []
    if dictionary is not None:
        best = F.min(F.struct("tag", "lemma")).alias("b")
        parts.append(dictionary.groupBy("token").agg(best).select("token", "b.tag", "b.lemma"))
    if norms is not None:
        parts.append(norms.groupBy("token").agg(*[F.min(n).alias(n) for n in NORMS]))
    if gazetteer is not None:
        parts.append(gazetteer.groupBy("token").agg(F.min("entity").alias("entity")))
    if not parts:
        raise ValueError("a lookup needs a dictionary, norms or a gazetteer")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.join(part, "token", "full_outer")
    types = {"tag": "string", "lemma": "string", **{n: "double" for n in NORMS}, "entity": "string"}
    return merged.select("token", *[(F.col(c) if c in merged.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def tag_of(token: Column, tag: Column) -> Column:
    """The dictionary's tag, or one by the form of the token: number, symbol, punctuation, otherwise noun."""
    return (
        F.when(tag.isNotNull(), tag)
        .when(token.rlike(r"^\p{Nd}+$"), "num")
        .when(F.instr(F.lit(SYMBOLS), token) > 0, "sym")
        .when(token.rlike(rf"^{PUNCTUATION}$"), "punct")
        .otherwise("noun")
    )


def document_tokens(df: DataFrame, keys: Sequence[str], text: str, lookup: DataFrame) -> DataFrame:
    """Distinct tokens per document with their count and everything the lookup knows about them."""
    counted = df.select(*keys, F.explode(tokens_of(F.col(text))).alias("token")).groupBy(*keys, "token").agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = counted.join(broadcast_if_small(saved(lookup, "token-lookup"), 500_000), "token", "left")
    return joined.withColumns({"tag": tag_of(F.col("token"), F.col("tag")), "lemma": F.coalesce("lemma", "token")})


def token_features(token_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per document: tag counts and unique tag counts, norm totals, name entities, types, tokens and lemmas.

    The tokens are summed up per document, tag and entity, and these few sums per document: where the rows of a document are together,
    as after ``spread`` by ``keys``, no token is shuffled or stored.
    """
    keys = list(keys)
    named = [e for e in ENTITIES if e not in ENTITY_PATTERNS]
    word = ~F.col("tag").isin("punct", "sym", "space")
    sums = token_rows.groupBy(*keys, "tag", "entity").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"), F.collect_set(F.when(word, F.col("lemma"))).alias("lemmas"),
        *[F.sum(F.col(m) * F.col("n")).alias(m) for m in NORMS],
    )
    total = lambda value, condition: F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))
    return sums.groupBy(*keys).agg(
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"t_{m}") for m in NORMS],
        total("u", word).alias("__types"),
        *[total(c, F.col("tag") == t).alias(f"n_{k}{t}") for t in TAGS for c, k in (("n", ""), ("u", "u"))],
        *[total("n", F.col("entity") == e).alias(f"t_n_ent_{e}") for e in named],
        F.size(F.array_distinct(F.flatten(F.collect_list("lemmas")))).alias("__lemmas"),
        total("n", word).alias("__tokens"),
    )


def ratio_of(numerator: str, denominator: str) -> Column:
    """``safe_ratio`` as one parsed expression; over a hundred columns are built this way, and composing
    each from Python operators takes longer than running it."""
    return F.expr(f"if({denominator} <> 0, cast({numerator} as double) / cast({denominator} as double), 0D)")


def tag_variation(tag: str) -> dict[str, Column]:
    return {
        f"simp_{tag}_var": ratio_of(f"n_u{tag}", f"n_{tag}"),
        f"root_{tag}_var": ratio_of(f"n_u{tag}", f"sqrt(n_{tag})"),
        f"corr_{tag}_var": ratio_of(f"n_u{tag}", f"sqrt(2 * n_{tag})"),
    }


def linguistic_features(
    df: DataFrame, keys: Sequence[str], text: str, lookup: DataFrame, stopwords: Sequence[str]
) -> DataFrame:
    """All features, one row per document; ``keys`` identify a document."""
    counted = add_reading_time(add_readability(add_averages(add_counts(df.select(*keys, text), text, stopwords))))
    base = add_pattern_entities(counted, text).drop(text)
    from_tokens = saved(token_features(document_tokens(df, keys, text, lookup), keys), "token-features")
    rows = base.join(from_tokens, list(keys), "left").fillna(0)
    rows = rows.withColumn("t_n_ent", F.expr(" + ".join(f"t_n_ent_{e}" for e in ENTITIES)))
    extra: dict[str, Column] = {}
    averaged = {m: f"t_{m}" for m in NORMS} | {t: f"n_{t}" for t in TAGS}
    averaged |= {f"n_ent{e}": f"t_n_ent{e}" for e in ["", *[f"_{e}" for e in ENTITIES]]}
    for name, column in averaged.items():
        extra |= {f"a_{name}_pw": ratio_of(column, "t_word"), f"a_{name}_ps": ratio_of(column, "t_sent")}
    for t in TAGS:
        extra |= tag_variation(t)
    extra |= type_token_ratios(F.col("__lemmas"), F.col("__tokens"))
    extra |= type_token_ratios(F.col("__types"), F.col("__tokens"), "_no_lem")
    return rows.withColumns(extra).drop("__tokens", "__types", "__lemmas")


def resume_features(
    df: DataFrame, keys: Sequence[str], text: str, lookup: DataFrame, stopwords: Sequence[str], path: str
) -> None:
    """Extract the features of the documents that the table at ``path`` lacks and append them."""
    spark = df.sparkSession
    todo = sinks.pending_rows(df, spark.read.parquet(path), keys) if sinks.table_exists(spark, path) else df
    linguistic_features(todo, keys, text, lookup, stopwords).write.mode("append").parquet(path)


def tagged_tokens(df: DataFrame, keys: Sequence[str], text: str, lookup: DataFrame) -> DataFrame:
    """The token table: keys, ``idx``, ``token``, ``tag``, ``lemma``."""
    rows = df.select(*keys, F.posexplode(tokens_of(F.col(text))).alias("idx", "token"))
    known = broadcast_if_small(saved(lookup.select("token", "tag", "lemma"), "tags"), 500_000)
    joined = rows.join(known, "token", "left")
    return joined.select(*keys, "idx", "token", tag_of(F.col("token"), F.col("tag")).alias("tag"), F.coalesce("lemma", "token").alias("lemma"))


def token_quality(token_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents, tokens, mean tokens, and the shares of verbs, nouns, proper nouns and noise."""
    per_doc = token_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("tag") == t).alias(t) for t in ("verb", "noun", "propn")],
        F.count_if(F.col("tag").isin("x", "space")).alias("noise"),
    )
    shares = [safe_ratio(F.sum(t), F.sum("n")).alias(f"{t}_share") for t in ("verb", "noun", "propn", "noise")]
    return per_doc.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.avg("n").alias("mean_tokens"), *shares)


def tag_distribution(token_rows: DataFrame) -> DataFrame:
    return token_rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def empty_lemma_examples(token_rows: DataFrame, k: int = 40) -> DataFrame:
    """Up to k tokens whose lemma is missing or a placeholder, in alphabetical order."""
    empty = token_rows.filter(F.col("lemma").isin("", "-PRON-"))
    return empty.select("token", "lemma").distinct().orderBy("token", "lemma").limit(k)


def sample_token_tables(
    df: DataFrame, keys: Sequence[str], text: str, lookup: DataFrame, k: int = 5, seed: int = 42
) -> DataFrame:
    """The token table of k randomly chosen documents."""
    return tagged_tokens(random_rows(df, k, keys, seed), keys, text, lookup)


def feature_names() -> list[str]:
    """All feature columns in their usual order."""
    names = "t_word t_stopword t_punct t_syll t_syll2 t_syll3 t_uword t_sent t_char".split()
    names += "a_word_ps a_char_ps a_char_pw a_syll_ps a_syll_pw a_stopword_ps a_stopword_pw".split()
    names += [f"t_{m}" for m in NORMS] + [f"a_{m}_{per}" for m in NORMS for per in ("pw", "ps")]
    kinds = ["", *[f"_{e}" for e in ENTITIES]]
    names += [f"t_n_ent{e}" for e in kinds] + [f"a_n_ent{e}_{per}" for per in ("pw", "ps") for e in kinds]
    names += [f"{kind}_{t}_var" for kind in ("simp", "root", "corr") for t in TAGS]
    names += [f"{kind}_ttr{s}" for s in ("", "_no_lem") for kind in ("simp", "root", "corr", "bilog", "uber")]
    names += [f"n_{t}" for t in TAGS] + [f"n_u{t}" for t in TAGS] + [f"a_{t}_{per}" for per in ("pw", "ps") for t in TAGS]
    return names + "fkre fkgl fogi smog cole auto".split() + [f"rt_{s}" for s in READING_SPEED]


def feature_metadata(spark) -> DataFrame:
    """``feature`` and ``language``: ``en`` for features resting on English resources, else ``general``."""
    english = {"fkre", "fkgl", "fogi", "smog", "cole", "auto"}
    rows = [(n, "en" if n in english or "n_ent" in n or any(m in n for m in NORMS) else "general") for n in feature_names()]
    return spark.createDataFrame(rows, "feature string, language string")


def language_features(columns: Sequence[str], metadata: DataFrame, language: str) -> list[str]:
    """The columns valid for a language: all for ``en``, otherwise no ``en`` feature; unknown columns stay."""
    if language == "en":
        return list(columns)
    english = metadata.filter((F.col("language") == "en") & F.col("feature").isin(list(columns)))
    barred = {r["feature"] for r in english.select("feature").take(len(columns))}
    return [c for c in columns if c not in barred]
