"""Text cleaning as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns the cleaned columns are defined by.
URL = r"http\S+"
MENTION = r"@\w+"
URL_OR_WWW = r"http\S+|www\.\S+"
URL_OR_WWW_LOOSE = r"http\S+|www.\S+"
WORD_CHAR = r"[\p{L}\p{M}\p{N}_]"
TAG = rf"[#@]{WORD_CHAR}+"
DIGITS = r"\p{Nd}+"
WHITESPACE = r"(?U)\s+"
TERM = r"[\p{L}\p{N}_]{2,}"
SENTENCE_END = r"[.!?]+"
VOWEL_GROUP = r"[aeiouy]+"


def strip_urls_and_mentions(text: Column) -> Column:
    """Remove URLs, then mentions (ASCII word characters)."""
    return F.regexp_replace(F.regexp_replace(text, URL, ""), MENTION, "")


def safe_lower(text: Column) -> Column:
    """Lower-case, with a missing text read as empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def strip_links(text: Column) -> Column:
    return F.regexp_replace(text, URL_OR_WWW, "")


def strip_tags(text: Column) -> Column:
    """Remove hashtags and mentions, Unicode letters included."""
    return F.regexp_replace(text, TAG, "")


def strip_punctuation(text: Column) -> Column:
    """Delete the 32 ASCII punctuation characters."""
    return F.translate(text, string.punctuation, "")


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS, "")


def cap_repetitions(text: Column, limit: int = 2) -> Column:
    """Shorten every run of one character to at most ``limit`` (never below 1)."""
    keep = max(int(limit), 1)
    return F.regexp_replace(text, r"(?s)(.)\1{%d,}" % keep, "$1" * keep)


def tokens(text: Column) -> Column:
    """Split on Unicode white space without empty tokens."""
    return F.filter(F.split(text, WHITESPACE), lambda t: t != "")


def drop_stopwords(words: Column, stopwords: Sequence[str]) -> Column:
    """Drop listed tokens; the list becomes a hash-set lookup in the plan."""
    listed = sorted({w.strip().lower() for w in stopwords if w and w.strip()})
    return F.filter(words, lambda t: ~t.isin(listed)) if listed else words


def drop_short(words: Column, min_length: int = 3) -> Column:
    return F.filter(words, lambda t: F.length(t) >= min_length)


def normalised_tokens(
    text: Column, stopwords: Sequence[str] = (), max_repetition: int = 2, min_length: int = 3
) -> Column:
    """The whole normalisation up to the token list, in its fixed order."""
    cleaned = strip_digits(strip_punctuation(strip_tags(strip_links(safe_lower(text)))))
    words = tokens(cap_repetitions(cleaned, max_repetition))
    return drop_short(drop_stopwords(words, stopwords), min_length)


def normalised_text(text: Column, stopwords: Sequence[str] = (), max_repetition: int = 2, min_length: int = 3) -> Column:
    return F.array_join(normalised_tokens(text, stopwords, max_repetition, min_length), " ")


def light_clean(text: Column) -> Column:
    """Links out, white space to single blanks, trimmed; missing text reads as empty."""
    linkless = F.regexp_replace(F.coalesce(text, F.lit("")), URL_OR_WWW_LOOSE, "")
    return F.trim(F.regexp_replace(linkless, WHITESPACE, " "))


def terms(text: Column) -> Column:
    """Lower-cased terms of at least two word characters, for term counting."""
    return F.regexp_extract_all(safe_lower(text), F.lit(f"({TERM})"))


def epoch_to_timestamp(epoch: Column) -> Column:
    """Epoch to timestamp; values above 1e11 are milliseconds, text that is no number is null."""
    number = epoch.try_cast("bigint")
    return F.when(number > 10**11, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))


def epoch_seconds_text(epoch: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in the session time zone."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def pretty_label(label: Column) -> Column:
    """``some_label`` to ``Some Label``."""
    return F.initcap(F.translate(label, "_", " "))


def slug(name: Column) -> Column:
    """A name usable as a folder: ``/`` and blanks become ``_``."""
    return F.translate(name, "/ ", "__")


def week_ending_sunday(moment: Column) -> Column:
    """The Sunday that closes the week (Monday first) of ``moment``."""
    return F.date_add(F.date_trunc("week", moment).cast("date"), 6)


def default_stopwords(extra: Sequence[str] = ()) -> list[str]:
    """Spark's English stop words together with ``extra``; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords("english")} | {w.lower() for w in extra})


def read_stopwords(spark: SparkSession, path: str, max_words: int = 100_000) -> list[str]:
    """A stop-word file, one word per line, blank lines ignored."""
    lines: DataFrame = spark.read.text(path)
    words = lines.select(F.lower(F.trim("value")).alias("w")).filter(F.col("w") != "").distinct()
    rows = words.take(max_words + 1)
    if len(rows) > max_words:
        raise ValueError(f"stop-word file {path} has more than {max_words} words")
    return sorted(r["w"] for r in rows)
