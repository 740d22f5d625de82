"""Text cleaning on edge rows."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import filters, language, lemmas

STOP = ["the", "and"]


def value_of(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, ""),
        ("", ""),
        ("?!.,;", ""),
        ("the and THE", ""),
        ("soooo goood", "soo good"),
        ("@joão fala #não disto", "fala disto"),
        ("see http://a.b/c?d and www.x.y now", "see now"),
        ("tab\there\nand there", "tab here there"),
        ("a1b2c3 12345 x", "abc"),
        ("it's o'clock", "its oclock"),
        ("😀😀😀😀 wow", "wow"),
        ("aab  bbbb ccc", "aab"),  # capped to "bb" and "cc", which are too short
    ],
)
def test_normalise(spark, text, expected):
    assert value_of(spark, text, lambda c: tx.normalised_text(c, STOP)) == expected


def test_cap_floor(spark):
    assert value_of(spark, "aaab", lambda c: tx.cap_repetitions(c, 0)) == "ab"
    assert value_of(spark, "a\n\n\n\nb", tx.cap_repetitions) == "a\n\nb"


def test_length_borders(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (0, 19, 20, 21)] + [(None,)], "text string")
    assert sorted(len(r["text_clean"]) for r in filters.clean_and_keep_long(rows).collect()) == [20, 21]
    assert [len(r["text"]) for r in filters.keep_longer_than(rows, "text").collect()] == [21]


def test_mentions_stop_at_ascii(spark):
    assert value_of(spark, "hi @joão ok", tx.strip_urls_and_mentions) == "hi ão ok"
    assert value_of(spark, "hi @joão ok", tx.strip_tags) == "hi  ok"


def test_epoch_units(spark):
    rows = spark.createDataFrame([("1704067200",), ("1704067200000",), ("bad",), (None,)], "t string")
    got = [r["m"] for r in rows.select(F.date_format(tx.epoch_to_timestamp(F.col("t")), "yyyy-MM-dd").alias("m")).collect()]
    assert got == ["2024-01-01", "2024-01-01", None, None]


def test_week_label_is_the_closing_sunday(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-07",), ("2024-01-08",)], "d string")
    weeks = rows.select(tx.week_ending_sunday(F.col("d").cast("timestamp")).cast("string").alias("w")).collect()
    assert [r["w"] for r in weeks] == ["2024-01-07", "2024-01-07", "2024-01-14"]


def test_pretty_label_and_slug(spark):
    assert value_of(spark, "foreign_policy", tx.pretty_label) == "Foreign Policy"
    assert value_of(spark, "a/b c", tx.slug) == "a_b_c"


def test_lemmas_keep_order_and_unknown_words(spark):
    docs = spark.createDataFrame([(1, "cats chased mice"), (2, "")], "id long, text string")
    words = spark.createDataFrame([("cats", "cat"), ("mice", "mouse"), ("mice", "zzz")], "token string, lemma string")
    got = {r["id"]: r["clean_text"] for r in lemmas.normalise(docs, "text", ["id"], words).collect()}
    assert got == {1: "cat chased mouse", 2: ""}


def test_language_of_blank_text_is_unknown(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string")
    profiles = language.fit_profiles(train, "text", "lang")
    docs = spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, " \n"), (4, None)], "id long, text string")
    got = {r["id"]: r["language"] for r in language.detect_language(docs, profiles, "text", ["id"]).collect()}
    assert got == {1: "en", 2: "fr", 3: "unknown", 4: "unknown"}


def test_stopword_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("The\n\n  And \nthe\n")
    assert tx.read_stopwords(spark, str(tmp_path / "stop.txt")) == ["and", "the"]
    assert "of" in tx.default_stopwords(["Extra"]) and "extra" in tx.default_stopwords(["Extra"])


def test_merge_keys_unify_numbers(spark):
    rows = spark.createDataFrame([(" 30 ",), ("30.0",), ("cosine ",)], "k string")
    assert [r["k"] for r in rows.select(filters.merge_key(F.col("k")).alias("k")).collect()] == ["30", "30", "cosine"]


def test_merge_keys_keep_long_ids_and_lookalikes_apart(spark):
    values = ["9007199254740993", "9007199254740992", "30d", "30", "1e3", "1000", "+30", "030.00", "0.50", "-0", "0", "-7.10", "1.", None]
    rows = spark.createDataFrame([(v,) for v in values], "k string")
    keys = [r["k"] for r in rows.select(filters.merge_key(F.col("k")).alias("k")).collect()]
    assert keys == ["9007199254740993", "9007199254740992", "30d", "30", "1e3", "1000", "30", "30", "0.5", "0", "0", "-7.1", "1", None]


def test_join_on_shared_keeps_the_left_types(spark):
    from parlance.operators import joins

    left = spark.createDataFrame([(10_000_000_000, "a"), (3, "b")], "k long, l string")
    right = spark.createDataFrame([(1e10, 1), (3.5, 2)], "k double, r int")
    joined = joins.join_on_shared(left, right, ["k", "missing"])
    assert joined.dtypes == [("k", "bigint"), ("l", "string"), ("r", "int")]
    assert sorted(map(tuple, joined.collect()), key=repr) == [(10_000_000_000, "a", 1), (3, "b", None)]


EDGE_TEXTS = [(1, "The cats were running, running!"), (2, None), (3, ""), (4, "ab"), (5, "Der Hund läuft 😀😀 sehr"), (6, "cats cats dogs")]


def same_rows(one, other):
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    return plain(one) == plain(other)


def test_small_and_large_lookups_agree(spark):
    from parlance.operators import toxicity

    docs = spark.createDataFrame(EDGE_TEXTS, "id long, text string")
    labelled = docs.withColumn("lang", F.when(F.col("id") == 5, "de").otherwise("en"))
    profiles = language.fit_profiles(labelled, "text", "lang")
    found = [language.detect_language(docs, profiles, "text", ["id"], max_profile_bytes=n) for n in (0, 1 << 20)]
    assert same_rows(*found) and {r["id"]: r["language"] for r in found[1].collect()}[2] == "unknown"

    lexicon = spark.createDataFrame([("cats", 0.5, None), ("hund", 0.1, 1.0)], "token string, a double, b double")
    scored = [toxicity.lexicon_scores(docs, ["id"], "text", lexicon, ["a", "b"], max_lexicon_bytes=n) for n in (0, 1 << 20)]
    assert same_rows(*scored)

    dictionary = spark.createDataFrame([("cats", "cat"), ("cats", "kitten"), ("running", "run")], "token string, lemma string")
    written = [lemmas.normalise(docs, "text", ["id"], dictionary, ["the"], max_dictionary_bytes=n) for n in (0, 1 << 20)]
    assert same_rows(*written) and {r["id"]: r["clean_text"] for r in written[1].collect()}[6].startswith("cat cat")


def test_rows_in_and_outside_a_language(spark):
    docs = spark.createDataFrame([(i, "en" if i % 3 else None) for i in range(30)], "id long, lang string")
    taken = language.sample_in_and_outside(docs, "lang", "en", ["id"], 4).collect()
    assert sorted(r["inside"] for r in taken) == [False] * 4 + [True] * 4
