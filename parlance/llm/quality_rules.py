"""Quality rules whose cutoffs come with a guarantee on wrongly rejected good text.

Each rule compares a whole-number metric of a document with a cutoff. For every stratum, rule and cutoff on a fixed grid the
labelled good rows are counted, and a cutoff counts as certified when the exact binomial tail says that a
false-rejection rate of ``max_false_rejection`` would show so few rejections only with probability
``confidence_error / number of tests`` (Bonferroni over strata, rules and cutoffs). Of the certified cutoffs that
catch at least ``min_precision`` times as many bad rows as good ones, the one with the best balance is taken; if
there is none the rule is off in that stratum.

Everything is DataFrame functions: one pass over the text makes a narrow table of counts; labels join that table, and
thresholds are one row per stratum and rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import computed
from parlance.session import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Metrics as whole numbers (per thousand words; the last one hundredths of a character per word), rejected above the cutoff.
METRICS = {
    "symbols": "n_symbols * 1000 div nullif(n_words, 0)",
    "dup_lines": "n_dup_lines * 1000 div nullif(n_words, 0)",
    "repeats": "n_repeat_words * 1000 div nullif(n_words, 0)",
    "word_length": "word_chars * 100 div nullif(n_words, 0)",
}
CUTOFFS = {
    "symbols": (10, 20, 50, 100, 200, 300, 500, 750, 1000, 1500, 2000),
    "dup_lines": (2, 5, 10, 20, 30, 50, 75, 100, 200),
    "repeats": (50, 100, 150, 200, 250, 300, 350, 400, 450),
    "word_length": (700, 800, 900, 1000, 1200, 1500, 2000),
}
N_CUTOFFS = sum(len(v) for v in CUTOFFS.values())


def count_columns(text: Column) -> dict[str, Column]:
    """Words, lines and three-word windows of a text as arrays; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return {
        "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, " \t\n\x0b\f\r", "") != ""),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def repeated_words(words: str, windows: str) -> Column:
    """How many words lie in a three-word window that occurs twice or more in the text.

    Windows are sorted with their place; equal neighbours are the repeated ones. Texts without any skip the sort.
    """
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    neighbours = F.zip_with(
        placed,
        F.slice(placed, 2, F.greatest(F.size(windows) - 1, F.lit(0))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
    )
    starts = F.array_distinct(F.flatten(F.filter(neighbours, lambda x: x.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.size(covered)).cast("long")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """``doc_id``, ``stratum``, ``n_words`` and the four counts of every whole text, ``base_failed`` included.

    Null text has no words. A null stratum is its own stratum.
    """
    key = F.col(f"`{stratum}`").cast("string") if stratum else F.lit("all")
    arrays = computed(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(key, F.lit("")).alias("stratum"), F.col(text_col).alias("text")),
        a=F.struct(*[v.alias(k) for k, v in count_columns(F.col("text")).items()]),
    ).select("doc_id", "stratum", "a.*", F.length(
        F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with("words", F.slice("words", 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(
        pairs, F.slice("words", 3, F.greatest(F.size("words") - 2, F.lit(0))), lambda ab, c: F.concat(ab, F.lit(" "), c)
    )
    windows = F.when(F.size("words") >= 3, F.slice(triples, 1, F.greatest(F.size("words") - 2, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )
    windowed = computed(
        arrays.select(
            "doc_id", "stratum", "words", "n_symbols", "word_chars",
            F.size("words").cast("long").alias("n_words"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        ),
        windows=windows,
    )
    return windowed.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words("words", "windows").alias("n_repeat_words"),
    ).withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for n draws at ``rate``, summed term by term on the log scale; 1 when k is above the mean.

    Above the mean the tail is about a half or more, which certifies nothing.
    """
    odds = F.log(F.lit(rate)) - F.log1p(F.lit(-rate))
    first = n * F.log1p(F.lit(-rate))
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def step(state: Column, j: Column) -> Column:
        return F.struct(
            (state["term"] + F.log((n - j).cast("double")) - F.log((j + 1).cast("double")) + odds).alias("term"),
            (state["total"] + F.exp(state["term"])).alias("total"),
        )

    summed = F.aggregate(F.sequence(F.lit(0).cast("long"), k), zero, step, lambda s: s["total"])
    return F.when(k.cast("double") > n * rate, F.lit(1.0)).otherwise(summed)


def certified_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    max_false_rejection: float = 0.02,
    confidence_error: float = 0.05,
    min_precision: int = 9,
) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff`` for every rule that is on, from the labelled rows of ``counts``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad). Rows with null are no labels, repeated labels of an id count
    once by the larger one, rows failing the base rules are left out. No labels: no rules.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    holdout = counts.filter(~F.col("base_failed")).join(marked, "doc_id")
    metric = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.expr(expression).alias("metric"), F.array(*map(F.lit, CUTOFFS[rule])).alias("grid"))
        for rule, expression in METRICS.items()
    ])
    # A cell per stratum, rule, cutoff and label: whatever the number of rows, a map task sends that many.
    rejected = (
        holdout.select("stratum", "quality", F.inline(metric))
        .select("stratum", "quality", "rule", "metric", F.explode("grid").alias("cutoff"))
        .groupBy("stratum", "rule", "cutoff")
        .agg(
            F.count(F.when(F.col("quality") == 1, 1)).alias("good"),
            F.count(F.when((F.col("quality") == 1) & (F.col("metric") > F.col("cutoff")), 1)).alias("good_rejected"),
            F.count(F.when((F.col("quality") == 0) & (F.col("metric") > F.col("cutoff")), 1)).alias("bad_rejected"),
        )
    )
    cells = saved(rejected, "rule-cells")
    strata = cells.agg(F.countDistinct("stratum").alias("n_strata"))
    level = F.lit(confidence_error) / (F.lit(N_CUTOFFS) * strata.scalar())
    certified = cells.filter(F.col("good") > 0).filter(
        binomial_tail(F.col("good_rejected"), F.col("good"), max_false_rejection) <= level
    )
    useful = certified.filter((F.col("bad_rejected") > 0) & (F.col("bad_rejected") >= min_precision * F.col("good_rejected")))
    balance = F.struct((F.col("bad_rejected") - F.col("good_rejected")).alias("gain"), F.col("cutoff"))
    return useful.groupBy("stratum", "rule").agg(F.max_by("cutoff", balance).alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", **options: float) -> DataFrame:
    """Counts of every document with ``kept``: false if a base rule or a certified rule of its stratum rejects it."""
    counts = saved(text_counts(docs, stratum=stratum), "text-counts")
    cutoffs = certified_cutoffs(counts, labels, **options)
    wide = cutoffs.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in METRICS]
    )
    joined = counts.join(saved(wide, "cutoffs"), "stratum", "left")
    passes = F.lit(True)
    for rule, expression in METRICS.items():
        passes = passes & F.coalesce(F.expr(expression) <= F.col(f"max_{rule}"), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & passes).alias("kept"), "stratum", *[f"max_{rule}" for rule in METRICS],
    )
