"""Names of one or several words: a gazetteer matched against the words of whole texts.

Names go into one Aho-Corasick automaton over word numbers, which reads a text once however many names there are. It is sent to the tasks while
it fits a byte limit; a larger gazetteer is joined to the word windows of the lengths it has. Either way the leftmost match counts, of
several the longest, and matches do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.numbers import safe_ratio
from parlance.operators.features import tokens_of
from parlance.session import saved

MAX_NAME_BYTES = 64 << 20
MATCH = "array<struct<start:int,words:int,name:string,entity:string>>"


def known_names(gazetteer: DataFrame) -> DataFrame:
    """``tokens`` and ``entity`` of every distinct name of ``gazetteer`` (``name``, ``entity``), split and lower-cased like a text.

    Of several entities of a name the alphabetically first counts; names without a word are left out.
    """
    names = gazetteer.select(tokens_of(F.col("name")).alias("tokens"), "entity").filter((F.size("tokens") > 0) & F.col("entity").isNotNull())
    return names.groupBy("tokens").agg(F.min("entity").alias("entity"))


def leftmost_longest(found: Iterator[tuple[int, tuple[int, str, str]]]) -> Iterator[tuple[int, int, str, str]]:
    """Start, words, name and entity of the matches to keep, out of all of them by their last word."""
    free = 0
    for start, words, name, entity in sorted((end - words + 1, -words, name, entity) for end, (words, name, entity) in found):
        if start >= free:
            free = start - words
            yield start, -words, name, entity


def build_automaton(names: Iterator[tuple[list[str], str]]) -> tuple[dict[str, int], ahocorasick.Automaton | None]:
    """The numbers of the words that names use, and the automaton over them; None without a name."""
    number: dict[str, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for tokens, entity in names:
        automaton.add_word(tuple(number.setdefault(t, len(number) + 1) for t in tokens), (len(tokens), " ".join(tokens), entity))
    if not number:
        return number, None
    automaton.make_automaton()
    return number, automaton


def _finder(shared):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("name", pa.string()), ("entity", pa.string())]))

    @F.arrow_udf(MATCH)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number, automaton = shared.value
        for column in batches:
            rows = []
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            coded = column.flatten().dictionary_encode()
            codes = pa.array([number.get(w, 0) for w in coded.dictionary.to_pylist()], pa.int64())
            words = pc.fill_null(codes.take(coded.indices), 0).to_pylist()
            start = 0
            for n in lengths:
                some = words[start : start + n]
                start += n
                found = leftmost_longest(automaton.iter(tuple(some))) if automaton is not None and any(some) else ()
                rows.append([dict(zip(("start", "words", "name", "entity"), m, strict=True)) for m in found])
            yield pa.array(rows, kind)

    return find


def find_entities(df: DataFrame, keys: Sequence[str], text: str, gazetteer: DataFrame, max_name_bytes: int = MAX_NAME_BYTES) -> DataFrame:
    """One row per name found: keys, ``start`` (number of its first word), ``words``, ``name``, ``entity``.

    Words are those of ``tokens_of``: lower-cased words and single punctuation characters. ``keys`` identify a text. A null text has no
    names. Matching takes place where a text is read, or, for a gazetteer beyond ``max_name_bytes``, by joins, with the same result.
    """
    names = saved(known_names(gazetteer), "names")
    size, lengths = names.agg(
        F.sum(F.aggregate("tokens", F.lit(0), lambda a, t: a + F.octet_length(t) + 8)), F.collect_set(F.size("tokens"))
    ).first()
    if (size or 0) <= max_name_bytes:
        rows = ((r["tokens"], r["entity"]) for r in names.toLocalIterator())
        shared = df.sparkSession.sparkContext.broadcast(build_automaton(rows))
        matched = df.select(*keys, _finder(shared)(tokens_of(F.col(text))).alias("matches"))
        return matched.select(*keys, F.inline("matches"))
    words = df.select(*keys, tokens_of(F.col(text)).alias("w"))
    windows = F.array(*[F.lit(n) for n in sorted(lengths)])
    spans = words.select(*keys, "w", F.explode(windows).alias("words")).filter(F.size("w") >= F.col("words")).select(
        *keys, "words", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("words") + 1), lambda i: F.slice("w", i, F.col("words")))).alias("start", "tokens")
    )
    found = spans.join(names.hint("merge"), "tokens").select(*keys, "start", "words", F.array_join("tokens", " ").alias("name"), "entity")
    # The matches of one text in order; a match is kept if it starts where no kept one reaches.
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("words")).alias("less"), "name", "entity")))
    kept = F.aggregate(
        "ordered",
        F.struct(F.lit(0).alias("free"), F.expr("CAST(array() AS array<struct<start:int,less:int,name:string,entity:string>>)").alias("kept")),
        lambda s, m: F.when(
            m["start"] >= s["free"], F.struct((m["start"] - m["less"]).alias("free"), F.concat(s["kept"], F.array(m)).alias("kept"))
        ).otherwise(s),
    )
    chosen = found.groupBy(*keys).agg(ordered.alias("ordered")).select(*keys, F.inline(kept["kept"]))
    return chosen.select(*keys, "start", (-F.col("less")).alias("words"), "name", "entity")


def entity_counts(
    df: DataFrame, keys: Sequence[str], text: str, gazetteer: DataFrame, entities: Sequence[str], max_name_bytes: int = MAX_NAME_BYTES
) -> DataFrame:
    """Per text: names of every type (``t_n_ent_<type>``) and of all listed types, also per word; 0 where there are none."""
    found = find_entities(df, keys, text, gazetteer, max_name_bytes)
    counts = found.groupBy(*keys).agg(*[F.count_if(F.col("entity") == e).alias(f"t_n_ent_{e}") for e in entities])
    sizes = df.select(*keys, F.size(tokens_of(F.col(text))).alias("tokens"))
    joined = sizes.join(saved(counts, "entity-counts"), list(keys), "left").fillna(0, [f"t_n_ent_{e}" for e in entities])
    total: Column = sum((F.col(f"t_n_ent_{e}") for e in entities[1:]), F.col(f"t_n_ent_{entities[0]}"))
    return joined.withColumn("t_n_ent", total).withColumn("a_n_ent_pt", safe_ratio(F.col("t_n_ent"), F.col("tokens")))
