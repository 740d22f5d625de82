"""One query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    byte_bpe,
    chaining,
    exact_dedup,
    importance,
    jaccard_forest,
    language_id,
    merkle,
    packing,
    perspectives,
    pu_quality,
    quality_rules,
    vantage,
    warc_bundles,
)
from parlance.llm.common import crc_remainder, read
from parlance.llm.ngrams import held_out
from parlance.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

NORMALISED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op10_exact_dedup",
    f"""
    WITH normalised AS (SELECT doc_id, sha256({NORMALISED}) AS text_sha256, {NORMALISED} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
    FROM normalised
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest id stays."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest").drop("group_key")


def _cutoff_rows() -> str:
    rows = [f"('{rule}', {c})" for rule, grid in quality_rules.CUTOFFS.items() for c in grid]
    return ", ".join(rows)


def _metric_case() -> str:
    parts = [f"WHEN '{r}' THEN {e.replace(' div ', ' // ')}" for r, e in quality_rules.METRICS.items()]
    return f"CASE g.rule {' '.join(parts)} END"


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3_SQL = f"""
    WITH split AS (
        SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {SPACES}, '') <> '') AS l
        FROM documents),
    windows AS (
        SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
    repeated AS (
        SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
              FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1)
        GROUP BY doc_id),
    counts AS (
        SELECT doc_id, stratum, len(w) AS n_words, length(translate(text, {SPACES}, '')) AS word_chars,
               length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
               len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
        FROM split LEFT JOIN repeated USING (doc_id)),
    based AS (SELECT *, n_words < {quality_rules.MIN_WORDS}
              OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
    grid(rule, cutoff) AS (VALUES {_cutoff_rows()}),
    marked AS (SELECT doc_id, max(quality) AS quality FROM labels
               WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    cells AS (
        SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS good,
               count(*) FILTER (quality = 1 AND {_metric_case()} > cutoff) AS good_rejected,
               count(*) FILTER (quality = 0 AND {_metric_case()} > cutoff) AS bad_rejected
        FROM based JOIN marked USING (doc_id), grid g WHERE NOT base_failed GROUP BY stratum, rule, cutoff),
    tested AS (
        SELECT *, CASE WHEN good_rejected > 0.02 * good THEN 1.0 ELSE list_sum(list_transform(range(0, good_rejected + 1),
            lambda j: exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1)
                          + j * ln(0.02) + (good - j) * ln(0.98)))) END AS tail
        FROM cells WHERE good > 0),
    useful AS (
        SELECT * FROM tested WHERE tail <= 0.05 / ({quality_rules.N_CUTOFFS} * (SELECT count(DISTINCT stratum) FROM cells))
        AND bad_rejected > 0 AND bad_rejected >= 9 * good_rejected),
    chosen AS (
        SELECT stratum, rule, cutoff FROM useful
        QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_rejected - good_rejected DESC, cutoff DESC) = 1),
    failed AS (SELECT DISTINCT b.doc_id FROM based b JOIN chosen g USING (stratum)
               WHERE n_words > 0 AND {_metric_case()} > g.cutoff)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.doc_id = b.doc_id) AS kept
    FROM based b
    """


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the certified rules of each language over every document."""
    verdict = quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes decoded from them, as digests."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP8_SQL = f"""
    WITH named AS (
        SELECT conv_id, turn, CASE WHEN coalesce(role, 'unknown') = '' THEN 'unnamed' ELSE coalesce(role, 'unknown') END AS speaker,
               replace(coalesce(text, ''), '{perspectives.MARK}', '{perspectives.PLAIN_MARK}') AS text FROM conversations),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS position FROM named),
    people AS (SELECT DISTINCT conv_id, speaker AS assistant FROM named WHERE speaker <> 'system'),
    rendered AS (
        SELECT p.conv_id, assistant, position, turn, speaker, text,
               CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = assistant THEN 'assistant' ELSE 'user' END AS role_as
        FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id),
    pieces AS (
        SELECT *, '{perspectives.START}' || role_as || CASE WHEN role_as = 'user'
               THEN ' name=' || regexp_replace(speaker, '{perspectives.UNSAFE_IN_NAMES}', '_', 'g') ELSE '' END || chr(10) AS opening
        FROM rendered),
    sized AS (
        SELECT *, opening || text || '{perspectives.END}' || chr(10) AS piece FROM pieces),
    starts AS (
        SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, assistant ORDER BY position) - length(piece) AS BIGINT) AS char_start
        FROM sized)
    SELECT conv_id, assistant, position, turn, speaker, role_as, piece, char_start,
           CASE WHEN role_as = 'assistant' THEN char_start + length(opening) END AS loss_start,
           CASE WHEN role_as = 'assistant' THEN char_start + length(piece) - 1 END AS loss_end
    FROM starts
    """


@query("op8_perspective_rotation", OP8_SQL)
def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its participants, turn by turn."""
    return perspectives.rotate(read(spark, sf_dir, "conversations"))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out("doc_id", 5, 0))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op6_pu_quality")
def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from good and unlabelled documents that are not held out."""
    docs, out = read(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    labels = read(spark, sf_dir, "labels").filter(~out)
    model = pu_quality.train(docs, labels, ~out)
    scored = pu_quality.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document and the number of its verified links."""
    return jaccard_forest.near_duplicates(read(spark, sf_dir, "documents"))[0]


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents as pieces of at most 4096 tokens, packed; the ids themselves are left out."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.tokenise(docs, path, end_id=2, max_tokens=4096, keep_ids=False))


@query("op4_vector_packing")
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 4096."""
    return pack_documents(read(spark, sf_dir, "documents"))


@query("op7_collinear_chaining")
def op7_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has, too."""
    return chaining.repeated_passages(read(spark, sf_dir, "documents"))


OP5_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
    FROM m
    """


@query("op5_warc_bundles", OP5_SQL)
def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to seekable bundles and read back from them."""
    bundles, _ = warc_bundles.write_bundles(warc_bundles.record_types(read(spark, sf_dir, "pages")))
    records = warc_bundles.read_bundles(bundles, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def crc32_sql(text: str) -> str:
    """CRC-32 of a text in SQL: byte by byte, eight steps of the reversed polynomial each."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


CRC_WORD, CRC_ID = crc32_sql("word"), crc32_sql("CAST(doc_id AS VARCHAR)")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
    WITH words AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents),
    wanted AS (SELECT unnest({WORDS_SQL}) AS word FROM benchmark),
    places AS (SELECT word, ({CRC_WORD}) % 10000 AS bucket FROM (SELECT word FROM words UNION SELECT word FROM wanted)),
    source AS (SELECT bucket, count(*) AS s FROM words JOIN places USING (word) GROUP BY 1),
    target AS (SELECT bucket, count(*) AS t FROM wanted JOIN places USING (word) GROUP BY 1),
    totals AS (SELECT (SELECT count(*) FROM words) AS all_s, (SELECT count(*) FROM wanted) AS all_t),
    gains AS (
        SELECT bucket, CAST(floor(1000::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
               / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM source LEFT JOIN target USING (bucket), totals),
    weighed AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
                FROM words JOIN places USING (word) JOIN gains USING (bucket) GROUP BY 1),
    scored AS (
        SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)
               + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM documents LEFT JOIN weighed USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS all_n
               FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * all_n // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)
    """


@query("op11_importance_resampling", OP11_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents for likeness to the benchmark, and a draw of a tenth of those with twenty words."""
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return importance.resample(docs, benchmark, longest=1)


def field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12_SQL = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {leaf_sql("text")} AS leaf,
               CASE WHEN ({CRC_ID}) % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS other,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
        FROM documents),
    nodes(source, level, pos, n, h) AS (
        SELECT source, 0, pos, n, leaf FROM leaves
        UNION ALL
        SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n),
    subroots AS (
        SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos,
               count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, pos, n, h) AS (
        SELECT 0, pos, n, subroot FROM subroots
        UNION ALL
        SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
    everything AS (
        SELECT source AS tree, false AS upper, level, pos, n, h FROM nodes UNION ALL SELECT NULL, true, level, pos, n, h FROM tops),
    runs AS (
        SELECT tree, upper, level, pos // 3 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM everything WHERE n > 1 GROUP BY ALL),
    steps(doc_id, source, upper, level, pos, h, siblings) AS (
        SELECT doc_id, source, false, 0, pos, other, '' FROM leaves
        UNION ALL
        SELECT s.doc_id, s.source, s.upper OR r.hs IS NULL, CASE WHEN r.hs IS NULL THEN 0 ELSE s.level + 1 END,
               CASE WHEN r.hs IS NULL THEN b.pos ELSE s.pos // 3 END,
               CASE WHEN r.hs IS NULL THEN s.h ELSE sha256(array_to_string(list_transform(r.hs,
                   lambda x, i: CASE WHEN i - 1 = s.pos % 3 THEN s.h ELSE x END), '')) END,
               CASE WHEN r.hs IS NULL THEN s.siblings
                    ELSE s.siblings || array_to_string(list_filter(r.hs, lambda x, i: i - 1 <> s.pos % 3), '') END
        FROM steps s JOIN subroots b ON b.source IS NOT DISTINCT FROM s.source
        LEFT JOIN runs r ON r.upper = s.upper AND (s.upper OR r.tree IS NOT DISTINCT FROM s.source) AND r.level = s.level AND r.run = s.pos // 3
        WHERE r.hs IS NOT NULL OR NOT s.upper),
    ends AS (SELECT doc_id, max_by(h, level) AS folded_root, max_by(siblings, level) AS siblings FROM steps WHERE upper GROUP BY doc_id)
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = t.h AS verified
    FROM leaves JOIN ends USING (doc_id) JOIN subroots b ON b.source IS NOT DISTINCT FROM leaves.source, (SELECT h FROM tops WHERE n = 1) t
    """


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by source, with every second document's line breaks deleted as the tampering."""
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaf = merkle.leaf_digest(*plain, text)
    tampered = F.when(crc_remainder("doc_id", 2) == 0, merkle.leaf_digest(*plain, F.translate(text, "\n", "")))
    return merkle.manifest(read(spark, sf_dir, "documents"), "doc_id", "source", leaf, tampered)


@query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that three differing bits make."""
    return vantage.near_fingerprints(read(spark, sf_dir, "documents"))
