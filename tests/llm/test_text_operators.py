"""Operators on documents: brute force on small fixtures, edge rows, SQL."""

import hashlib
import itertools
import random
import struct
import zlib

import check
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parlance.llm import (
    byte_bpe, chaining, components, exact_dedup, jaccard_forest, language_id, packing, pu_quality, quality_rules, queries,
)
from parlance.llm.ngrams import held_out

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30_000))
CLASHES = ["id", "h", "norm", "n", "key", "u", "v", "g", "words", "row", "component", "row_no", "digest", "pos", "__row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def frame(spark, rows):
    """Rows of (doc_id, text, lang) as documents with columns whose names clash with those of the operators."""
    full = [(i, t, lang, None, None if t is None else len(t), *[None] * len(CLASHES)) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (1, None, "en"), (2, "", None), (3, "  \n\t", "en"), (4, "Same text here", "en"), (5, "same TEXT here", "de"), (5, "same TEXT here", "de"),
    (6, LONG, "en"), (7, LONG, None), (None, "no id", "en"), (8, "ÄÖ straße", "de"), (9, "äö straße", "de"), (10, "!!! ??? 123", "en"),
    (11, "x" * 3000, "en"), (12, "a b c d", "en"), (13, "A b C d", "en"),
]
OPERATORS = {
    "exact": lambda d: exact_dedup.exact_groups(d),
    "language": lambda d: language_id.identify(d, language_id.train(d, F.lit(True))),
    "near": lambda d: jaccard_forest.near_duplicates(d)[0],
    "passages": lambda d: chaining.repeated_passages(d),
    "packing": lambda d: queries.pack_documents(d),
    "rules": lambda d: quality_rules.apply_rules(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "quality": lambda d: pu_quality.score(d, pu_quality.train(d, d.select("doc_id", F.lit(1).alias("quality")), F.lit(True))),
    "bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS),
}
RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op10_exact_dedup"])
def test_query_against_sql(spark, con, name):
    assert check.compare(spark, con, SF_DIR, name, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "passages"])
def test_edge_rows_keep_their_row(spark, name):
    rows = OPERATORS[name](frame(spark, EDGES)).collect()
    ids = [r["doc_id"] for r in rows]
    wanted = sorted((i for i, _, _ in EDGES), key=repr)
    assert (sorted(set(ids), key=repr) == sorted(set(wanted), key=repr)) if name == "packing" else sorted(ids, key=repr) == wanted


# Exact duplicates


def test_exact_groups_on_edges(spark):
    rows = exact_dedup.exact_groups(frame(spark, EDGES), keep="largest").collect()
    kept = {}
    for r in rows:
        kept.setdefault(r["keep_id"], []).append(r)
    assert {r["doc_id"] for r in kept[5]} == {4, 5} and sum(r["kept"] for r in kept[5]) == 1 and kept[5][0]["group_size"] == 3
    assert {r["doc_id"] for r in kept[2]} == {1, 2} and {r["doc_id"] for r in kept[7]} == {6, 7}
    assert {r["doc_id"] for r in kept[8]} == {8} and {r["doc_id"] for r in kept[9]} == {9}  # only A-Z is lower-cased
    assert [r["keep_id"] for r in rows if r["doc_id"] is None] == [None]


def test_bytes_settle_collisions(spark):
    texts = [(i, f"text {i % 4}", "en") for i in range(20)]
    weak = exact_dedup.exact_groups(frame(spark, texts), content_hash=lambda norm: F.unhex(F.hex(F.length(norm))))
    strong = exact_dedup.exact_groups(frame(spark, texts))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(weak.select(*columns).collect()) == sorted(strong.select(*columns).collect())


def test_drop_exact_copies_keeps_columns(spark):
    docs = frame(spark, EDGES)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([1, 3, 4, 6, None, 8, 9, 10, 11, 12], key=repr)


# Language


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = queries.QUERIES["op1_language_id"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and len(out) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 9])
def test_codewords_differ(k):
    codes = language_id.code_matrix(k)
    assert codes.shape[0] == k and all((codes[i] != codes[j]).any() for i in range(k) for j in range(i))


def test_texts_without_letters_are_undetermined(spark):
    docs = frame(spark, EDGES)
    model = language_id.train(docs, F.lit(True))
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {1, 2, 3, 10}
    assert found[1]["score"] == 0 and set(r["lang_pred"] for r in found.values()) <= {"und", "en", "de"}
    kept = language_id.keep_identified(docs, model)
    assert kept.schema.simpleString() == docs.schema.simpleString() and 10 not in {r["doc_id"] for r in kept.collect()}


def test_ambiguous_document_is_flagged(spark):
    a, b = ("der die und ist nicht ein ", "the and of that with are ")
    rows = [(i, (a if i % 2 else b) * 20, "de" if i % 2 else "en") for i in range(40)]
    model = language_id.train(frame(spark, rows), F.lit(True))
    found = {r["doc_id"]: r for r in language_id.identify(frame(spark, [(1, a * 20, None), (2, b * 20, None), (3, (a + b) * 20, None)]), model).collect()}
    assert (found[1]["lang_pred"], found[2]["lang_pred"]) == ("de", "en") and found[3]["score"] < min(found[1]["score"], found[2]["score"])


# Near duplicates


def invented(rng, n):
    return [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + str(rng.randrange(50)) for _ in range(n)]


def near_fixture(rng):
    rows, i = [], 0
    for group in range(40):
        base = invented(rng, rng.choice([12, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
            rows.append((i, " ".join(words), "en"))
            i += 1
    return rows


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates_against_all_pairs(spark):
    rows = near_fixture(random.Random(3))
    members, links = jaccard_forest.near_duplicates(frame(spark, rows))
    class_of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 100
    assert np.mean([class_of[a] == class_of[b] for a, b in near]) >= 0.99
    for r in links.collect():
        exact = len(sets[r["u"]] & sets[r["v"]]) / len(sets[r["u"]] | sets[r["v"]])
        assert exact >= 0.8 and abs(exact - r["similarity"]) < 1e-9
    kept = {r["doc_id"] for r in jaccard_forest.drop_near_copies(frame(spark, rows)).collect()}
    assert kept == set(class_of.values())


def template_fixture(rng):
    """Pairs of near copies that share most of a template, so that many classes meet in one prefix without being alike as a whole."""
    template, rows = invented(rng, 100), []
    for group in range(120):
        base = template + invented(rng, 30)
        for _ in range(2):
            words = list(base)
            words[-1 - rng.randrange(30)] = "edit" + str(rng.randrange(10**6))
            rows.append((len(rows), " ".join(words), "en"))
    rng.shuffle(rows)
    return [(i, text, lang) for i, (_, text, lang) in enumerate(rows)]


def test_near_duplicates_of_many_classes_in_one_prefix(spark):
    rows = template_fixture(random.Random(4))
    class_of = {r["doc_id"]: r["class_id"] for r in jaccard_forest.near_duplicates(frame(spark, rows))[0].collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) == 120 and all(class_of[a] == class_of[b] for a, b in near) and len(set(class_of.values())) == 120


@pytest.mark.parametrize("block_rows", [3, 256])
def test_number_of_links_against_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(jaccard_forest, "BLOCK_ROWS", block_rows)
    rows = near_fixture(random.Random(9))
    rows += [(1000 + i, text, lang) for i, text, lang in rows[::5]]  # equal copies are not links
    found = {r["doc_id"]: r for r in jaccard_forest.near_duplicates(frame(spark, rows))[0].collect()}
    sets = {i: shingles(t) for i, t, _ in rows if found[i]["copy_of"] == i}
    for i in found:
        own = sets[found[i]["copy_of"]]
        near = [j for j in sets if sets[j] != own and len(sets[j] & own) >= 0.8 * len(sets[j] | own)]
        assert found[i]["n_links"] == sum(found[j]["class_id"] == found[i]["class_id"] for j in near)
    assert max(r["n_links"] for r in found.values()) >= 8


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "BLOCK_ROWS", 3)
    test_near_duplicates_against_all_pairs(spark)


def test_near_duplicates_on_edges(spark):
    found = {r["doc_id"]: r for r in jaccard_forest.near_duplicates(frame(spark, EDGES))[0].collect() if r["doc_id"] is not None}
    assert found[6]["class_id"] == found[7]["class_id"] == 6 and found[12]["class_id"] == found[13]["class_id"] == 12
    assert all(found[i]["class_id"] == i for i in (1, 2, 3)) and found[4]["class_id"] == found[5]["class_id"] == 4


def test_prefixes_shorten_to_the_target_recall():
    depths = jaccard_forest.prefix_depths(0.8, 0.99)
    assert depths == sorted(depths, reverse=True)
    assert jaccard_forest.recall_at(depths[-1], 0.8) >= 0.99 > jaccard_forest.recall_at(depths[-1] + 1, 0.8)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, rng.randrange(101, 200)) for _ in range(50)] + [(300, 301), (301, 300), (5, 5)]
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 1 for i in range(2, 61)) and {found[b] for a, b in edges if a == 100} == {100} and found[301] == 300


# Passages


def passage_fixture(rng):
    passages = [invented(rng, 80) for _ in range(4)]
    rows = []
    for i in range(40):
        words = invented(rng, rng.randrange(20, 300))
        if i % 2:
            passage = list(passages[i % 4])
            for _ in range(i % 3):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = passage
        rows.append((i, " ".join(words), "en"))
    return rows


def test_passages_against_brute_force(spark):
    rows = passage_fixture(random.Random(5))
    docs = frame(spark, rows)
    passages = chaining.repeated_passages(docs)
    covered = {}
    for r in passages.collect():
        assert r["source_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    first = {}
    for i, text, _ in rows:
        words = text.split()
        for k in range(len(words) - 49):
            window = tuple(words[k : k + 50])
            if first.setdefault(window, i) != i:
                assert set(range(k, k + 50)) <= covered[i]
    assert set(covered) == set(range(5, 40, 2))  # documents 1 and 3 hold the first copies, even ones hold none
    left = chaining.cut_passages(docs, passages)
    assert left.schema.simpleString() == docs.schema.simpleString()
    texts = {r["doc_id"]: r for r in left.collect()}
    assert texts[0]["text"] == rows[0][1] and texts[1]["text"] == rows[1][1]
    assert all(len(texts[i]["text"].split()) < len(rows[i][1].split()) - 70 and texts[i]["n_chars"] == len(texts[i]["text"]) for i in range(5, 40, 2))


def test_parts_of_a_chain_that_fails_as_a_whole(spark):
    rng = random.Random(6)
    parts = [invented(rng, 52) for _ in range(3)]
    changed = [[*part[:25], "changed", *part[26:]] for part in parts]  # so that no 50 words are an exact repeat
    rows = [(i, " ".join(sum(([*part, *invented(rng, 22)] for part in side), [])), "en") for i, side in enumerate([parts, changed])]
    found = [(r["start_word"], r["end_word"]) for r in chaining.repeated_passages(frame(spark, rows)).collect()]
    for at in (0, 74, 148):
        assert any(start <= at and at + 52 <= end for start, end in found)


def test_exact_passages_whose_seeds_come_first_elsewhere(spark):
    rng = random.Random(8)
    passage, lines = invented(rng, 52), [invented(rng, 25) for _ in range(3)]
    around = lambda words: " ".join([*invented(rng, 30), *words, *invented(rng, 30)])
    texts = [around(passage[:49]), around(passage), around(passage), *map(around, lines), around(sum(lines, [])), around(sum(lines, []))]
    found = chaining.repeated_passages(frame(spark, [(i, text, "en") for i, text in enumerate(texts)])).collect()
    spans = {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in found}
    assert spans == {(2, 1, 30, 82), (7, 6, 30, 105)}


def test_passages_whose_pieces_come_first_in_several_layers_of_documents(spark):
    rng = random.Random(9)
    around = lambda words: " ".join([*invented(rng, 30), *words, *invented(rng, 30)])
    passage, texts = invented(rng, 75), []
    for cuts in ((25, 50), (20, 45, 60), (30, 55), (15, 40)):  # each layer has all its words, but in pieces
        texts += [around(passage[low:high]) for low, high in zip((0, *cuts), (*cuts, 75))]
    texts += [around(passage), around(passage), around([*passage[:37], "changed", *passage[38:]])]
    first = len(texts) - 3
    found = chaining.repeated_passages(frame(spark, [(i, text, "en") for i, text in enumerate(texts)])).collect()
    spans = {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in found}
    assert {x for x in spans if x[0] == first + 1} == {(first + 1, first, 30, 105)}
    assert any(i == first + 2 and j in (first, first + 1) and low <= 30 and high >= 105 for i, j, low, high in spans)
    assert all(i > first for i, *_ in spans)


def test_a_passage_whose_pieces_come_first_in_its_own_source(spark):
    rng = random.Random(10)
    passage = invented(rng, 60)
    pieces = [word for low in (0, 30) for word in [*passage[low : low + 30], *invented(rng, 70)]]
    texts = [" ".join([*pieces, *passage, *invented(rng, 30)]), " ".join([*invented(rng, 30), *passage, *invented(rng, 30)])]
    found = chaining.repeated_passages(frame(spark, [(i, text, "en") for i, text in enumerate(texts)])).collect()
    assert [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["source_start"]) for r in found] == [(1, 0, 30, 90, len(pieces))]


def test_all_words_of_shared_passages_are_found_by_brute_force(spark):
    rng = random.Random(11)
    lines, rows = [invented(rng, 18) for _ in range(9)], []
    for i in range(60):  # lines of 18 words in any order: some three in a row come again, most come first apart from each other
        picked = [rng.choice(lines) for _ in range(rng.randrange(1, 6))]
        rows.append((i, " ".join([*invented(rng, 20), *sum(picked, []), *invented(rng, 20)]), "en"))
    covered = {}
    for r in chaining.repeated_passages(frame(spark, rows)).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    first = {}
    for i, text, _ in rows:
        words = text.split()
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) != i:
                assert set(range(k, k + 50)) <= covered[i]


def test_what_cannot_become_a_passage_is_told_by_its_bytes():
    rng = np.random.default_rng(12)
    own, other = rng.integers(0, 3, (2, 400)).astype(np.uint8)
    other[100:130] = own[100:130]
    at = np.arange(60, 340)
    edge = [np.zeros(len(at), int), np.full(len(at), 400)]
    for step in (1, -1):
        far = chaining.reach(own, at, *edge, other, at, *edge, step)
        exact = [chaining.extend(own[i::step], other[i::step])[0] for i in at]
        assert (far >= exact).all() and (far == exact).mean() > 0.8


def test_of_passages_of_a_document_no_word_is_lost(spark):
    rows = [(1, 0, 0, 60, 0, 60, 1.0), (1, 2, 10, 60, 0, 50, 1.0), (1, 3, 40, 100, 0, 60, 1.0), (1, 4, 0, 60, 0, 60, 1.0), (5, 2, 10, 60, 0, 50, 1.0)]
    names = "id long, source_id long, start_word long, end_word long, source_start long, source_end long, similarity double"
    kept = chaining.longest(spark.createDataFrame(rows, names)).collect()
    assert sorted(tuple(r) for r in kept) == [rows[0], rows[2], rows[4]]


@pytest.fixture(scope="module")
def edited_passages(spark):
    """Pairs of documents that share a passage of 80 words with an edit every so many words, and which of them are found."""
    rng, rows, pairs = random.Random(3), [], {}
    around = lambda words: " ".join([*invented(rng, 60), *words, *invented(rng, 60)])
    for every in (7, 8, 10, 12, 20):
        for _ in range(30):
            passage, off = invented(rng, 80), rng.randrange(every)
            changed = [f"edit{rng.random()}" if j % every == off else w for j, w in enumerate(passage)]
            if every == 20:  # all its unchanged runs come first in another document, far from each other
                runs = "".join("\n" if j % every == off else w + " " for j, w in enumerate(passage)).split("\n")
                rows.append((len(rows), " ".join(sum(([*run.split(), *invented(rng, 30)] for run in runs), [])), "en"))
            pairs.setdefault(every, []).append((len(rows) + 1, len(rows)))
            rows += [(len(rows), around(passage), "en"), (len(rows) + 1, around(changed), "en")]
    return pairs, {(r["doc_id"], r["source_id"]) for r in chaining.repeated_passages(frame(spark, rows)).collect()}


@pytest.mark.parametrize("every", [7, 8, 10, 12, 20])
def test_recall_of_edited_passages(edited_passages, every):
    pairs, found = edited_passages
    assert sum(pair in found for pair in pairs[every]) >= 0.9 * len(pairs[every])
    assert found <= {pair for some in pairs.values() for pair in some}


def test_passages_of_a_periodic_text(spark):
    rng = random.Random(4)
    again = ["la"] * 70 + ["do", "re"] * 40
    rows = [(i, " ".join([*invented(rng, 30), *again, *invented(rng, 30)]), "en") for i in range(3)]
    found = chaining.repeated_passages(frame(spark, rows)).collect()
    for i in (1, 2):
        assert set(range(30, 180)) <= set().union(*(range(r["start_word"], r["end_word"]) for r in found if r["doc_id"] == i))


def test_passages_on_edges(spark):
    docs = frame(spark, EDGES)
    passages = chaining.repeated_passages(docs)
    assert {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in passages.collect()} == {(7, 6, 0, 30_000)}
    left = sorted((r["doc_id"] for r in chaining.cut_passages(docs, passages).collect()), key=repr)
    assert left == sorted((i for i, _, _ in EDGES if i != 7), key=repr)


def test_chain_equals_exhaustive_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        pos, src = np.sort(rng.choice(60, n, replace=False)), rng.integers(0, 60, n)
        k, cost = chaining.SEED_WORDS, chaining.GAP_COST
        best = np.zeros(n)
        for i in range(n):
            earlier = [best[j] - cost * (pos[i] - pos[j] + src[i] - src[j]) for j in range(i) if src[j] < src[i]]
            best[i] = k + max([0, *earlier])
        chain = max(chaining.best_chains(pos, src), key=len)
        assert all(pos[a] < pos[b] and src[a] < src[b] for a, b in zip(chain, chain[1:]))
        total = k * len(chain) - cost * sum(pos[b] - pos[a] + src[b] - src[a] for a, b in zip(chain, chain[1:]))
        assert total <= best.max() + 1e-9


def test_a_passage_of_seeds_that_are_not_sampled_is_found(spark):
    rng, words = random.Random(3), []
    while len(words) < 50:
        tried = [*words, f"w{rng.randrange(10**6)}"]
        hashes = chaining.window_hashes(chaining.word_hashes(np.frombuffer(" ".join(tried).encode(), np.uint8))[0], chaining.SEED_WORDS)
        if not len(hashes) or hashes[-1] % np.uint64(chaining.SAMPLE):
            words = tried
    fill = lambda: " ".join(f"f{rng.randrange(10**6)}" for _ in range(30))
    texts = [f"{fill()} {' '.join(words)} {fill()}" for _ in range(2)]
    found = chaining.repeated_passages(frame(spark, [(i, text, "en") for i, text in enumerate(texts)])).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["source_id"], r["similarity"]) for r in found] == [(1, 30, 80, 0, 1.0)]


def test_of_eight_seeds_in_a_row_one_is_kept():
    words = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    _, places = chaining.seed_places(words)
    assert np.diff(places).max() <= chaining.LONGEST_GAP and len(places) < 0.4 * len(words)
    _, inside = chaining.seed_places(words[5000:5050])
    assert set(places[(places >= 5008) & (places < 5038)]) <= set(5000 + inside)


def test_edit_distance():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([1, 3, 4, 9, 5, 6])
    assert chaining.edits(a, b) == 3 and chaining.edits(a, a) == 0 and chaining.edits(a[:0], b) == 6 and chaining.edits(b, a[:0]) == 6


# Packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = frame(spark, [r for r in EDGES if r[0] is not None and r[0] != 5] + [(50, "<|endoftext|> It's é 你好", "en")])
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.tokenise(docs, path, 2, 512), max_tokens=512, max_segments=4, max_loss_tokens=512).collect()
    pieces = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == len(pieces.setdefault(r["doc_id"], []))
        pieces[r["doc_id"]] += ids
        total = r["doc_tokens"]
    for r in docs.select("doc_id", "text").collect():
        assert pieces[r["doc_id"]] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
    assert total
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0] + [n for _, n in parts]))[:-1]
        assert sum(n for _, n in parts) <= 512 and len(parts) <= 4


def test_word_encoder_equals_the_tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = packing.WordEncoder(file.read())
    words = ["Hello,", "it's", "IT'S", "l'été", "été", "e\u0301te\u0301.", "İstanbul", "ΟΔΟΣ", "ΟΔΟΣ,", "ﬁn", "x1y", "a,b", "...", "!!", "don't!", "ß?", "你好!", "ª", "naïve;:", "A\u0308b"]
    words += ["'s,", "s", ",", "<|endoftext|>", "ab<|endoftext|>", "straße.", "ǅ", "\u0345x", "x\u200b.", "\x1cq"]
    words += ["THE!!", "thenes$$$", "a,\"b", "x-", "-x", "word.'s", "it's.", "don't$$", "ß%%%", "12%", "x1%", "<|endoftext|>,"]
    words += ["<|startoftext|>a", "<|ENDOFTEXT|>", "é<|endoftext|>e\u0301", "<|endoftext|", "<|endoftext|><|endoftext|>"]
    for word in words:
        assert list(struct.unpack(f"<{len(encoder[word.encode()]) // 4}I", encoder[word.encode()])) == encoder.tokenizer.encode(word, add_special_tokens=False).ids, word
    assert encoder[b"<|endoftext|>"] == struct.pack("<I", 49407)


def test_packing_keeps_every_limit():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 400, 500), np.ones(500), rng.integers(0, 100, 500)], 1).astype(float)
    limits = np.array([1000, 5, 150], float)
    sequence, _ = packing.pack_group(demand, limits)
    totals = np.stack([np.bincount(sequence, demand[:, c]) for c in range(3)], 1)
    assert (totals <= limits).all() and sequence.min() == 0
    least = np.ceil((demand.sum(0) / limits).max())
    assert len(totals) <= 1.15 * least


def test_a_piece_beyond_a_limit_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 20)], "doc_id long, length long"), max_tokens=10)


# Quality rules


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10), (0, 500), (3, 500), (9, 1000), (40, 5000)]
    found = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in found.collect():
        exact = sum(comb(r["n"], j) * 0.02**j * 0.98 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert abs(r["p"] - exact) < 1e-9 * max(1, exact)
    above = spark.createDataFrame([(30, 500)], "k long, n long").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02)).first()[0]
    assert above == 1.0


def test_counts_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(100 + i, "\n".join(" ".join(rng.choice(["a", "b", "c#", "dé", "$x"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 9))), "en") for i in range(60)]
    for r in quality_rules.text_counts(frame(spark, rows + EDGES[:4])).collect():
        text = dict((i, t) for i, t, _ in rows + EDGES[:4])[r["doc_id"]] or ""
        words = text.split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)}
        lines = [line for line in text.split("\n") if line.split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_certified_cutoff_limits_false_rejection(spark):
    good = [(i, " ".join(["word"] * 3 + [f"w{j}" for j in range(60)]), "en") for i in range(1000)]
    bad = [(2000 + i, " ".join(f"w{j}%%%" for j in range(60)), "en") for i in range(100)]
    few = [(5000 + i, " ".join(f"w{j}%%%" for j in range(60)), "de") for i in range(5)]
    docs = frame(spark, good + bad + few)
    labels = docs.select("doc_id", (F.col("doc_id") < 2000).cast("int").alias("quality"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)
    assert all(kept[i] for i, _, _ in few)  # no good rows of that stratum, so nothing is certified there


# Quality classifier


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.QUERIES["op6_pu_quality"](spark, sf_dir).join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1 and r["held_out"]]
    bad = [r["score"] for r in rows if r["quality"] == 0 and r["held_out"]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_no_positives_gives_no_model(spark):
    docs = frame(spark, EDGES)
    assert pu_quality.train(docs, docs.select("doc_id", F.lit(0).alias("quality")), F.lit(True)) is None
    assert {r["score"] for r in pu_quality.score(docs, None).collect()} == {0.5}


def test_prior_from_the_best_bin():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 3000), neg[:3000]])
    assert abs(pu_quality.best_bin_prior(pos, mixed) - 0.5) < 0.06


# Byte-level BPE


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
    rows = EDGES + [(60, "Ünï 你好  x's I'LL don't 123,45 \t\n  zz 😀 <|endoftext|> x", "en"), (61, "ab" * 1500 + "\x00\x01", "en")]
    docs = frame(spark, rows)
    for words in (0, 50, 100_000):
        found = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, dictionary_words=words), RANKS).collect()
        texts = sorted((t or "") for _, t, _ in rows)
        assert sorted(bytes(r["decoded"]).decode() for r in found) == texts
        by_text = {bytes(r["decoded"]).decode(): bytes(r["ids"]) for r in found}
        for text in set(texts):
            ids = encoding.encode_ordinary(text)
            assert by_text[text] == struct.pack(f"<{len(ids)}I", *ids)


def test_fold_in_spark_equals_the_task_fold(spark):
    words = [(w,) for w in ["hello", " world", "zzxqj", "ééé", "  ", "a", "unbelievably", "1234567"]]
    folded = byte_bpe.fold_words(spark.createDataFrame(words, "word string"), RANKS).collect()
    assert {r["word"]: r["ids"] for r in folded} == {w: byte_bpe.fold_in_task(w.encode(), dict(RANKS)) for (w,) in words}


def test_query_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_byte_bpe"](spark, SF_DIR).collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_held_out_rule(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("out", held_out("doc_id", 4, 2)).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# Byte-level BPE at its limits


def test_long_matches_fold_like_short_ones():
    rng, rank_of = random.Random(9), dict(RANKS)
    for alphabet in ("ab", "the quick", "äöü字", "aaaa"):
        word = "".join(rng.choices(alphabet, k=66)).encode()[:195]
        if word not in rank_of:
            assert byte_bpe.fold_long(word, rank_of) == byte_bpe.fold_in_task(word, rank_of)


def test_a_megabyte_of_letters_is_folded_in_seconds():
    import time

    word = "".join(random.Random(2).choices("etaoinshrdlu", k=1_000_000)).encode()
    begin = time.perf_counter()
    ids = byte_bpe.fold_long(word, dict(RANKS))
    assert time.perf_counter() - begin < 20
    pieces = {rank: piece for piece, rank in RANKS}
    assert b"".join(pieces[i] for i in ids) == word


def test_frequent_words_are_never_none(spark):
    rows = spark.createDataFrame([(1, " a b c d e f" * 50), (2, " a b c g")], "doc_id long, text string")
    words = lambda df, most: {r["word"] for r in byte_bpe.frequent_words(df, "text", public_tokenizers.PATTERN, most).collect()}
    assert words(rows, 3) == {" a", " b", " c"}
    assert words(rows, 100) == {f" {c}" for c in "abcdefg"}
    alike = spark.createDataFrame([(1, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)))], "doc_id long, text string")
    assert 60 < len(words(alike, 100)) < 140


def test_exact_copies_with_null_and_repeated_ids(spark):
    rows = [(None, "same"), (None, "same"), (1, "SAME"), (2, "other"), (2, "other"), (3, None), (4, "")]
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    kept = exact_dedup.drop_exact_copies(docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(False, 0, "same"), (True, 2, "other"), (True, 3, None)]
    assert kept.columns == docs.columns
