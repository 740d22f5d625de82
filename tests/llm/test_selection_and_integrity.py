"""Importance resampling, Merkle manifests and SimHash components: brute force, SQL, edge rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import check
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import importance, merkle, numbering, queries, vantage

SF_DIR = "/root/testdata/sf0.001"
CLASHES = ["id", "tree", "n", "pos", "block", "leaf", "path", "root", "print", "shard", "rows", "t", "rank", "score", "place", "less", "all", "__slice"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = " ".join(f"word{i % 977}" for i in range(120_000))
EDGES = [
    (1, None, "a"), (2, "", None), (3, "  \n\t", ""), (4, "Same text here", "a"), (4, "Same text here", "a"), (4, "other", "a"),
    (5, LONG, "a"), (6, LONG, None), (None, "no id\nat all", "b"), (7, "ÄÖ straße 字", "b"), (8, "\n", "a"), (9, "one two", "a"), (None, None, None),
]


def frame(spark, rows):
    full = [(i, t, None, s, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def manifest_of(docs, **options):
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest(*plain, F.translate("text", "\n", "")))
    return merkle.manifest(docs, "doc_id", "source", merkle.leaf_digest(*plain, F.col("text")), tampered, **options)


OPERATORS = {
    "resample": lambda d: importance.resample(d, d.filter("doc_id > 3"), min_words=1, percent=50),
    "manifest": manifest_of,
    "fingerprints": vantage.near_fingerprints,
}


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_merkle_manifest"])
def test_query_against_sql(spark, con, name):
    assert check.compare(spark, con, SF_DIR, name, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    rows = OPERATORS[name](frame(spark, EDGES)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in EDGES)


# Numbering


@pytest.mark.parametrize("groups", [1, 3])
def test_numbered_over_many_slices(spark, groups):
    rows = [(f"g{i % groups}", (i * 7919) % 1000) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbering.numbered(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = defaultdict(list)
    for g, v in rows:
        expected[g].append(v)
    assert {(r["g"], r["pos"], r["v"], r["n"]) for r in found} == {
        (g, k, v, len(vs)) for g, vs in expected.items() for k, v in enumerate(sorted(vs))
    }


def test_join_of_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([0] * 50 + list(range(1, 60)))], "k long, i long")
    classes = spark.createDataFrame([(k, 50 if k == 0 else 1, f"c{k}") for k in range(60)], "k long, n long, c string")
    found = numbering.join_counted(rows, classes, "k", "n", 109, parts=10)
    assert sorted((r["i"], r["c"]) for r in found.collect()) == [(i, f"c{k}") for i, k in enumerate([0] * 50 + list(range(1, 60)))]


# Importance resampling


def words_of(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_features(text, longest):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, longest, buckets, percent, min_words):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in brute_features(t, longest))
    t = Counter(place(f) for text in target for f in brute_features(text, longest))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows, eligible = [], []
    for i, text in docs:
        found = brute_features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score))
        if len(words_of(text)) >= min_words:
            eligible.append((-score, i))
    drawn = {i: k + 1 for k, (_, i) in enumerate(sorted(eligible)[: percent * len(eligible) // 100])}
    return sorted((*row, drawn.get(row[0])) for row in rows)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_against_brute_force(spark, longest):
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "ŒUVRE", "字", "a1b"]
    sentence = lambda: rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 30, 60])))
    docs = [(i, rng.choice([sentence(), sentence(), None])) for i in range(300)]
    target = [sentence() for _ in range(20)] + [None]
    frame_of = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(frame_of, wanted, longest=longest, buckets=97, percent=30, min_words=5)
    rows = sorted(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert rows == brute_resample(docs, target, longest, 97, 30, 5)
    assert any(r[4] for r in rows)


def test_slices_keep_every_text_whole():
    texts = pa.array(["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5, "e" * 30])
    parts = list(importance.in_slices(texts, 40))
    assert [x for _, part in parts for x in part.to_pylist()] == texts.to_pylist()
    assert [low for low, _ in parts] == [0, 2, 3]


@pytest.mark.parametrize("missing", [None, ""])
def test_features_of_a_slice_are_those_of_its_texts(missing):
    texts = pa.array(["one Two", missing, "three", "Four five six", "", "İ seven"])
    for low, some in importance.in_slices(texts, 9):
        rows, found, n_words = importance.feature_buckets(some, 1, 10_000)
        alone = [importance.feature_buckets(pa.array([t], pa.string()), 1, 10_000) for t in some.to_pylist()]
        assert n_words.tolist() == [int(a[2][0]) for a in alone]
        assert found.tolist() == [b for a in alone for b in a[1].tolist()]


def test_a_target_like_the_corpus_gains_nothing():
    counts = np.array([5, 0, 9])
    assert importance.bucket_gains(counts, counts).tolist() == [0, 0, 0]


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity):
    """Whole trees in memory: ``rows`` of (id, group, leaf, other)."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def walk(tree, place, digest):
        siblings = []
        for level in tree[:-1]:
            low = place // arity * arity
            run = level[low : low + arity]
            siblings += [d for k, d in enumerate(run) if low + k != place]
            run[place - low] = digest
            digest, place = h(*run), place // arity
        return digest, siblings

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = levels([r[2] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for place, (i, _, leaf, other) in enumerate(groups[g]):
            subroot, low = walk(trees[g], place, other)
            root, high = walk(top, k, subroot)
            yield i, leaf, trees[g][-1][0], top[-1][0], h(*low, *high), root, root == top[-1][0]


def leaf_of(i, source, lang, n, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)]
    return h(*parts)


@pytest.mark.parametrize(("block_levels", "n"), [(1, 40), (2, 100), (3, 28), (6, 60), (2, 1), (1, 4)])
def test_manifest_against_whole_trees(spark, block_levels, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a\nb", "plain", None, "", "ü\n\n"]), rng.choice([None, "", "a", "a", "a", "b", "é", "z", *[f"s{i}"] * 2])) for i in range(n)]
    rows += rows[:2]
    known = [
        (i, s, leaf_of(i, s, None, None if t is None else len(t), t),
         leaf_of(i, s, None, None if t is None else len(t), t.replace("\n", "") if t and i % 2 == 0 else t))
        for i, t, s in rows
    ]
    found = manifest_of(frame(spark, rows), block_levels=block_levels).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_manifest(known, 3))


@pytest.mark.parametrize("arity", [2, 5])
def test_manifest_of_other_arity(spark, arity):
    rows = [(i, "a\nb", "s") for i in range(57)]
    known = [(i, s, leaf_of(i, s, None, 3, t), leaf_of(i, s, None, 3, t if i % 2 else "ab")) for i, t, s in rows]
    found = manifest_of(frame(spark, rows), arity=arity, block_levels=2)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(brute_manifest(known, arity))


def test_versions_share_untouched_nodes():
    leaves = [merkle.Node(h(str(i)).encode()) for i in range(27)]
    tree = merkle.grow(leaves, 3)
    version = merkle.changed(merkle.descent(tree, 3, 14), merkle.Node(h("other").encode()))

    def nodes(root):
        return {id(root)}.union(*[nodes(c) for c in root.children])

    assert version.digest != tree.digest
    assert len(nodes(version) - nodes(tree)) == 4  # the leaf and its three ancestors
    assert merkle.folded(leaves[14].digest, merkle.path_of(merkle.descent(version, 3, 14))) == tree.digest


# Fingerprints


def brute_fingerprint(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "Ä b\x0bc\x1cd e", LONG[:300_000], "x\xa0y z   w"])
def test_fingerprint_against_brute_force(text):
    assert vantage.fingerprint((text or "").encode()) == brute_fingerprint(text)


def brute_components(points, reach):
    label = list(range(len(points)))
    for i, j in itertools.combinations(range(len(points)), 2):
        if (points[i] ^ points[j]).bit_count() <= reach:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def clouds(rng, centres, around):
    """Random points with neighbours at one to six bits, so that some link, some do not, and some link by chains."""
    points = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        points.add(centre)
        for _ in range(rng.randrange(around)):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            points.add(centre)
    return sorted(points)


@pytest.mark.parametrize("leaf", [8, 64, 5000])
def test_search_connects_what_brute_force_connects(leaf):
    points = clouds(random.Random(leaf), 150, 8)
    pairs = vantage.search(np.array(points, np.uint64), 3, leaf)
    label = list(range(len(points)))
    for a, b in pairs.tolist():
        x, y = label[a], label[b]
        label = [min(x, y) if k in (x, y) else k for k in label]
    assert label == brute_components(points, 3)


@pytest.mark.parametrize(("most", "sample"), [(64, 1 << 16), (64, 100), (16, 300)])
def test_components_over_many_shards(spark, most, sample):
    rng = random.Random(most + sample)
    points = clouds(rng, 250, 6)
    dense = rng.getrandbits(64)
    points = sorted({*points, *[dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)]})  # cannot be parted
    prints = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "print long").repartition(4)
    met = vantage.shards(prints, len(points), 3, most, sample)
    assert met.select("shard").distinct().count() > 2
    links = vantage.near_links(prints, len(points), 3, most, sample).collect()
    number = {int(np.uint64(p).view(np.int64)): k for k, p in enumerate(points)}
    label = list(range(len(points)))
    for u, v in links:
        x, y = label[number[u]], label[number[v]]
        label = [min(x, y) if k in (x, y) else k for k in label]
    assert label == brute_components(points, 3)


def test_near_fingerprints_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"] * 3, r["text"]) for r in rows] + [(1, None), (2, " "), (4, rows[0]["text"]), (5, rows[1]["text"] + " more")]
    prints = [brute_fingerprint(t) for _, t in rows]
    label, least = brute_components(prints, 3), {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, i), i)
    expected = sorted((i, f"{p:016x}", least[k]) for (i, _), p, k in zip(rows, prints, label, strict=True))
    found = vantage.near_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), most=64)
    assert sorted(tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()) == expected
    assert len({c for *_, c in expected}) < len(expected)
