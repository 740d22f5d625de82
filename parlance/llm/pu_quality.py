"""Quality scores learnt from trusted positives and unlabelled text alone (positive-unlabelled learning).

Only rows marked good are trusted; the other side of the training set is a sample of the whole corpus with every label hidden. The share of
good text in the corpus (class prior) is estimated by the best-bin rule: among the top scores of a first classifier, the ratio
of the unlabelled to the positive share, taken where its confidence bound is smallest. The scorer then minimises the non-negative
unbiased risk ``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``; when the second part falls below zero the
step goes the other way, which keeps the network from learning the unlabelled rows by heart.

The fit uses bounded samples on the driver. Scoring is one pass over the whole texts in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.ngrams import hashed_counts, hellinger, sampled, texts_of

BUCKETS = 512
SHAPE = 12


@dataclass
class PuModel:
    """Small networks on standardised features; ``prior`` is the estimated share of good text."""

    mean: np.ndarray
    scale: np.ndarray
    networks: list[tuple[np.ndarray, np.ndarray]]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.mean([forward(z, *network)[1] for network in self.networks], axis=0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def forward(z: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(z @ w1[:-1] + w1[-1])
    return hidden, hidden @ w2[:-1] + w2[-1]


def shape_of(text: np.ndarray, byte_counts: np.ndarray) -> np.ndarray:
    """What a text looks like from afar: lengths, kinds of characters, how much of it repeats."""
    n = max(len(text), 1)
    raw = text.tobytes()
    words, lines = raw.split(), raw.split(b"\n")
    m = max(len(words), 1)
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    same_as_last = sum(a == b for a, b in zip(words, words[1:]))
    full_lines = [line for line in lines if line]
    upper, lower = byte_counts[65:91].sum(), byte_counts[97:123].sum()
    digits, high = byte_counts[48:58].sum(), byte_counts[128:].sum()
    space = byte_counts[[9, 10, 11, 12, 13, 32]].sum()
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), (n - space) / m / 10, len(full_lines) / m * 10,
        upper / n, digits / n, (n - upper - lower - digits - high - space) / n, upper / max(upper + lower, 1),
        len(tally) / m, max(tally.values(), default=0) / m, same_as_last / m,
        1 - len(set(full_lines)) / max(len(full_lines), 1),
    ], np.float32)


def features(text: np.ndarray) -> np.ndarray:
    byte_counts = np.bincount(text, minlength=256).astype(np.float32)
    return np.concatenate([shape_of(text, byte_counts), hellinger(byte_counts), hellinger(hashed_counts(text, (2,), BUCKETS))])


def vectors(column: pa.Array) -> np.ndarray:
    rows = [features(text) for text in texts_of(column)]
    return np.stack(rows) if rows else np.zeros((0, SHAPE + 256 + BUCKETS), np.float32)


def softplus(v: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, v)


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit_network(
    pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 24, rounds: int = 400, seed: int = 5, l2: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Minimise the non-negative risk for ``prior`` with Adam on mini-batches."""
    rng, d = np.random.default_rng(seed), pos.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d + 1, hidden)).astype(np.float32), np.zeros(hidden + 1, np.float32)]
    w[1][:-1] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    m, v, rate = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0.01
    for t in range(1, rounds + 1):
        p = pos[rng.integers(0, len(pos), min(512, len(pos)))]
        u = unl[rng.integers(0, len(unl), min(1024, len(unl)))]
        z = np.vstack([p, u])
        h, f = forward(z, *w)
        fp, fu = f[: len(p)], f[len(p) :]
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        g_negative = np.concatenate([-prior * sigmoid(fp) / len(p), sigmoid(fu) / len(u)])
        g_positive = np.concatenate([-prior * sigmoid(-fp) / len(p), np.zeros(len(u))])
        g = g_positive + g_negative if negative >= 0 else -g_negative
        back = (g[:, None] * w[1][None, :-1]) * (1 - h * h)
        grads = [
            np.vstack([z.T @ back, back.sum(0)[None]]) + l2 * w[0],
            np.append(h.T @ g, g.sum()) + l2 * w[1],
        ]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w[0], w[1]


def best_bin_prior(pos: np.ndarray, unl: np.ndarray, error: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of rows the scoring classifier has not seen."""
    cuts = np.unique(np.quantile(pos, np.linspace(0, 0.99, 100)))
    q_pos = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    q_unl = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    slack = np.sqrt(np.log(4 / error) / (2 * len(unl))) + np.sqrt(np.log(4 / error) / (2 * len(pos)))
    q_pos = np.maximum(q_pos, 1e-9)
    best = int(np.argmin((q_unl + slack) / q_pos))
    return float(np.clip(q_unl[best] / q_pos[best], 0.02, 0.98))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, rounds: int = 4, start: float = 0.7) -> float:
    """Fit with the prior so far on one half of the samples, estimate it anew from the scores of the other half, and so on.

    A contaminated top bin can only raise the ratio, so the smallest estimate is taken.
    """
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    priors = [start]
    for k in range(rounds):
        network = fit_network(pos[::2], unl[::2], priors[-1], seed=k)
        priors.append(best_bin_prior(forward(pos[1::2], *network)[1], forward(unl[1::2], *network)[1]))
    return min(priors[1:])


def fit(pos: np.ndarray, unl: np.ndarray, members: int = 3) -> PuModel:
    """Prior first, then a few networks on all samples, whose logits are averaged."""
    mean, scale = unl.mean(0), np.maximum(unl.std(0), 1e-3)
    pos, unl = np.clip((pos - mean) / scale, -8, 8), np.clip((unl - mean) / scale, -8, 8)
    prior = estimate_prior(pos, unl)
    return PuModel(mean, scale, [fit_network(pos, unl, prior, seed=10 + k) for k in range(members)], prior)


def train(
    docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    max_positives: int = 4000, max_unlabelled: int = 8000,
) -> PuModel | None:
    """Fit on at most about ``max_positives`` good and ``max_unlabelled`` corpus rows of the training part; None if a side is empty.

    Labels with null are none; of repeated labels of one id the smaller counts, so that a trusted row is undisputed. Null text is empty.
    """
    rows = docs.filter(training).select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = labels.select(F.col(id_col).alias("key"), F.col(quality_col).cast("int").alias("quality")).dropna()
    good = marked.groupBy("key").agg(F.min("quality").alias("quality")).filter("quality = 1").select("key")
    n_good, n_rows = good.count(), rows.count()
    if not n_good or not n_rows:
        return None
    positives = sampled(good, "key", min(1.0, max_positives / n_good), "u").drop("u")
    unlabelled = sampled(rows.select("key"), "key", min(1.0, max_unlabelled / n_rows), "u").drop("u")
    wanted = F.broadcast(  # bounded by the two parameters
        positives.withColumn("p", F.lit(True)).join(unlabelled.withColumn("q", F.lit(True)), "key", "full")
    )
    chosen = rows.join(wanted, "key").dropDuplicates(["key"]).select("key", "p", "q", "text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [v.astype(np.float16).tobytes() for v in vectors(part.column(3))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(x, pa.binary())], ["key", "p", "q", "x"])

    kind = chosen.schema["key"].dataType.simpleString()
    table = chosen.mapInArrow(batches, f"key {kind}, p boolean, q boolean, x binary").toArrow().sort_by("key")
    if not len(table):
        return None
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in table["x"]]).astype(np.float32)
    p, q = (np.array([bool(v) for v in table[c].to_pylist()]) for c in ("p", "q"))
    return fit(x[p], x[q]) if p.any() and q.any() else None


def score(docs: DataFrame, model: PuModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher is better) of every whole text; 0.5 without a model.

    Null text is scored as empty text. Equal texts get equal scores; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, len(part), 512):
                piece = part.slice(low, 512)
                if model is None:
                    p = np.full(len(piece), 0.5)
                else:
                    p = np.clip(model.predict(vectors(piece.column(1)).astype(np.float32)), 0, 1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, score double")
