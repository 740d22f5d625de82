"""Language identification with error-correcting output codes.

Every language has a codeword of plus and minus ones. One binary classifier per bit (logistic regression on hashed byte n-grams)
says on which side a text lies; the language whose codeword has the smallest weighted logistic loss wins. A bit weighs for a
language as much as the classifier gets that language's calibration rows right. Where two codewords are nearly equally close,
the document is flagged as ambiguous.

The classifiers are fitted on a bounded sample of the labelled rows. Scoring is one pass over the whole texts, in Arrow batches,
without a shuffle; the model is a few hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.ngrams import hashed_counts, hellinger, sampled, texts_of

BUCKETS = 4096
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
AMBIGUOUS_BELOW = 0.6


@dataclass
class CodeModel:
    """``codes`` and ``weights`` are languages x bits, ``w`` is (buckets + 1) x bits with the bias last."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    w: np.ndarray
    temperature: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every row against every codeword."""
        margins = x @ self.w[:-1] + self.w[-1]
        return np.einsum("kb,nkb->nk", self.weights, np.logaddexp(0, -self.codes[None] * margins[:, None, :]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language and the share it gets when distances are turned into probabilities."""
        loss = self.losses(x)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.temperature)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``k`` languages: all splits into two sides up to six languages, else the best of random codes."""
    if k <= 6:
        first = [s for r in range(k) for s in combinations(range(1, k), r)]
        sides = [[1 if i == 0 or i in s else -1 for i in range(k)] for s in first if len(s) < k - 1]
        return np.array(sides, np.float32).T.reshape(k, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, distance = None, -1
    for _ in range(300):
        codes = rng.choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        apart = min(int((codes[i] != codes[j]).sum()) for i in range(k) for j in range(i))
        if apart > distance and (np.abs(codes.sum(0)) < k).all():
            best, distance = codes, apart
    return best


def fit_bits(x: np.ndarray, targets: np.ndarray, rounds: int = 250, l2: float = 1e-4) -> np.ndarray:
    """Logistic regressions for all bits at once, by accelerated gradient steps."""
    n, d = x.shape
    w = np.zeros((d + 1, targets.shape[1]), np.float32)
    ahead, step = w.copy(), 2.0  # rows and bias have length one, so the curvature is at most a half
    for t in range(1, rounds + 1):
        margin = targets * (x @ ahead[:-1] + ahead[-1])
        pull = -targets / (1 + np.exp(margin)) / n
        new = ahead - step * (np.vstack([x.T @ pull, pull.sum(0)[None]]) + l2 * ahead)
        ahead = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def fit_codes(x: np.ndarray, labels: np.ndarray, languages: list[str]) -> CodeModel:
    """Bits on four fifths of the rows; bit weights and temperature on the rest."""
    codes = code_matrix(len(languages))
    calibration = np.arange(len(x)) % 5 == 4
    train = ~calibration if calibration.any() else np.ones(len(x), bool)
    check = calibration if calibration.any() else train
    w = fit_bits(x[train], codes[labels[train]])
    right = (np.sign(x[check] @ w[:-1] + w[-1]) == codes[labels[check]]).astype(np.float32)
    weights = np.ones_like(codes)
    for k in range(len(languages)):
        if (labels[check] == k).any():
            weights[k] = np.clip(2 * right[labels[check] == k].mean(0) - 1, 0.05, 1)
    weights /= weights.sum(1, keepdims=True)
    model = CodeModel(languages, codes, weights, w, 1.0)
    loss = model.losses(x[check])
    fit = [
        (float(np.mean(loss[np.arange(len(loss)), labels[check]] * t + np.log(np.exp(-loss * t).sum(1)))), t)
        for t in (0.5, 1, 2, 4, 8, 16)
    ]
    model.temperature = min(fit)[1]
    return model


def vectors(column: pa.Array) -> np.ndarray:
    rows = [hellinger(hashed_counts(text, ORDERS, BUCKETS)) for text in texts_of(column)]
    return np.stack(rows) if rows else np.zeros((0, BUCKETS), np.float32)


def train(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int = 4000,
) -> CodeModel | None:
    """Fit on about ``sample_rows`` rows, spread evenly over the languages; None without labelled text.

    The driver sees the sample's vectors (8 KB each) and nothing else.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       training.alias("training"))
    rows = rows.filter(F.col("training") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages, share = sorted(counts), sample_rows / len(counts)
    shares = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, share / counts[k]))) for k in languages])
    chosen = sampled(rows, "key", shares).select("u", "lang", F.lower("text").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [v.astype(np.float16).tobytes() for v in vectors(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["u", "lang", "x"])

    table = chosen.mapInArrow(batches, "u double, lang string, x binary").toArrow().sort_by([("u", "ascending"), ("lang", "ascending")])
    if not len(table):
        return None
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in table["x"]]).astype(np.float32)
    labels = np.array([languages.index(v) for v in table["lang"].to_pylist()])
    return fit_codes(x, labels, languages)


def identify(docs: DataFrame, model: CodeModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` for every whole text.

    Null text and text without a letter is ``und`` with score 0, as is everything without a model. With one language that
    language is certain. Equal distances go to the language that sorts first. Repeated rows get equal results, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _lettered(F.col(text_col)).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, len(part), 256):
                piece = part.slice(low, 256)
                lang, score = _decide(piece.column(1), model)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS_BELOW)],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def _lettered(text: Column) -> Column:
    """Lower-cased text, or null if it has no letter."""
    text = F.lower(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(r"\p{L}"), text)


def _decide(texts: pa.Array, model: CodeModel | None) -> tuple[np.ndarray, np.ndarray]:
    named = texts.is_valid().to_numpy(zero_copy_only=False)
    lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if model is not None and named.any():
        if len(model.languages) == 1:
            best, p = np.zeros(len(texts), int), np.ones(len(texts))
        else:
            best, p = model.predict(vectors(texts))
        lang = np.where(named, np.array(model.languages, object)[best], UNDETERMINED)
        score = np.where(named, np.clip(p, 0, 1), 0.0)
    return lang, score


def keep_identified(docs: DataFrame, model: CodeModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as they are whose language is recognised; without a model every row with a letter.

    Rejected are texts without a letter and those whose best language has less than one and a half times the share that
    chance would give it. A text in two languages is flagged as ambiguous by ``identify``, and stays. Rows travel through the batches whole, so nothing is joined back.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _lettered(F.col(f"`{text_col}`")).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, len(part), 256):
                piece = part.slice(low, 256)
                keep = piece.column(1).is_valid()
                if model is not None:
                    least = min(1.5 / len(model.languages), AMBIGUOUS_BELOW)
                    keep = pa.array(_decide(piece.column(1), model)[1] >= least)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(keep)], ["row"])

    return packed.mapInArrow(batches, T.StructType([packed.schema["row"]])).select("row.*")
