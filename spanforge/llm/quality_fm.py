"""Quality classifier: a factorisation machine over words, structure and metadata.

A document is a sparse vector: hashed words (weight: square root of the word's share),
structure statistics (shares of capitals, digits, marks, repeated lines and so on,
standardised) and metadata (the stated length and whether it holds). The machine scores
it as ``w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, the
sum-of-squares form of all pairwise interactions, in time linear in the entries of x.

Labels, language, source and doc_id are never inputs. Training takes at most
``TRAIN_ROWS`` labelled rows, chosen by a hash of their id from those outside the
held-out fold; the model has a fixed size. Scoring is one pass without a shuffle.

Defined results: a null text is an empty text, and empty texts are scored from their
statistics; a null ``n_chars`` counts as "not stated". Labels that are null or repeated
(the least one counts) do no harm. Without labelled rows, or with one class only, every
score is the smoothed share of label 1. Rows are kept one for one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import WORD, arrow_batches

#: Most labelled rows that training takes; more don't change the separation measured.
TRAIN_ROWS = 4000
BUCKETS = 1 << 14
FACTORS = 6
EPOCHS = 14
HELD_OUT_REMAINDER = 2
THRESHOLD = 0.7
_WORDS = re.compile(WORD).findall
_STATS = (
    "log_words mean_word capitals digits marks symbols bangs commas high_bytes lines_per_word repeated_lines "
    "distinct_words short_words long_words pipes empty stated length_holds log_stated"
).split()


def structure(text: str, words: list[str], distinct: int, n_chars: int | None) -> list[float]:
    """Structure statistics and metadata of one text, in the order of ``_STATS``."""
    raw = text.encode("utf-8", "replace")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    size, n = max(len(raw), 1), len(words)
    letters = max(int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    count = lambda chars: int(h[list(chars.encode())].sum())
    return [
        math.log1p(n),
        math.log1p(sum(lengths) / max(n, 1)),
        int(h[65:91].sum()) / letters,
        int(h[48:58].sum()) / size,
        (int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum())) / size,
        math.sqrt(count("#*$%&|<>") / size),
        math.sqrt(count("!") / size),
        count(".,") / max(n, 1),
        int(h[128:].sum()) / size,
        len(lines) / max(n, 1),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        distinct / max(n, 1),
        sum(x <= 3 for x in lengths) / max(n, 1),
        sum(x > 20 for x in lengths) / max(n, 1),
        count("|") / max(n, 1),
        float(not n),
        float(n_chars is not None),
        float(n_chars is not None and n_chars == len(text)),
        math.log1p(max(n_chars or 0, 0)),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of the words and their weights (unit length), and the statistics."""
    text = text or ""
    words = _WORDS(text)
    counts = Counter(words)
    buckets = np.fromiter((crc32(w.encode("utf-8", "replace")) for w in counts), np.int64, len(counts)) % BUCKETS
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(len(words), 1))
    return buckets, weights.astype(np.float32), structure(text, words, len(counts), n_chars)


@dataclass
class FactorisationMachine:
    """A fixed-size model: BUCKETS word columns, then one for each statistic."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32) * np.float32(0.3)

    def logit(self, buckets: np.ndarray, weights: np.ndarray, stats: list[float]) -> float:
        d = self.dense(np.asarray(stats))
        index = np.concatenate([buckets, BUCKETS + np.arange(len(d))])
        x = np.concatenate([weights, d])
        v = self.factors[index] * x[:, None]
        pairs = float((v.sum(0) ** 2).sum() - (v * v).sum()) / 2
        return self.bias + float(self.linear[index] @ x) + pairs

    def score(self, text: str | None, n_chars: int | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(*features(text, n_chars))))))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float], int]], seed: int = 7) -> FactorisationMachine:
    """Fit by Adagrad over mini-batches of the logistic loss; deterministic for the same rows."""
    wide = BUCKETS + len(_STATS)
    positive = sum(y for *_, y in rows)
    prior = math.log((positive + 1) / (len(rows) - positive + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(wide, np.float32), (rng.standard_normal((wide, FACTORS)) * 0.05).astype(np.float32)
    if not rows or positive in (0, len(rows)):
        return FactorisationMachine(prior, w, np.zeros_like(v), np.zeros(len(_STATS)), np.ones(len(_STATS)))
    stats = np.array([s for _, _, s, _ in rows])
    model = FactorisationMachine(prior, w, v, stats.mean(0), stats.std(0) + 1e-6)
    dense = model.dense(stats)
    own = np.arange(BUCKETS, wide)
    index = [np.concatenate([b, own]) for b, *_ in rows]
    value = [np.concatenate([x, d]) for (_, x, _, _), d in zip(rows, dense, strict=True)]
    y = np.array([k for *_, k in rows], np.float32)
    gw, gv, gb = np.full(wide, 1e-2, np.float32), np.full((wide, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), 64):
            batch = order[k : k + 64]
            sizes = np.array([len(index[i]) for i in batch])
            i, x = np.concatenate([index[j] for j in batch]), np.concatenate([value[j] for j in batch])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = model.factors[i] * x[:, None]
            total = np.add.reduceat(vx, at)
            z = model.bias + np.add.reduceat(model.linear[i] * x, at) + ((total**2).sum(1) - np.add.reduceat((vx * vx).sum(1), at)) / 2
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            e = np.repeat((p - y[batch]) / len(batch), sizes).astype(np.float32)
            columns, inverse = np.unique(i, return_inverse=True)
            dw = np.bincount(inverse, e * x, len(columns)).astype(np.float32) + 1e-4 * model.linear[columns]
            each = (e * x)[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(inverse, each[:, f], len(columns)) for f in range(FACTORS)], 1).astype(np.float32) + 1e-3 * model.factors[columns]
            db = float(((p - y[batch]) / len(batch)).sum())
            gw[columns] += dw * dw
            gv[columns] += dv * dv
            gb += db * db
            model.linear[columns] -= 0.3 * dw / np.sqrt(gw[columns])
            model.factors[columns] -= 0.05 * dv / np.sqrt(gv[columns])
            model.bias -= 0.1 * db / math.sqrt(gb)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that training never sees; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, list[float], int]]:
    """At most ``most`` labelled rows, as features; the choice depends on ids alone."""
    arrow_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    # `chosen` has at most `most` rows of two numbers: safe to broadcast at any scale.
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "y", "d.text", "d.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, n) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([x.astype("<u2").tobytes() for x, _, _ in found], pa.binary()), pa.array([x.tobytes() for _, x, _ in found], pa.binary()), pa.array([x for _, _, x in found], pa.list_(pa.float64()))],
                ["doc_id", "y", "buckets", "weights", "stats"],
            )

    rows = picked.mapInArrow(run, "doc_id long, y int, buckets binary, weights binary, stats array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["weights"], np.float32), r["stats"], r["y"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> FactorisationMachine:
    return train(training_rows(docs, labels, most))


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted`` for every row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t, n) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows predicted 1, with every column they had."""
    arrow_batches(docs.sparkSession)
    at_text, at_n = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [model.score(t, n) >= THRESHOLD for t, n in zip(b.column(at_text).to_pylist(), b.column(at_n).to_pylist(), strict=True)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
