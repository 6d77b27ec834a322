"""Quality classifier (operator 2) by positive-unlabelled learning.

Trusted positives (``quality`` 1) and unlabelled web text train a linear scorer
by the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` under the logistic loss.
Rows labelled 0 are never learned from. The class prior is estimated first: for
every region A that a positive-against-unlabelled scorer cuts out,
``U(A) >= prior * P(A)``, so the least ratio ``U(A) / P(A)`` over held-apart rows
bounds it.

A text's features come from the whole text: pairs of byte classes, its size and
how well it compresses, and how often words, word pairs and triples return.
Ids, labels, language and source are never features.

Fitting uses a bounded sample, ``FIT_ROWS`` positives and as many unlabelled
rows, first in hash order of the id; scoring covers every row.

Edge cases: null texts count as empty and get a score like any other; rows with
a null id are scored and never learned from; without positives or without
unlabelled rows every score is 0.5; an id labelled several times is positive if
any of its labels is 1; repeated rows get equal scores; empty tables give empty
results; further columns of the input, also of clashing names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Isolated, fold

FIT_ROWS = 4000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
STEPS = 1000
RATE = 0.05
RIDGE = 1e-4

#: Byte classes by what the bytes are used for; those in no group are the last class.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!", b"|",
          b"#*$%&<>", b"'\"`", b"()[]{}", b":;?", b"-_/\\=+~^@", bytes(range(128, 192)), bytes(range(192, 256)))
CLASSES = len(GROUPS) + 1
CLASS_OF = np.full(256, len(GROUPS), np.int64)
for _k, _group in enumerate(GROUPS):
    CLASS_OF[list(_group)] = _k
DENSE = 7
WIDTH = CLASSES * CLASSES + DENSE


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    kinds = CLASS_OF[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / len(raw))
    ws = raw.lower().split()
    n = max(1, len(ws))
    triples = max(1, len(ws) - 2)
    out[CLASSES * CLASSES:] = (
        np.log1p(len(raw)) / 10,
        min(1.0, len(zlib.compress(raw, 1)) / (len(raw) + 16)),
        len(set(ws)) / n,
        sum(map(eq, ws, ws[1:])) / n,
        len(set(zip(ws, ws[1:], ws[2:]))) / triples if len(ws) > 2 else 1,
        len(raw) / n / 20,
        1.0,
    )
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; where the bracket is negative its own gradient is climbed."""
    w, m, v = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(3))
    p1, u1 = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))
    for t in range(1, STEPS + 1):
        zp, zu = p1 @ w, u1 @ w
        gain = -p1.T @ _sigmoid(-zp) * (prior / len(p1))
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = u1.T @ _sigmoid(zu) / len(u1) - p1.T @ _sigmoid(zp) * (prior / len(p1))
        g = gain + down if bracket >= 0 else -down
        g[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The least ``U(A) / P(A)`` over the regions of a cross-fitted scorer that hold at least half of the positives."""
    ratios = []
    for half in (0, 1):
        w, b = minimise(p[half::2], u[half::2], 0.5)
        sp, su = np.sort(p[1 - half::2] @ w + b), np.sort(u[1 - half::2] @ w + b)
        cuts = np.quantile(sp, np.linspace(0, 0.5, 101))
        above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
        above_u = 1 - np.searchsorted(su, cuts) / len(su)
        slack = np.sqrt(above_u * (1 - above_u) / len(su)) + np.sqrt(above_p * (1 - above_p) / len(sp))
        ratios.append(float(((above_u + slack) / above_p).min()))
    return min(0.99, max(0.01, sum(ratios) / len(ratios)))


def fit(p: np.ndarray, u: np.ndarray) -> Model | None:
    if len(p) < 4 or len(u) < 4:
        return None
    both = np.vstack([p, u])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-2)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (p, u))
    prior = estimate_prior(p, u)
    weights, bias = minimise(p, u, prior)
    return Model(mean.astype(np.float32), scale.astype(np.float32), weights.astype(np.float32), bias, prior)


def scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = np.empty(len(texts))
    for at in range(0, len(texts), 512):  # bounded feature blocks
        x = np.stack([features(t) for t in texts[at:at + 512]])
        out[at:at + 512] = _sigmoid(np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights + model.bias)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on the bounded sample; ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``."""
    spark = docs.sparkSession
    learnable = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ids = docs.select("doc_id").where(learnable)
    marked = labels.select("doc_id", "quality").where(learnable)
    sure = marked.where("quality = 1").select("doc_id").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen_p = {r[0] for r in ids.join(sure, "doc_id", "left_semi").distinct().orderBy(*order).limit(FIT_ROWS).collect()}
    chosen_u = {r[0] for r in ids.join(marked, "doc_id", "left_anti").distinct().orderBy(*order).limit(FIT_ROWS).collect()}
    if not chosen_p or not chosen_u:
        return None
    texts = docs.where(F.col("doc_id").isin(sorted(chosen_p | chosen_u))).select("doc_id", "text")
    schema = "doc_id long, x binary"

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    rows = texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(featured, schema).collect()
    rows = sorted((r["doc_id"], bytes(r["x"])) for r in rows)

    def matrix(of: set) -> np.ndarray:
        own = [np.frombuffer(x, np.float32) for i, x in rows if i in of]
        return np.stack(own) if own else np.zeros((0, WIDTH), np.float32)

    return fit(matrix(chosen_p), matrix(chosen_u))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    box, marks = Isolated(docs), Isolated(labels)
    inner = box.df.select(box["doc_id"].alias("doc_id"), box["text"].alias("text"))
    model = train(inner, marks.df.select(marks["doc_id"].alias("doc_id"), marks["quality"].alias("quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    found = inner.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
