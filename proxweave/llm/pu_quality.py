"""Text quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

CLASSES = np.full(256, 9, dtype=np.int64)  # of bytes; 9: other control and the rest
CLASSES[97:123] = 0
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[[9, 11, 12, 13, 32]] = 3
CLASSES[10] = 4
CLASSES[[ord(c) for c in ".,;:'\"()-?"]] = 5
CLASSES[[ord(c) for c in "#*$%&@^~_=+<>{}[]/\\`"]] = 6
CLASSES[ord("!")] = 7
CLASSES[ord("|")] = 8
CLASSES[128:] = 10
N_CLASSES = 11
N_FEATURES = N_CLASSES + 11
BINS = 1000


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes, word shapes and repetition; bounded values, zeros for a text without words."""
    text = text or b""
    words = text.split()
    n = len(words)
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not n:
        return out
    share = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=N_CLASSES) / len(text)
    out[:N_CLASSES] = np.sqrt(share)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = [len(w) for w in counts]
    out[N_CLASSES:] = (
        min(sum(map(len, words)) / n, 30) / 10,
        min(max(sizes), 60) / 60,
        np.log1p(len(counts)) / np.log1p(n),
        len(counts) / n,
        pairs / max(n - 1, 1),
        sum(map(eq, words, words[1:])) / max(n - 1, 1),
        max(counts.values()) / n,
        len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / n,
        sum(w[:1].isupper() for w in words) / n,
        min(np.log1p(n) / 12, 1.5),
    )
    return out


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from histograms of a positive-unlabelled score (ascending bins).

    For every cut the share of unlabelled above it over that of positives above it bounds the prior from
    above; the cut with the least upper confidence limit is taken.
    """
    n_p, n_u = max(pos.sum(), 1), max(unl.sum(), 1)
    q_p, q_u = np.cumsum(pos[::-1]) / n_p, np.cumsum(unl[::-1]) / n_u
    ok = q_p > 0.01
    if not ok.any():
        return 0.5
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    limit = np.where(ok, (q_u + slack) / np.maximum(q_p, 1e-12), np.inf)
    best = int(np.argmin(limit))
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


@dataclass
class Model:
    """A linear score on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Risk:
    """Sums over rows from which a risk, its gradient and its Hessian follow; sums of parts add up.

    ``x`` are standardised features with a one, ``pos`` marks trusted positives. All rows are the
    unlabelled text.
    """

    def __init__(self, size: int):
        self.size = size
        self.cells = 5 + 3 * size + 2 * size * size

    def sums(self, x: np.ndarray, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = x @ w
        on = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        bend = on * (1 - on)
        xp, zp, onp = x[pos], z[pos], on[pos]
        head = [len(x), len(xp), softplus(z).sum(), softplus(zp).sum(), softplus(-zp).sum()]
        return np.concatenate([head, x.T @ on, xp.T @ onp, xp.sum(0), ((x.T * bend) @ x).ravel(), ((xp.T * bend[pos]) @ xp).ravel()])

    def at(self, total: np.ndarray, w: np.ndarray, prior: float | None, l2: float):
        """``(risk, negative part, gradient, Hessian)`` at ``w``.

        With a prior: ``prior * E_p[l(f)] + (E_u[l(-f)] - prior * E_p[l(-f)])`` for the logistic loss ``l``; its
        second part is the negatives' risk. Without: positives against unlabelled, ``E_p[l(f)] + E_u[l(-f)]``.
        """
        d = self.size
        n, m = total[0], max(total[1], 1)
        lu, lp0, lp1 = total[2] / n, total[3] / m, total[4] / m
        gu, gp, mean = total[5 : 5 + d] / n, total[5 + d : 5 + 2 * d] / m, total[5 + 2 * d : 5 + 3 * d] / m
        hu, hp = total[5 + 3 * d :].reshape(2, d, d)
        decay = np.append(np.full(d - 1, l2), 0)
        if prior is None:
            risk, part, g, h = lp1 + lu, lu, gp - mean + gu, hp / m + hu / n
        else:
            part = lu - prior * lp0
            risk, g, h = prior * lp1 + part, gu - prior * mean, hu / n
        return risk + decay @ (w * w) / 2, part, g + decay * w, h + np.diag(decay + 1e-9)


def minimise(total_at, risk: Risk, prior: float | None, *, l2: float = 1e-3, steps: int = 30, tolerance: float = 1e-4) -> np.ndarray:
    """Weights of the least non-negative risk by Newton steps; ``total_at(w)`` gives the sums over all rows.

    For this loss the unbiased risk is convex. A step that would raise it is halved. One that would make
    the negatives' part of it negative fits the positives as negatives; it is shortened to where that
    part is about zero, and the descent ends there, as the non-negative estimator holds it.
    """
    w = np.zeros(risk.size)
    value, part, g, h = risk.at(total_at(w), w, prior, l2)
    move = -np.linalg.solve(h, g)
    for _ in range(steps):
        new, rest, g, h = risk.at(total_at(w + move), w + move, prior, l2)
        if rest < 0:
            if part < 0.002:
                break
            move = move * max(0.1, 0.95 * part / (part - rest))
        elif new > value + 1e-12:
            move = move / 2
        else:
            w, value, part, move = w + move, new, rest, -np.linalg.solve(h, g)
        if np.abs(move).max() < tolerance:
            break
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def total_over(df: DataFrame, cells: int, of) -> np.ndarray:
    """The sum over all rows ``(x, pos)`` of ``cells`` numbers; ``of(x, pos)`` gives those of a batch. No row is collected."""

    def run(batches):
        total = np.zeros(cells)
        for b in batches:
            total += of(_matrix(b.column(0)).astype(np.float64), b.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    rows = df.select("x", "pos").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(cells)
    out[rows.column("cell").to_numpy()] = rows.column("v").to_numpy()
    return out


def fit(df: DataFrame) -> tuple[Model, float]:
    """A model and the class prior from ``(x, pos)`` rows, in some twenty passes over them.

    Means and scales, the first classifier, the histograms of its score and the risk take all rows,
    positives and unlabelled alike.
    """
    d = N_FEATURES
    moments = total_over(df, 2 + 2 * d, lambda x, pos: np.concatenate([[len(x), pos.sum()], x.sum(0), (x * x).sum(0)]))
    n, known = moments[:2]
    if not n or not known:
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0), 0.5
    mean = moments[2 : 2 + d] / n
    scale = np.maximum(np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0)), 1e-3)
    risk = Risk(d + 1)

    def total_at(w: np.ndarray) -> np.ndarray:
        one = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        return total_over(df, risk.cells, lambda x, pos: risk.sums(one(x), pos, w))

    first = minimise(total_at, risk, None)
    model = Model(mean, scale, first[:-1], float(first[-1]))

    def bins(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
        at = np.minimum((model.score(x) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at[pos], minlength=BINS), np.bincount(at, minlength=BINS)])

    prior = class_prior(*total_over(df, 2 * BINS, bins).reshape(2, BINS))
    w = minimise(total_at, risk, prior)
    return Model(mean, scale, w[:-1], float(w[-1])), prior


def pu_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    trainable: Column | None = None,
    threshold: float = 0.3,
) -> DataFrame:
    """``(id, th, score, predicted, prior)``, one row for each input row; ``th`` is a hash of the text.

    Trusted positives are ids all of whose labels are 1, among rows of ``labels`` where ``trainable``
    holds. All documents are the unlabelled text. A classifier of positives against unlabelled is fitted;
    its score histograms over all positives and all documents give the class prior; then the
    non-negative risk is minimised. Every row takes part in every sum, with its whole text; only sums
    reach the driver.

    A null text counts as empty, and so does one without words: it gets the model's score for zero
    features. Without trusted positives, or documents, every score is 0.5. Null ids or labels are no
    labels. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """

    def extract(batches):
        for b in batches:
            x = np.concatenate([features(t.as_py()) for t in b.column(2)]) if b.num_rows else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * N_FEATURES, pa.array(x, pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "th", "x"])

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    known = labels.where(F.lit(True) if trainable is None else trainable)
    good = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("least")).where("least = 1").select("id", F.lit(True).alias("pos"))
    vectors = src.mapInArrow(extract, f"id {kind}, th long, x array<float>").join(broadcast_if_small(good), "id", "left")
    vectors = materialize(vectors.withColumn("pos", F.coalesce("pos", F.lit(False))), "features")
    model, prior = fit(vectors)

    def score(batches):
        for b in batches:
            s = np.round(model.score(_matrix(b.column(2))), 9)  # sums vary in their last digits
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["id", "th", "score"])

    scored = vectors.select("id", "th", "x").mapInArrow(score, f"id {kind}, th long, score double")
    return scored.select(
        F.col("id").alias(id_col), "th", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.lit(prior).alias("prior")
    )
