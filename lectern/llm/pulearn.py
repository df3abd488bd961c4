"""A quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text (no label at all) are all it learns from; label 0 is never used. With
class prior pi, loss l and a linear score g it minimises the non-negative unbiased risk

    pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)])

where the second term, once negative, is climbed back up instead of being minimised. The prior is estimated from the two
sets alone: a positive-versus-unlabelled score is fitted on one half, and on the other half the least ratio of
unlabelled to positive shares above a threshold, with a confidence margin, bounds the share of positives.

Bounded sample: at most `max_positive` and `max_unlabelled` ids of the learning folds, those with the least hash; one feature
row of each (at most 30,000 by default) comes to the driver. Labels are joined as narrow rows. Scoring is one
projection over all documents.

Defined results: null and empty texts get a score from all-zero features; very long texts count whole; repeated rows get equal
scores; an id that stands in several rows is learnt from once, with the least of its feature rows; documents whose label rows disagree or are null count as neither set; without positives or without unlabelled text
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_fold, least_hashes

N_FEATURES = 256 + 12
SYMBOLS = b"#*$%&|<>{}[]\\^~_=@"
ENDS = (b".", b"!", b"?", b":", b";", b'"', b")", "…".encode(), "”".encode(), "»".encode())


@dataclass(frozen=True)
class PuConfig:
    max_positive: int = 10_000
    max_unlabelled: int = 20_000
    threshold: float = 0.7
    steps: int = 1500
    rate: float = 0.02
    ridge: float = 1e-4
    #: Scaled features are cut at this size.
    cut: float = 6.0


def features(text: str | None) -> np.ndarray:
    """Square roots of byte shares, then shares of capitals, symbols, repeated words, windows and lines, and sizes."""
    out = np.zeros(N_FEATURES, np.float32)
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / len(data))
    size = max(1, len(data) - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = max(1, n - 2)
    shouted = sum(map(bytes.isupper, words))
    out[256:] = (
        counts[65:91].sum() / size,
        np.sqrt(sum(int(counts[b]) for b in SYMBOLS) / size),
        counts[48:58].sum() / size,
        shouted / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 0,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        sum(x.rstrip().endswith(ENDS) for x in lines) / len(lines),
        np.log1p(n) / 10,
        size / n / 10,
        np.log1p(n / len(lines)) / 10,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class PuModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return _sigmoid(self.scaled(x) @ self.weights[:-1] + self.weights[-1])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -self.cut, self.cut)


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, config: PuConfig) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative unbiased risk with the logistic loss."""
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (p, u))

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        against_u, against_p = np.logaddexp(0, gu).mean(), np.logaddexp(0, gp).mean()
        negative = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        ridge = config.ridge * np.append(w[:-1], 0)
        if against_u - prior * against_p < 0:
            return -negative + ridge
        return negative - prior * (p.T @ _sigmoid(-gp)) / len(p) + ridge

    return _adam(gradient, p.shape[1], config.steps, config.rate)


def estimate_prior(p: np.ndarray, u: np.ndarray, config: PuConfig) -> float:
    """Share of positives in u: fit positive against unlabelled on even rows, bound the ratio of tails on odd rows."""
    fit_p, fit_u = (np.hstack([x[::2], np.ones((len(x[::2]), 1), x.dtype)]) for x in (p, u))

    def gradient(w: np.ndarray) -> np.ndarray:
        return fit_u.T @ _sigmoid(fit_u @ w) / len(fit_u) - fit_p.T @ _sigmoid(-(fit_p @ w)) / len(fit_p) + config.ridge * np.append(w[:-1], 0)

    w = _adam(gradient, fit_p.shape[1], min(config.steps, 500), config.rate)
    own_p, own_u = (np.sort(x[1::2] @ w[:-1]) for x in (p, u))
    if not len(own_p) or not len(own_u):
        return 0.5
    cuts = np.quantile(own_p, np.linspace(0.0, 0.95, 96))
    share_p, share_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (own_p, own_u))
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(own_u)) + 1 / np.sqrt(len(own_p)))
    best = int(np.argmin((share_u + margin) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray, config: PuConfig = PuConfig(), prior: float | None = None) -> PuModel:
    if not len(p) or not len(u):
        return PuModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(0), 0.5, config.cut)
    # the spread among positives is the yardstick: what they never do stands out
    centre, scale = p.mean(axis=0), p.std(axis=0) + 0.02
    bare = PuModel(centre, scale, np.zeros(1), 0.5, config.cut)
    sp, su = bare.scaled(p), bare.scaled(u)
    prior = estimate_prior(sp, su, config) if prior is None else prior
    return PuModel(centre, scale, non_negative_risk(sp, su, prior, config), prior, config.cut)


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "positive", "x"])


def learn(docs: DataFrame, labels: DataFrame, learn_from, config: PuConfig = PuConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PuModel:
    """A model from the rows of docs for which the column learn_from(id) is true."""
    judged = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("least"), F.max(label_col).alias("most"), F.lit(True).alias("judged"))
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & learn_from(F.col("id"))).distinct()
    ids = ids.join(judged, "id", "left")
    positive = ids.where((F.col("least") == 1) & (F.col("most") == 1)).select("id", F.lit(True).alias("positive"))
    unlabelled = ids.where(F.col("judged").isNull()).select("id", F.lit(False).alias("positive"))
    # at most max_positive + max_unlabelled narrow rows, each id once
    chosen = least_hashes(positive, "positive", config.max_positive).unionByName(least_hashes(unlabelled, "positive", config.max_unlabelled))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "positive", "text").mapInArrow(_feature_rows, f"id {kind}, positive boolean, x binary")
    rows = rows.groupBy("id", "positive").agg(F.min("x").alias("x")).select("positive", "x").toArrow()
    x = np.frombuffer(b"".join(r.as_py() for c in rows.column("x").chunks for r in c), np.float32).reshape(-1, N_FEATURES)
    is_p = np.array(rows.column("positive").to_pylist(), bool)
    # a fixed order, so that the fit doesn't depend on how rows arrived
    order = np.lexsort(x.T[::-1]) if len(x) else np.zeros(0, int)
    x, is_p = x[order].astype(np.float64), is_p[order]
    shuffled = np.random.default_rng(7).permutation(len(x))
    x, is_p = x[shuffled], is_p[shuffled]
    return fit(x[is_p], x[~is_p], config)


def score_documents(docs: DataFrame, model: PuModel, held_out, config: PuConfig = PuConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array([features(t.as_py()) for t in batch.column(2)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= config.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, config: PuConfig = PuConfig()) -> DataFrame:
    """Scores of all documents by a model that never saw the labels of the held-out fold."""
    held = lambda i: id_fold(i, 4) == 2
    return score_documents(docs, learn(docs, labels, lambda i: ~held(i), config), held, config)
