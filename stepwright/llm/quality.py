"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stash, table, texts_of

SAMPLE = 20_000  # positive and unlabelled rows that are fitted at most, of each: the bound of what reaches the driver, a few MB
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Bytes whose shares are features of their own; the rest fall in classes.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAMES = ("upper", "lower", "digit", "blank", "newline", "control", "high", *(f"mark_{chr(c)}" for c in MARKS), "log_words", "word_bytes", "distinct_words", "distinct_lines", "line_words", "caps_words", "marked_words")

_CLASSES = np.zeros((256, 7 + len(MARKS)), np.float64)
for _c in range(256):
    _k = 0 if 65 <= _c <= 90 else 1 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 3 if _c == 32 else 4 if _c == 10 else 5 if _c < 32 or _c == 127 else 6 if _c > 127 else 7 + MARKS.index(_c)
    _CLASSES[_c, _k] = 1
_LETTER_MARKS = bytes(c for c in MARKS if c not in b".,'-")


def features(data: bytes) -> np.ndarray:
    """Shares of byte classes and marks, and shape of words and lines, of a whole text. Zeros if it is empty."""
    out = np.zeros(len(NAMES))
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ _CLASSES / len(data)
    out[: len(shares)] = np.sqrt(shares)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    if words:
        out[len(shares) :] = (
            np.log1p(len(words)) / 10,
            min(len(data) / len(words), 40) / 10,
            len(set(words)) / len(words),
            len(set(lines)) / len(lines),
            min(len(words) / len(lines), 400) / 100,
            sum(map(bytes.isupper, words)) / len(words),
            sum(1 for w in words if w[-1] in _LETTER_MARKS) / len(words),
        )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def mapped(docs: DataFrame, columns: list[str], name: str, kind: T.DataType, of_features) -> DataFrame:
    """The given columns of docs and `name`: what of_features makes of the (n, features) array of a batch of whole texts."""
    small_batches(docs.sparkSession)
    kept = docs.select(*columns, F.col("text").cast("string").alias("text"))

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(d) for d in texts_of(batch)], np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), of_features(x)], [*columns, name])

    return kept.mapInArrow(of, kept.drop("text").schema.add(name, kind))


def featured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of docs and `features`, of whole texts."""

    def lists(x: np.ndarray):
        import pyarrow as pa

        return pa.array(list(x), pa.list_(pa.float32()))

    return mapped(docs, columns, "features", T.ArrayType(T.FloatType()), lists)


def fold(doc_id: Column, salt: str = "") -> Column:
    return F.pmod(F.crc32(F.concat(F.lit(salt), doc_id.cast("string")).cast("binary")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    """Null ids have no remainder: they are not held out, and are never fitted."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R+(positives), R-(unlabelled) - prior * R-(positives)) of raw scores, logistic loss."""
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The step's direction at w and the negative part of the risk.

    It descends the whole risk; where the negative part is below zero, it ascends that part alone (Kiryo et al. 2017).
    """
    zp, zu = p @ w, u @ w
    _, negative = risks(zp, zu, prior)
    up = (p * (sigmoid(zp) - 1)[:, None]).mean(0) * prior
    down = (u * sigmoid(zu)[:, None]).mean(0) - prior * (p * sigmoid(zp)[:, None]).mean(0)
    return (up + down if negative >= 0 else -down), negative


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.02, decay: float = 1e-4, watch: tuple[int, ...] = ()) -> Model | dict[int, Model]:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) over a linear model.

    Logistic loss, full-batch Adam over `gradient`. Deterministic. With `watch`, the models after those many rounds.
    """
    everything = np.concatenate([positive, unlabelled])
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    p = np.c_[np.clip((positive - mean) / scale, -8, 8), np.ones(len(positive))]
    u = np.c_[np.clip((unlabelled - mean) / scale, -8, 8), np.ones(len(unlabelled))]
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    seen = {}
    for t in range(1, max((rounds, *watch)) + 1):
        g = gradient(w, p, u, prior)[0] + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t in watch:
            seen[t] = Model(mean, scale, w.copy(), prior)
    return seen if watch else Model(mean, scale, w, prior)


#: Numbers of rounds among which a part of the training rows, set aside, decides.
ROUNDS = (250, 500, 1000, 1500)


def rounds_by_risk(positive: np.ndarray, unlabelled: np.ndarray, aside_p: np.ndarray, aside_u: np.ndarray, prior: float) -> int:
    """The number of rounds whose model has the least non-negative risk on the rows set aside; no label but the positives' is read."""
    models = fit_pu(positive, unlabelled, prior, rounds=max(ROUNDS), watch=ROUNDS)

    def risk(model: Model) -> float:
        up, down = risks(model.raw(aside_p), model.raw(aside_u), prior)
        return up + max(0.0, down)

    return min(ROUNDS, key=lambda t: (round(risk(models[t]), 9), t))


def share_of_positives(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The class prior: what share of the unlabelled text scores like the positives.

    A model is fitted to tell positives from unlabelled text. Above any score there are at least prior times
    as many of the unlabelled as of the positives, so the prior is their ratio at the score where its upper
    confidence bound is least (best bin estimation, Garg et al. 2021). No negative label is read.
    """
    told = fit_pu(positive, np.concatenate([positive, unlabelled]), len(positive) / (len(positive) + len(unlabelled)), rounds=500)
    p, u = np.sort(told.score(positive)), np.sort(told.score(unlabelled))
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    at = int(((above_u + slack) / above_p).argmin())
    return min(max(float(above_u[at] / above_p[at]), 0.02), 0.98)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows outside the held-out fold: trusted positives and unlabelled text, `sample` of each at most, in hash order.

    Trusted positives are rows of quality 1. The unlabelled text is a hash sample of all rows, whatever
    their label; the class prior is estimated from scores on it. Negative labels are not read, null ids are
    not fitted. Without positives every score is 1.
    """
    positives = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("__quality")).where("__quality = 1").select(F.col("doc_id").alias("__good_id"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), order.alias("__order")).distinct()
    unlabelled = ids.orderBy("__order").limit(sample).select("*", F.lit(False).alias("__good"))
    good = ids.join(positives, F.col("__id") == F.col("__good_id"), "left_semi").orderBy("__order").limit(sample).select("*", F.lit(True).alias("__good"))
    chosen = stash(unlabelled.union(good).withColumn("__aside", fold(F.col("__id"), "aside:") == 0))
    few = F.broadcast(chosen.select("__id").distinct())  # 2 * sample ids at most
    narrow = featured(docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("__id"), "left_semi"), ["doc_id"])
    rows = narrow.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    got = rows.select("features", "__good", "__aside", "__order").orderBy("__order", "features", "__good").limit(2 * sample).toPandas()
    if not len(got) or not got["__good"].any():
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.r_[np.zeros(len(NAMES)), 40.0], 1.0)
    x, good, aside = np.stack(got["features"].to_numpy()).astype(np.float64), got["__good"].to_numpy(bool), got["__aside"].to_numpy(bool)
    prior = share_of_positives(x[good], x[~good])
    parts = [x[g & a] for a in (~aside, aside) for g in (good, ~good)]
    rounds = rounds_by_risk(*parts, prior) if all(map(len, parts)) else max(ROUNDS)
    return fit_pu(x[good], x[~good], prior, rounds)


def scores(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of docs and the score, 0 to 1, of every whole text."""

    def scored(x: np.ndarray):
        import pyarrow as pa

        return pa.array(model.score(x.astype(np.float64)), pa.float64())

    return mapped(docs, columns, name, T.DoubleType(), scored)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality.

    Only the text is scored: no label, language, source or id. Null and empty texts get the score of a
    text without any feature; a very long text is scored whole. Repeated rows are scored alike. A null doc_id is scored, not
    fitted and not held out. An empty table gives an empty one; extra columns are ignored.
    """
    out = scores(docs.select("doc_id", "text"), fit(docs, labels, sample), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without those whose score is below the threshold; docs' own columns. Rows as in classify."""
    model = fit(docs, labels, sample)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([features((t or "").encode()) for t in texts], np.float32).reshape(-1, len(NAMES))
        return pd.Series(model.score(x.astype(np.float64)), dtype="float64")

    return docs.where(score(F.col("text").cast("string")) >= threshold)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
