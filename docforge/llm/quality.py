"""Quality classifier: regularised quadratic discriminant analysis.

1. Statistics of the whole text (``FEATURES``), each transformed to be roughly
   Gaussian (logarithms of counts, arcsine roots of shares).
2. Training on at most ``SAMPLE`` labelled rows outside the held-out fold
   (those with the smallest id hashes), broadcast to the documents; their
   statistics, a few numbers a row, are what the driver gets.  Class
   covariances are shrunk towards the pooled covariance and its diagonal.
3. A score is the logistic of the difference of the two class log densities,
   from Mahalanobis distances by the cached Cholesky factors.  Scale and offset
   of the logistic are fitted on the same sample, so that 0.5 is the threshold.

Labels, language, source and id are no inputs of a score.  A null text counts
as empty; an empty text has the statistics of zero words and is scored like any
other.  If a class has no labelled row, every score is the share of label 1
(0.5 without any labels).
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, label_sample, labelled_rows

FOLDS, HELD_OUT = 3, 1
#: labelled rows fitted on at most
SAMPLE = 20_000
#: shrinkage of a class covariance to the pooled one, and of that to its diagonal
TO_POOLED, TO_DIAGONAL = 0.1, 0.05

FEATURES = ["words", "word_length", "upper", "symbol", "stop_mark", "other_mark", "digit",
            "distinct", "repeat", "distinct_pairs", "line_words", "repeat_lines", "short_words",
            "longest_word"]

_UPPER, _DIGIT, _STOP, _OTHER, _LETTER = (np.zeros(256, bool) for _ in range(5))
_UPPER[ord("A"):ord("Z") + 1] = True
_DIGIT[ord("0"):ord("9") + 1] = True
_STOP[[ord(c) for c in ".,;:'\"!?-()"]] = True
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_LETTER[128:] = True
_OTHER[33:127] = True
_OTHER &= ~(_DIGIT | _STOP | _LETTER)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    text = text or ""
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8),
                       minlength=256)
    words = text.split()
    n = len(words)
    w = max(1, n)
    sizes = [len(x) for x in words]
    marks = max(1, int(hist[33:].sum()))
    letters = max(1, int(hist[_LETTER].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: float(np.arcsin(np.sqrt(min(1.0, a / b))))
    return [
        np.log1p(n),
        np.log1p(sum(sizes) / w),
        share(int(hist[_UPPER].sum()), letters),
        share(int(hist[_OTHER].sum()), marks),
        share(int(hist[_STOP].sum()), marks),
        share(int(hist[[33, 63]].sum()), marks),
        share(int(hist[_DIGIT].sum()), marks),
        share(len(set(words)), w),
        share(sum(map(eq, words, words[1:])), w),
        share(len(set(zip(words, words[1:]))) + 1, w),
        np.log1p(n / max(1, len(lines))),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        share(sum(s <= 1 for s in sizes), w),
        np.log1p(max(sizes, default=0)),
    ]


class Discriminant:
    """Two shrunk Gaussian class densities and the logistic over their difference."""

    def __init__(self, moments: dict):
        """moments: class -> (rows, sum vector, scatter matrix about zero)."""
        rows = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
        total = rows[0] + rows[1]
        self.share = rows[1] / total if total else 0.5
        self.scale, self.offset, self.parts = 1.0, 0.0, None
        if not rows[0] or not rows[1]:
            return
        mean = {c: moments[c][1] / rows[c] for c in (0, 1)}
        own = {c: moments[c][2] / rows[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (rows[0] * own[0] + rows[1] * own[1]) / total
        self.centre = (moments[0][1] + moments[1][1]) / total
        spread = np.diag((moments[0][2] + moments[1][2]) / total) - self.centre ** 2
        self.spread = np.sqrt(np.maximum(spread, 1e-12))
        target = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(
            np.maximum(np.diag(pooled), 1e-4 * self.spread ** 2 + 1e-9))
        self.parts = []
        for c in (0, 1):
            # few rows of a class lean more on the pooled covariance
            keep = (1 - TO_POOLED) * rows[c] / (rows[c] + 2 * len(target))
            cov = keep * own[c] + (1 - keep) * target
            factor = np.linalg.cholesky(cov + np.diag(1e-3 * self.spread ** 2 + 1e-9))
            self.parts.append((mean[c], factor, np.log(np.diag(factor)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        # what lies far outside of the sample's range counts as its edge
        x = self.centre + np.clip(x - self.centre, -6 * self.spread, 6 * self.spread)
        density = [-0.5 * (_whiten(factor, (x - mean).T) ** 2).sum(0) - logdet
                   for mean, factor, logdet in self.parts]
        return density[1] - density[0]

    def fit_logistic(self, x: np.ndarray, y: np.ndarray, steps: int = 30) -> None:
        """Newton steps for the logistic's scale and offset, lightly regularised."""
        if self.parts is None:
            return
        d = self.difference(x)
        unit = max(d.std(), 1e-9)
        z = np.column_stack((d / unit, np.ones(len(d))))
        beta = np.zeros(2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2)
            beta += np.linalg.solve(hess, z.T @ (y - p) - beta)
        if beta[0] > 0:
            self.scale, self.offset = beta[0] / unit, beta[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        z = self.scale * self.difference(x) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _whiten(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Forward substitution, column-wise; without the BLAS library, whose
    threads can hang in forked Python workers."""
    z = np.empty_like(y)
    for i, row in enumerate(factor):
        z[i] = (y[i] - (row[:i, None] * z[:i]).sum(0)) / row[i]
    return z


def _matrix(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS,
        held_out: int = HELD_OUT, bound: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text") -> Discriminant:
    """Train on the documents of the bounded label sample, at most ``bound`` distinct ids and
    texts; rows that repeat count once."""
    sample = label_sample(labels, label, folds, held_out, bound)
    rows = labelled_rows(docs, sample, bound, id_col, text_col).select("label", "text", "name")
    width = len(FEATURES)

    def stats(batches):
        for pdf in batches:
            x = _matrix(pdf["text"].tolist())
            yield pd.DataFrame({"label": pdf["label"].to_numpy(), "x": list(x), "name": pdf["name"].to_numpy()})

    # at most `bound` rows of a few numbers reach the driver
    got = rows.mapInPandas(stats, "label int, x array<double>, name string").toPandas().sort_values("name")
    if not len(got):
        return Discriminant({})
    x, y = np.vstack(got["x"]).reshape(-1, width), got["label"].to_numpy()
    model = Discriminant({c: ((y == c).sum(), x[y == c].sum(0), x[y == c].T @ x[y == c])
                          for c in (0, 1)})
    model.fit_logistic(x, y)
    return model


def add_scores(docs: DataFrame, model: Discriminant, text_col: str = "text",
               score_col: str = "score") -> DataFrame:
    """``docs`` with the score column (one of that name is replaced), in one pass
    without a shuffle."""
    docs = docs.drop(score_col)
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    at = docs.columns.index(text_col)

    def score(batches):
        for b in batches:
            s = model.score(_matrix(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], schema.names)

    return docs.mapInArrow(score, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                   text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged."""
    model = fit(docs, labels, text_col=text_col)
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op3_quality_discriminant(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return add_scores(docs, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
