"""Quality classifier: a regularised quadratic discriminant over document statistics.

A text becomes a short vector of transformed statistics. Class means and covariances come
from a bounded sample of labelled training rows; covariances are shrunk towards the pooled
one and the pooled diagonal, and factored once (Cholesky). One map pass scores every text.
The score is the logistic of the difference of the two log densities (Mahalanobis term,
log determinant, log prior), on a scale that a one-dimensional fit on the training rows sets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold, slices, smallest_hashes, unused_names

#: At most so many labelled rows per class are used, those with the smallest hash of their id.
TRAIN_ROWS, SHRINK, CUT = 20_000, (0.10, 0.05), 0.3
NAMES = (
    "words", "word_length", "word_spread", "longest", "upper", "caps_words", "digits", "marks", "bang", "symbols",
    "pipes", "lines", "distinct", "repeated_next", "top_word", "wide", "entropy", "line_repeats", "marked_words", "sentence_ends",
)
_UPPER, _LETTERS = slice(65, 91), [*range(65, 91), *range(97, 123)]
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@^_~\\{}[]/"]
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_ENDS = re.compile(rb"[.!?](?:\s|$)")


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of one text; the empty text has all-zero counts."""
    words = raw.split()
    n, size = len(words), len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    mean, spread, longest = (lengths.mean(), lengths.std(), lengths.max()) if n else (0.0, 0.0, 0)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = int(hist[_LETTERS].sum()) + 1
    caps = sum(map(bytes.isupper, words))
    rate = lambda x, of, eps=0.002: np.log((x / max(of, 1) + eps) / (1 + eps))
    share = hist[hist > 0] / max(size, 1)
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    top = max(counts.values()) if n else 0
    marked = sum(w[-1] in b"!#$%&*@^~|" for w in words)
    return [
        np.log1p(n), mean, np.log1p(spread), np.log1p(longest),
        rate(hist[_UPPER].sum(), letters), rate(caps, n), rate(hist[48:58].sum(), size), rate(hist[_MARKS].sum(), size),
        rate(hist[33], n), rate(hist[_SYMBOLS].sum(), n), rate(hist[124], n), rate(hist[10], n, 0.005),
        np.log((len(counts) + 1) / (n + 1)) / np.log(n + 2), rate(same, n, 0.01), rate(top, n, 0.01), rate(hist[128:].sum(), size),
        float(-(share * np.log(share)).sum()), rate(len(lines) - len(set(lines)), len(lines), 0.01), rate(marked, n, 0.005), rate(len(_ENDS.findall(raw)), n, 0.005),
    ]


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: tuple[float, float] = SHRINK):
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
        self.parts = []
        for c in (0, 1):
            own = (1 - shrink[0]) * np.cov(z[y == c].T, bias=True) + shrink[0] * pooled
            own = (1 - shrink[1]) * own + shrink[1] * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(own))
            root = np.linalg.cholesky(own)
            self.parts.append((z[y == c].mean(0), np.linalg.inv(root), 2 * np.log(np.diag(root)).sum(), np.log((y == c).mean())))
        self.slope, self.shift = 1.0, 0.0
        margin = self.margin(x)
        slope, shift = 0.1, 0.0
        for _ in range(50):  # Newton steps of a ridge-penalised logistic fit in two unknowns
            p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
            w, g = p * (1 - p) + 1e-9, p - y
            hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(g * margin).sum() + 1e-3 * slope, g.sum() + 1e-3 * shift])
            slope, shift = slope - np.clip(step[0], -0.5, 0.5), shift - np.clip(step[1], -2, 2)
        self.slope, self.shift = max(slope, 1e-3), shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 minus those of class 0, tamed to a signed square root far out."""
        z = (x - self.centre) / self.scale
        logs = [prior - 0.5 * (det + (((z - mean) @ inverse.T) ** 2).sum(1)) for mean, inverse, det, prior in self.parts]
        d = logs[1] - logs[0]
        return np.sign(d) * (np.sqrt(1 + 2 * np.abs(d)) - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """text and y of at most ``rows`` training rows of each class, those with the smallest hash of their id.

    Training rows are those whose crc32 fold of five is not 0. The sample of the label table
    is bounded, so it may be broadcast: no text is shuffled.
    """
    marks = labels.select(F.col(label_id).alias("label_id"), F.col(label_col).cast("int").alias("y")).filter(fold("label_id") != 0)
    taken = [smallest_hashes(marks.filter(F.col("y") == c), "label_id", rows) for c in (0, 1)]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, F.col("id") == F.col("label_id")).select("id", "text", "y")


def _vectors(batches):
    for batch in slices(batches):
        rows = [statistics((text or "").encode()) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "x": pa.array(rows, pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", train_rows: int = TRAIN_ROWS, **columns: str) -> Discriminant | None:
    """Fit on at most ``train_rows`` labelled rows of each class; None without two rows of each."""
    bound_batches(docs.sparkSession)
    sample = training_sample(docs, labels, label_col, train_rows, **columns).select("text", "y")
    rows = sample.mapInArrow(_vectors, "y int, x array<double>").toPandas().sort_values("y", kind="stable")
    if min((rows["y"] == 0).sum(), (rows["y"] == 1).sum()) < 2:
        return None
    x = np.array(rows["x"].to_list())
    order = np.lexsort([*x.T, rows["y"]])  # the same sums whatever the order in which tasks end
    return Discriminant(x[order], rows["y"].to_numpy()[order])


def with_score(docs: DataFrame, model: Discriminant | None, name: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the score; 0.5 everywhere where there is no model."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            p = np.full(len(texts), 0.5)
            if sent.value and texts:
                p = sent.value.score(np.array([statistics((text or "").encode()) for text in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Rows whose crc32 fold of five is 0 are held out and never give a label; a row without an id is neither. Null texts
    score as empty ones; repeated rows get equal scores; with too few labels all score 0.5.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, cut: float = CUT) -> DataFrame:
    """The rows that score at least ``cut``, all columns as they are; null and empty texts have a score as any other."""
    (name,) = unused_names(docs, "quality_score")
    scored = with_score(docs, fit(docs, labels), name)
    return scored.filter(F.col(name) >= cut).drop(name)
