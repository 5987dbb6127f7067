"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a short fixed seed plus words and word beginnings that a bounded sample of
labelled texts marks as toxic by log-odds; it is of bounded size. One map pass turns every
whole text into dense features: lexicon densities, second-person proximity, capitals,
punctuation and obfuscation rates. Trees and calibration are Spark ML models; lexicon,
trees and calibration are each learned from rows of their own, none of them held out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold, materialise, slices
from .quality import training_sample

#: Labelled rows per class, lexicon entries, and an entry's least texts, least log-odds and standard errors taken off.
TRAIN_ROWS, LEXICON, LEAST_TEXTS, LEAST_ODDS, ERRORS, CUT = 10_000, 4000, 4, 1.0, 1.5, 0.5
#: The seed lexicon, and second-person words of four languages.
SEED = "asshole bastard bitch clown crap damn disgusting dumb fool freak fuck garbage hate idiot imbecile jerk kill loser moron pathetic retard scum shit stupid trash ugly vermin worthless".split()
SECOND = {w.encode() for w in "you your yours yourself du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus ustedes vosotros u ur".split()}
NAMES = (
    "n_words", "hits", "density", "weight_rate", "most", "strong", "distinct_hits", "second", "near_second", "capitals", "bangs", "marks", "obfuscated", "stretched", "seed_rate", "second_most", "middling", "faint", "excess",
)
_KEEP = bytes(b if chr(b).isalnum() or b >= 128 or chr(b) in "@$*'" else 32 for b in range(256))
_OBFUSCATED = re.compile(rb"[a-z][@$*0-9]+[a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_REACH = 6


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_KEEP).split()


def units(word: bytes) -> list[bytes]:
    """A word, and its beginnings of 3 to 6 bytes marked with a star."""
    return [word, *(word[:k] + b"*" for k in range(3, 7) if len(word) > k)]


class Weights(dict):
    """The largest lexicon weight of a word's units, remembered up to a fixed number of words."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        get = self.lexicon.get
        value = self[word] = max(get(u, 0.0) for u in units(word))
        return value


_SEEDS = {w.encode() for w in SEED}


def vector(text: str, weights: Weights) -> list[float]:
    """The dense features of one text; the empty text has zeros."""
    words = words_of(text)
    n = len(words)
    size = max(n, 1)
    value = np.fromiter(map(weights.__getitem__, words), np.float64, n)
    hit = np.flatnonzero(value > 0)
    second = np.array([i for i, w in enumerate(words) if w in SECOND])
    near = 0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        right = np.abs(second[np.minimum(at, len(second) - 1)] - hit)
        left = np.abs(second[np.maximum(at - 1, 0)] - hit)
        near = int((np.minimum(left, right) <= _REACH).sum())
    raw = text.encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = hist[65:91].sum() + hist[97:123].sum()
    joined = b" ".join(words)
    top = np.sort(value)[::-1]
    return [
        np.log1p(n), np.log1p(len(hit)), len(hit) / size, value.sum() / size, float(top[0]) if n else 0.0, (value >= 4).sum() / size,
        np.log1p(len({words[i] for i in hit.tolist()})), len(second) / size, near / (len(hit) + 1), hist[65:91].sum() / (letters + 1), hist[33] / size,
        hist[_MARKS].sum() / (len(raw) + 1), len(_OBFUSCATED.findall(joined)) / size, len(_STRETCHED.findall(joined)) / size,
        sum(map(_SEEDS.__contains__, words)) / size, float(top[1]) if n > 1 else 0.0,
        ((value >= 2.5) & (value < 4)).sum() / size, ((value > 0) & (value < 2.5)).sum() / size, value.sum() / np.sqrt(size),
    ]


def _unit_counts(batches):
    """How many toxic and other texts of this task have each unit."""
    counts: dict[bytes, list[int]] = {}
    for batch in slices(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            for unit in {u for w in set(words_of(text or "")) for u in units(w)}:
                counts.setdefault(unit, [0, 0])[y] += 1
    if counts:
        pairs = np.array(list(counts.values()), np.int64)
        yield pa.RecordBatch.from_pydict({"unit": pa.array(list(counts), pa.binary()), "neg": pa.array(pairs[:, 0]), "pos": pa.array(pairs[:, 1])})


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Units of (text, y) whose smoothed log-odds mark toxic texts, at most ``LEXICON`` of them, and the seed."""
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = totals.get(0, 0), totals.get(1, 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    odds = odds - ERRORS * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))  # rare units must be clearer
    counted = sample.mapInArrow(_unit_counts, "unit binary, neg long, pos long").groupBy("unit").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    rows = counted.filter(F.col("pos") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "unit").limit(LEXICON).collect()
    return {w: 2.0 for w in _SEEDS} | {bytes(r["unit"]): r["odds"] for r in rows}


def with_features(df: DataFrame, lexicon: dict[bytes, float], *, text_col: str = "text") -> DataFrame:
    """``df`` without its text but with one column per feature."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)
    rest = [c for c in df.columns if c != text_col]

    def run(batches):
        weights = Weights(sent.value)
        for batch in slices(batches):
            rows = np.array([vector(text or "", weights) for text in batch.column(text_col).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(np.ascontiguousarray(x), pa.float64()) for x in rows.T)], [*rest, *NAMES])

    schema = df.select(*rest, *[F.lit(0.0).alias(name) for name in NAMES]).schema
    return df.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id and score (0 to 1, higher is more toxic) for every row.

    Labels come from at most ``train_rows`` rows of each class outside the held-out fold:
    folds 1 and 2 for the lexicon, 3 for the trees, 4 for the calibration. Null texts score
    as empty ones; repeated rows get equal scores; where a part lacks a class all score 0.5.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sample = materialise(training_sample(docs, labels, label_col, train_rows, id_col=id_col, text_col=text_col).withColumn("part", fold("id")), "toxic-sample")
    found = {(r["part"], r["y"]) for r in sample.groupBy("part", "y").count().collect()}
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not all({(p, 0), (p, 1)} <= found for p in (3, 4)):
        return ids.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    lexicon = learn_lexicon(sample.filter("part in (1, 2)").select("text", "y"))
    pack = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    known = materialise(with_features(sample.filter("part in (3, 4)").select("id", "part", "y", "text"), lexicon), "toxic-x")
    known = pack.transform(known.coalesce(4).sortWithinPartitions("id").withColumn("label", F.col("y").cast("double")))
    trees = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.3, maxBins=32, seed=6, featuresCol="features", labelCol="label").fit(known.filter("part = 3"))
    margin = vector_to_array("probability")[1]
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(trees.transform(known.filter("part = 4")).select(margin.alias("p"), "label"))
    scored = trees.transform(pack.transform(with_features(ids, lexicon))).select("id", margin.alias("p"))
    # A small share of the uncalibrated value keeps the order inside the calibration's steps.
    return calibration.transform(scored).select(F.col("id").alias(id_col), (F.col("prediction") * 0.98 + F.col("p") * 0.02).alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Rows whose crc32 fold of five is 0 are held out and never give a label; a row without an
    id is neither. Null texts score as empty ones; repeated rows get equal scores.
    """
    scored = score(docs, labels)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
