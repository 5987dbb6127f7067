"""Retrieval and answer evaluation.

Relevant documents (``qrels``) are given by query, or, where many queries share them, by topic,
with ``topics`` (query, topic; one a query): then no row is made for each query and document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import KEY


def _relevant(qrels: DataFrame, topics: DataFrame | None, query: str, key: list[str]) -> DataFrame:
    """How many relevant documents each query has."""
    if topics is None:
        return qrels.groupBy(query).agg(F.count_distinct(*key).alias("relevant"))
    return topics.select(query, "topic").join(qrels.groupBy("topic").agg(F.count_distinct(*key).alias("relevant")), "topic").drop("topic")


def _known(rows: DataFrame, qrels: DataFrame, topics: DataFrame | None, query: str, key: list[str], flag: str) -> DataFrame:
    """Rows with a column that is 1 for relevant documents, else null."""
    if topics is None:
        return rows.join(qrels.select(query, *key).distinct().withColumn(flag, F.lit(1)), [query, *key], "left")
    return rows.join(topics.select(query, "topic"), query, "left").join(qrels.select("topic", *key).distinct().withColumn(flag, F.lit(1)), ["topic", *key], "left").drop("topic")


def _hits(ranked: DataFrame, qrels: DataFrame, topics: DataFrame | None, query: str, key: list[str]) -> DataFrame:
    """Ranked rows, first rank per key, with a hit flag."""
    first = ranked.groupBy(query, *key).agg(F.min("rank").alias("rank"))
    return _known(first, qrels, topics, query, key, "hit").withColumn("hit", F.coalesce("hit", F.lit(0)))


def metrics_at_k(ranked: DataFrame, qrels: DataFrame, ks: list[int], *, topics: DataFrame | None = None, query: str = "query_id", key: list[str] = KEY) -> DataFrame:
    """EVL-1: precision, recall and F1 at each k and query; precision divides by k."""
    relevant = _relevant(qrels, topics, query, key)
    at = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hits = _hits(ranked, qrels, topics, query, key).select(query, "rank", "hit", at).groupBy(query, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit")).otherwise(0)).alias("hits"))
    grid = relevant.select(query, "relevant", at)
    p, r = F.col("hits") / F.col("k"), F.col("hits") / F.col("relevant")
    full = grid.join(hits, [query, "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return full.select(query, "k", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def average_precision(ranked: DataFrame, qrels: DataFrame, *, topics: DataFrame | None = None, query: str = "query_id", key: list[str] = KEY) -> DataFrame:
    """EVL-2: average precision of each query with relevant documents; its mean is MAP."""
    relevant = _relevant(qrels, topics, query, key)
    hits = _hits(ranked, qrels, topics, query, key)
    seen = F.sum("hit").over(W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    gain = hits.withColumn("gain", F.when(F.col("hit") == 1, seen / F.col("rank")).otherwise(0.0)).groupBy(query).agg(F.sum("gain").alias("gain"))
    return relevant.join(gain, query, "left").select(query, (F.coalesce("gain", F.lit(0.0)) / F.col("relevant")).alias("average_precision"))


def reciprocal_rank(ranked: DataFrame, qrels: DataFrame, *, topics: DataFrame | None = None, query: str = "query_id", key: list[str] = KEY) -> DataFrame:
    """EVL-3: one over the rank of the first relevant document, 0 for a miss."""
    first = _hits(ranked, qrels, topics, query, key).filter("hit = 1").groupBy(query).agg(F.min("rank").alias("first"))
    return _relevant(qrels, topics, query, key).join(first, query, "left").select(query, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, *, topics: DataFrame | None = None, query: str = "query_id", key: list[str] = KEY) -> DataFrame:
    """EVL-4: metrics of each query by the rows that came back: precision divides by their number.

    A document that comes back several times counts where it first stands; its later rows
    keep their places and count as returned. A query without relevant documents has nulls, one
    for which nothing came back zeros.
    """
    relevant = _relevant(qrels, topics, query, key)
    w = W.partitionBy(query).orderBy("rank", *key)
    placed = ranked.select(query, *key, "rank").withColumn("place", F.row_number().over(w)).withColumn("nth", F.row_number().over(W.partitionBy(query, *key).orderBy("place")))
    known = _known(placed, qrels, topics, query, key, "known")
    hits = known.withColumn("hit", F.when(F.col("known").isNotNull() & (F.col("nth") == 1), 1).otherwise(0))
    seen = hits.withColumn("seen", F.sum("hit").over(W.partitionBy(query).orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    per = seen.groupBy(query).agg(
        F.count(F.lit(1)).alias("returned"),
        F.sum("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("place")).otherwise(0.0)).alias("gain"),
    )
    judged = lambda c: F.when(F.col("relevant").isNotNull(), c)
    zero = lambda c: judged(F.coalesce(c, F.lit(0.0)))
    p, r = zero(F.col("hits") / F.col("returned")), zero(F.col("hits") / F.col("relevant"))
    return relevant.join(per, query, "full").select(
        query,
        "relevant",
        F.coalesce("returned", F.lit(0)).alias("returned"),
        judged(F.coalesce("hits", F.lit(0))).alias("hits"),
        judged((F.coalesce("first", F.lit(0)) == 1).cast("int")).alias("top1"),
        judged(F.col("first").isNotNull().cast("int")).alias("topk"),
        zero(1 / F.col("first")).alias("mrr"),
        p.alias("precision"),
        r.alias("recall"),
        judged(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"),
        zero(F.col("gain") / F.col("relevant")).alias("map"),
    )


def run_summary(rows: DataFrame, judges: list[str] = ()) -> DataFrame:
    """EVL-5: a run's cases and means to four decimals; nulls (no relevant documents, not judged) do not count.

    Where rows have ``answered`` or ``correct`` (booleans), the rates of answers among the
    cases and of right ones among those judged follow; ``judges`` names columns of further scores.
    """
    means = [F.round(F.avg(c), 4).alias(c) for c in ("top1", "topk", "mrr", "precision", "recall", "f1", "map")]
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    more = [rate(F.coalesce("answered", F.lit(False))).alias("answer_rate")] if "answered" in rows.columns else []
    more += [F.round(F.avg(F.when(F.col("correct"), 1.0).when(~F.col("correct"), 0.0)), 4).alias("accuracy")] if "correct" in rows.columns else []
    more += [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in judges]
    return rows.agg(F.count(F.lit(1)).alias("cases"), *means, F.sum(1 - F.col("topk")).alias("misses"), F.round(F.avg("returned"), 4).alias("mean_returned"), *more)


def training_pairs(qa: DataFrame, mode: str, max_chars: int) -> DataFrame:
    """EVL-7: question and positive text by mode (answer, source, answer_source)."""
    source = F.left("source_text", F.lit(max_chars))
    positive = {"answer": F.col("answer"), "source": source, "answer_source": F.concat_ws("\n", "answer", source)}[mode]
    return qa.select("question", F.trim(positive).alias("positive")).filter((F.length(F.trim("question")) > 0) & (F.length("positive") > 0))


def build_cases(items: DataFrame, docs: DataFrame) -> DataFrame:
    """EVL-6: question cases with stable ids and their source's title; blank questions and truths go."""
    from quarry.functions.text import stable_key

    rows = items.filter((F.trim("question") != "") & (F.trim("ground_truth") != "")).join(docs.select(F.col("doc_id").alias("source_doc_id"), F.col("title").alias("source_title")), "source_doc_id", "left")
    return rows.select(stable_key([F.col("question"), F.col("ground_truth")]).alias("case_id"), "question", "ground_truth", "source_doc_id", F.coalesce("source_title", F.lit("")).alias("source_title"))


def evaluation_frame(cases: DataFrame, retrieved: DataFrame, done: DataFrame, *, query: str = "query_id") -> DataFrame:
    """EVL-8: cases not scored yet, each with its retrieved keys in rank order."""
    open_ = cases.join(done.select(query).distinct(), query, "left_anti")
    context = retrieved.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_pk")))["chunk_pk"].alias("contexts"))
    return open_.join(context, query, "left").select(query, F.coalesce("contexts", F.array().cast("array<bigint>")).alias("contexts"))
