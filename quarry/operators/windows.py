"""Windows, orders, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-1: the first row of each key in an order."""
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("n_ = 1").drop("n_")


def recent(df: DataFrame, key: str, order: list[str], columns: list[str], n: int) -> DataFrame:
    """WIN-2: each row with the ``n - 1`` rows before it, newest last, as ``recent``."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), -1)
    return df.withColumn("recent", F.collect_list(F.struct(*columns)).over(w))


def look_back(recent_rows: Column, now: Column, seconds: int, column: str = "sec") -> Column:
    """WIN-3: of the recent rows those of the last ``seconds``, newest first."""
    return F.reverse(F.filter(recent_rows, lambda x: x[column] >= now - seconds))


def next_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """WIN-4: the number of a request's version, after the latest released one of its document."""
    last = versions.groupBy("document_id").agg(F.max(F.struct("major", "minor")).alias("v"))
    major = F.when(F.col("v").isNull(), 1).when(F.col("change") == "major", F.col("v.major") + 1).otherwise(F.col("v.major"))
    minor = F.when(F.col("v").isNull() | (F.col("change") == "major"), 0).otherwise(F.col("v.minor") + 1)
    return requests.join(last, "document_id", "left").select("request_id", "document_id", major.alias("major"), minor.alias("minor"))


def summary_candidates(messages: DataFrame, summaries: DataFrame, least: int = 14, keep: int = 8) -> DataFrame:
    """WIN-5: of long sessions all but the last ``keep`` messages, unless the stored summary covers them."""
    w = W.partitionBy("session_id")
    rows = messages.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("message_order"), F.desc("id"))))
    open_ = rows.filter((F.col("n") >= least) & (F.col("back") > keep))
    ends = open_.groupBy("session_id").agg(F.max("message_order").alias("upto"), F.count(F.lit(1)).alias("messages"))
    return ends.join(summaries, "session_id", "left").filter(F.coalesce("covered", F.lit(0)) < F.col("upto")).select("session_id", "upto", "messages")


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-6: one row per key, the first; the order of the kept rows stays."""
    return latest(df, keys, order)


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """ORD-1: the page's rows, and one row with totals."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size)
    payload = total.select("total", F.lit(page).alias("page"), F.lit(size).alias("size"), pages.alias("pages"), (F.lit(page) < pages).alias("has_next"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size), payload


def merged_page(a: DataFrame, b: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """ORD-2: one page over two tables."""
    return a.unionByName(b).orderBy(*order).offset((page - 1) * size).limit(size)


def order_directory(nodes: DataFrame) -> DataFrame:
    """ORD-3: children of each parent in order: attachments last, stored place, title, key."""
    w = W.partitionBy("parent").orderBy(F.col("kind") == "attachment", F.asc_nulls_last("stored_place"), "title", "key")
    return nodes.withColumn("place", F.row_number().over(w))


def search_rows(df: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    """ORD-4, ORD-7: rows with the keyword in a column, letters of either case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(keyword.lower())
    return df.filter(hit)


def pending(feedback: DataFrame, states: list[str], n: int, order: list[str]) -> DataFrame:
    """ORD-5: the oldest ``n`` rows in an open state."""
    return feedback.filter(F.col("status").isin(states)).orderBy(*order).limit(n)


def all_documents(breakdown: DataFrame, knowledge: DataFrame) -> DataFrame:
    """SET-1: both libraries with a library column."""
    return breakdown.withColumn("library", F.lit("breakdown")).unionByName(knowledge.withColumn("library", F.lit("knowledge")), allowMissingColumns=True)


def todo(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SET-2: rows whose key is not done."""
    return every.join(done.select(key).distinct(), key, "left_anti")


def review_queue(a: DataFrame, b: DataFrame, users: DataFrame) -> DataFrame:
    """ORD-6: both review tables, newest first, with names."""
    names = users.select(F.col("user_id").alias("owner_id"), "full_name")
    return a.unionByName(b, allowMissingColumns=True).join(names, "owner_id", "left").orderBy(F.desc_nulls_last("created"), F.desc("review_id"))
