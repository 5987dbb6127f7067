"""Joins of the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def question_answer_pairs(messages: DataFrame) -> DataFrame:
    """JN-1: each question with the first answer at or after it in its session; a window, not a self-join."""
    w = W.partitionBy("session_id").orderBy("ts_sec", F.desc("role"), "id").rowsBetween(1, W.unboundedFollowing)
    answer = F.first(F.when(F.col("role") == 0, F.struct("id", "ts_sec")), ignorenulls=True).over(w)
    pairs = messages.filter("role in (0, 1)").withColumn("answer", answer).filter("role = 1")
    return pairs.select("session_id", F.col("id").alias("question_id"), F.col("answer.id").alias("answer_id"), (F.col("answer.ts_sec") - F.col("ts_sec")).alias("wait_sec"), F.when(F.col("answer").isNull(), "pending").otherwise("success").alias("status"))


def upload_contributions(users: DataFrame, files: DataFrame) -> DataFrame:
    """JN-2: uploads of approved users, of others only if they have any, and one row for unknown uploaders."""
    counts = files.groupBy(F.col("uploader_id").alias("user_id")).agg(F.count(F.lit(1)).alias("uploads"))
    known = users.join(counts, "user_id", "left").withColumn("uploads", F.coalesce("uploads", F.lit(0))).filter((F.col("registration_status") == "approved") | (F.col("uploads") > 0))
    unknown = counts.join(users, "user_id", "left_anti").agg(F.coalesce(F.sum("uploads"), F.lit(0)).alias("uploads")).filter("uploads > 0")
    return known.select("user_id", "full_name", "uploads").unionByName(unknown.select(F.lit(-1).cast("long").alias("user_id"), F.lit("unknown").alias("full_name"), "uploads"))


def attach_titles(refs: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """JN-3: the first title of a document, else the stored one."""
    first = titles.groupBy(*keys).agg(F.min_by("title", "place").alias("found_title"))
    return refs.join(first, keys, "left").withColumn("title", F.coalesce("found_title", "stored_title")).drop("found_title")


def searchable(docs: DataFrame, versions: DataFrame, served: DataFrame) -> DataFrame:
    """JN-4: documents without versions, and served versions, never drafts."""
    free = docs.join(versions.select("document_id").distinct(), "document_id", "left_anti").withColumn("version_id", F.lit(None).cast("long"))
    return free.unionByName(docs.join(served.select("document_id", "version_id"), "document_id"))


#: Days from ``DAY_ZERO`` that intervals are compared by, as a power of two; what lies beyond counts as the first or last day.
DAY_BITS, DAY_ZERO = 17, "1850-01-01"
#: Rows up to which all rows of a key are compared: that costs less than to deal out a row's blocks.
FEW_SCOPES = 512


def _day(column: Column, missing: int) -> Column:
    day = F.datediff(column, F.lit(DAY_ZERO).cast("date"))
    return F.when(column.isNull(), missing).otherwise(F.greatest(F.lit(0), F.least(day, F.lit((1 << DAY_BITS) - 1))))


def _cover(start: Column, end: Column) -> Column:
    """The largest aligned blocks (level, index) that make up the days from ``start`` to before ``end``: two a level at most."""

    def at(n: int):
        size, level = 1 << n, F.lit(n)
        i, j = F.ceil(start / size).cast("int"), (F.floor(end / size) - 1).cast("int")
        left = ((i + 1) * size <= end) & ((i % 2 == 1) | ((i + 2) * size > end))
        right = (j * size >= start) & ((j % 2 == 0) | ((j - 1) * size < start)) & (i != j)
        return F.array(F.when(left, F.struct(level.alias("level"), i.alias("index"))), F.when(right, F.struct(level.alias("level"), j.alias("index"))))

    return F.array_compact(F.flatten(F.array(*[at(n) for n in range(DAY_BITS + 1)])))


def _blocks_of(day: Column) -> Column:
    """The aligned block of each level that holds the day."""
    return F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(day, n).alias("index")) for n in range(DAY_BITS + 1)])


def overlapping_pairs(scopes: DataFrame, keys: list[str], wild: list[str] = (), *, row_id: str = "version_id", start: str = "effective_from", end: str = "effective_to", few: int = FEW_SCOPES) -> DataFrame:
    """(left_id, right_id) of rows with equal ``keys`` (null equals null), no different value in ``wild`` columns where both are set, and overlapping ranges.

    Of two ranges that overlap, the later start lies in the other range. A range is cut into
    the largest aligned blocks of days, a start is looked up in the block of each level that
    holds it: one block is common where the day is in the range, and none otherwise. So the
    join brings only pairs that belong together (up to the time of day), and no key compares
    all its rows. A wildcard row has a key for each set of columns that a partner may have
    set. Keys of at most ``few`` rows need no blocks: a row meets that many at most. A missing
    start or end is open; equal rows pair once, under the smaller id first.
    """
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(wild)), F.lit(0))
    rows = scopes.select(F.col(row_id).alias("id"), F.struct(*[F.col(k) for k in keys]).alias("key"), F.array(*[F.col(c).cast("string") for c in wild]).cast("array<string>").alias("wild"), mask.alias("mask"), F.col(start).alias("s"), F.col(end).alias("e"))
    rows = rows.withColumns({"from": _day(F.col("s"), 0), "to": _day(F.col("e"), (1 << DAY_BITS) - 1) + 1})
    seen = [r[0] for r in rows.select("mask").distinct().collect()] if wild else [0]  # 2 to the number of wild columns at most
    both = lambda own, other: F.transform(own, lambda x, i: F.when(F.call_function("shiftright", F.col("mask").bitwiseAND(other), i) % 2 == 1, x))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("key")
    partner = rows.join(large, "key", "left_semi").withColumn("other", F.explode(F.array(*[F.lit(m) for m in seen]))).withColumn("shared", F.array_join(both(F.col("wild"), F.col("other")), "\x01", "\x00"))
    held = partner.select(F.col("id").alias("a"), "key", F.col("mask").alias("m"), F.col("other").alias("n"), "shared", F.col("s").alias("s1"), F.col("e").alias("e1"), F.explode(_cover(F.col("from"), F.col("to"))).alias("block"))
    points = partner.select(F.col("id").alias("b"), "key", F.col("other").alias("m"), F.col("mask").alias("n"), "shared", F.col("s").alias("s2"), F.col("e").alias("e2"), F.explode(_blocks_of(F.col("from"))).alias("block"))
    named = lambda a, w, s, e: small.select("key", F.col("id").alias(a), F.col("wild").alias(w), F.col("s").alias(s), F.col("e").alias(e))
    small = rows.join(large, "key", "left_anti")
    agree = F.forall(F.zip_with("w1", "w2", lambda x, y: F.coalesce(x == y, F.lit(True))), lambda x: x)
    met = named("a", "w1", "s1", "e1").join(named("b", "w2", "s2", "e2").hint("merge"), "key").filter(agree)
    columns = ["a", "b", "s1", "e1", "s2", "e2"]
    pairs = held.join(points, ["key", "m", "n", "shared", "block"]).select(*columns).unionByName(met.select(*columns))
    first = (F.col("s1").isNull() & F.col("s2").isNotNull()) | F.coalesce(F.col("s1") < F.col("s2"), F.lit(False)) | (F.col("s1").eqNullSafe(F.col("s2")) & (F.col("a") < F.col("b")))
    before = lambda s, e: F.coalesce(F.col(s) < F.col(e), F.lit(True))
    pairs = pairs.filter(first & before("s1", "e2") & before("s2", "e1"))
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def validity_conflicts(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """JN-5: pairs of scopes with equal keys (null equals null) whose validity overlaps; a missing start or end is open."""
    return overlapping_pairs(scopes, keys)


def scope_overlaps(scopes: DataFrame, key: str, wild: list[str]) -> DataFrame:
    """JN-6: pairs of one document whose wildcard columns do not differ where both are set, and whose ranges overlap."""
    return overlapping_pairs(scopes.filter(F.col(key).isNotNull()), [key], wild)


def coexistence_violations(versions: DataFrame) -> DataFrame:
    """JN-7: in documents with several published versions, those without hardware or with a hardware that another has."""
    w, h = W.partitionBy("document_id"), W.partitionBy("document_id", F.lower("hardware_version"))
    rows = versions.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("same", F.count(F.lit(1)).over(h)).filter("n > 1")
    reason = F.when(F.col("hardware_version").isNull(), "no hardware").when(F.col("same") > 1, "same hardware")
    return rows.withColumn("reason", reason).filter("reason is not null").select("document_id", "version_id", "reason")


def expand_sections(sections: DataFrame, matched: DataFrame, limit: int = 10) -> DataFrame:
    """JN-8: matched sections with their neighbours and children (marker prefix), the first ``limit``; unmatched documents give their first ones."""
    w = W.partitionBy("doc_id").orderBy("position")
    base = sections.withColumn("before", F.lag("position").over(w)).withColumn("after", F.lead("position").over(w))
    hit = base.join(matched.select("doc_id", "position"), ["doc_id", "position"], "left_semi")
    near = hit.select("doc_id", F.explode(F.array_compact(F.array("before", "position", "after"))).alias("position"))
    kids = sections.alias("s").join(hit.alias("h"), (F.col("s.doc_id") == F.col("h.doc_id")) & F.col("s.marker").startswith(F.concat(F.col("h.marker"), F.lit(".")))).select("s.doc_id", "s.position")
    found = near.unionByName(kids).distinct()
    none = sections.join(matched.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "position")
    return found.unionByName(none).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def neighbour_snippets(ranked: DataFrame, chunks: DataFrame, *, best: int = 3, most: int = 6, query: str = "query_id") -> DataFrame:
    """JN-9: chunks next to the best ones of each document, each once, at most ``most``."""
    w = W.partitionBy(query, "doc_id").orderBy(F.desc("score"), "chunk_pk")
    top = ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= best)
    around = top.select(query, "doc_id", F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"), "place")
    near = around.join(chunks.select("doc_id", "chunk_index", "chunk_pk"), ["doc_id", "chunk_index"]).groupBy(query, "doc_id", "chunk_pk").agg(F.min("place").alias("place"))
    order = W.partitionBy(query, "doc_id").orderBy("place", "chunk_pk")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def in_subtree(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """JN-10: pages that are a root or have one among their ancestors."""
    ids = pages.select("page_id", F.explode(F.array_union(F.array("page_key"), "ancestors")).alias("root"))
    return ids.join(roots.select("root").distinct(), "root", "left_semi").select("page_id").distinct()


def plan_refresh(pages: DataFrame, stored: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """JN-11: each collected page new, changed or unchanged against the store; a page that was not collected is no delete."""
    old = stored.select(*keys, *[F.col(c).alias(f"{c}_old") for c in watched], F.lit(1).alias("known_"))
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_old"))
    return pages.join(old, keys, "left").select(*keys, F.when(F.col("known_").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("action"))


def merge_ranked(primary: DataFrame, secondary: DataFrame, most: int, *, query: str = "query_id", key: list[str] | None = None) -> DataFrame:
    """JN-12: two ranked sets as one: greatest score, chunks unioned, first-seen order breaks ties."""
    key = key or ["library_type", "doc_id"]
    both = primary.withColumn("source", F.lit(0)).unionByName(secondary.withColumn("source", F.lit(1)))
    merged = both.groupBy(query, *key).agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"), F.min(F.struct("source", "rank")).alias("seen"))
    w = W.partitionBy(query).orderBy(F.desc("score"), "seen", *key)
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("seen")


def compare_last(traces: DataFrame, columns: list[str]) -> DataFrame:
    """JN-13: the last two rows of each session, and which columns changed."""
    w = W.partitionBy("session_id").orderBy("ts_sec", "id")
    rows = traces.withColumn("last", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts_sec"), F.desc("id"))))
    for c in columns:
        rows = rows.withColumn(f"{c}_before", F.lag(c).over(w))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("session_id"))).filter("last = 1 and n > 1")
    return rows.select("session_id", *[(~F.col(c).eqNullSafe(F.col(f"{c}_before"))).alias(f"{c}_changed") for c in columns])


def attach_names(df: DataFrame, users: DataFrame, column: str, out: str) -> DataFrame:
    """JN-14: display names; ids without a user read ``user<id>``, missing ids stay missing."""
    names = users.select(F.col("user_id").alias(column), F.col("full_name").alias("name_"))
    return df.join(names, column, "left").withColumn(out, F.coalesce("name_", F.concat(F.lit("user"), F.col(column).cast("string")))).drop("name_")


def apply_reviews(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """JN-15: approved requests applied: the latest per document creates, updates (a blank title keeps the old) or soft-deletes."""
    w = W.partitionBy("doc_id").orderBy(F.desc("review_id"))
    last = reviews.filter("status = 'approved'").withColumn("n", F.row_number().over(w)).filter("n = 1").select("doc_id", "action", F.col("title").alias("new_title"))
    joined = docs.join(last, "doc_id", "full_outer")
    title = F.when(F.col("action").isin("create", "update") & (F.trim("new_title") != ""), F.col("new_title")).otherwise(F.col("title"))
    return joined.select(
        "doc_id",
        title.alias("title"),
        F.when(F.col("action") == "delete", 1).otherwise(0).alias("is_deleted"),
        F.when(F.col("action").isNull(), F.coalesce("is_indexed", F.lit(0))).otherwise(0).alias("is_indexed"),
    )
