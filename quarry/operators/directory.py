"""The browsing tree of pages from several sites (QLT-15, ORD-3): site, ancestors, page, attachment, with documents and sections below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _key(*parts: Column) -> Column:
    """A key of several parts, unambiguous: their JSON."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with ``steps``: the nodes from site to page, and on to the attachment, each with key, title and kind."""
    site = F.coalesce("site", F.lit("Confluence"))
    path = F.when(F.size(F.coalesce("title_path", F.array().cast("array<string>"))) > 0, F.col("title_path")).otherwise(F.array("doc_title"))
    last = F.size("path") - 1
    step = lambda key, title, kind: F.struct(key.alias("key"), title.alias("title"), F.lit(kind).alias("kind"))
    rows = rows.filter("page_id is not null and cast(page_id as string) <> ''").withColumns({"site": site, "path": path})
    given = F.coalesce("ancestor_ids", F.array().cast("array<string>"))

    def above(title, i):
        # An ancestor without an id is known by the titles that lead to it; the last one may be given as the parent.
        page = F.when(i < F.size(given), F.get(given, i)).when(i == last - 1, F.col("parent_id").cast("string"))
        named = F.to_json(F.concat(F.array(F.col("site"), F.lit("path")), F.slice("path", F.lit(1), i + 1)))
        return step(F.when(F.coalesce(page, F.lit("")) != "", _key(F.col("site"), page)).otherwise(named), title, "page")

    ancestors = F.transform(F.slice("path", F.lit(1), last), above)
    page = step(_key(F.col("site"), F.col("page_id")), F.element_at("path", -1), "page")
    file = step(_key(F.col("site"), F.lit("attachment"), F.col("page_id"), F.col("attachment_id")), F.coalesce("attachment_title", "doc_title"), "attachment")
    root = step(_key(F.col("site")), F.col("site"), "site")
    steps = F.concat(F.array(root), ancestors, F.array(page), F.when(F.col("attachment_id").isNotNull(), F.array(file)).otherwise(F.array().cast("array<struct<key:string,title:string,kind:string>>")))
    return rows.withColumn("steps", steps)


def child_order(rows: DataFrame) -> DataFrame:
    """ORD-3: (parent, key, stored) of children by the newest snapshot of their page (source_version, then doc_id); attachments' snapshots do not count."""
    own = rows.filter("attachment_id is null and child_pages is not null and page_id is not null")
    site = F.coalesce("site", F.lit("Confluence"))
    rank = F.struct(F.coalesce(F.expr("try_cast(source_version as bigint)"), F.lit(0)).alias("v"), "doc_id")
    newest = own.groupBy(_key(site, F.col("page_id")).alias("parent"), site.alias("site_")).agg(F.max_by("child_pages", rank).alias("children"))
    each = newest.select("parent", "site_", F.posexplode("children").alias("stored", "child")).filter("child is not null")
    return each.groupBy("parent", _key(F.col("site_"), F.col("child")).alias("key")).agg(F.min("stored").alias("stored"))


def source_directory(rows: DataFrame) -> DataFrame:
    """QLT-15, ORD-3: one row for each node: key, parent, title, kind, depth, place among its siblings, and documents and sections at it and below.

    ``rows`` are sections with metadata: doc_id, doc_title, section_id, site, page_id,
    title_path, ancestor_ids, parent_id, child_pages, source_version, attachment_id,
    attachment_title, navigation_only. A node has the parent and title of the first row (by
    document and section) that names it. Siblings stand with attachments last, then by the
    place that the newest snapshot of their page gives, then title, then key. Counts come from
    each row's own way up, so a node deep down needs no rounds. Rows without a page are left out.
    """
    placed = _placed(rows)
    ways = placed.select("doc_id", "section_id", F.coalesce("navigation_only", F.lit(False)).alias("bare"), "steps", F.posexplode("steps").alias("depth", "step"))
    named = ways.select(F.col("step.key").alias("key"), "doc_id", "section_id", F.struct(F.when(F.col("depth") > 0, F.col("steps")[F.col("depth") - 1]["key"]).alias("parent"), F.col("step.title").alias("title"), F.col("step.kind").alias("kind"), "depth").alias("n"))
    nodes = named.groupBy("key").agg(F.min_by("n", F.struct("doc_id", "section_id", F.col("n.depth"))).alias("n")).select("key", "n.*")
    below = ways.select(F.col("step.key").alias("key_"), "doc_id", F.when(~F.col("bare"), F.struct("doc_id", "section_id")).alias("section"))
    sums = below.groupBy("key_").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("section").alias("sections"))
    order = child_order(rows).select(F.col("parent").alias("p_"), F.col("key").alias("k_"), "stored")
    full = nodes.join(sums, F.col("key") == F.col("key_")).join(order, (F.col("parent") == F.col("p_")) & (F.col("key") == F.col("k_")), "left")
    w = W.partitionBy("parent").orderBy(F.col("kind") == "attachment", F.asc_nulls_last("stored"), F.lower("title"), "key")
    return full.withColumn("place", F.row_number().over(w)).select("key", "parent", "title", "kind", "depth", "place", "documents", "sections")


def node_documents(rows: DataFrame) -> DataFrame:
    """QLT-15: (key, doc_id, doc_title, sections) of the documents at each node, newest first by ``place``; sections in order of their index, each once."""
    placed = _placed(rows)
    at = F.element_at("steps", -1)["key"]
    section = F.when(~F.coalesce("navigation_only", F.lit(False)), F.struct("section_index", "section_id", F.coalesce("section_title", F.lit("正文")).alias("title")))
    docs = placed.groupBy(at.alias("key"), "doc_id").agg(F.min("doc_title").alias("doc_title"), F.array_sort(F.collect_set(section)).alias("sections"))
    return docs.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.desc("doc_id"))))
