"""Versions of documents by section (QLT-18): keys and content hashes, alignment of two versions, and what a publication changes."""

from __future__ import annotations

import bisect
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.blanks import strip

SERVED = ["active", "legacy_active"]


def slug(title: Column) -> Column:
    """Small Latin letters and digits with dots between, at most 180 characters."""
    return F.left(F.trim(F.regexp_replace(F.lower(strip(title)), "[^a-z0-9]+", "."), F.lit(".")), F.lit(180))


def section_keys(sections: DataFrame, *, version: str = "version_id", position: str = "position", title: str = "title", text: str = "text", key: str | None = None) -> DataFrame:
    """Sections with ``section_key`` and ``content_hash``.

    The key is the given one, or the title's slug (``section`` without one) and the place from
    1. The hash is the SHA-256 of title and text as JSON; nulls count as empty.
    """
    place = F.row_number().over(W.partitionBy(version).orderBy(position))
    made = F.concat(F.coalesce(F.nullif(slug(F.coalesce(title, F.lit("section"))), F.lit("")), F.lit("section")), F.lit("."), place.cast("string"))
    own = F.lit("") if key is None else strip(key)
    content = F.to_json(F.struct(F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return sections.withColumn("section_key", F.coalesce(F.nullif(own, F.lit("")), made)).withColumn("content_hash", F.sha2(content, 256))


def version_hashes(keyed: DataFrame, *, version: str = "version_id", position: str = "position") -> DataFrame:
    """One hash for each version: the SHA-256 of its sections' hashes in order, joined by commas."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct(position, "section_key", "content_hash"))), lambda s: s["content_hash"])
    return keyed.groupBy(version).agg(F.count(F.lit(1)).alias("n_sections"), F.sha2(F.array_join(hashes, ","), 256).alias("version_hash"))


def in_order(places: list[int]) -> list[bool]:
    """Which members of a sequence belong to its longest increasing subsequence, the one that ends lowest at each length."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect.bisect_left(tails, p)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [p], [i]
    kept, i = [False] * len(places), ends[-1] if ends else -1
    while i >= 0:
        kept[i], i = True, before[i]
    return kept


def align(old: DataFrame, new: DataFrame, *, document: str = "document_id", position: str = "position") -> DataFrame:
    """document, section_key, change, moved, old_position and new_position of the sections of two versions of each document.

    Sections match by key, and those left over by content where it is once in either version
    (renamed). A match is kept or changed by its hash. Matches outside the longest common
    subsequence of both orders have moved, so as few as possible do. Sections without a
    match are added or removed. Only keys, hashes and places are compared.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        # A key that comes twice in a version stands for its first section.
        first = df.withColumn("n_", F.row_number().over(W.partitionBy(document, "section_key").orderBy(position))).filter("n_ = 1")
        return first.select(F.col(document).alias("doc"), F.col("section_key").alias(f"{name}_key"), F.col("content_hash").alias(f"{name}_hash"), F.col(position).cast("long").alias(f"{name}_position"))

    left, right = side(old, "old"), side(new, "new")
    by_key = left.join(right, (left["doc"].eqNullSafe(right["doc"])) & (F.col("old_key") == F.col("new_key")), "full").select(F.coalesce(left["doc"], right["doc"]).alias("doc"), *left.columns[1:], *right.columns[1:])
    lost, came = by_key.filter("new_key is null").select(*left.columns), by_key.filter("old_key is null").select("doc", *right.columns[1:])
    alone = lambda df, name: df.withColumn("same_", F.count(F.lit(1)).over(W.partitionBy("doc", f"{name}_hash"))).filter("same_ = 1").drop("same_")
    a, b = alone(lost, "old").alias("a"), alone(came, "new").alias("b")
    renamed = a.join(b, F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.old_hash") == F.col("b.new_hash"))).select("a.*", *[f"b.{c}" for c in right.columns[1:]])
    gone = lost.join(renamed.select(F.col("doc").alias("d"), F.col("old_key").alias("k")), F.col("doc").eqNullSafe(F.col("d")) & (F.col("old_key") == F.col("k")), "left_anti")
    fresh = came.join(renamed.select(F.col("doc").alias("d"), F.col("new_key").alias("k")), F.col("doc").eqNullSafe(F.col("d")) & (F.col("new_key") == F.col("k")), "left_anti")
    pairs = by_key.filter("old_key is not null and new_key is not null").unionByName(renamed)
    schema = pairs.select("doc", "old_key", "new_key", "old_hash", "new_hash", "old_position", "new_position").withColumn("moved", F.lit(True)).schema

    def order(table: pa.Table) -> pa.Table:
        table = table.select(schema.names[:-1]).sort_by([("new_position", "ascending"), ("new_key", "ascending")])
        places = table.column("old_position").to_pylist()
        ranks = {k: i for i, k in enumerate(sorted(zip(places, table.column("old_key").to_pylist())))}
        kept = in_order([ranks[k] for k in zip(places, table.column("old_key").to_pylist())])
        return table.append_column("moved", pa.array([not x for x in kept], pa.bool_()))

    matched = pairs.groupBy("doc").applyInArrow(order, schema)
    change = F.when(F.col("old_key") != F.col("new_key"), "renamed").when(F.col("old_hash") == F.col("new_hash"), "kept").otherwise("changed")
    out = matched.select("doc", F.col("new_key").alias("section_key"), change.alias("change"), "moved", "old_position", "new_position")
    none = F.lit(None).cast("long")
    out = out.unionByName(gone.select("doc", F.col("old_key").alias("section_key"), F.lit("removed").alias("change"), F.lit(False).alias("moved"), "old_position", none.alias("new_position")))
    out = out.unionByName(fresh.select("doc", F.col("new_key").alias("section_key"), F.lit("added").alias("change"), F.lit(False).alias("moved"), none.alias("old_position"), "new_position"))
    return out.withColumnRenamed("doc", document)


class Publication(NamedTuple):
    """What publishing changes: refusals (version_id, reason), versions after it, relations (source, target) and documents' default versions."""

    refused: DataFrame
    versions: DataFrame
    relations: DataFrame
    defaults: DataFrame


def publish(versions: DataFrame, requests: DataFrame, defaults: DataFrame, as_of: Column) -> Publication:
    """QLT-18: the whole plan of publishing versions, as a slowly changing dimension.

    ``versions`` have version_id, document_id, workflow_status, validity_status,
    hardware_version, effective_from, effective_to; ``requests`` have version_id, mode
    (replace or coexist) and supersedes (ids, null is none), one a document (the greatest
    version counts); ``defaults`` have document_id and default_version_id. Refused: a range
    that ends before it begins, targets that are not served versions of the same document,
    coexistence with targets or without hardware, replacement without one where something is
    served, hardware (letters of any case) that a version which stays has, or a version which stays without any.
    """
    served = versions.filter((F.col("workflow_status") == "published") & F.col("validity_status").isin(SERVED)).select(F.col("version_id").alias("served_id"), F.col("document_id").alias("served_doc"), F.lower(strip("hardware_version")).alias("served_hardware"))
    one = W.partitionBy("document_id").orderBy(F.desc("version_id"))
    targets = F.coalesce("supersedes", F.array().cast("array<bigint>"))
    asked = requests.select("version_id", "mode", F.array_distinct(targets).alias("supersedes")).join(versions, "version_id").withColumn("n_", F.row_number().over(one)).filter("n_ = 1").drop("n_")
    asked = asked.withColumn("own", F.lower(strip("hardware_version")))
    others = asked.select("version_id", "document_id", "supersedes", "own").join(served, (F.col("document_id") == F.col("served_doc")) & (F.col("version_id") != F.col("served_id")))
    stays = ~F.array_contains("supersedes", F.col("served_id"))
    about = others.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n_served"), F.count_if(~stays).alias("n_hit"), F.bool_or(stays & (F.col("served_hardware") == "")).alias("bare"),
        F.bool_or(stays & (F.col("served_hardware") == F.col("own")) & (F.col("own") != "")).alias("same"), F.count_if(stays).alias("n_stay"),
    )
    known = asked.join(about, "version_id", "left").fillna({"n_served": 0, "n_hit": 0, "n_stay": 0, "bare": False, "same": False})
    reason = (
        F.when(F.col("effective_from") >= F.col("effective_to"), "range ends before it begins")
        .when(F.col("n_hit") < F.size("supersedes"), "target is not served")
        .when((F.col("mode") == "coexist") & (F.size("supersedes") > 0), "coexistence with targets")
        .when((F.col("mode") == "replace") & (F.col("n_served") > 0) & (F.size("supersedes") == 0), "no target")
        .when((F.col("mode") == "coexist") & (F.col("own") == ""), "no hardware")
        .when((F.col("n_stay") > 0) & ((F.col("own") == "") | F.col("bare")), "no hardware")
        .when(F.col("same"), "same hardware")
    )
    judged = known.withColumn("reason", reason)
    good = judged.filter("reason is null").select(F.col("version_id").alias("new_id"), F.col("document_id").alias("new_doc"), F.col("supersedes").alias("old_ids"), F.col("effective_from").alias("new_from"))
    relations = good.select(F.explode("old_ids").alias("source_version_id"), F.col("new_id").alias("target_version_id"), F.lit("supersedes").alias("relation_type"))
    rows = versions.join(good, F.col("document_id") == F.col("new_doc"), "left")
    is_new, is_old = F.coalesce(F.col("version_id") == F.col("new_id"), F.lit(False)), F.coalesce(F.array_contains("old_ids", F.col("version_id")), F.lit(False))
    after = rows.withColumns(
        {
            "workflow_status": F.when(is_new, "published").when(is_old, "superseded").otherwise(F.col("workflow_status")),
            "validity_status": F.when(is_new, "active").when(is_old, "superseded").otherwise(F.col("validity_status")),
            "effective_to": F.when(is_old, F.coalesce("effective_to", "new_from", as_of)).otherwise(F.col("effective_to")),
        }
    ).select(*versions.columns)
    place = F.when(F.col("new_id").isNotNull() & (F.col("default_version_id").isNull() | F.array_contains("old_ids", F.col("default_version_id"))), F.col("new_id")).otherwise(F.col("default_version_id"))
    moved = defaults.join(good, F.col("document_id") == F.col("new_doc"), "left").select("document_id", place.alias("default_version_id"))
    return Publication(judged.filter("reason is not null").select("version_id", "reason"), after, relations, moved)
