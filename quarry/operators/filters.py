"""Filters and predicates of the knowledge base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_BLOCK = 2048


def live(df: DataFrame) -> DataFrame:
    """FLT-1: rows that are not deleted."""
    return df.filter(F.col("is_deleted") == 0)


def in_range(column: Column, start=None, end=None) -> Column:
    """FLT-2: half-open range; either end may be missing."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= F.lit(start))
    if end is not None:
        out = out & (column < F.lit(end))
    return out


def library(column: Column, mode: str = "exact") -> Column:
    """FLT-3: the library of a label: by equality or by containment, else breakdown."""
    low = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    hit = low == "knowledge" if mode == "exact" else low.contains("knowledge")
    return F.when(hit, "knowledge").otherwise("breakdown")


def tag_any(df: DataFrame, ids: list, tags: str = "tag_ids") -> DataFrame:
    """FLT-4: rows with any of the tags; values that are no numbers are ignored, no tag means no filter."""
    wanted = [int(i) for i in ids if str(i).strip().isdigit()]
    return df.filter(F.arrays_overlap(tags, F.array(*[F.lit(i) for i in wanted]))) if wanted else df


def tag_keyword(docs: DataFrame, tags: DataFrame, keyword: str, doc_id: str = "doc_id") -> DataFrame:
    """FLT-5: documents with a tag whose name or alias contains the keyword."""
    low = keyword.lower()
    named = F.lower("name").contains(low) | F.exists("aliases", lambda a: F.lower(a).contains(low))
    hit = docs.select(doc_id, F.explode("tag_ids").alias("tag_id")).join(tags.filter(named).select("tag_id"), "tag_id").select(doc_id).distinct()
    return docs.join(hit, doc_id, "left_semi")


def search_documents(docs: DataFrame, users: DataFrame, keyword: str, columns: list[str], *, tags: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """FLT-6: documents of which a column, the contributor or a tag (its name or an alias) holds the keyword, with the contributor's name.

    Letters of either case; a document whose contributor is unknown is found, too, without a
    name. A document is found once, however many of its parts hold the keyword.
    """
    low = keyword.lower()
    people = users.select(F.col("user_id").alias("contributor_id"), "full_name")
    rows = docs.join(people, "contributor_id", "left")
    hit = F.coalesce(F.lower("full_name").contains(low), F.lit(False))
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    if tags is not None:
        named = F.lower("name").contains(low) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(low))
        tagged = docs.select(doc_id, F.explode("tag_ids").alias("tag_id")).join(tags.filter(named).select("tag_id"), "tag_id").select(F.col(doc_id).alias("tagged_id")).distinct()
        rows = rows.join(tagged, F.col(doc_id) == F.col("tagged_id"), "left")
        hit = hit | F.col("tagged_id").isNotNull()
    found = rows.filter(hit)
    return found.drop("tagged_id") if tags is not None else found


def page_of(found: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """FLT-6: one page of what a search found, each row with the ``total`` of all pages."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).orderBy(*order)


def keyword_recall(docs: DataFrame, queries: DataFrame, k: int, fields: list[str], *, doc_id: str = "doc_id", query: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """FLT-7: documents that hold all terms of a query, each in some field; terms under two characters do not count.

    Queries go out in blocks of bounded size. A task makes one automaton of a block's
    distinct terms, reads each document once, and counts the terms of every query by an
    inverted list. Case is ignored; ties go to the smaller document id.
    """
    terms = queries.select(query, F.array_distinct(F.transform(F.filter("terms", lambda t: F.length(t) >= 2), F.lower)).alias("terms")).filter(F.size("terms") > 0)
    base = docs.select(F.col(doc_id).alias("id_"), F.concat_ws("\0", *[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]).alias("text_"))
    schema = f"{query} {queries.schema[query].dataType.simpleString()}, {doc_id} {docs.schema[doc_id].dataType.simpleString()}, score int"
    kinds = {query: to_arrow_type(queries.schema[query].dataType), doc_id: to_arrow_type(docs.schema[doc_id].dataType), "score": pa.int32()}
    blocks, found = max(1, -(-terms.count() // block)), None
    for b in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).collect()
        if rows:
            part = base.mapInArrow(_recall(docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows]), kinds), schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), doc_id))).filter(F.col("rank") <= k)


def _recall(sent, kinds: dict):
    def run(batches):
        import ahocorasick

        words, lists = {}, []
        for place, (_, terms) in enumerate(sent.value):
            for term in terms:
                at = words.setdefault(term, len(words))
                if at == len(lists):
                    lists.append([])
                lists[at].append(place)
        finder = ahocorasick.Automaton()
        for term, place in words.items():
            finder.add_word(term, place)
        finder.make_automaton()
        wanted = np.array([len(terms) for _, terms in sent.value])
        ids = [query for query, _ in sent.value]
        lists = [np.array(x) for x in lists]
        for batch in batches:
            out = [[], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {place for _, place in finder.iter(text)}
                if not seen:
                    continue
                count = np.bincount(np.concatenate([lists[place] for place in seen]), minlength=len(wanted))
                for q in np.flatnonzero(count == wanted).tolist():
                    for column, value in zip(out, (ids[q], doc, int(wanted[q]))):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds.values())], list(kinds))

    return run


def serving_versions(versions: DataFrame, docs: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """FLT-9: published, valid, indexed versions of live documents, and of the requested ones if given."""
    ok = (F.col("workflow_status") == "published") & F.col("validity_status").isin("active", "legacy_active") & (F.col("index_status") == "indexed")
    out = versions.filter(ok).join(docs.select("document_id").distinct(), "document_id", "left_semi")
    return out if requested is None else out.join(requested.select("version_id").distinct(), "version_id", "left_semi")


def guard_refs(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """FLT-10: references to allowed versions; unversioned ones only of documents without versions; the fault library passes."""
    managed = versions.select(F.col("document_id").alias("doc_id")).distinct()
    allowed = versions.select(F.col("document_id").alias("doc_id"), "version_id").distinct()
    knowledge = refs.filter("library_type = 'knowledge'")
    good = knowledge.filter("version_id is not null").join(allowed, ["doc_id", "version_id"], "left_semi")
    free = knowledge.filter("version_id is null").join(managed, "doc_id", "left_anti")
    return refs.filter("library_type <> 'knowledge'").unionByName(good).unionByName(free)


def confidence_cut(refs: DataFrame, routes: DataFrame, query: str = "query_id") -> DataFrame:
    """FLT-11: references that reach the floor of their query's route."""
    floor = F.when(F.col("route") == "knowledge_search", 0.5).otherwise(0.62)
    return refs.join(routes, query).filter(F.col("score") >= floor)


def term_hit_filter(refs: DataFrame, query: str = "query_id", terms: str = "terms", text: str = "text") -> DataFrame:
    """FLT-12: references with at least half of the query's best number of term hits (two at least), where that leaves any."""
    hits = F.size(F.filter(terms, lambda t: F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(t))))
    w = W.partitionBy(query)
    rows = refs.withColumn("hits", hits).withColumn("most", F.max("hits").over(w))
    return rows.filter((F.size(terms) < 2) | (F.col("most") < 2) | (F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("most") / 2)))).drop("most")


def device_scope(cands: DataFrame, queries: DataFrame, tags: DataFrame, docs: DataFrame, query: str = "query_id") -> DataFrame:
    """FLT-13: the candidates (query, doc_id) that are in the scope of their query's device.

    Where the device names exactly one tag, those are documents with it or with no tag;
    queries whose device is unknown or ambiguous have no scope and no rows.
    """
    names = tags.select("tag_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("alias")).select("tag_id", F.lower(F.trim("alias")).alias("alias"))
    one = queries.withColumn("alias", F.lower(F.trim("device"))).join(names, "alias").groupBy(query).agg(F.count_distinct("tag_id").alias("n"), F.min("tag_id").alias("tag_id")).filter("n = 1")
    own = docs.select("doc_id", F.coalesce("tag_ids", F.array().cast("array<int>")).alias("own_"))
    rows = cands.join(one.select(query, "tag_id"), query).join(own, "doc_id")
    return rows.filter((F.size("own_") == 0) | F.array_contains("own_", F.col("tag_id"))).select(*cands.columns)


#: Greetings and thanks that carry no content.
SMALL_TALK = r"^(hi|hello|hey|ok|okay|thanks|thank you|bye|good)[!. ]*$"


def low_value(column: Column) -> Column:
    """FLT-14: empty texts, greetings, and compact texts under four characters without an error code."""
    text = F.trim(F.coalesce(column, F.lit("")))
    compact = F.regexp_replace(text, r"\s+", "")
    return (compact == "") | F.lower(text).rlike(SMALL_TALK) | ((F.length(compact) < 4) & ~compact.rlike(r"[A-Za-z]\d|\d{3}"))


#: Page numbers and confidentiality footers.
NOISE = r"^\s*(-?\s*\d{1,4}\s*-?|page\s+\d+(\s*(/|of)\s*\d+)?|confidential.*|all rights reserved.*)\s*$"
CONTACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|https?://|www\."


def drop_lines(column: Column, drop) -> Column:
    """A text without the lines that ``drop`` holds true for, and without blank ones."""
    return F.array_join(F.filter(F.split(column, "\n"), lambda s: ~drop(s) & (F.trim(s) != "")), "\n")


def drop_noise_lines(column: Column) -> Column:
    """FLT-15."""
    return drop_lines(column, lambda s: F.lower(s).rlike(NOISE))


def drop_contact_lines(column: Column, patterns: list[str]) -> Column:
    """FLT-16: configured patterns always; mail and web addresses only in lines of at most 180 characters."""

    def drop(s):
        out = s.rlike(CONTACT) & (F.length(s) <= 180)
        for p in patterns:
            out = out | s.rlike(p)
        return out

    return drop_lines(column, drop)


def effective_permissions(users: DataFrame, groups: DataFrame) -> DataFrame:
    """FLT-19: a user's permission set: that of its role group where it has one, else its own old ones.

    ``users`` are (user_id, group_id, permissions), ``groups`` (group_id, permissions); admin
    implies every permission, write and review imply read.
    """
    rows = users.join(groups.select("group_id", F.col("permissions").alias("of_group")), "group_id", "left")
    own = F.coalesce("of_group", "permissions", F.array().cast("array<string>"))
    read = F.when(F.arrays_overlap(own, F.array(F.lit("write"), F.lit("review"))), F.array(F.lit("read"))).otherwise(F.array().cast("array<string>"))
    full = F.array(*[F.lit(x) for x in ("admin", "read", "write", "review")])
    return rows.select("user_id", F.when(F.array_contains(own, "admin"), F.array_union(own, full)).otherwise(F.array_union(own, read)).alias("permissions"))


def visible_scopes(users: DataFrame, permission: str) -> DataFrame:
    """FLT-19: (viewer_id, scope) of every user: ``all`` with the permission, else ``own``. ``users`` have their effective permissions; null is none."""
    sees = F.coalesce(F.array_contains("permissions", permission), F.lit(False))
    return users.groupBy(F.col("user_id").alias("viewer_id")).agg(F.when(F.bool_or(sees), "all").otherwise("own").alias("scope"))


def visible_rows(df: DataFrame, scopes: DataFrame, viewer, *, owner: str = "owner_id") -> DataFrame:
    """FLT-19: the rows that one viewer sees: all of them, or their own; an unknown viewer sees none."""
    one = scopes.filter(F.col("viewer_id") == F.lit(viewer)).select("scope").limit(1)
    return df.crossJoin(F.broadcast(one)).filter((F.col("scope") == "all") | (F.col(owner) == F.lit(viewer))).drop("scope")


def visible_counts(df: DataFrame, scopes: DataFrame, *, owner: str = "owner_id") -> DataFrame:
    """FLT-19: how many rows each viewer sees: rows are counted once by owner and once in all, whoever sees them."""
    own = df.groupBy(F.col(owner).alias("owner_")).agg(F.count(F.lit(1)).alias("own_"))
    whole = df.agg(F.count(F.lit(1)).alias("all_"))
    rows = scopes.join(own, F.col("viewer_id") == F.col("owner_"), "left").crossJoin(F.broadcast(whole))
    return rows.select("viewer_id", F.when(F.col("scope") == "all", F.col("all_")).otherwise(F.coalesce("own_", F.lit(0))).alias("n"))


def feedback_eligible(messages: DataFrame, traces: DataFrame) -> DataFrame:
    """FLT-17: answers that feedback may refer to.

    Their latest trace is of the knowledge route, has documents, and fetched or reused them
    or has documents at all; without a trace, or on another route, they cite some themselves.
    """
    w = W.partitionBy("message_id").orderBy(F.desc("trace_sec"), F.desc("trace_id"))
    last = traces.withColumn("n", F.row_number().over(w)).filter("n = 1")
    rows = messages.filter("role = 0").join(last, messages["id"] == last["message_id"], "left")
    acted = F.exists(F.coalesce("actions", F.array().cast("array<string>")), lambda a: a.startswith("rag_search") | a.startswith("reuse_previous_references"))
    fetched = (F.col("n_documents") > 0) & (acted | (F.col("n_documents") > 0))
    own = F.coalesce("ai_reference_doc_ids", F.lit("")) != ""
    return rows.filter(F.when(F.col("route") == "knowledge_search", fetched).otherwise(own)).select("id")


def audit_candidates(traces: DataFrame, least: int = 2) -> DataFrame:
    """FLT-18: per session the substantive traces that have to do with the active context; all substantive ones where under ``least`` do.

    Substantive are traces of the knowledge route with documents, images or a retrieval
    action. They share a document with the context, hold its text or lie in it, or share two terms.
    """
    acted = F.exists("actions", lambda a: a.contains("rag_search") | a.contains("reuse_previous_references"))
    rows = traces.filter((F.col("route") == "knowledge_search") & ((F.size("docs") > 0) | (F.col("n_images") > 0) | acted))
    tight = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    asked, active = tight("query"), tight("active_text")
    inside = (asked != "") & (active != "") & (asked.contains(active) | active.contains(asked))
    words = (asked != "") & (active != "") & (F.size(F.array_intersect("terms", "active_terms")) >= 2)
    related = F.arrays_overlap("docs", "active_docs") | inside | words
    rows = rows.withColumn("related", F.coalesce(related, F.lit(False)))
    n = F.sum(F.col("related").cast("int")).over(W.partitionBy("session_id"))
    return rows.withColumn("n_related", n).filter(F.col("related") | (F.col("n_related") < least)).drop("n_related")
