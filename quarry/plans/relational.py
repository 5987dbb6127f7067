"""Registered filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import filters as fl
from quarry.operators import joins as jn
from quarry.operators import retrieval as rt

from .registry import query
from .retrieval import KNN, ranked

SERVED = "workflow_status = 'published' and validity_status in ('active', 'legacy_active') and index_status = 'indexed'"
LIVE_DOCS = "document_id in (select c_custkey from customer where c_custkey % 7 <> 0)"


def live_docs(t):
    return t("customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("document_id"))


def tagged(t):
    number = F.regexp_extract("file_name", r"Brand#(\d+)", 1).cast("int")
    return t("tagged_files").select(F.col("file_id").alias("doc_id"), "file_name", F.when(F.col("file_id") % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(number)).alias("tag_ids"))


TAGGED = "tagged as (select file_id as doc_id, file_name, case when file_id % 11 = 0 then []::int[] else [regexp_extract(file_name, 'Brand#([0-9]+)', 1)::int] end as tag_ids from {tagged_files})"


def with_aliases(t):
    return t("tags").withColumn("aliases", F.array(F.concat(F.lit("B-"), F.col("tag_id").cast("string")), F.concat(F.lit("family "), (F.col("tag_id") % 5).cast("string"))))


@query("flt01_live", "select id, uploader_id, status from {source_files} where is_deleted = 0")
def flt01(t):
    return fl.live(t("source_files")).select("id", "uploader_id", "status")


@query("flt02_range", "select event_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def flt02(t):
    import datetime

    return t("events").filter(fl.in_range(F.col("ts"), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 12))).select("event_id")


@query("flt03_library", """with x as (select doc_id, case doc_id % 4 when 0 then ' Knowledge ' when 1 then 'knowledge_v2' when 2 then 'breakdown' else null end as label from documents)
select doc_id, case when lower(trim(coalesce(label, ''))) = 'knowledge' then 'knowledge' else 'breakdown' end as exact, case when contains(lower(coalesce(label, '')), 'knowledge') then 'knowledge' else 'breakdown' end as part from x""")
def flt03(t):
    label = F.when(F.col("doc_id") % 4 == 0, " Knowledge ").when(F.col("doc_id") % 4 == 1, "knowledge_v2").when(F.col("doc_id") % 4 == 2, "breakdown")
    return t("documents").select("doc_id", fl.library(label).alias("exact"), fl.library(label, "contains").alias("part"))


@query("flt04_tag_any", f"with {TAGGED} select doc_id, file_name from tagged where list_has_any(tag_ids, [12, 31])")
def flt04(t):
    return fl.tag_any(tagged(t), [12, "31", "x"]).select("doc_id", "file_name")


@query("flt05_tag_keyword", f"with {TAGGED} select doc_id from tagged where len(list_filter(tag_ids, lambda x: x in (select tag_id from {{tags}} where tag_id % 5 = 3))) > 0".replace("len(list_filter(tag_ids, lambda x: x in (select tag_id from {tags} where tag_id % 5 = 3))) > 0", "tag_ids[1] in (select tag_id from {tags} where tag_id % 5 = 3)"))
def flt05(t):
    return fl.tag_keyword(tagged(t), with_aliases(t), "Family 3").select("doc_id")


@query("flt06_search", """with d as (select *, doc_id % 100 + 1 as contributor_id, case when doc_id % 3 = 0 then [11 + doc_id % 5, 21] else []::bigint[] end as tag_ids from documents),
hit as (select doc_id, full_name from d left join {users} u on u.user_id = d.contributor_id where coalesce(contains(lower(full_name), '12'), false) or contains(lower(source), '12') or coalesce(contains(lower(text), '12'), false)
  or doc_id in (select doc_id from (select doc_id, unnest(tag_ids) as x from d) z join {tags} g on g.tag_id = z.x where contains(lower(name), '12') or contains(concat('b-', tag_id::varchar), '12') or contains(concat('family ', (tag_id % 5)::varchar), '12')))
select doc_id, coalesce(full_name, '') as full_name, (select count(*) from hit) as total from hit order by doc_id desc limit 50 offset 10""")
def flt06(t):
    docs = t("documents").withColumns({"contributor_id": F.col("doc_id") % 100 + 1, "tag_ids": F.when(F.col("doc_id") % 3 == 0, F.array((F.col("doc_id") % 5 + 11).cast("int"), F.lit(21))).otherwise(F.array().cast("array<int>"))})
    found = fl.search_documents(docs, t("users"), "12", ["text", "source"], tags=with_aliases(t))
    return fl.page_of(found, [F.desc("doc_id")], 50, 10).select("doc_id", F.coalesce("full_name", F.lit("")).alias("full_name"), "total")


QTERMS = "qt as (select item_id as query_id, list_filter(list_distinct(string_split(lower(text), ' ')[1:3]), lambda x: length(x) >= 2) as terms from benchmark)"


@query("flt07_keyword_recall", f"""with {QTERMS}, found as (select query_id, doc_id, len(terms) as score from qt join documents d on len(terms) > 0 and len(list_filter(terms, lambda x: contains(lower(d.text), x))) = len(terms)),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from found) select query_id, doc_id, score::int as score, rank from r where rank <= 5""")
def flt07(t):
    terms = t("benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.slice(F.split(F.lower("text"), " "), 1, 3)).alias("terms"))
    return fl.keyword_recall(t("documents"), terms, 5, ["text"])


@query("flt08_sources", "select id, status from {source_files} where is_deleted = 0 and status in ('uploaded', 'parse_failed') and uploader_id % 10 <> 3 order by upload_time desc, id desc limit 40 offset 20")
def flt08(t):
    rows = fl.live(t("source_files")).filter(F.col("status").isin("uploaded", "parse_failed") & (F.col("uploader_id") % 10 != 3))
    return rows.orderBy(F.desc("upload_time"), F.desc("id")).offset(20).limit(40).select("id", "status")


@query("flt09_serving", f"select version_id, document_id from {{versions}} where {SERVED} and {LIVE_DOCS} and version_id % 2 = 1")
def flt09(t):
    requested = t("versions").filter("version_id % 2 = 1").select("version_id")
    return fl.serving_versions(t("versions"), live_docs(t), requested).select("version_id", "document_id")


REFS = "refs as (select o_orderkey as ref_id, case when o_orderkey % 4 = 0 then 'breakdown' else 'knowledge' end as library_type, o_custkey + case when o_orderkey % 3 = 0 then 1 else 0 end as doc_id, case when o_orderkey % 5 = 0 then null else o_orderkey end as version_id from orders)"


@query("flt10_guard", f"""with {REFS}, v as (select * from {{versions}} where {SERVED})
select ref_id from refs where library_type <> 'knowledge' or (version_id is not null and exists (select 1 from v where v.version_id = refs.version_id and v.document_id = refs.doc_id))
or (version_id is null and not exists (select 1 from v where v.document_id = refs.doc_id))""")
def flt10(t):
    refs = t("orders").select(
        F.col("o_orderkey").alias("ref_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "breakdown").otherwise("knowledge").alias("library_type"),
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("doc_id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("version_id"),
    )
    return fl.guard_refs(refs, t("versions").filter(SERVED)).select("ref_id")


@query("flt11_confidence", f"with {KNN} select query_id, chunk_pk from ranked where score * 2 >= case when (query_id // 50) % 2 = 0 then 0.5::double else 0.62::double end")
def flt11(t):
    routes = t("query_vectors").select("query_id", F.when(F.floor(F.col("query_id") / 50) % 2 == 0, "knowledge_search").otherwise("chat").alias("route"))
    return fl.confidence_cut(ranked(t).withColumn("score", F.col("score") * 2), routes).select("query_id", "chunk_pk")


@query("flt12_term_hits", """with r as (select doc_id % 50 as query_id, doc_id, text, [ 'the', 'de', 'und', 'of' ] as terms from documents),
h as (select *, len(list_filter(terms, lambda x: contains(lower(coalesce(text, '')), x))) as hits from r), m as (select *, max(hits) over (partition by query_id) as most from h)
select query_id, doc_id, hits::int as hits from m where most < 2 or hits >= greatest(2, most // 2)""")
def flt12(t):
    refs = t("documents").select((F.col("doc_id") % 50).alias("query_id"), "doc_id", "text", F.array(*[F.lit(x) for x in ("the", "de", "und", "of")]).alias("terms"))
    return fl.term_hit_filter(refs).select("query_id", "doc_id", "hits")


@query("flt13_device", f"""with {TAGGED}, q as (select tag_id as query_id, case when tag_id % 3 = 0 then concat('family ', (tag_id % 5)::varchar) else concat('b-', tag_id::varchar) end as device from {{tags}}),
a as (select tag_id, lower(name) as alias from {{tags}} union select tag_id, concat('b-', tag_id::varchar) from {{tags}} union select tag_id, concat('family ', (tag_id % 5)::varchar) from {{tags}}),
one as (select query_id, min(a.tag_id) as tag_id from q join a on a.alias = q.device group by 1 having count(distinct a.tag_id) = 1),
n as (select query_id, row_number() over (order by query_id) - 1 as place, count(*) over () as size from q), c as (select n.query_id, doc_id from tagged join n on n.place = doc_id % size or n.place = (doc_id * 7 + 3) % size)
select query_id, doc_id from (select distinct * from c) x join one using (query_id) join tagged using (doc_id) where len(tag_ids) = 0 or list_contains(tag_ids, one.tag_id)""")
def flt13(t):
    queries = t("tags").select(F.col("tag_id").alias("query_id"), F.when(F.col("tag_id") % 3 == 0, F.concat(F.lit("Family "), (F.col("tag_id") % 5).cast("string"))).otherwise(F.concat(F.lit("b-"), F.col("tag_id").cast("string"))).alias("device"))
    # Candidates: each document for two of the queries, as a search would bring them.
    ids = F.array_sort(F.collect_set("query_id"))
    places = queries.agg(ids.alias("ids"))
    docs = tagged(t)
    size = F.size("ids")
    both = F.array_distinct(F.array(F.element_at("ids", (F.col("doc_id") % size + 1).cast("int")), F.element_at("ids", ((F.col("doc_id") * 7 + 3) % size + 1).cast("int"))))
    cands = docs.crossJoin(F.broadcast(places)).select(F.explode(both).alias("query_id"), "doc_id")
    return fl.device_scope(cands, queries, with_aliases(t), docs)


@query("flt14_low_value", r"""with c as (select event_id, case when event_id % 9 = 0 then '' when event_id % 9 = 1 then 'Hello!' when event_id % 9 = 2 then 'E 4' when event_id % 9 = 3 then 'ab' else props end as text from events)
select event_id from c where not (regexp_replace(trim(text), '\s+', '', 'g') = '' or regexp_matches(lower(trim(text)), '^(hi|hello|hey|ok|okay|thanks|thank you|bye|good)[!. ]*$')
or (length(regexp_replace(trim(text), '\s+', '', 'g')) < 4 and not regexp_matches(regexp_replace(trim(text), '\s+', '', 'g'), '[A-Za-z]\d|\d{3}')))""")
def flt14(t):
    kind = F.col("event_id") % 9
    text = F.when(kind == 0, "").when(kind == 1, "Hello!").when(kind == 2, "E 4").when(kind == 3, "ab").otherwise(F.col("props"))
    return t("events").withColumn("text_", text).filter(~fl.low_value(F.col("text_"))).select("event_id")


def line_query(noise: str) -> str:
    return f"select doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda s: not ({noise}) and trim(s) <> ''), chr(10))) as cleaned from (select doc_id, concat(text, chr(10), 'Page 3 of 9', chr(10), 'Confidential draft', chr(10), 'write to me@site.org now', chr(10), '- 12 -') as text from documents)"


def noisy(t):
    return t("documents").select("doc_id", F.concat("text", F.lit("\nPage 3 of 9\nConfidential draft\nwrite to me@site.org now\n- 12 -")).alias("text"))


@query("flt15_noise_lines", line_query(rf"regexp_matches(lower(s), '{fl.NOISE}')"))
def flt15(t):
    return noisy(t).select("doc_id", F.md5(fl.drop_noise_lines(F.col("text")).cast("binary")).alias("cleaned"))


@query("flt16_contact_lines", line_query(rf"(regexp_matches(s, '{fl.CONTACT}') and length(s) <= 180) or regexp_matches(s, '^Licensed under')"))
def flt16(t):
    return noisy(t).select("doc_id", F.md5(fl.drop_contact_lines(F.col("text"), ["^Licensed under"]).cast("binary")).alias("cleaned"))


@query("flt19_visible", """with p as (select user_id, case when user_id % 600 = 0 then true when user_id % 700 = 1 then true when user_id % 2 = 0 and user_id % 500 = 2 then true else false end as sees from {users})
select p.user_id as viewer_id, count(f.id) as n from p left join {source_files} f on p.sees or f.uploader_id = p.user_id group by 1""")
def flt19(t):
    k = F.col("user_id")
    groups = t("region").select(F.col("r_regionkey").alias("group_id"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("admin"))).when(F.col("r_regionkey") == 1, F.array(F.lit("write"))).otherwise(F.array(F.lit("own"))).alias("permissions"))
    users = t("users").select("user_id", F.when(k % 600 == 0, 0).when(k % 700 == 1, 1).when(k % 2 == 1, 2).cast("long").alias("group_id"), F.when((k % 500 == 2) | (k % 700 == 1), F.array(F.lit("review"))).otherwise(F.array(F.lit("own"))).alias("permissions"))
    files = t("source_files").withColumnRenamed("uploader_id", "owner_id")
    return fl.visible_counts(files, fl.visible_scopes(fl.effective_permissions(users, groups), "read"))


@query("jn01_question_answer", """with q as (select * from {messages} where role = 1), a as (select * from {messages} where role = 0),
p as (select q.session_id, q.id as question_id, (select (a.ts_sec * 1000000 + a.id)::bigint from a where a.session_id = q.session_id and a.ts_sec >= q.ts_sec order by a.ts_sec, a.id limit 1) as k, q.ts_sec from q)
select session_id, question_id, coalesce((select id from a where a.ts_sec * 1000000 + a.id = k and a.session_id = p.session_id), -1) as answer_id, case when k is null then 'pending' else 'success' end as status from p""")
def jn01(t):
    return jn.question_answer_pairs(t("messages")).select("session_id", "question_id", F.coalesce("answer_id", F.lit(-1)).alias("answer_id"), "status")


@query("jn02_uploads", """with c as (select uploader_id, count(*) as uploads from {source_files} group by 1)
select user_id, full_name, coalesce(uploads, 0) as uploads from {users} u left join c on c.uploader_id = u.user_id where registration_status = 'approved' or uploads > 0
union all select -1, 'unknown', sum(uploads)::bigint from c where uploader_id not in (select user_id from {users}) having sum(uploads) > 0""")
def jn02(t):
    return jn.upload_contributions(t("users"), t("source_files"))


@query("jn03_titles", """with titles as (select doc_id, min(title) as title from {stored_titles} group by 1) select i.chunk_pk, coalesce(t.title, i.title) as title from {index_titles} i left join titles t using (doc_id)""")
def jn03(t):
    titles = t("stored_titles").withColumn("place", F.lit(0))
    return jn.attach_titles(t("index_titles").withColumnRenamed("title", "stored_title"), titles, ["doc_id"]).select("chunk_pk", "title")


@query("jn04_searchable", f"""with d as (select c_custkey as document_id from customer)
select document_id, -1 as version_id from d where not exists (select 1 from {{versions}} v where v.document_id = d.document_id)
union all select d.document_id, v.version_id from d join {{versions}} v on v.document_id = d.document_id where {SERVED}""")
def jn04(t):
    docs = t("customer").select(F.col("c_custkey").alias("document_id"))
    return jn.searchable(docs, t("versions"), t("versions").filter(SERVED)).select("document_id", F.coalesce("version_id", F.lit(-1)).alias("version_id"))


OVERLAP = "(b.effective_to is null or a.effective_from < b.effective_to) and (a.effective_to is null or b.effective_from < a.effective_to)"


@query("jn05_conflicts", f"""select a.version_id as left_id, b.version_id as right_id from {{versions}} a join {{versions}} b on a.document_id = b.document_id and a.machine_model_id is not distinct from b.machine_model_id and a.version_id < b.version_id and {OVERLAP}
where a.workflow_status = 'published' and b.workflow_status = 'published'""")
def jn05(t):
    return jn.validity_conflicts(t("versions").filter("workflow_status = 'published'"), ["document_id", "machine_model_id"])


@query("jn06_wildcards", f"""select a.version_id as left_id, b.version_id as right_id from {{versions}} a join {{versions}} b on a.document_id = b.document_id and a.version_id < b.version_id and {OVERLAP}
and (a.machine_model_id is null or b.machine_model_id is null or a.machine_model_id = b.machine_model_id) and (a.hardware_version is null or b.hardware_version is null or a.hardware_version = b.hardware_version)""")
def jn06(t):
    return jn.scope_overlaps(t("versions"), "document_id", ["machine_model_id", "hardware_version"])


@query("jn07_coexistence", """with v as (select *, count(*) over (partition by document_id) as n, count(*) over (partition by document_id, lower(hardware_version)) as same from {versions} where workflow_status = 'published')
select document_id, version_id, case when hardware_version is null then 'no hardware' else 'same hardware' end as reason from v where n > 1 and (hardware_version is null or same > 1)""")
def jn07(t):
    return jn.coexistence_violations(t("versions").filter("workflow_status = 'published'"))


@query("jn09_neighbours", f"""with {KNN}, top as (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_pk) as place from ranked),
a as (select query_id, doc_id, unnest([chunk_index - 1, chunk_index, chunk_index + 1]) as chunk_index, place from top where place <= 3),
n as (select query_id, a.doc_id, c.chunk_pk, min(place) as place from a join {{chunks}} c on c.doc_id = a.doc_id and c.chunk_index = a.chunk_index group by all),
r as (select *, row_number() over (partition by query_id, doc_id order by place, chunk_pk) as rank from n) select query_id, doc_id, chunk_pk, rank from r where rank <= 6""")
def jn09(t):
    return jn.neighbour_snippets(ranked(t), t("chunks")).select("query_id", "doc_id", "chunk_pk", "rank")


PAGE = r"select page_id, string_split(regexp_extract(url, '//([^?#]*)', 1), '/') as parts from pages"


@query("jn10_subtree", rf"with p as ({PAGE}) select page_id from p where parts[1] like 'm.%' or array_to_string(parts[1:2], '/') like '%.net/fr'")
def jn10(t):
    parts = F.split(F.regexp_extract("url", r"//([^?#]*)", 1), "/")
    key = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    pages = t("pages").withColumn("parts", parts).select("page_id", key(3).alias("page_key"), F.array(key(1), key(2)).alias("ancestors"))
    roots = pages.select(F.explode("ancestors").alias("root")).filter("root like 'm.%' and root not like '%/%' or root like '%.net/fr'").distinct()
    return jn.in_subtree(pages, roots)


@query("jn11_refresh", """with n as (select page_id, url, length(html) as size from pages), o as (select page_id, case when page_id % 5 = 0 then concat(url, '#old') else url end as url, length(html) as size from pages where page_id % 7 <> 0)
select n.page_id, case when o.page_id is null then 'new' when n.url = o.url and n.size = o.size then 'unchanged' else 'changed' end as action from n left join o using (page_id)""")
def jn11(t):
    pages = t("pages").select("page_id", "url", F.length("html").alias("size"))
    stored = pages.filter("page_id % 7 <> 0").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("#old"))).otherwise(F.col("url")))
    return jn.plan_refresh(pages, stored, ["page_id"], ["url", "size"])


@query("jn12_merge", f"""with {KNN}, both_ as (select query_id, library_type, doc_id, score, chunk_pk, 0 as source, rank from ranked where rank <= 10 union all select query_id, library_type, doc_id, score * 1.1::double, chunk_pk, 1, rank from ranked where rank between 6 and 20),
m as (select query_id, library_type, doc_id, max(score) as score, list_sort(list_distinct(list(chunk_pk))) as chunks, min(source * 1000 + rank) as seen from both_ group by all),
r as (select *, row_number() over (partition by query_id order by score desc, seen, library_type, doc_id) as rank from m) select query_id, library_type, doc_id, rank, array_to_string(chunks, ',') as chunks from r where rank <= 8""")
def jn12(t):
    base = ranked(t).withColumn("chunks", F.array("chunk_pk")).select("query_id", *rt.KEY, "score", "chunks", "rank")
    merged = jn.merge_ranked(base.filter("rank <= 10"), base.filter("rank between 6 and 20").withColumn("score", F.col("score") * 1.1), 8)
    return merged.select("query_id", *rt.KEY, "rank", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


@query("jn13_compare", """with m as (select *, lag(ai_reference_doc_ids) over w as b1, lag(token_count) over w as b2, row_number() over (partition by session_id order by ts_sec desc, id desc) as last, count(*) over (partition by session_id) as n from {messages} window w as (partition by session_id order by ts_sec, id))
select session_id, ai_reference_doc_ids is distinct from b1 as ai_reference_doc_ids_changed, token_count is distinct from b2 as token_count_changed from m where last = 1 and n > 1""")
def jn13(t):
    return jn.compare_last(t("messages"), ["ai_reference_doc_ids", "token_count"])


@query("jn14_names", "select f.id, coalesce(u.full_name, concat('user', f.uploader_id::varchar)) as uploader from {source_files} f left join {users} u on u.user_id = f.uploader_id")
def jn14(t):
    return jn.attach_names(t("source_files"), t("users"), "uploader_id", "uploader").select("id", "uploader")


@query("jn15_reviews", """with r as (select o_orderkey as review_id, o_custkey as doc_id, case o_orderstatus when 'F' then 'update' when 'O' then 'create' else 'delete' end as action, case when o_orderkey % 3 = 0 then '' else concat('title ', o_orderkey::varchar) end as title, case when o_orderkey % 4 = 0 then 'pending' else 'approved' end as status from orders),
l as (select * from (select *, row_number() over (partition by doc_id order by review_id desc) as n from r where status = 'approved') where n = 1),
d as (select c_custkey as doc_id, c_name as title, 1 as is_indexed from customer where c_custkey % 2 = 0)
select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(case when l.action in ('create', 'update') and trim(l.title) <> '' then l.title else d.title end, '') as title, case when l.action = 'delete' then 1 else 0 end as is_deleted, case when l.action is null then coalesce(is_indexed, 0) else 0 end as is_indexed from d full join l on l.doc_id = d.doc_id""")
def jn15(t):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    reviews = t("orders").select(
        key.alias("review_id"), F.col("o_custkey").alias("doc_id"), F.when(status == "F", "update").when(status == "O", "create").otherwise("delete").alias("action"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("title "), key.cast("string"))).alias("title"), F.when(key % 4 == 0, "pending").otherwise("approved").alias("status"),
    )
    docs = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.lit(1).alias("is_indexed"))
    return jn.apply_reviews(docs, reviews).withColumn("title", F.coalesce("title", F.lit("")))
