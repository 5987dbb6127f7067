"""Registered aggregations, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import stats as st
from quarry.operators import windows as wi

from .registry import query
from .relational import TAGGED, tagged


def library_docs(t):
    d = F.col("doc_id")
    return t("documents").select("doc_id", F.when(d % 3 == 0, "knowledge").otherwise("breakdown").alias("library"), (d % 10 == 9).cast("int").alias("is_deleted"), (d % 4 != 0).cast("int").alias("vectorized"))


@query("agg01_library", """with d as (select doc_id, case when doc_id % 3 = 0 then 'knowledge' else 'breakdown' end as library, doc_id % 10 = 9 as del, doc_id % 4 <> 0 as vec from documents),
a as (select library, count(*) as documents, count(*) filter (vec) as vectorized, count(*) filter (not vec) as waiting from d where not del group by 1),
r as (select case when o_orderkey % 2 = 0 then 'knowledge' else 'breakdown' end as library, count(*) as n from orders where o_orderstatus = 'P' group by 1),
f as (select case when id % 5 = 0 then 'knowledge' else 'breakdown' end as library, count(*) as n from {source_files} group by 1)
select library, documents, vectorized, waiting, coalesce(r.n, 0) as pending_reviews, f.n as source_files from a left join r using (library) left join f using (library)""")
def agg01(t):
    reviews = t("orders").select(F.when(F.col("o_orderkey") % 2 == 0, "knowledge").otherwise("breakdown").alias("library"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    files = t("source_files").select(F.when(F.col("id") % 5 == 0, "knowledge").otherwise("breakdown").alias("library"))
    return st.library_statistics(library_docs(t), reviews, files)


@query("agg02_categories", """with d as (select doc_id, case when doc_id % 9 = 0 then null else doc_id % 40 + 100 end as category_id from documents), c as (select category_id, count(*) as n from d group by 1)
select name, coalesce(n, 0) as n from {categories} k left join c on c.category_id = k.id union all select 'uncategorised', sum(n)::bigint from c where category_id is null or category_id not in (select id from {categories})""")
def agg02(t):
    docs = t("documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 40 + 100).alias("category_id"))
    return st.category_counts(docs, t("categories"))


@query("agg03_tokens", """select sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(total_tokens)::bigint as total_tokens, count(*) as calls, sum(case when request_type like 'parse%' then total_tokens else 0 end)::bigint as parse_tokens,
round(avg(total_tokens))::bigint as mean_tokens, count(*) filter (request_type = 'parse_image') * 578 as image_tokens, (select sum(case when role = 1 then token_count else 0 end)::bigint from {messages}) as question_tokens,
(select sum(case when role = 0 then token_count else 0 end)::bigint from {messages}) as answer_tokens, (select count(*) filter (ai_reference_doc_ids <> '') * 258 from {messages}) as reference_tokens,
sum(case when request_type like 'parse%' then 0 else total_tokens end)::bigint as qa_tokens from {usage_log}""")
def agg03(t):
    return st.token_summary(t("usage_log"), t("messages"))


@query("agg04_daily", """with d as (select unnest(generate_series(date '2024-01-26', date '2024-02-02', interval 1 day))::date as day)
select d.day::varchar as day, coalesce(sum(case when request_type like 'parse%' then total_tokens end), 0)::bigint as parse_tokens, coalesce(sum(case when request_type not like 'parse%' then total_tokens end), 0)::bigint as qa_tokens
from d left join {usage_log} u on u.created_time::date = d.day group by 1""")
def agg04(t):
    return st.token_daily(t("usage_log"), "2024-01-26", "2024-02-02")


@query("agg04_months", """with m as (select strftime(created_time + to_days((id % 90)::int), '%Y-%m') as month, coalesce(sum(case when request_type like 'parse%' then total_tokens end), 0)::bigint as parse_tokens, coalesce(sum(case when request_type not like 'parse%' then total_tokens end), 0)::bigint as qa_tokens from {usage_log} group by 1)
select *, parse_tokens + qa_tokens as month_total, sum(parse_tokens + qa_tokens) over (order by month)::bigint as so_far from m""")
def agg04_months(t):
    spread = t("usage_log").withColumn("created_time", F.col("created_time").cast("timestamp") + F.make_dt_interval((F.col("id") % 90).cast("int")))
    return st.token_months(spread)


@query("agg05_hourly", """with h as (select unnest(range(24))::int as hour) select h.hour, coalesce(sum(total_tokens), 0)::bigint as tokens from h left join {usage_log} u on hour(u.created_time) = h.hour and u.created_time::date = date '2024-01-15' group by 1""")
def agg05(t):
    return st.token_hourly(t("usage_log"), "2024-01-15")


NOW = 1706659200
SLICES = [("month", i, NOW - 30 * 86400 + i * 30 * 86400 // 7, NOW - 30 * 86400 + (i + 1) * 30 * 86400 // 7 + (i == 6)) for i in range(7)] + [("week", i, NOW - (7 - i) * 86400, NOW - (6 - i) * 86400) for i in range(7)]


@query("agg06_trends", f"""with g as (select * from (values {", ".join(str(s) for s in SLICES)}) as x("range", slice, s, e))
select "range", slice, (select count(*) from events v where epoch_us(ts) // 1000000 >= s and epoch_us(ts) // 1000000 < e and event_type = 'signup') as uploads, (select count(*) from events v where epoch_us(ts) // 1000000 >= s and epoch_us(ts) // 1000000 < e and event_type = 'click') as questions from g""")
def agg06(t):
    sec = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec")
    facts = {name: t("events").filter(F.col("event_type") == kind).select(sec) for name, kind in (("uploads", "signup"), ("questions", "click"))}
    return st.trend_series(facts, SLICES)


@query("agg07_active", """select count(distinct user_id) as active_users from (select user_id from events where event_type = 'click' union all select user_id from {messages} union all select uploader_id from {source_files} where is_deleted = 0)""")
def agg07(t):
    return st.active_users([t("events").filter("event_type = 'click'"), t("messages"), t("source_files").filter("is_deleted = 0").withColumnRenamed("uploader_id", "user_id")])


@query("agg08_tag_usage", f"""with {TAGGED}, e as (select doc_id, unnest(tag_ids) as tag_id from tagged), k as (select e.* from e join {{tags}} using (tag_id) where tag_id % 2 = 1), c as (select tag_id, count(*) as n from k group by 1)
select name, coalesce(n, 0) as n, coalesce(n, 0) >= 2 as frequent from {{tags}} left join c using (tag_id) where tag_id % 2 = 1 union all select 'untagged', count(*), count(*) >= 2 from tagged where doc_id not in (select doc_id from k)""")
def agg08(t):
    return st.tag_usage(tagged(t), t("tags").filter("tag_id % 2 = 1"))


@query("agg09_tag_counts", f"""with {TAGGED}, e as (select doc_id, unnest(tag_ids) as tag_id from tagged)
select tag_id, (select count(*) from e where e.tag_id = g.tag_id) as documents, (select count(*) from e where e.tag_id = g.tag_id and doc_id % 6 = 0) as pending from {{tags}} g""")
def agg09(t):
    return st.tag_counts(tagged(t), tagged(t).filter("doc_id % 6 = 0"), t("tags"))


@query("agg10_hot", """with p as (select id, string_split(ai_reference_doc_ids, ',') as parts from {messages} where ai_reference_doc_ids <> ''), e as (select unnest(parts) as p from p),
r as (select case when p like '%:%' then string_split(p, ':')[1] else 'knowledge' end as library, case when p like '%:%' then string_split(p, ':')[2] else p end::bigint as doc_id from e), c as (select library, doc_id, count(*) as hits from r group by all)
select library, doc_id, hits, row_number() over (order by hits desc, library, doc_id) as rank from c order by hits desc, library, doc_id limit 5""")
def agg10(t):
    from quarry.functions.text import parse_refs

    refs = t("messages").select(F.explode(parse_refs(F.col("ai_reference_doc_ids"))).alias("r")).select("r.*")
    return st.hot_documents(refs, 5)


@query("agg11_rates", """with c as (select count(*) filter (role = 1) as q, count(*) filter (role = 0) as a, count(*) filter (ai_reference_doc_ids <> '') as h from {messages}) select round(least(100, a * 100.0::double / q), 4) as answer_rate, round(least(100, h * 100.0::double / a), 4) as hit_rate from c""")
def agg11(t):
    c = t("messages").agg(F.count_if(F.col("role") == 1).alias("q"), F.count_if(F.col("role") == 0).alias("a"), F.count_if(F.col("ai_reference_doc_ids") != "").alias("h"))
    return c.select(F.round(st.rate(F.col("a"), F.col("q")), 4).alias("answer_rate"), F.round(st.rate(F.col("h"), F.col("a")), 4).alias("hit_rate"))


@query("agg12_change", """with c as (select user_id, count(*) filter (ts >= timestamp '2024-01-24') as now, count(*) filter (ts < timestamp '2024-01-24' and ts >= timestamp '2024-01-17') as before from events group by 1)
select user_id, round(case when before > 0 then (now - before) * 100.0::double / before when now > 0 then 100 else 0 end, 4) as change from c""")
def agg12(t):
    day = F.to_date("ts").cast("string")
    c = t("events").groupBy("user_id").agg(F.count_if(day >= "2024-01-24").alias("now"), F.count_if((day < "2024-01-24") & (day >= "2024-01-17")).alias("before"))
    return c.select("user_id", F.round(st.percent_change(F.col("now"), F.col("before")), 4).alias("change"))


@query("agg13_top_users", """with c as (select user_id, count(*) as ops, count(*) filter (event_type = 'click') as questions from events group by 1) select user_id, full_name, coalesce(ops, 0) as ops, coalesce(questions, 0) as questions from {users} u left join c using (user_id) where status = 1 order by ops desc nulls last, questions desc nulls last, user_id limit 10""")
def agg13(t):
    events = t("events").withColumn("event_type", F.when(F.col("event_type") == "click", "question").otherwise(F.col("event_type")))
    return st.top_users(t("users"), events, 10)


@query("agg14_tasks", """with i as (select o_custkey as task_id, case o_orderstatus when 'F' then 'success' when 'P' then 'failed' else 'active' end as status, epoch(o_orderdate)::bigint as start_sec from orders),
p as (select task_id, count(*) filter (status = 'success') as success, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'active') as active, coalesce(max(case when status = 'active' then start_sec end), min(start_sec)) as last from i group by 1)
select task_id, success, failed, active, active > 0 and 996710400 - last > 86400 * 900 as stale, case when active > 0 and 996710400 - last > 86400 * 900 then 996710400 - last else 0 end as elapsed from p""")
def agg14(t):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("active")
    items = t("orders").select(F.col("o_custkey").alias("task_id"), status.alias("status"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("start_sec"))
    return st.task_progress(items, 996710400, 86400 * 900)


@query("agg15_files", r"""with f as (select concat(p_type, '/', p_name, case p_partkey % 3 when 0 then '.PDF' when 1 then '.docx' else '' end) as path, p_size as size from part)
select lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) as extension, string_split(path, '/')[1] as folder, count(*) as files, sum(size)::bigint as bytes from f group by all""")
def agg15(t):
    ext = F.when(F.col("p_partkey") % 3 == 0, ".PDF").when(F.col("p_partkey") % 3 == 1, ".docx").otherwise("")
    return st.file_inventory(t("part").select(F.concat("p_type", F.lit("/"), "p_name", ext).alias("path"), F.col("p_size").alias("size")))


@query("agg16_status", "select coalesce(case when id % 13 = 0 then null else status end, 'unknown') as status, count(*) as n from {source_files} group by 1")
def agg16(t):
    return st.status_inventory(t("source_files").withColumn("status", F.when(F.col("id") % 13 != 0, F.col("status"))))


@query("agg17_fields", """with r as (select 'kind' as field, 0 as place, p_partkey as row, 'p_type' as origin, trim(p_type) as value from part union all select 'label', 0, p_partkey, 'p_name', trim(p_name) from part union all select 'label', 1, p_partkey, 'p_brand', trim(p_brand) from part),
f as (select field, lower(value) as k, min({'row': row, 'place': place, 'origin': origin, 'value': left(value, 120)}) as v from r where value <> '' group by all), n as (select *, row_number() over (partition by field order by v.row, v.place, k) as n from f)
select field, string_agg(concat('[', v.origin, '] ', v.value), '; ' order by n) as values from n where n <= 8 group by 1""".replace("as values", 'as "values"'))
def agg17(t):
    return st.collect_fields(t("part").select("p_partkey", "p_type", "p_name", "p_brand"), "p_partkey", {"kind": ["type"], "label": ["name", "brand"]})


@query("agg18_overview", "select 'part' as name, count(*) as n_rows, 6 as n_columns from part union all select 'events', count(*), 6 from events union all select 'documents', count(*), 5 from documents")
def agg18(t):
    return st.table_overview({n: t(n) for n in ("part", "events", "documents")})


@query("agg19_register", """with a as (select cast(substring(p_brand, 7) as int) as model_id, string_agg(distinct p_type, ',' order by p_type) as aliases from part group by 1), r as (select cast(substring(p_brand, 7) as int) as model_id, string_agg(distinct 'r' || p_size::varchar, ',' order by 'r' || p_size::varchar) as revisions from part where p_size < 20 group by 1)
select tag_id as model_id, name, coalesce(aliases, '') as aliases, coalesce(revisions, '') as revisions from {tags} g left join a on a.model_id = g.tag_id left join r on r.model_id = g.tag_id""")
def agg19(t):
    model = F.substring("p_brand", 7, 9).cast("int").alias("model_id")
    reg = st.model_register(t("tags").withColumnRenamed("tag_id", "model_id"), t("part").select(model, F.col("p_type").alias("alias")), t("part").filter("p_size < 20").select(model, F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("revision")))
    return reg.select("model_id", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("revisions", ",").alias("revisions"))


@query("agg20_usage", """with c as (select case id % 3 when 0 then 'small' else 'large' end as model, request_type, case when id % 4 = 0 then null else input_tokens end as i, input_tokens as p, case when id % 5 = 0 then null else output_tokens end as o, output_tokens as q, case when id % 2 = 0 then null else total_tokens end as t from {usage_log})
select model, request_type, sum(coalesce(i, p))::bigint as input_tokens, sum(coalesce(o, q))::bigint as output_tokens, sum(coalesce(t, coalesce(i, p) + coalesce(o, q)))::bigint as total_tokens, count(*) as calls from c group by all""")
def agg20(t):
    def unless(n, c):
        return F.when(F.col("id") % n != 0, F.col(c)).alias(c)

    calls = t("usage_log").select(F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("model"), "request_type", unless(4, "input_tokens"), F.col("input_tokens").alias("prompt_tokens"), unless(5, "output_tokens"), F.col("output_tokens").alias("completion_tokens"), unless(2, "total_tokens"))
    return st.normalise_usage(calls)


TIMED = """e as (select event_id, user_id as request_id, event_type as stage, case when event_id % 11 = 0 then 'late' when event_id % 13 = 0 then null else 'ok' end as status, (epoch_us(ts) // 1000)::bigint as ms from events),
x as (select *, lead(ms) over (partition by request_id order by ms, stage) - ms as elapsed from e), tt as (select stage, status, elapsed, ms from x union all select 'request.total', case when count(*) filter (status <> 'ok') > 0 then 'late' else 'ok' end, max(ms) - min(ms), min(ms) from e group by request_id)"""


def timed_events(t):
    status = F.when(F.col("event_id") % 11 == 0, "late").when(F.col("event_id") % 13 != 0, "ok")
    return t("events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), status.alias("status"))


@query("agg21_timing", f"""with {TIMED} select stage, count(elapsed) as n, sum(elapsed)::bigint as total_ms, max(elapsed)::bigint as max_ms, quantile_cont(elapsed, 0.5) as p50_ms, round(quantile_cont(elapsed, 0.95), 3) as p95_ms, count(*) filter (status <> 'ok') as n_failed from tt group by 1""")
def agg21(t):
    return st.stage_timing(timed_events(t)).withColumn("p95_ms", F.round("p95_ms", 3))


@query("agg21_sketches", f"""with {TIMED} select (date '1970-01-01' + (ms // 86400000)::int)::varchar as day, stage, count(elapsed) as n from tt where elapsed is not null group by 1, 2""")
def agg21_sketches(t):
    """The days' sketches; tests hold their merged quantiles against exact ones."""
    return st.timing_sketches(timed_events(t)).select(F.col("day").cast("string").alias("day"), "stage", F.kll_sketch_get_n_bigint("sketch").alias("n"))


FB = "f as (select *, epoch_us(created_at) // 1000000 as sec from {feedback})"


def feedback_sec(t):
    return t("feedback").withColumn("sec", F.unix_timestamp(F.col("created_at").cast("timestamp")))


@query("win01_latest", f"with {FB} select document_id, feedback_id, feedback_type from (select *, row_number() over (partition by document_id order by sec desc, feedback_id desc) as n from f) where n = 1")
def win01(t):
    return wi.latest(feedback_sec(t), ["document_id"], [F.desc("sec"), F.desc("feedback_id")]).select("document_id", "feedback_id", "feedback_type")


@query("win02_recent", f"with {FB} select feedback_id, count(*) over w as n_recent, coalesce(sum(feedback_id) over w, 0)::bigint as id_sum from f window w as (partition by user_id order by sec, feedback_id rows between 19 preceding and 1 preceding)")
def win02(t):
    rows = wi.recent(feedback_sec(t), "user_id", ["sec", "feedback_id"], ["feedback_id", "sec"], 20)
    return rows.select("feedback_id", F.size("recent").cast("long").alias("n_recent"), F.aggregate("recent", F.lit(0).cast("long"), lambda s, x: s + x["feedback_id"]).alias("id_sum"))


@query("win03_look_back", f"with {FB}, r as (select feedback_id, sec, list(sec) over (partition by user_id order by sec, feedback_id rows between 19 preceding and 1 preceding) as secs from f) select feedback_id, len(list_filter(coalesce(secs, []), lambda x: x >= sec - 86400)) as n_day from r")
def win03(t):
    rows = wi.recent(feedback_sec(t), "user_id", ["sec", "feedback_id"], ["feedback_id", "sec"], 20)
    return rows.select("feedback_id", F.size(wi.look_back(F.col("recent"), F.col("sec"), 86400)).cast("long").alias("n_day"))


@query("win04_next", """with v as (select o_custkey as document_id, o_orderkey % 4 + 1 as major, o_orderkey % 6 as minor from orders where o_orderstatus = 'F'), l as (select document_id, max(major * 100 + minor) as v from v group by 1)
select c_custkey as request_id, c_custkey as document_id, case when v is null then 1 when c_custkey % 3 = 0 then v // 100 + 1 else v // 100 end as major, case when v is null or c_custkey % 3 = 0 then 0 else v % 100 + 1 end as minor from customer left join l on l.document_id = c_custkey""")
def win04(t):
    versions = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 4 + 1).alias("major"), (F.col("o_orderkey") % 6).alias("minor"))
    requests = t("customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 3 == 0, "major").otherwise("minor").alias("change"))
    return wi.next_version(versions, requests)


@query("win05_summaries", """with m as (select *, count(*) over (partition by session_id) as n, row_number() over (partition by session_id order by message_order desc, id desc) as back from {messages}),
e as (select session_id, max(message_order) as upto, count(*) as messages from m where n >= 6 and back > 3 group by 1) select session_id, upto, messages from e where case when session_id % 3 = 0 then 99 else session_id % 4 end < upto""")
def win05(t):
    summaries = t("messages").select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 3 == 0, 99).otherwise(F.col("session_id") % 4).alias("covered"))
    return wi.summary_candidates(t("messages"), summaries, 6, 3)


@query("win06_distinct", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) where n = 1")
def win06(t):
    return wi.distinct_first(t("documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source")


@query("ord01_page", "select count(*) as total, 3 as page, 20 as size, ceil(count(*) / 20)::bigint as pages, 3 < ceil(count(*) / 20) as has_next, (select string_agg(doc_id::varchar, ',' order by doc_id desc) from (select doc_id from documents order by doc_id desc limit 20 offset 40)) as rows from documents".replace("as rows", 'as "ids"'))
def ord01(t):
    rows, payload = wi.paginate(t("documents").select("doc_id"), [F.desc("doc_id")], 3, 20)
    ids = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id"), False), lambda x: x.cast("string")), ",").alias("ids"))
    return payload.crossJoin(ids)


@query("ord02_merged", """select kind, id from (select 'document' as kind, doc_id as id, case when doc_id % 5 = 0 then null else n_chars end as n from documents union all select 'page', page_id, length(html) from pages) order by n desc nulls last, kind, id limit 30 offset 30""")
def ord02(t):
    a = t("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("n"))
    b = t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    return wi.merged_page(a, b, [F.desc_nulls_last("n"), F.asc("kind"), F.asc("id")], 2, 30).select("kind", "id")


@query("ord03_directory", """with n as (select page_id as key, regexp_extract(url, '//([^/]+)', 1) as parent, case when page_id % 6 = 0 then 'attachment' else 'page' end as kind, case when page_id % 3 = 0 then page_id % 10 else null end as stored_place, url as title from pages)
select key, parent, row_number() over (partition by parent order by kind = 'attachment', stored_place nulls last, title, key) as place from n""")
def ord03(t):
    nodes = t("pages").select(F.col("page_id").alias("key"), F.regexp_extract("url", "//([^/]+)", 1).alias("parent"), F.when(F.col("page_id") % 6 == 0, "attachment").otherwise("page").alias("kind"), F.when(F.col("page_id") % 3 == 0, F.col("page_id") % 10).alias("stored_place"), F.col("url").alias("title"))
    return wi.order_directory(nodes).select("key", "parent", "place")


@query("ord04_sessions", "with s as (select session_id, min(user_id) as user_id, max(ts_sec) as updated from {messages} group by 1) select session_id, updated from s where user_id = 3 order by updated desc, session_id limit 5 offset 1")
def ord04(t):
    s = t("messages").groupBy("session_id").agg(F.min("user_id").alias("user_id"), F.max("ts_sec").alias("updated"))
    return s.filter("user_id = 3").orderBy(F.desc("updated"), "session_id").offset(1).limit(5).select("session_id", "updated")


@query("ord05_pending", "select feedback_id from (select * exclude (status), case feedback_id % 3 when 0 then 'pending' when 1 then 'verifying' else 'done' end as status from {feedback}) where status in ('pending', 'verifying') order by created_at, feedback_id limit 25")
def ord05(t):
    status = F.when(F.col("feedback_id") % 3 == 0, "pending").when(F.col("feedback_id") % 3 == 1, "verifying").otherwise("done")
    return wi.pending(t("feedback").withColumn("status", status), ["pending", "verifying"], 25, ["created_at", "feedback_id"]).select("feedback_id")


@query("ord06_reviews", """select review_id, coalesce(full_name, '') as full_name from (select o_orderkey as review_id, o_custkey as owner_id, o_orderdate as created from orders union all select l_orderkey * 10 + l_linenumber + 1000000, l_suppkey + 1000000, l_shipdate from lineitem) r left join {users} u on u.user_id = r.owner_id order by created desc nulls last, review_id desc limit 60""")
def ord06(t):
    a = t("orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("created"))
    b = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1000000).alias("review_id"), (F.col("l_suppkey") + 1000000).alias("owner_id"), F.col("l_shipdate").alias("created"))
    return wi.review_queue(a, b, t("users")).limit(60).select("review_id", F.coalesce("full_name", F.lit("")).alias("full_name"))


@query("ord07_search", "select user_id, full_name from {users} where contains(lower(full_name), '0012') or contains(lower(department), 'build') order by user_id limit 30")
def ord07(t):
    return wi.search_rows(t("users"), ["full_name"], "0012").unionByName(wi.search_rows(t("users"), ["department"], "BUILD")).distinct().orderBy("user_id").limit(30).select("user_id", "full_name")


@query("set01_union", "select 'breakdown' as library, doc_id as id from documents union all select 'knowledge', page_id from pages")
def set01(t):
    return wi.all_documents(t("documents").select(F.col("doc_id").alias("id")), t("pages").select(F.col("page_id").alias("id"))).select("library", "id")


@query("set02_todo", "select doc_id from documents where source not in (select source from documents where doc_id % 50 = 7)")
def set02(t):
    return wi.todo(t("documents"), t("documents").filter("doc_id % 50 = 7"), "source").select("doc_id")
