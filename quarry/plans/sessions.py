"""Registered memory, streaming and source queries, and what is left of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import filters as fl
from quarry.operators import joins as jn
from quarry.operators import memory as me
from quarry.operators import retrieval as rt
from quarry.sources import readers as rd
from quarry.streaming import jobs

from .registry import query
from .retrieval import KNN, ranked

DEVICES = ["AX[-_]?7", "K50"]
#: Fixed values, stated for the SQL by itself.
SLOT_SQL = {
    "device": "regexp_extract(tx, '(?i)(?:AX[-_]?7|K50|ECR|Q30|FIT|NSB|SBC|DNQ|PLC|CNC|测序仪|清洗机|洗衣机|洗碗机|烘干机|干衣机|笔记本|电脑|电视|耳机|设备|仪器)')",
    "component": "regexp_extract(tx, '(?i)(?:清洗泵|注射泵|泵|阀|管路|相机|温控|电源|电机|传感器|芯片|试剂|barcode|激光|主板|屏幕|电池|压缩机|排水泵)')",
    "error_code": "upper(regexp_extract(tx, '(?i)(^|[^\\pL\\pN_])([A-Z]{1,6}[-_]?\\d{2,}|E\\d{2,}|ERR[-_]?[A-Z0-9]+)([^\\pL\\pN_]|$)', 2))",
    "symptom": "regexp_extract(tx, '(?:报警|报错|异常|失败|超时|堵塞|漏液|漏水|不启动|无法启动|不工作|卡顿|噪音|压力|温度|信号|断开|连接不上|脱水|不排水|不加热)')",
}
FOCUS_SQL = "解决方案|解决办法|处理方法|怎么解决|怎么处理|怎么办|修复|恢复|原因|为什么|根因|成因|排查|检查步骤|操作步骤|步骤|怎么查|定位|总结|复盘|概括|简述|图片|图|照片|示意|截图|参数|阈值|范围|指标|多少"
EXCLUDED_SQL, ANSWER_EXCLUDED_SQL = "没有|没|不是|排除|未发现|无.*异常|不堵|没堵", "排除|不是|未发现|未检出|无.*异常|没有|没"
SIG = f"""recursive s0 as (select *, trim(coalesce(text, '')) as tx, regexp_replace(trim(coalesce(text, '')), '\\s+', '', 'g') as tight from {{turns}}),
s1 as (select *, row_number() over (partition by session_id order by turn_no) as i, {", ".join(f"{x} as {k}" for k, x in SLOT_SQL.items())},
  regexp_matches(tight, '{me.CUE}') as cue, regexp_matches(tight, '{me.SWITCH}') as sw, regexp_matches(tight, '{FOCUS_SQL}') as foc, tight = '' or regexp_matches(tight, '(?i){me.LOW_VALUE}') as low,
  (regexp_matches(tx, '{me.CONFIRMED}') or regexp_matches(tx, '{EXCLUDED_SQL}')) and regexp_replace(tx, '[,，。！？!?\\s]', '', 'g') <> '' as facts,
  list_transform(list_filter(regexp_extract_all(regexp_replace(tx, '[，。！？、；：,.!?;:()\\[\\]【】"''“”‘’]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_-]+|[一-鿿]{{2,}}'), lambda w: w not in ({", ".join(f"'{w}'" for w in me.CONTEXT_STOP)})), lambda w: lower(w))[1:50] as words from s0),
fold as (select session_id, i, turn_no, 0.0::double as score, 'new' as action, '' as conflicts, device, component, error_code, symptom, words as issue, words as asked, case when symptom <> '' then [lower(symptom)] else words end as sw_words from s1 where i = 1
  union all select session_id, i, turn_no, score, action, conflicts, case when device <> '' then device when action = 'switch' then '' else d0 end, case when component <> '' then component when action = 'switch' then '' else c0 end, case when error_code <> '' then error_code when action = 'switch' then '' else e0 end, case when symptom <> '' then symptom when action = 'switch' then '' else y0 end,
    case when action = 'continue' then issue0 else words end, words, case when symptom <> '' then [lower(symptom)] when action = 'switch' then words when len(syw) > 0 then syw when action = 'continue' then issue0 else words end
  from (select *, case when low then 'continue' when (cd or ce or sw) and score < 0.45 then 'switch' when score >= 0.65 or (facts and not (cd or ce or sw) and score >= 0.5) then 'continue' when score >= 0.4 then 'clarify' else 'switch' end as action, case when low then '' else array_to_string(list_filter([case when cd then 'device' end, case when ce then 'error_code' end], lambda x: x is not null), ',') end as conflicts
    from (select *, case when low then 0.35::double else round(least(1, greatest(0, 0.2::double + case when cue then 0.35::double else 0 end - case when sw then 0.45::double else 0 end + least(0.3::double, 0.12::double * (hd::int + hc::int + he::int)) - least(0.5::double, 0.18::double * (cd::int + ce::int))
      + case when foc and not anchored then 0.12::double else 0 end + case when facts and not anchored then 0.3::double else 0 end + case when len(list_intersect(list_distinct(list_concat(list_concat(issue0, asked0), syw)[1:50]), list_distinct(words))) >= 2 then 0.18::double else 0 end)), 9) end as score
      from (select *, bd and (contains(nd0, nd) or contains(nd, nd0)) as hd, bd and not (contains(nd0, nd) or contains(nd, nd0)) as cd, bc and (contains(nc0, nc) or contains(nc, nc0)) as hc, be and (contains(ne0, ne) or contains(ne, ne0)) as he, be and not (contains(ne0, ne) or contains(ne, ne0)) as ce, (bd and nd <> nd0) or (be and ne <> ne0) as anchored
        from (select *, nd <> '' and nd0 <> '' as bd, nc <> '' and nc0 <> '' as bc, ne <> '' and ne0 <> '' as be
          from (select s1.*, f.device as d0, f.component as c0, f.error_code as e0, f.symptom as y0, f.issue as issue0, f.asked as asked0, f.sw_words as syw, lower(s1.device) as nd, lower(f.device) as nd0, lower(s1.component) as nc, lower(f.component) as nc0, lower(s1.error_code) as ne, lower(f.error_code) as ne0 from fold f join s1 on s1.session_id = f.session_id and s1.i = f.i + 1) q1) q2) q3) q4) q5)"""


@query("mem01_transition", f"with {SIG} select session_id, turn_no, round(score, 6) as score, action as transition, conflicts from fold")
def mem01(t):
    return me.context_transition(t("turns"), DEVICES).select("session_id", "turn_no", F.round("score", 6).alias("score"), "transition", "conflicts")


@query("mem02_segments", f"with {SIG} select session_id, turn_no, sum(case when action in ('new', 'switch') then 1 else 0 end) over (partition by session_id order by turn_no)::bigint as segment from fold")
def mem02(t):
    return me.segment_sessions(me.context_transition(t("turns"), DEVICES)).select("session_id", "turn_no", "segment")


SQUEEZE = "regexp_replace(trim({}), '\\s+', ' ', 'g')"
LINE = "rtrim(left(trim(regexp_replace({}, '^[\\-\\*\\d\\.\\)、）\\s]+', '')), {}))"
FACT = "left(regexp_replace(" + SQUEEZE.format("text") + ", '^[,，。！？!?\\s]+|[,，。！？!?\\s]+$', '', 'g'), 160)"
EXTRACT = f"""x as (select session_id, turn_no, coalesce(text, '') as text, answer, (case when doc_a = doc_b then [doc_a] else [doc_a, doc_b] end)[1:n_docs] as ids, n_docs from {{turns}}), x1 as (select *, {FACT} as fact from x),
u as (select session_id, turn_no, ids, 0 as place, {LINE.format("fact", 260)} as text, unnest([case when regexp_matches(fact, '{me.CONFIRMED}') then 'confirmed_facts' end, case when regexp_matches(fact, '{EXCLUDED_SQL}') then 'excluded_causes' end, case when contains(text, '?') or contains(text, '？') then 'pending_questions' end]) as category, unnest([0.9::double, 0.92::double, 0.74::double]) as confidence, unnest(['active', 'active', 'open']) as status from x1),
l0 as (select session_id, turn_no, ids, list_filter(list_transform(string_split(answer, chr(10)), lambda z: {LINE.format(SQUEEZE.format("z"), 220)}), lambda z: z <> '' and z <> '---')[1:40] as lines from x),
l1 as (select session_id, turn_no, ids, unnest(range(1, len(lines) + 1)) as place, lines from l0), l as (select *, lines[place] as text from l1),
a as (select session_id, turn_no, ids, place, text, unnest([case when regexp_matches(text, '{me.ANSWER_FACT}') or regexp_matches(text, '{me.UNCERTAIN}') or regexp_matches(text, '{ANSWER_EXCLUDED_SQL}') then 'candidate_facts' end, case when regexp_matches(text, '{me.STEP}') then 'suggested_steps' end, case when right(text, 1) in ('?', '？') or regexp_matches(text, '{me.PENDING}') then 'pending_questions' end]) as category,
  unnest(case when len(ids) > 0 then [0.64::double, 0.68::double, 0.76::double] else [0.52::double, 0.56::double, 0.76::double] end) as confidence, unnest(['candidate', 'proposed', 'open']) as status from l),
d0 as (select session_id, turn_no, ids, unnest(range(0, len(ids))) as place from x), d as (select session_id, turn_no, [ids[place + 1]] as ids, place, concat('doc ', ids[place + 1]::varchar) as text, 'cited_docs' as category, 0.9::double as confidence, 'active' as status from d0),
al as (select * from u union all select * from a union all select * from d),
gd as (select *, regexp_replace(lower(text), '\\s+', '', 'g') as k from al where category is not null and regexp_replace(text, '\\s+', '', 'g') <> '' and not regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '{me.LOW_SIGNAL}') and (length(regexp_replace(text, '\\s+', '', 'g')) >= 4 or regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '{me.CODE}'))),
ex0 as (select session_id, turn_no, category, k, min(place) as place, arg_min(text, place) as text, max(confidence) as confidence, any_value(status) as status, arg_min(ids, place) as ids from gd group by 1, 2, 3, 4),
ex as (select * from (select *, row_number() over (partition by session_id, turn_no, category order by place desc, k) as n from ex0) where n <= 8)"""


def exchanges(t):
    both = F.slice(F.array_distinct(F.array("doc_a", "doc_b")), F.lit(1), F.col("n_docs"))
    return t("turns").withColumn("doc_ids", both)


@query("mem03_extract", f"with {EXTRACT} select session_id, turn_no, category, md5(text) as text, confidence, status, array_to_string(ids, ',') as docs from ex")
def mem03(t):
    docs = F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",")
    return me.extract_memory(exchanges(t)).select("session_id", "turn_no", "category", F.md5(F.col("text").cast("binary")).alias("text"), "confidence", "status", docs.alias("docs"))


MEMORY = EXTRACT + """, r as (select *, case when category = 'cited_docs' then ids[1]::varchar else k end as k2 from ex),
u2 as (select session_id, category, k2, round(max(confidence), 2) as confidence, arg_max(status, turn_no * 1000 + place) as status, max(turn_no) as last_seen, min(turn_no * 1000 + place) as first, arg_min(text, turn_no * 1000 + place) as text, list_sort(list_distinct(flatten(list(ids)))) as ids, count(*) as seen from r group by 1, 2, 3),
m as (select * from (select *, row_number() over (partition by session_id, category order by first desc, k2 desc) as n from u2) where n <= 24)"""
STALE = MEMORY + """, st as (select * exclude (status), case when 12 - last_seen > case category when 'confirmed_facts' then 24 when 'excluded_causes' then 24 when 'candidate_facts' then 8 when 'pending_questions' then 10 when 'suggested_steps' then 12 else 16 end then 'stale' else status end as status from m)"""


def records(t):
    return me.upsert_memory(me.extract_memory(exchanges(t)))


@query("mem04_upsert", f"with {MEMORY} select session_id, category, md5(text) as text, confidence, status, last_seen, seen, array_to_string(ids, ',') as docs from m")
def mem04(t):
    docs = F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",")
    return records(t).select("session_id", "category", F.md5(F.col("text").cast("binary")).alias("text"), "confidence", "status", "last_seen", "seen", docs.alias("docs"))


@query("mem05_stale", f"with {STALE} select session_id, category, md5(text) as text, status from st")
def mem05(t):
    return me.mark_stale(records(t), F.lit(12)).select("session_id", "category", F.md5(F.col("text").cast("binary")).alias("text"), "status")


def keywords_sql(column: str) -> str:
    """SQL of EXP-2."""
    stop = ", ".join(f"'{w}'" for w in tx.MEMORY_STOP)
    tokens = f"list_transform(regexp_extract_all(coalesce({column}, ''), '[A-Za-z][A-Za-z0-9_-]+|\\d+(?:\\.\\d+)?|[一-鿿]+'), lambda w: lower(w))"
    pairs = f"flatten(list_transform({tokens}, lambda w: case when regexp_full_match(w, '[一-鿿]{{3,}}') then list_transform(range(1, length(w)), lambda j: substr(w, j, 2)) else [w] end))"
    kept = f"list_filter({pairs}, lambda w: w not in ({stop}))"
    return f"list_filter({kept}, lambda w, j: list_position({kept}, w) = j)[1:80]"


@query("mem06_conflicts", f"""with {MEMORY}, w as (select *, {keywords_sql("text")} as words, regexp_replace(lower(text), '\\s+', '', 'g') as tight from m),
p as (select a.session_id, a.text as ta, a.first as fa, b.text as tb, b.first as fb, case when a.tight = b.tight then 1.0::double when length(a.tight) >= 6 and length(b.tight) >= 6 and (contains(a.tight, b.tight) or contains(b.tight, a.tight)) then 0.86::double when len(a.words) = 0 or len(b.words) = 0 then 0 else len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) end as similarity
  from w a join w b on a.session_id = b.session_id and a.category = 'confirmed_facts' and b.category = 'excluded_causes')
select session_id, md5(case when fa > fb then tb else ta end) as superseded, round(similarity, 6) as similarity from p where similarity >= 0.45""")
def mem06(t):
    return me.resolve_conflicts(records(t)).select("session_id", F.md5(F.col("superseded").cast("binary")).alias("superseded"), F.round("similarity", 6).alias("similarity"))


@query("mem07_rank", f"""with {STALE}, q as (select id as query_id, session_id, turn_no as now_turn, {keywords_sql("text")} as qw from {{turns}}),
s as (select query_id, category, text, last_seen, first, len(qw) as nq, round((0.52::double * case when len(qw) > 0 then len(list_intersect({keywords_sql("text")}, qw)) / len(qw) else 0.25::double end + 0.28::double * confidence + 0.2::double / (1 + least(greatest(0, now_turn - last_seen), 30) / 8)) * case status when 'active' then 1.0::double when 'open' then 0.92::double when 'proposed' then 0.78::double else 0.66::double end
  * case category when 'confirmed_facts' then 1.0::double when 'excluded_causes' then 0.95::double when 'pending_questions' then 0.85::double when 'suggested_steps' then 0.76::double when 'candidate_facts' then 0.66::double else 0.82::double end, 9) as score from q join st using (session_id) where status <> 'stale'),
top as (select *, row_number() over (partition by query_id, category order by score desc, last_seen desc, first desc, text desc) as rank from s where score >= 0.05 or nq = 0)
select query_id, category, rank, round(score, 5) as score, md5(text) as text from top where rank <= case category when 'confirmed_facts' then 5 when 'excluded_causes' then 4 when 'suggested_steps' then 4 else 3 end""")
def mem07(t):
    q = t("turns").select(F.col("id").alias("query_id"), "session_id", F.col("turn_no").alias("now_turn"), F.col("text").alias("query"))
    return me.rank_memory(me.mark_stale(records(t), F.lit(12)), q).select("query_id", "category", "rank", F.round("score", 5).alias("score"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("mem08_summary", """with r as (select *, row_number() over (partition by session_id order by message_order desc) as back from {messages}) select session_id, md5(left(string_agg(concat(case when role = 1 then 'user: ' else 'ai: ' end, left(content_text, 220)), chr(10) order by message_order), 1600)) as summary from r where back <= 12 group by 1""")
def mem08(t):
    return me.summarise(t("messages")).select("session_id", F.md5(F.col("summary").cast("binary")).alias("summary"))


@query("mem09_slots", f"""with {SIG}, o as (select f.session_id, f.turn_no, action, f.conflicts, s.device, s.component, s.error_code, s.symptom from fold f join s1 s on s.session_id = f.session_id and s.i = f.i),
p as (select session_id, turn_no, action, conflicts, unnest(['device', 'component', 'error_code', 'symptom']) as slot, unnest([device, component, error_code, symptom]) as value from o),
c as (select *, case when slot = 'device' and turn_no % 2 = 0 then 0.85::double else 0.62::double end as base from p where value <> ''), u as (select *, case when action = 'continue' then least(0.95::double, base + 0.06::double) else base end as up from c)
select session_id, turn_no, slot, value, round(case when list_contains(string_split(conflicts, ','), slot) then greatest(0.35::double, up - 0.25::double) else up end, 2) as confidence from u""")
def mem09(t):
    given = F.when(F.col("turn_no") % 2 == 0, F.array(F.lit("device"))).otherwise(F.array().cast("array<string>"))
    return me.slot_confidence(me.context_transition(t("turns"), DEVICES).withColumn("given", given)).select("session_id", "turn_no", "slot", "value", "confidence")


@query("str04_usage", """select strftime(date_trunc('hour', created_time), '%Y-%m-%d %H') as hour, case when request_type like 'parse%' then 'parse' else 'qa' end as business, sum(total_tokens)::bigint as tokens, count(*) as calls from {usage_log} group by all""")
def str04(t):
    """The batch form of the stream; tests replay the stream and compare."""
    rows = jobs.usage_counts(t("usage_log").withColumn("created_time", F.col("created_time").cast("timestamp")))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "business", "tokens", "calls")


@query("str05_activity", """with h as (select user_id, unnest(generate_series(date_trunc('hour', created_at) - interval 23 hour, date_trunc('hour', created_at), interval 1 hour)) as s from {feedback}) select user_id, strftime(s, '%Y-%m-%d %H') as hour, count(*) as n from h group by all""")
def str05(t):
    rows = jobs.activity(t("feedback").withColumn("created_at", F.col("created_at").cast("timestamp")))
    return rows.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n")


@query("src05_metadata", "select chunk_pk, doc_id, library_type, chunk_index, label from {chunks}")
def src05(t):
    return rd.scan_chunk_metadata(t("chunks"))


@query("snk01_replace", "select chunk_pk, label from {chunks} where doc_id % 5 <> 2 union all select chunk_pk + 100000, label from {chunks} where doc_id % 5 = 2 and chunk_index = 0")
def snk01(t):
    meta = rd.scan_chunk_metadata(t("chunks"))
    new = meta.filter("doc_id % 5 = 2").withColumn("chunk_pk", F.when(F.col("chunk_index") == 0, F.col("chunk_pk") + 100000)).filter("chunk_pk is not null")
    return rd.replace_chunks(meta, new).select("chunk_pk", "label")


@query("snk02_delete", "select version_id from {versions} where machine_model_id is distinct from 2")
def snk02(t):
    return rd.delete_version(t("versions"), t("versions").filter("machine_model_id = 2")).select("version_id")


@query("snk03_safe", r"select part.p_partkey, case p_partkey % 4 when 0 then concat('''=', p_name) when 1 then concat('''-', p_name) else p_name end as p_name from part")
def snk03(t):
    k = F.col("p_partkey") % 4
    return rd.spreadsheet_safe(t("part").select("p_partkey", F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, F.concat(F.lit("-"), "p_name")).otherwise(F.col("p_name")).alias("p_name")))


SECTIONS = "s as (select doc_id, unnest(range(0, 14)) as position from documents), m as (select doc_id, position, concat((position // 5 + 1)::varchar, case when position % 5 = 0 then '' else concat('.', (position % 5)::varchar) end) as marker from s)"


@query("jn08_sections", f"""with {SECTIONS}, h as (select * from m where doc_id % 2 = 0 and position in (5, 8)), n as (select doc_id, unnest([position - 1, position, position + 1]) as position from h union select m.doc_id, m.position from m join h on h.doc_id = m.doc_id and m.marker like h.marker || '.%'),
a as (select distinct n.* from n join m using (doc_id, position) union all select doc_id, position from m where doc_id not in (select doc_id from h)), r as (select *, row_number() over (partition by doc_id order by position) as rank from a) select doc_id, position, rank from r where rank <= 10""")
def jn08(t):
    base = t("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("position"))
    minor = F.col("position") % 5
    sections = base.withColumn("marker", F.concat((F.floor(F.col("position") / 5) + 1).cast("string"), F.when(minor == 0, "").otherwise(F.concat(F.lit("."), minor.cast("string")))))
    return jn.expand_sections(sections, sections.filter("doc_id % 2 = 0 and position in (5, 8)")).select("doc_id", "position", "rank")


@query("vec05_rescore", f"""with {KNN}, d as (select r.query_id, r.chunk_pk, r.score, regexp_replace(lower(d.text), '[\\s_\\-]+', ' ', 'g') as body, regexp_replace(lower(concat('doc ', r.doc_id::varchar)), '[\\s_\\-]+', ' ', 'g') as title, case (query_id // 50) % 3 when 0 then []::varchar[] when 1 then ['the', 'zzz'] else ['doc 1', 'qqq'] end as terms from ranked r join documents d using (doc_id)),
h as (select *, len(terms) as n, len(list_filter(terms, lambda x: contains(body, x) or contains(title, x) or (x = 'zzz' and (contains(body, 'd e') or contains(title, 'd e'))))) as hit, len(list_filter(terms, lambda x: contains(title, x) or (x = 'zzz' and contains(title, 'd e')))) as th from d)
select query_id, chunk_pk, round(case when n = 0 then score when hit > 0 then least(1, score + least(0.15::double, 0.08::double + 0.06::double * hit / n + 0.03::double * th / n)) else greatest(0, score - 0.10::double) end, 4) as rescored from h""")
def vec05(t):
    q = F.floor(F.col("query_id") / 50) % 3
    terms = F.when(q == 0, F.array().cast("array<string>")).when(q == 1, F.array(F.lit("the"), F.lit("zzz"))).otherwise(F.array(F.lit("doc 1"), F.lit("qqq")))
    docs = t("documents").select("doc_id", "text", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    rows = ranked(t).join(docs, "doc_id").withColumn("terms", terms).withColumn("aliases", F.create_map(F.lit("zzz"), F.array(F.lit("D__E"))))
    return rt.domain_rescore(rows, aliases="aliases").select("query_id", "chunk_pk", F.round("rescored", 4).alias("rescored"))


@query("flt17_eligible", """with t as (select id * 10 + k as trace_id, id as message_id, ts_sec + k as trace_sec, case when (id + k) % 3 = 0 then 'chat' else 'knowledge_search' end as route, (id + k) % 4 as n_documents from {messages}, (select unnest([0, 1]) as k) where id % 6 <> 5),
l as (select * from (select *, row_number() over (partition by message_id order by trace_sec desc, trace_id desc) as n from t) where n = 1)
select m.id from {messages} m left join l on l.message_id = m.id where m.role = 0 and case when route = 'knowledge_search' then n_documents > 0 else ai_reference_doc_ids <> '' end""")
def flt17(t):
    m = t("messages")
    n = F.col("id") + F.col("k")
    traces = m.filter("id % 6 <> 5").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("id") * 10 + F.col("k")).alias("trace_id"), F.col("id").alias("message_id"), (F.col("ts_sec") + F.col("k")).alias("trace_sec"),
        F.when(n % 3 == 0, "chat").otherwise("knowledge_search").alias("route"), (n % 4).alias("n_documents"), F.when(n % 2 == 0, F.array(F.lit("rag_search"))).alias("actions"),
    )
    return fl.feedback_eligible(m, traces)


@query("flt18_audit", """with m as (select id, session_id, case id % 5 when 4 then 'chat' else 'knowledge_search' end as route, case when id % 3 = 0 then []::bigint[] else [token_count % 5] end as docs, case id % 7 when 0 then 1 else 0 end as n_images, case id % 2 when 0 then 'rag_search:x' else 'other' end as action, content_text as query, list_distinct(string_split(lower(content_text), ' ')) as terms from {messages}),
a as (select session_id, arg_max(docs, id) as active_docs, arg_max(terms, id) as active_terms, arg_max(left(query, 30), id) as active_text from m group by 1),
k as (select m.*, active_docs, active_terms, regexp_replace(lower(query), '\\s+', '', 'g') as q, regexp_replace(lower(active_text), '\\s+', '', 'g') as x from m join a using (session_id) where route = 'knowledge_search' and (len(docs) > 0 or n_images > 0 or contains(action, 'rag_search'))),
r as (select *, list_has_any(docs, active_docs) or (q <> '' and x <> '' and (contains(q, x) or contains(x, q) or len(list_intersect(terms, active_terms)) >= 2)) as related from k), n as (select *, sum(related::int) over (partition by session_id) as k from r) select id, related from n where related or k < 2""")
def flt18(t):
    k = F.col("id")
    m = t("messages").select(
        "id", "session_id", F.when(k % 5 == 4, "chat").otherwise("knowledge_search").alias("route"), F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("token_count") % 5).cast("long"))).alias("docs"),
        F.when(k % 7 == 0, 1).otherwise(0).alias("n_images"), F.array(F.when(k % 2 == 0, "rag_search:x").otherwise("other")).alias("actions"), F.col("content_text").alias("query"), F.array_distinct(F.split(F.lower("content_text"), " ")).alias("terms"),
    )
    active = m.groupBy("session_id").agg(F.max_by("docs", "id").alias("active_docs"), F.max_by("terms", "id").alias("active_terms"), F.max_by(F.left("query", F.lit(30)), "id").alias("active_text"))
    return fl.audit_candidates(m.join(active, "session_id")).select("id", "related")


LEVELS = """v as (select item_id as query_id, k as level, case when k % 2 = 0 then 'keyword' else 'semantic' end as kind, case when k < 2 then text when k = 2 then text || '  ' when k = 3 then text || ' ?!' when k = 4 then '  ' || left(text, 20) || '  ' else left(text, 10 + k) end as text from benchmark, (select unnest(range(0, 6)) as k) where item_id % 4 <> 0 or k > 0),
f as (select *, case when kind = 'keyword' then regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g') else regexp_replace(lower(text), '[\\s\\pP]', '', 'g') end as key from v), g as (select * from (select *, row_number() over (partition by query_id, kind, key order by level, text) as n from f where key <> '') where n = 1),
h as (select *, max((level = 0)::int) over (partition by query_id) as orig, row_number() over (partition by query_id, level = 1 order by kind, text) as nth from g)"""


@query("vec10_plan", f"with {LEVELS} select query_id, level, kind, md5(text) as text from h where level <> 1 or orig = 0 or nth = 1")
def vec10(t):
    k = F.col("k")
    text = F.when(k < 2, F.col("text")).when(k == 2, F.concat("text", F.lit("  "))).when(k == 3, F.concat("text", F.lit(" ?!"))).when(k == 4, F.concat(F.lit("  "), F.left("text", F.lit(20)), F.lit("  "))).otherwise(F.left("text", 10 + k))
    rows = t("benchmark").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).filter("item_id % 4 <> 0 or k > 0")
    levels = rows.select(F.col("item_id").alias("query_id"), k.alias("level"), F.when(k % 2 == 0, "keyword").otherwise("semantic").alias("kind"), text.alias("text"))
    return rt.plan_queries(levels).withColumn("text", F.md5(F.col("text").cast("binary")))


JUDGED = """an as (select item_id as query_id, case item_id % 4 when 0 then ['The', 'zzqx'] when 1 then []::varchar[] when 2 then ['qqqq'] else ['de'] end as terms, case item_id % 3 when 0 then '' else 'cause' end as requested, case item_id % 5 when 0 then ['la', 'zzz'] else []::varchar[] end as symptoms, item_id % 5 = 0 as joint from benchmark),
c as (select query_id, doc_id, list_filter(list_transform(terms, lambda x: lower(x)), lambda x: contains(concat(title, ' ', lower(text)), x)) as hit, len(terms) as nt, requested <> '' as req, list_filter(symptoms, lambda x: contains(concat(title, ' ', lower(text)), x)) as shown,
  regexp_matches(title, '原因|排查|检查|处理|解决|措施|建议') as acts, regexp_matches(title, '原因|排查|检查|处理|解决|措施') as cause from an join (select doc_id, text, case doc_id % 3 when 0 then '原因' when 1 then '建议' else 'doc' end as title from documents) d on d.doc_id % 60 = an.query_id % 60 and d.doc_id % 60 <> 7),
s as (select *, nt = 0 or len(hit) > 0 as pri, (nt = 0 or len(hit) > 0) and (acts or not req) as sup from c),
g as (select query_id, list_sort(list_distinct(flatten(list(hit)))) as matched, coalesce(list_sort(list(distinct doc_id) filter (sup)), []) as supporting, coalesce(list_sort(list(distinct doc_id) filter (not pri and nt > 0)), []) as irrelevant, list_sort(list(distinct doc_id)) as every, list_distinct(flatten(list(shown))) as shown, bool_or(sup and cause) as caused from s group by 1),
f as (select an.*, g.query_id is null as nothing, coalesce(matched, []) as matched, coalesce(supporting, []) as supporting, coalesce(irrelevant, []) as irrelevant, every, shown, coalesce(caused, false) as caused from an left join g using (query_id)),
x as (select *, list_concat(case when joint then list_transform(list_filter(symptoms, lambda y: not list_contains(coalesce(shown, []), y)), lambda y: 'symptom: ' || y) else [] end, list_filter([case when joint then 'joint cause' end, case when len(terms) > 0 and len(matched) = 0 then 'primary term' end, case when requested <> '' and len(supporting) > 0 and not caused then 'cause or remedy' end], lambda y: y is not null)) as ms from f),
j as (select query_id, array_to_string(matched, ',') as matched, array_to_string(supporting, ',') as supporting, array_to_string(case when not nothing and len(supporting) = 0 and not (len(terms) > 0 and len(matched) > 0) then every else irrelevant end, ',') as irrelevant,
  case when nothing then 'none' when len(supporting) > 0 then case when len(supporting) >= 2 and len(ms) = 0 then 'strong' else 'partial' end when len(terms) > 0 and len(matched) > 0 then 'partial' else 'weak' end as relevance,
  case when nothing then 'refine' when len(supporting) > 0 then case when len(ms) = 0 then 'answer' else 'refine' end when len(terms) > 0 and len(matched) > 0 then 'refine' else 'replan' end as next_action,
  array_to_string(case when nothing then ['documents'] when len(supporting) > 0 or len(ms) > 0 then ms when len(terms) > 0 and len(matched) > 0 then ['cause or remedy'] else ['main entity'] end, ',') as missing from x)"""


def judged(t):
    k = F.col("item_id")
    none = F.array().cast("array<string>")
    asks = t("benchmark").select(
        k.alias("query_id"), F.when(k % 4 == 0, F.array(F.lit("The"), F.lit("zzqx"))).when(k % 4 == 1, none).when(k % 4 == 2, F.array(F.lit("qqqq"))).otherwise(F.array(F.lit("de"))).alias("primary_terms"),
        F.when(k % 3 != 0, "cause").otherwise("").alias("requested"), F.when(k % 5 == 0, F.array(F.lit("la"), F.lit("zzz"))).otherwise(none).alias("symptoms"), (k % 5 == 0).alias("joint"), (k % 60).alias("b"),
    )
    d = F.col("doc_id")
    docs = t("documents").select("doc_id", "text", F.when(d % 3 == 0, "原因").when(d % 3 == 1, "建议").otherwise("doc").alias("title"), (d % 60).alias("b")).filter("b <> 7")
    return rt.judge_sufficiency(docs.join(asks.select("query_id", "b"), "b").drop("b"), asks)


@query("vec12_sufficiency", f"with {JUDGED} select * from j")
def vec12(t):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return judged(t).select("query_id", text("matched"), text("supporting"), text("irrelevant"), "relevance", "next_action", "missing")


@query("vec13_refine", f"with {JUDGED}, y as (select query_id, string_split(missing, ',')[1:3] as ms from j where missing <> ''), z as (select query_id, unnest(ms) as m from y) select query_id, 'keyword' as kind, concat('unit ', query_id::varchar, ' ', m) as text from z union all select query_id, 'semantic', concat('what is known of ', m, ' for unit ', query_id::varchar) from z")
def vec13(t):
    return rt.refine_queries(judged(t).withColumn("entity", F.concat(F.lit("unit "), F.col("query_id").cast("string"))))


@query("vec15_snippets", """with recursive p as (select doc_id, text, list_sort(list_distinct(list_filter([strpos(lower(text), 'the'), strpos(lower(text), 'und'), strpos(lower(text), 'que'), strpos(lower(text), 'licen')], lambda x: x > 0))) as h from documents where text is not null),
q as (select doc_id, text, case when len(h) = 0 and text <> '' then [1]::bigint[] else h end as spots from p),
w as (select doc_id, text, spots, 1 as i, 0 as n, greatest(1, spots[1] - 250) as s, least(length(text) + 1, spots[1] + 1250) as e, true as opens from q where len(spots) > 0
  union all select doc_id, text, spots, i + 1, case when spots[i + 1] < e then n else n + 1 end, case when spots[i + 1] < e then s else greatest(1, spots[i + 1] - 250) end, case when spots[i + 1] < e then e else least(length(text) + 1, spots[i + 1] + 1250) end, spots[i + 1] >= e from w where i < len(spots))
select doc_id % 9 as query_id, doc_id, n, md5(substring(text, s, e - s)) as snippet from w where opens and n < 8""")
def vec15(t):
    terms = F.array(*[F.lit(x) for x in ("the", "und", "que", "licen")])
    out = rt.evidence_snippets(t("documents").select((F.col("doc_id") % 9).alias("query_id"), "doc_id", "text", terms.alias("terms")))
    return out.withColumn("snippet", F.md5(F.col("snippet").cast("binary")))


@query("vec15_trees", """with c as (select page_id as doc_id, page_id % 7 as query_id, string_split(regexp_extract(url, '//([^?#]*)', 1), '/') as path, url as text from pages), t as (select *, ['shop', 'page', 'a'] as terms from c),
s as (select *, len(list_filter(terms, lambda x: contains(lower(text), x))) as h, len(list_filter(terms, lambda x: contains(lower(path[-1]), x))) as f, len(list_filter(terms, lambda x: contains(lower(array_to_string(path, ' ')), x))) as p from t)
select query_id, doc_id, round(0.4::double * h / 3 + 0.3::double * f / 3 + 0.2::double * p / 3 + 0.1::double / greatest(1, len(path)), 6) as score from s where h > 0""")
def vec15_trees(t):
    pages = t("pages").select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 7).alias("query_id"), F.split(F.regexp_extract("url", r"//([^?#]*)", 1), "/").alias("path"), F.col("url").alias("text"))
    return rt.tree_evidence(pages.withColumn("terms", F.array(F.lit("shop"), F.lit("page"), F.lit("a")))).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("evl06_cases", "select left(sha1(concat_ws('|', left(b.text, 40), b.text)), 12) as case_id, b.item_id as source_doc_id, coalesce(s.title, '') as source_title from benchmark b left join {stored_titles} s on s.doc_id = b.item_id where b.item_id % 5 <> 0")
def evl06(t):
    from quarry.operators import evaluation as ev

    items = t("benchmark").select(F.col("item_id").alias("source_doc_id"), F.when(F.col("item_id") % 5 == 0, "  ").otherwise(F.left("text", F.lit(40))).alias("question"), F.col("text").alias("ground_truth"))
    return ev.build_cases(items, t("stored_titles")).select("case_id", "source_doc_id", "source_title")


@query("evl07_pairs", "select left(text, 40) as question, md5(trim(concat(text, chr(10), left(repeat(text, 3), 200)))) as positive from benchmark")
def evl07(t):
    from quarry.operators import evaluation as ev

    qa = t("benchmark").select(F.left("text", F.lit(40)).alias("question"), F.col("text").alias("answer"), F.repeat("text", F.lit(3)).alias("source_text"))
    return ev.training_pairs(qa, "answer_source", 200).withColumn("positive", F.md5(F.col("positive").cast("binary")))


@query("evl08_frame", f"with {KNN} select query_id, string_agg(chunk_pk::varchar, ',' order by rank) as contexts from ranked where rank <= 6 and (query_id // 50) % 4 <> 1 group by 1")
def evl08(t):
    from quarry.operators import evaluation as ev

    done = t("query_vectors").filter("floor(query_id / 50) % 4 = 1")
    out = ev.evaluation_frame(t("query_vectors"), ranked(t).filter("rank <= 6"), done)
    return out.select("query_id", F.array_join(F.transform("contexts", lambda x: x.cast("string")), ",").alias("contexts"))
