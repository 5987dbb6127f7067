"""Views that turn the driver tables into the domain tables of a knowledge base.

Each text runs unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "messages": """
select conv_id * 1000 + turn as id, conv_id as session_id, conv_id % 15 as user_id,
  turn + 1 as message_order,
  case role when 'assistant' then 0 when 'user' then 1 else 2 end as role,
  text as content_text,
  1704067200 + conv_id * 3600 + turn * 60 as ts_sec,
  case when role <> 'assistant' or conv_id % 4 = 3 then ''
       else concat(case when conv_id % 2 = 0 then 'knowledge:' else 'breakdown:' end,
                   cast((conv_id * 7 + turn) % 20 as string), ',', cast(turn % 5 as string)) end
    as ai_reference_doc_ids,
  length(text) as token_count
from conversations
""",
    "turns": """
select conv_id as session_id, turn + 1 as turn_no, conv_id * 1000 + turn as id,
  case (conv_id * 3 + turn) % 11 when 0 then 'AX-7 测序仪 报警 E102，怎么处理？' when 1 then '这个问题的原因是什么'
       when 2 then '已经检查过电源，没有异常' when 3 then '另一个 K50 设备漏液' when 4 then '谢谢'
       when 5 then '继续排查步骤' when 6 then '泵堵塞，压力异常 ERR-7' when 7 then 'AX-7 报警 E102 阈值多少?'
       when 8 then '换个问题，笔记本不启动' when 9 then '总结一下' else text end as text,
  concat(case (conv_id + turn) % 5 when 0 then '- 确认报警 E102' when 1 then '1. 检查电源 并重启' when 2 then '可能是主板问题，请补充型号'
       when 3 then 'ok' else '没有发现异常' end, chr(10), '---', chr(10), text) as answer,
  (conv_id + turn) % 3 as n_docs, (conv_id * 7 + turn) % 20 as doc_a, turn % 5 as doc_b
from conversations
""",
    "questions": """
select conv_id * 1000 + turn as id, (conv_id + turn) % 29 = 3 as has_images, turn % 4 = 1 as has_context,
  case turn % 3 when 0 then 'switch' else 'continue' end as context_action,
  case (conv_id * 5 + turn) % 29 when 0 then '知识库里有多少篇文档？' when 1 then '你好呀！' when 2 then '这个回答对吗？' when 3 then '请重新回答我的问题'
       when 4 then '为什么两次回答不一样' when 5 then '你的回答不对' when 6 then '你们的设备故障太多了，无语' when 7 then '你们的设备质量怎么样'
       when 8 then '查一下今天的天气' when 9 then '上面这个问题怎么解决' when 10 then '怎么办' when 11 then 'AX-7 报警的处理'
       when 12 then '   ' when 13 then 'hello' when 14 then '结合日志和曲线，综合分析 Q30 下降的根因' when 15 then 'error 42 设备老是坏' when 16 then '重新检查答案的依据'
       when 17 then '再详细说一下刚才的步骤' when 18 then '真的吗' when 19 then '我要投诉' when 20 then concat('继续 ', text)
       when 21 then concat('　', chr(9), '你好', chr(10)) when 22 then concat('设备　K50 问题', chr(160), '很多！。') when 23 then '请用测序仪Q30异常太多了' when 24 then '先看报表，　再对比两次的曲线'
       when 25 then '资料库里目前一共有多少？' when 26 then '查询一下最近的天气' when 27 then null else text end as question
from conversations
""",
    "headings": """
select doc_id, k as line_no, case (doc_id + k) % 13 when 0 then concat('## ', w) when 1 then concat('1.2.3 ', w) when 2 then concat('4．5、', w) when 3 then concat('三、', w)
       when 4 then concat('十二．', w) when 5 then concat('二十、', w) when 6 then concat('九十九 ', w) when 7 then concat('1.1.1.1.1.1.1.1 ', w) when 8 then concat('#######', w)
       when 9 then concat('　5　', w) when 10 then concat('一二、', w) when 11 then concat('3x ', w) else w end as heading
from (select doc_id, k, substring(coalesce(text, ''), k * 40 + 1, 30) as w from documents cross join (select 0 as k union all select 1 union all select 2) t) x
""",
    "sheets": """
select doc_id, concat(substring(coalesce(text, ''), 1, 30), chr(10),
  case doc_id % 6 when 0 then '| Error Code | Name |' when 1 then '| a | b |' when 2 then '|  | 设备名称 | 原因 |' when 3 then '| code | description' when 4 then '| 编码 | 名称 | x |' else '| only | text |' end, chr(10),
  case doc_id % 7 when 0 then '| not | a rule |' when 1 then '|:--- | ---: |' else '| --- | --- |' end, chr(10),
  '| ', replace(replace(replace(substring(coalesce(text, ''), 1, 2500), '|', ' '), chr(10), ' '), '. ', concat(' | ', source, ' |', chr(10), '| ')), ' | end |', chr(10), 'after', chr(10), chr(10),
  '| k | v |', chr(10), '| --- | --- |', chr(10), case when doc_id % 4 = 0 then concat('|  |  |', chr(10), '| x | |', chr(10)) else '' end, 'last | line') as text
from documents
""",
    "old_sections": """
select conv_id as document_id, conv_id * 2 as version_id, turn as position, concat(role, ' Part ', cast(turn as string)) as title, text from conversations
""",
    "new_sections": """
select conv_id as document_id, conv_id * 2 + 1 as version_id, (turn * 5 + conv_id) % 9 as position,
  case when (conv_id + turn) % 7 = 3 then concat('Renamed ', role) else concat(role, ' Part ', cast(turn as string)) end as title,
  case when (conv_id + turn) % 4 = 1 then concat(text, ' edited') else text end as text, turn
from conversations where (conv_id + turn) % 6 <> 0
union all select conv_id, conv_id * 2 + 1, 100, null, 'added', 100 from conversations where turn = 0
""",
    "wiki": """
select doc_id, concat('doc ', cast(doc_id as string)) as doc_title, doc_id * 2 + k as section_id, k as section_index, case when k = 0 then null else concat('s', cast(k as string)) end as section_title,
  case when doc_id % 4 = 3 then null else source end as site, case when doc_id % 50 = 49 then null else cast(doc_id % 37 as string) end as page_id,
  split(case doc_id % 37 % 3 when 0 then concat('P', cast(doc_id % 37 as string)) when 1 then concat('Top,P', cast(doc_id % 37 as string)) else concat('Top,Mid,p', cast(doc_id % 37 as string)) end, ',') as title_path,
  case when doc_id % 37 % 3 = 2 then split(concat(',m', cast(doc_id % 37 % 2 as string)), ',') when doc_id % 37 % 3 = 1 and doc_id % 37 % 2 = 0 then split('3', ',') else null end as ancestor_ids,
  case when doc_id % 37 % 3 = 1 then '3' else null end as parent_id,
  case when doc_id % 37 = 3 then split(concat('4,1,', cast(doc_id % 5 as string), ',4'), ',') when doc_id % 37 = 12 then split('7', ',') else null end as child_pages, cast(doc_id % 6 as string) as source_version,
  case when doc_id % 9 = 4 then cast(doc_id % 2 as string) else null end as attachment_id, case when doc_id % 9 = 4 then 'file' else null end as attachment_title,
  doc_id % 13 = 5 and k = 1 as navigation_only
from documents cross join (select 0 as k union all select 1 union all select 0) t
""",
    "usage_log": """
select event_id as id, user_id,
  case event_type when 'purchase' then 'parse_document' when 'signup' then 'parse_image'
       else 'chat' end as request_type,
  case event_type when 'error' then 'failed' when 'signup' then 'usage_missing'
       else 'success' end as status,
  cast(floor(value * 3) as bigint) as input_tokens,
  cast(floor(value) as bigint) as output_tokens,
  cast(floor(value * 3) as bigint) + cast(floor(value) as bigint) as total_tokens,
  ts as created_time
from events
""",
    "feedback": """
select event_id as feedback_id, user_id, event_id % 20 as conversation_id,
  case when event_id % 23 = 0 then 'suspicious' when event_id % 19 = 0 then 'irrelevant'
       when event_type = 'purchase' then 'positive' when event_type = 'view' then 'confirmation'
       when event_type = 'click' then 'correction' when event_type = 'signup' then 'additional_information'
       else 'negative' end as feedback_type,
  case event_id % 12 when 0 then 'ok' when 1 then '不是风扇，是电源模块' when 2 then '故障根因不是电源, 而是主板'
       when 3 then '已经确认 A102 power module' when 4 then '文档 17 是正确的参考'
       when 5 then concat('fan power ', cast(event_id % 4 as string)) when 6 then '回答错误，所有设备都这样'
       when 7 then 'unrelated to my question' when 8 then 'correct basis: the fan' when 9 then null
       when 10 then 'fan noise again' else '该设备温度异常' end as comment,
  case when event_id % 3 = 0 then '' else concat('the fan is confirmed ', cast(event_id % 5 as string)) end as answer_text,
  case event_id % 5 when 1 then 'contradict' when 2 then 'insufficient' when 3 then 'uncertain'
       else 'support' end as verification_result,
  case event_id % 8 when 0 then 'human' when 1 then 'expert' when 2 then 'rule' when 3 then 'llm'
       when 4 then 'cross_case' when 5 then 'maintenance_outcome' when 6 then 'retrieval' else 'other' end as verifier_type,
  case event_id % 6 when 0 then '' when 1 then 'document' when 2 then 'fault_case,answer'
       when 3 then 'conversation_context' when 4 then 'working_memory' else 'answer' end as evidence_types,
  case event_id % 9 when 0 then 'verified' when 1 then 'rejected' when 2 then 'promoted' else 'pending' end as status,
  case when event_id % 4 = 3 then null else concat('X-', cast(user_id % 3 as string)) end as device,
  cast(event_id % 10 as double) / 10 as confidence,
  event_id % 40 as document_id, ts as created_at
from events
""",
    "chunks": """
select vec_id as chunk_pk, cast(floor(vec_id / 5) as bigint) as doc_id,
  case when label % 2 = 0 then 'knowledge' else 'breakdown' end as library_type,
  vec_id % 5 as chunk_index, label, embedding
from embeddings
""",
    "query_vectors": """
select vec_id as query_id, label, embedding from embeddings where vec_id % 50 = 0
""",
    "qrels": """
select distinct q.vec_id as query_id, cast(floor(c.vec_id / 5) as bigint) as doc_id,
  case when c.label % 2 = 0 then 'knowledge' else 'breakdown' end as library_type
from embeddings q join embeddings c on q.label = c.label
where q.vec_id % 50 = 0
""",
    "users": """
select c_custkey as user_id, c_name as full_name, c_mktsegment as department,
  case when c_custkey % 10 = 0 then 0 else 1 end as status,
  case when c_custkey % 8 = 0 then 'pending' else 'approved' end as registration_status
from customer
""",
    "source_files": """
select o_orderkey as id,
  case when o_orderkey % 50 = 0 then 999999999 else o_custkey end as uploader_id,
  o_orderdate as upload_time,
  case o_orderstatus when 'F' then 'vectorized' when 'P' then 'parse_failed' else 'uploaded' end
    as status,
  case when o_orderkey % 40 = 1 then 1 else 0 end as is_deleted
from orders
""",
    "versions": """
select o_orderkey as version_id, o_custkey as document_id,
  case o_orderstatus when 'F' then 'published' when 'O' then 'draft' else 'superseded' end
    as workflow_status,
  case when o_orderstatus = 'F' and o_orderkey % 6 <> 0 then 'active'
       when o_orderstatus = 'F' and o_orderkey % 12 = 0 then 'legacy_active' else 'inactive' end
    as validity_status,
  case when o_orderkey % 9 = 0 then 'failed' when o_orderkey % 9 = 3 then 'pending' else 'indexed' end as index_status,
  case when o_orderkey % 5 = 0 then null else o_orderpriority end as hardware_version,
  case when o_orderkey % 4 = 0 then null else o_orderkey % 3 end as machine_model_id,
  o_orderdate as effective_from,
  case when o_orderkey % 3 = 0 then null else o_orderdate + interval '90' day end as effective_to
from orders
""",
    "categories": """
select cast(r_regionkey + 1 as bigint) as id, cast(null as bigint) as parent_id, r_name as name
from region
union all
select cast(n_nationkey + 100 as bigint), cast(n_regionkey + 1 as bigint), n_name from nation
""",
    "tags": """
select cast(substring(p_brand, 7) as int) as tag_id, p_brand as name from part group by p_brand
""",
    "tagged_files": """
select p_partkey as file_id, concat(p_name, ' ', p_brand, ' report') as file_name from part
""",
    "index_titles": """
select doc_id, doc_id * 3 + k as chunk_pk,
  case when doc_id % 11 = 0 and k = 1 then 'old title' else concat('doc ', cast(doc_id as string)) end
    as title
from documents cross join (select 0 as k union all select 1 union all select 2) t
""",
    "stored_titles": """
select doc_id,
  case when doc_id % 13 = 0 then 'renamed' else concat('doc ', cast(doc_id as string)) end as title
from documents where doc_id % 17 <> 0
""",
}


def with_views(sql: str) -> str:
    """A query with the views it names in front, for an engine that has the driver tables only."""
    used = [name for name in VIEWS if f"{{{name}}}" in sql]
    body = sql
    for name in used:
        body = body.replace(f"{{{name}}}", name)
    if not used:
        return body
    head = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in used)
    recursive = body.lstrip().lower().startswith("with recursive")
    if body.lstrip().lower().startswith("with"):
        body = body.lstrip()[len("with recursive") if recursive else len("with") :]
        return f"with {'recursive ' if recursive else ''}{head},{body}"
    return f"with {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over the driver tables of one folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in f"{sql} ".replace("\n", " ")}
    for t in named:
        sql = f" {sql} ".replace("\n", " ").replace(f" {t} ", f" {{{t}}} ")
    return spark.sql(sql, **named)
