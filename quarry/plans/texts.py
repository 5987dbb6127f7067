"""Registered column expressions and chunking jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import slots as sl
from quarry.functions import text as tx
from quarry.operators import chunking as ch
from quarry.operators import tables as tb

from .registry import query

STOP = ", ".join(f"'{w}'" for w in tx.STOP)
LATIN1 = r"list_transform(regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9][A-Za-z0-9_\-.]*)', 1), lambda x: lower(x))"


@query("exp01_terms", f"""with p as (select doc_id, unnest({LATIN1}) as t, generate_subscripts({LATIN1}, 1) as i from documents),
f as (select doc_id, t, min(i) as i from p where t not in ({STOP}) group by all), r as (select *, row_number() over (partition by doc_id order by i) as n from f)
select doc_id, string_agg(t, ' ' order by n) as terms from r where n <= 40 group by 1""")
def exp01(t):
    return t("documents").select("doc_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms")).filter("terms <> ''")


STOP2 = ", ".join(f"'{w}'" for w in tx.MEMORY_STOP)
KEYWORDS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z0-9_-]+|\d+(?:\.\d+)?|[一-鿿]+'), lambda w: lower(w))"
KEYWORDS = f"flatten(list_transform({KEYWORDS}, lambda w: case when length(w) > 2 and regexp_full_match(w, '[一-鿿]+') then list_transform(range(1, length(w)), lambda j: substr(w, j, 2)) else [w] end))"


@query("exp02_keywords", f"""with x as (select doc_id as id, text from documents union all select id, question from {{questions}}), p as (select id, unnest({KEYWORDS.format("text")}) as t, generate_subscripts({KEYWORDS.format("text")}, 1) as i from x),
f as (select id, t, min(i) as i from p where t not in ({STOP2}) group by all), r as (select *, row_number() over (partition by id order by i) as n from f)
select id, md5(string_agg(t, ' ' order by n)) as keywords from r where n <= 80 group by 1""".replace("doc_id as id", "-1 - doc_id as id"))
def exp02(t):
    rows = t("documents").select((-1 - F.col("doc_id")).alias("id"), "text").unionByName(t("questions").select("id", F.col("question").alias("text")))
    return rows.select("id", F.array_join(tx.memory_keywords(F.col("text")), " ").alias("k")).filter("k <> ''").select("id", F.md5(F.col("k").cast("binary")).alias("keywords"))


@query("exp03_similarity", """with m as (select id, content_text as a, coalesce(lag(content_text) over (partition by session_id order by message_order, id), '') as b from {messages}),
k as (select id, regexp_replace(lower(a), '\\s+', '', 'g') as x, regexp_replace(lower(b), '\\s+', '', 'g') as y, list_distinct(string_split(lower(a), ' ')) as ka, list_distinct(string_split(lower(b), ' ')) as kb from m)
select id, round(case when x <> '' and x = y then 1.0::double when length(x) >= 6 and length(y) >= 6 and (contains(x, y) or contains(y, x)) then 0.86::double else len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb))) end, 6) as similarity from k""")
def exp03(t):
    from pyspark.sql import Window as W

    before = F.coalesce(F.lag("content_text").over(W.partitionBy("session_id").orderBy("message_order", "id")), F.lit(""))
    m = t("messages").withColumn("b", before)
    keys = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return m.select("id", F.round(tx.text_similarity(F.col("content_text"), F.col("b"), keys("content_text"), keys("b")), 6).alias("similarity"))


@query("exp04_alias", r"""select f.file_id, g.tag_id from {tagged_files} f join {tags} g on regexp_matches(concat(' ', f.file_name, ' '), concat('(?i)[^A-Z0-9+]', replace(g.name, '#', '\#'), '[^A-Z0-9+]'))""")
def exp04(t):
    return t("tagged_files").join(F.broadcast(t("tags")), tx.alias_match(F.col("file_name"), F.col("name"))).select("file_id", "tag_id")


@query("exp05_terms", r"""select p_partkey, contains(regexp_replace(lower(p_type || '_-  ' || p_name), '[\s_\-]+', ' ', 'g'), 'e part') as hit, regexp_replace(lower(p_type || '_-  ' || p_name), '[\s_\-]+', ' ', 'g') as norm from part""")
def exp05(t):
    text = F.concat("p_type", F.lit("_-  "), "p_name")
    return t("part").select("p_partkey", tx.contains_term(text, F.array(F.lit("E__part"))).alias("hit"), tx.normalise_term(text).alias("norm"))


MIXED = "m as (select event_id, case event_id % 4 when 0 then '[\"a\", \"' || event_type || '\", 7]' when 1 then '\"one, two\"' when 2 then event_type || ' , x,, y' else null end as s from events)"


def mixed(t):
    k = F.col("event_id") % 4
    return t("events").select("event_id", F.when(k == 0, F.concat(F.lit('["a", "'), "event_type", F.lit('", 7]'))).when(k == 1, '"one, two"').when(k == 2, F.concat("event_type", F.lit(" , x,, y"))).alias("s"))


@query("exp06_list", f"""with {MIXED} select event_id, case event_id % 4 when 0 then array_to_string(from_json(s, '["VARCHAR"]'), '|') when 1 then json_extract_string(s, '$') when 2 then array_to_string(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''), '|') else '' end as items from m""")
def exp06(t):
    return mixed(t).select("event_id", F.array_join(tx.parse_list(F.col("s")), "|").alias("items"))


@query("exp07_refs", """with p as (select id, unnest(string_split(ai_reference_doc_ids, ',')) as p from {messages} where ai_reference_doc_ids <> '')
select id, string_agg(case when p like '%:%' then p else 'knowledge:' || p end, ',' order by case when p like '%:%' then p else 'knowledge:' || p end) as refs from p group by 1""")
def exp07(t):
    refs = F.transform(tx.parse_refs(F.col("ai_reference_doc_ids")), lambda r: F.concat_ws(":", r["library"], r["doc_id"].cast("string")))
    return t("messages").filter("ai_reference_doc_ids <> ''").select("id", F.array_join(F.array_sort(refs), ",").alias("refs"))


@query("exp08_tags", """select event_id, case event_id % 3 when 0 then concat(user_id::varchar, ',7') when 1 then case when user_id = 3 then '3' else concat('3,', user_id::varchar) end else '' end as tags from events where user_id <> 7""")
def exp08(t):
    u = F.col("user_id").cast("string")
    s = F.when(F.col("event_id") % 3 == 0, F.concat(u, F.lit("，7, x"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('["3","'), u, F.lit('","3"]'))).otherwise("none")
    return t("events").filter("user_id <> 7").select("event_id", F.array_join(F.transform(tx.parse_tag_ids(s), lambda x: x.cast("string")), ",").alias("tags"))


@query("exp09_keys", "select doc_id, left(sha1(concat_ws('|', doc_id::varchar, source)), 12) as case_id, sha256(concat_ws('|', coalesce(text, ''))) as content from documents")
def exp09(t):
    return t("documents").select("doc_id", tx.stable_key([F.col("doc_id"), F.col("source")]).alias("case_id"), tx.stable_key([F.col("text")], "sha256", 64).alias("content"))


@query("exp10_query_key", r"select doc_id, md5(regexp_replace(lower(text), '[\s\pP]', '', 'g')) as k from documents")
def exp10(t):
    return t("documents").select("doc_id", F.md5(tx.query_key(F.col("text")).cast("binary")).alias("k"))


@query("exp11_titles", r"select doc_id, case when trim(text) = '' then 'untitled' else left(regexp_replace(trim(text, ' '), '\s+', ' ', 'g'), 100) end as title from documents")
def exp11(t):
    return t("documents").select("doc_id", tx.clean_title(F.col("text")).alias("title"))



SLOT_SQL = r"""select session_id, turn_no, regexp_extract(text, '(?i)(?:AX[-_]?7|K50|ECR|Q30|FIT|NSB|SBC|DNQ|PLC|CNC|测序仪|清洗机|洗衣机|洗碗机|烘干机|干衣机|笔记本|电脑|电视|耳机|设备|仪器)') as device,
  regexp_extract(text, '(?i)(?:清洗泵|注射泵|泵|阀|管路|相机|温控|电源|电机|传感器|芯片|试剂|barcode|激光|主板|屏幕|电池|压缩机|排水泵)') as component,
  upper(regexp_extract(text, '(?i)(^|[^\pL\pN_])([A-Z]{1,6}[-_]?\d{2,}|E\d{2,}|ERR[-_]?[A-Z0-9]+)([^\pL\pN_]|$)', 2)) as error_code,
  regexp_extract(text, '报警|报错|异常|失败|超时|堵塞|漏液|漏水|不启动|无法启动|不工作|卡顿|噪音|压力|温度|信号|断开|连接不上|脱水|不排水|不加热') as symptom,
  upper(regexp_extract(text, '(?i)(^|[^\pL\pN_])(Q30|ECR|FIT|NSB|SBC|DNQ|K50)([^\pL\pN_]|$)', 2)) as metric,
  case when regexp_matches(t, '解决方案|解决办法|处理方法|怎么解决|怎么处理|怎么办|修复|恢复') then 'solution' when regexp_matches(t, '原因|为什么|根因|成因') then 'reason'
    when regexp_matches(t, '排查|检查步骤|操作步骤|步骤|怎么查|定位') then 'troubleshooting' when regexp_matches(t, '总结|复盘|概括|简述') then 'summary'
    when regexp_matches(t, '图片|图|照片|示意|截图') then 'image' when regexp_matches(t, '参数|阈值|范围|指标|多少') then 'parameter' else '' end as focus
from (select *, regexp_replace(text, '[\s\x{3000}]+', '', 'g') as t from {turns})"""


@query("exp12_slots", SLOT_SQL)
def exp12(t):
    found = sl.extract_slots("text", devices=["AX[-_]?7", "K50"], metrics=["K50"])
    return t("turns").select("session_id", "turn_no", found.alias("s")).select("session_id", "turn_no", "s.*")


HAN = "一二三四五六七八九"


@query("exp13_levels", rf"""with m as (select *, regexp_extract(line, '^(#{{1,6}})[\s\x{{3000}}]', 1) as h, replace(regexp_extract(line, '^(\d+([.．]\d+)*)[、.．\s\x{{3000}}]', 1), '．', '.') as n, regexp_extract(line, '^([一二三四五六七八九十]+)[、.．\s\x{{3000}}]', 1) as z
  from (select *, trim(heading, chr(12288) || ' ' || chr(9)) as line from {{headings}}))
select doc_id, line_no, case when n <> '' then n when z = '' then '' when contains(z, '十') then
    cast(case when left(z, 1) = '十' then 10 else 10 * instr('{HAN}', left(z, 1)) end + case when right(z, 1) = '十' then 0 else instr('{HAN}', right(z, 1)) end as varchar) when length(z) = 1 then cast(instr('{HAN}', z) as varchar) else '' end as marker,
  case when h <> '' then length(h) when n <> '' then least(6, 1 + length(n) - length(replace(n, '.', ''))) else 1 end as level from m""")
def exp13(t):
    return t("headings").select("doc_id", "line_no", tx.section_marker(F.col("heading")).alias("s")).select("doc_id", "line_no", "s.marker", "s.level")


@query("exp14_codes", "select doc_id, concat('KB-', lpad(doc_id::varchar, 6, '0')) as code from documents")
def exp14(t):
    return t("documents").select("doc_id", tx.document_code(F.col("doc_id")).alias("code"))


@query("exp15_ids", "select chunk_pk, case when library_type = 'knowledge' then doc_id + 1000000000 else doc_id end as encoded, library_type as decoded_library, doc_id as decoded_id from {chunks}")
def exp15(t):
    code = tx.encode_id(F.col("doc_id"), F.col("library_type"))
    return t("chunks").select("chunk_pk", code.alias("encoded"), tx.decode_id(code)["library"].alias("decoded_library"), tx.decode_id(code)["id"].alias("decoded_id"))


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


@query("chk01_windows", f"""with d as (select doc_id, {WORDS} as w from documents), p as (select doc_id, w, unnest(range(greatest(ceil((len(w) - 20) / 80)::bigint - 1, 0) + 1)) as i from d where len(w) > 0)
select doc_id, i::int as chunk_index, md5(array_to_string(w[i * 80 + 1:i * 80 + 100], ' ')) as chunk, least(100, len(w) - i * 80)::int as n_words from p""")
def chk01(t):
    return ch.window_chunks(t("documents"), 100, 20).withColumn("chunk", F.md5(F.col("chunk").cast("binary")))


@query("chk02_paragraphs", r"""with recursive l as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda p: trim(p, ' ')), lambda p: p <> '') as ps from documents),
c as (select doc_id, ps, list_transform(ps, lambda p: len(regexp_extract_all(p, '[\pL\pN]+|[^\s\pL\pN]'))) as ns from l where len(ps) > 0),
f as (select doc_id, ps, ns, 1 as i, 0 as k, ns[1] as n from c union all select doc_id, ps, ns, i + 1, case when n + ns[i + 1] > 60 then k + 1 else k end, case when n + ns[i + 1] > 60 then ns[i + 1] else n + ns[i + 1] end from f where i < len(ps)),
g as (select doc_id, k, string_agg(ps[i], chr(10) order by i) as t, sum(ns[i]) as n from f group by 1, 2),
cut as (select doc_id, k, regexp_extract(t, '^(\s*([\pL\pN]+|[^\s\pL\pN])){0,60}', 0) as chunk from g)
select doc_id, k as chunk_index, length(chunk) as n_chars, md5(chunk) as chunk from cut""")
def chk02(t):
    return ch.pack_paragraphs(t("documents"), 60).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("chk03_lossless", "select doc_id, md5(text) as whole, true as fits from documents where text <> ''")
def chk03(t):
    parts = ch.lossless_split(t("documents"), 600)
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))["chunk"], "")
    return parts.groupBy("doc_id").agg(F.md5(whole.cast("binary")).alias("whole"), (F.max(F.length("chunk")) <= 600).alias("fits"))


@query("chk04_overlap", r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as ws from documents),
f as (select doc_id, ws, 1 as i, 0 as k, ws[1] as cur from w where len(ws) > 0 union all select doc_id, ws, i + 1, case when length(cur) + length(ws[i + 1]) + 1 > 1800 then k + 1 else k end, case when length(cur) + length(ws[i + 1]) + 1 > 1800 then concat(right(cur, 180), ' ', ws[i + 1]) else concat(cur, ' ', ws[i + 1]) end from f where i < len(ws)),
c as (select doc_id, k, arg_max(cur, i) as chunk from f group by 1, 2) select doc_id, k as chunk_index, length(chunk) as n_chars, md5(chunk) as chunk from c""".replace("ws[1] as cur", "ws[1] as cur"))
def chk04(t):
    return ch.overlap_split(t("documents"), 1800, 180).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk"))


#: Tables of the sheets, by the SQL's own rules: runs of lines between bars with a separator in second place.
TABLES = r"""l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from {sheets}),
b as (select *, starts_with(trim(s), '|') and ends_with(trim(s), '|') as bar from l), r as (select *, line - row_number() over (partition by doc_id order by line) as island from b where bar),
q as (select *, row_number() over (partition by doc_id, island order by line) - 2 as row_no, first(line) over (partition by doc_id, island order by line) as start, list_transform(string_split(trim(trim(s), '|'), '|'), lambda c: trim(c)) as cells from r),
h as (select doc_id, start, any_value(cells) filter (row_no = -1) as header, bool_or(row_no = 0 and regexp_matches(trim(s), '^\|\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$')) as ok from q group by 1, 2),
t as (select doc_id, start, header, row_number() over (partition by doc_id order by start) as table_no from h where ok),
body as (select t.*, q.row_no, q.cells from t left join q on q.doc_id = t.doc_id and q.start = t.start and q.row_no > 0)"""


@query("chk05_tables", f"with {TABLES} select doc_id, table_no::int as table_no, start::int as line, array_to_string(header, '~') as header, count(row_no) as n_rows, md5(coalesce(string_agg(array_to_string(cells, '~'), '#' order by row_no), '')) as cells from body group by 1, 2, 3, 4")
def chk05(t):
    rows = tb.extract_tables(t("sheets"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row_no").isNotNull(), F.struct("row_no", "cells")))), lambda r: F.array_join(r["cells"], "~")), "#")
    return rows.groupBy("doc_id", "table_no", "line", F.array_join("header", "~").alias("header")).agg(F.count("row_no").alias("n_rows"), F.md5(cells.cast("binary")).alias("cells"))


@query("chk05_rest", f"""with {TABLES}, o as (select l.doc_id, l.line, case when t.start is null then l.s when l.line = t.start then concat('【表格：', array_to_string(list_filter(header, lambda c: c <> ''), ' / '), '，共', (select count(*) from q x where x.doc_id = t.doc_id and x.start = t.start and x.row_no > 0)::varchar, '行，已按表格记录单独向量化。】') end as s
from l left join q on q.doc_id = l.doc_id and q.line = l.line left join t on t.doc_id = q.doc_id and t.start = q.start)
select doc_id, md5(trim(coalesce(string_agg(s, chr(10) order by line) filter (trim(s) <> ''), ''))) as rest from o group by 1""")
def chk05_rest(t):
    return tb.without_tables(t("sheets")).select("doc_id", F.md5(F.col("rest").cast("binary")).alias("rest"))


@query("chk06_records", f"""with {TABLES}, k as (select *, list_filter(list_distinct(list_transform(header, lambda h: regexp_replace(lower(h), '[^a-z0-9一-鿿]+', '', 'g'))), lambda x: x <> '') as ks from body where row_no is not null),
j as (select *, len(list_filter(ks, lambda x: x in ('devicecode', 'errorcode', 'code', '错误码', '错误代码', '故障码', '报警码', 'description', 'vendorcode', 'workflowstep', 'devicename', 'position', '设备码', '设备名称', '描述', '处理方法', '原因', '解决方案'))) >= 2
  or len(list_filter(ks, lambda x: contains(x, 'errorcode') or contains(x, '错误码'))) > 0 or (len(list_filter(ks, lambda x: contains(x, 'code') or contains(x, '码'))) > 0 and len(list_filter(ks, lambda x: contains(x, 'name') or contains(x, '名称'))) > 0) as record from k),
rec as (select doc_id, table_no, row_no - 1 as chunk_no, row_no as a, row_no as b, start, array_to_string(list_filter(list_transform(range(1, greatest(len(header), len(cells)) + 1), lambda i: case when coalesce(cells[i], '') <> '' then concat(case when coalesce(header[i], '') = '' then concat('字段', i::varchar) else header[i] end, ': ', cells[i]) end), lambda x: x is not null), chr(10)) as text from j where record),
g0 as (select doc_id, table_no, (row_no - 1) // 18 as chunk_no, min(row_no) as a, max(row_no) as b, any_value(start) as start, list_filter(list_concat([any_value(header)], list(cells order by row_no)), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) as rows from j where not record group by 1, 2, 3),
g1 as (select *, list_max(list_transform(rows, lambda r: len(r))) as wide from g0 where len(rows) > 0),
grp as (select doc_id, table_no, chunk_no, a, b, start, array_to_string(list_concat(list_concat([concat('| ', array_to_string(list_resize(rows[1], wide, ''), ' | '), ' |')], [concat('| ', array_to_string(list_transform(range(0, wide), lambda i: '---'), ' | '), ' |')]), list_transform(rows[2:], lambda r: concat('| ', array_to_string(list_resize(r, wide, ''), ' | '), ' |'))), chr(10)) as text from g1)
select doc_id, table_no::int as table_no, chunk_no::int as chunk_no, a::int as row_start, b::int as row_end, start::int as line, kind, md5(text) as text from (select *, 'record_row' as kind from rec where text <> '' union all select *, 'row_group' from grp) z""")
def chk06(t):
    chunks = tb.table_chunks(tb.extract_tables(t("sheets")))
    return chunks.select("doc_id", "table_no", "chunk_no", "row_start", "row_end", "line", "kind", F.md5(F.col("text").cast("binary")).alias("text"))


@query("chk07_batches", """with recursive r as (select p_brand as b, p_partkey as n, length(concat_ws(' ', p_name, p_type)) as c, row_number() over (partition by p_brand order by p_partkey) as i from part),
f as (select b, i, n, 0 as batch, 1 as k, c as chars from r where i = 1 union all select r.b, r.i, r.n, case when f.k >= 20 or f.chars + r.c > 400 then f.batch + 1 else f.batch end, case when f.k >= 20 or f.chars + r.c > 400 then 1 else f.k + 1 end, case when f.k >= 20 or f.chars + r.c > 400 then r.c else f.chars + r.c end from f join r on r.b = f.b and r.i = f.i + 1)
select b as "table", batch, min(n) as first, count(*) as n_rows from f group by 1, 2""")
def chk07(t):
    return ch.batch_rows(t("part").select(F.col("p_brand").alias("table"), F.col("p_partkey").alias("n"), F.concat_ws(" ", "p_name", "p_type").alias("t")), 20, 400)


@query("chk08_assemble", """with k as (select chunk_pk, doc_id, chunk_index, library_type from {chunks} where doc_id in (select doc_id from documents))
select k.doc_id, chunk_index, left(sha1(concat_ws('|', library_type, k.doc_id::varchar, chunk_index::varchar)), 16) as chunk_id, concat('Title: doc ', k.doc_id::varchar, chr(10), 'chunk ', chunk_pk::varchar) as text from k where library_type = 'knowledge'""")
def chk08(t):
    pieces = t("chunks").filter("library_type = 'knowledge'").select("doc_id", "chunk_index", F.concat(F.lit("chunk "), F.col("chunk_pk").cast("string")).alias("chunk"))
    docs = t("documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("knowledge").alias("library"))
    return ch.assemble_chunks(pieces, docs).drop("metadata")


@query("chk08_sections", f"""with {TABLES}, o as (select l.doc_id, l.line, case when t.start is null then l.s when l.line = t.start then concat('【表格：', array_to_string(list_filter(header, lambda c: c <> ''), ' / '), '，共', (select count(*) from q x where x.doc_id = t.doc_id and x.start = t.start and x.row_no > 0)::varchar, '行，已按表格记录单独向量化。】') end as s
from l left join q on q.doc_id = l.doc_id and q.line = l.line left join t on t.doc_id = q.doc_id and t.start = q.start),
x as (select doc_id, string_agg(trim(s), chr(10) order by line) as rest from o where trim(s) <> '' group by 1),
d as (select doc_id, concat(case when doc_id % 3 = 0 then concat('标签：', lang, '，', source, chr(10)) else '' end, '文档标题：doc ', doc_id::varchar, chr(10), '目录编号：', case when doc_id % 2 = 0 then concat((doc_id % 9)::varchar, '.1') else '' end, chr(10), '目录标题：', case when doc_id % 5 = 0 then concat('doc ', doc_id::varchar) else 'part' end) as head,
  case when doc_id % 4 = 1 then concat(chr(10), '章节路径：a / b') else '' end as path from documents)
select d.doc_id, md5(concat(head, path, chr(10), '章节正文：', rest)) as text_chunk from d join x using (doc_id)""")
def chk08_sections(t):
    k = F.col("doc_id")
    docs = t("documents").select("doc_id", F.concat(F.lit("doc "), k.cast("string")).alias("title"), F.when(k % 3 == 0, F.array("lang", "source")).alias("tags"))
    sections = t("sheets").select(
        "doc_id", k.alias("section_id"), F.when(k % 5 != 0, "part").alias("section_title"), F.when(k % 2 == 0, F.concat((k % 9).cast("string"), F.lit(".1"))).alias("marker"),
        F.when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).alias("heading_path"), "text", F.lit(None).cast("array<string>").alias("images"),
    )
    out = tb.assemble_sections(docs, sections, budget=3000)  # one chunk a text, as the SQL has it
    return out.filter("kind = 'section_text'").select("doc_id", F.md5(F.col("content").cast("binary")).alias("text_chunk"))


@query("chk09_fields", "select p_partkey, 'p_name' as field, p_name as chunk from part union all select p_partkey, 'p_type', p_type from part union all select p_partkey, 'p_brand', p_brand from part where p_partkey % 3 <> 0")
def chk09(t):
    part = t("part").withColumn("p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise(" "))
    return ch.field_chunks(part, "p_partkey", ["p_name", "p_type", "p_brand"])


@query("chk10_tree", """with recursive p(id, path) as (select id, name from {categories} where parent_id is null union all select c.id, concat(p.path, ' / ', c.name) from p join {categories} c on c.parent_id = p.id),
k as (select parent_id, string_agg(name, '; ' order by name) as kids, count(*) as n from {categories} where parent_id is not null group by 1)
select id, 'path' as kind, path as chunk from p where id not in (select parent_id from k) union all select id, 'branch', concat(path, ': ', kids) from p join k on k.parent_id = p.id where n > 1""")
def chk10(t):
    return ch.tree_chunks(t("categories"))


@query("chk11_short", """with m as (select session_id, message_order, case when id % 9 = 0 then '| a | b |' else content_text end as body, case when id % 5 = 0 then '' else concat('t', message_order::varchar) end as title from {messages}),
s as (select *, row_number() over (partition by session_id order by message_order) as rn, length(regexp_replace(body, '\\s', '', 'g')) < 150 and body <> '| a | b |' as short from m),
g as (select *, sum(case when short and rn > 1 then 0 else 1 end) over (partition by session_id order by message_order) as g from s)
select session_id as doc_id, g::bigint as g, min(message_order) as position, count(*) as merged, md5(string_agg(body, chr(10) order by message_order)) as body, coalesce(string_agg(title, ' / ' order by message_order) filter (title <> ''), '') as title from g group by all""")
def chk11(t):
    body, title = F.when(F.col("id") % 9 == 0, "| a | b |").otherwise(F.col("content_text")), F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("message_order").cast("string")))
    sections = t("messages").select(F.col("session_id").alias("doc_id"), F.col("message_order").alias("position"), body.alias("body"), title.alias("title"))
    return ch.merge_short(sections, 150, title="title").withColumn("body", F.md5(F.col("body").cast("binary")))


@query("chk12_blocks", """with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from {sheets}),
f as (select *, line % 4 = 0 and not starts_with(s, '|') as h, starts_with(s, '|') as t from l), o as (select *, h or t <> coalesce(lag(t) over (partition by doc_id order by line), false) as opens from f),
b as (select *, sum(opens::int) over (partition by doc_id order by line) as block, last_value(case when h then s end ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and current row) as title from o),
c as (select *, case when t then 0 else floor(coalesce(sum(length(s)) over (partition by doc_id, block order by line rows between unbounded preceding and 1 preceding), 0) / 700) end as part from b)
select doc_id, block::bigint as block, part::bigint as part, min(line)::int as first_line, count(*) as n_lines, min(title) as title, bool_or(t) as is_table from c group by 1, 2, 3""")
def chk12(t):
    bar = F.col("s").startswith("|")
    return ch.heading_blocks(ch.lines_of(t("sheets")), (F.col("line") % 4 == 0) & ~bar, 700, table=bar)


@query("chk13_markers", """with recursive s as (select session_id as doc_id, message_order as position, (token_count % 3 + 1)::int as level, row_number() over (partition by session_id order by message_order) as i from {messages}),
f as (select doc_id, position, i, level, case when level = 1 then 1 else 1 end as a, case when level = 1 then 0 when level = 2 then 1 else 1 end as b, case when level = 3 then 1 else 0 end as c from s where i = 1
  union all select s.doc_id, s.position, s.i, s.level, case when s.level = 1 then f.a + 1 else greatest(f.a, 1) end, case when s.level = 1 then 0 when s.level = 2 then f.b + 1 else greatest(f.b, 1) end, case when s.level = 3 then f.c + 1 else 0 end from f join s on s.doc_id = f.doc_id and s.i = f.i + 1)
select doc_id, position, case level when 1 then a::varchar when 2 then concat(a::varchar, '.', b::varchar) else concat(a::varchar, '.', b::varchar, '.', c::varchar) end as marker from f""")
def chk13(t):
    return ch.fill_markers(t("messages").select(F.col("session_id").alias("doc_id"), F.col("message_order").alias("position"), (F.col("token_count") % 3 + 1).alias("level")))


@query("chk14_directory", """select doc_id, concat((doc_id % 9 + 1)::varchar, '.', (doc_id % 5)::varchar) as marker, source as title, (doc_id % 300)::int as page, 2 as level from documents where doc_id % 2 = 0""")
def chk14(t):
    s = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string"), F.lit("  "), "source", F.lit(" ...... "), (F.col("doc_id") % 300).cast("string"))).otherwise(F.lit("no entry"))
    return ch.parse_directory(t("documents").select("doc_id", s.alias("s"))).drop("s")


@query("chk15_context", """with r as (select doc_id % 25 as query_id, doc_id, text, row_number() over (partition by doc_id % 25 order by doc_id) as rank from documents), b as (select *, coalesce(sum(length(text)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from r)
select query_id, doc_id, md5(left(text, (5000 - before)::int)) as text from b where before < 5000""")
def chk15(t):
    from pyspark.sql import Window as W

    q = (F.col("doc_id") % 25).alias("query_id")
    refs = t("documents").select(q, "doc_id", "text", F.row_number().over(W.partitionBy(F.col("doc_id") % 25).orderBy("doc_id")).alias("rank"))
    return ch.fit_context(refs, 5000).select("query_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text"))
