"""Registered corpus quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import directory as dr
from quarry.operators import quality as ql
from quarry.operators import versioning as vn

from .registry import query
from .relational import TAGGED, live_docs, tagged, with_aliases

TERMS = {"the license": "[L]", "license": "[l]", "Apache": "[A]", "§": "[S]"}


@query("qlt01_mask", "select doc_id, md5(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the license', '[L]', 'g'), '(?i)license', '[l]', 'g'), '(?i)Apache', '[A]', 'g'), '§', '[S]')) as masked from documents")
def qlt01(t):
    return t("documents").select("doc_id", F.md5(ql.mask_text(F.col("text"), TERMS).cast("binary")).alias("masked"))


#: A nested record of an event; what its SQL expects is put together by hand.
MASKED = """case event_id % 6 when 0 then 'not json click' when 1 then concat('{"a": click', event_type) when 2 then concat('["', case when event_type = 'click' then '[C]' else event_type end, '", ["a [C]", ', cast(event_id as varchar), ']]')
  when 3 then null when 4 then '7' else concat('{"a": {"b": ["big [C]", 7, {"keep": {"x": "click"}, "x": "[C] me", "n": ', cast(event_id as varchar), '}]}, "keep": {"y": ["click"]}, "f": 1.5, "t": true, "z": null, "设备": "[D]-', case when event_type = 'click' then '[C]' else event_type end, '"}') end"""


@query("qlt02_mask_json", f"select event_id, {MASKED} as masked from events")
def qlt02(t):
    k, kind = F.col("event_id").cast("string"), F.col("event_type")
    nested = F.concat(F.lit('{"a":{"b":["big CLICK",7,{"keep":{"x":"click"},"x":"Click me","n":'), k, F.lit('}]},"keep":{"y":["click"]},"f":1.5,"t":true,"z":null,"设备":"设备-'), kind, F.lit('"}'))
    by = F.col("event_id") % 6
    s = F.when(by == 0, "not json click").when(by == 1, F.concat(F.lit('{"a": click'), kind)).when(by == 2, F.concat(F.lit('  ["'), kind, F.lit('",["a cLick",'), k, F.lit("]]"))).when(by == 4, "7").when(by == 5, nested)
    return t("events").select("event_id", ql.mask_json(s, {"click": "[C]", "设备": "[D]"}, ["keep"]).alias("masked"))


@query("qlt03_assign", r"""with f as (select file_id, case file_id % 10 when 0 then concat('(', (file_id % 60)::varchar, '-TS相关-NCMR报告) ', file_id::varchar) when 1 then concat('设备 手册 ', file_name) else file_name end as file_name from {tagged_files}),
g as (select tag_id, name as alias from {tags} union all select tag_id, concat('设备 ', case when tag_id % 2 = 0 then '手册' else '图' end) from {tags} union all select tag_id, concat('M-', tag_id::varchar) from {tags}),
hit as (select f.file_id, g.tag_id from f join g on regexp_matches(concat(' ', f.file_name, ' '), concat('(?i)[^A-Z0-9+]', replace(g.alias, '#', '\#'), '[^A-Z0-9+]'))),
short as (select f.file_id, g.tag_id from f join g on lower(regexp_extract(f.file_name, '^\(([A-Z0-9+]+)-TS相关-NCMR报告', 1)) = lower(split_part(g.alias, '-', -1)) where f.file_id not in (select file_id from hit))
select file_id, array_to_string(list_sort(list_distinct(list(tag_id))), ',') as tag_ids from (select * from hit union all select * from short) group by 1""")
def qlt03(t):
    k, n = F.col("file_id"), F.col("tag_id")
    name = F.when(k % 10 == 0, F.concat(F.lit("("), (k % 60).cast("string"), F.lit("-TS相关-NCMR报告) "), k.cast("string"))).when(k % 10 == 1, F.concat(F.lit("设备 手册 "), "file_name")).otherwise(F.col("file_name"))
    others = F.array(F.concat(F.lit("设备 "), F.when(n % 2 == 0, "手册").otherwise("图")), F.concat(F.lit("M-"), n.cast("string")))
    tagged = ql.assign_tags(t("tagged_files").select("file_id", name.alias("file_name")), t("tags").withColumn("others", others), aliases="others")
    return tagged.select("file_id", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tag_ids"))


@query("qlt04_conflicts", "select concat('family ', (tag_id % 5)::varchar) as alias, count(*) as n_tags from {tags} group by 1 having count(*) > 1")
def qlt04(t):
    return ql.tag_conflicts(with_aliases(t))


@query("qlt05_repeated", r"""with b as (select doc_id, unnest(string_split(text, chr(10))) as block, generate_subscripts(string_split(text, chr(10)), 1) as page from documents), n as (select *, regexp_replace(lower(trim(block)), '\s+', ' ', 'g') as norm from b),
c as (select *, count(*) over (partition by doc_id, norm) as seen, max(page) over (partition by doc_id) as pages from n) select doc_id, page, md5(block) as block from c where pages < 3 or seen < greatest(3, pages // 2)""")
def qlt05(t):
    blocks = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "block")).select("doc_id", "block", (F.col("p") + 1).alias("page"))
    return ql.drop_repeated_blocks(blocks).select("doc_id", "page", F.md5(F.col("block").cast("binary")).alias("block"))


@query("qlt06_images", """with i as (select l_orderkey % 500 as doc_id, l_linenumber as slide, (l_partkey % 7)::varchar as sha1, l_quantity as area, l_orderkey * 10 + l_linenumber as image_id from lineitem),
c as (select doc_id, sha1 from i group by all having count(distinct slide) >= 5) select image_id from i where area > 40 or not exists (select 1 from c where c.doc_id = i.doc_id and c.sha1 = i.sha1)""")
def qlt06(t):
    images = t("lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_linenumber").alias("slide"), (F.col("l_partkey") % 7).cast("string").alias("sha1"), F.col("l_quantity").alias("area"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"))
    return ql.drop_repeated_images(images, 5, 40).select("image_id")


SIGN = "xor((p_partkey * 2654435761) % 4294967296, case when p_partkey % 3 = 0 then (p_partkey % 8) * 576460752303423488 else 0 end)"


@query("qlt07_signatures", f"""with i as (select p_partkey as image_id, {SIGN} as s, 1.0::double + p_size / 10.0::double as a from part where p_partkey % 20 <> 0), r as (select p_partkey as ref_id, {SIGN} as s, 1.0::double + p_size / 10.0::double as a from part where p_partkey % 20 = 0),
m as (select image_id, ref_id, bit_count(xor(i.s, r.s))::bigint as d from i join r on bit_count(xor(i.s, r.s)) <= 6 and abs(ln(i.a / r.a)) <= 0.30) select image_id, ref_id, d as distance from (select *, row_number() over (partition by image_id order by d, ref_id) as n from m) where n = 1""")
def qlt07(t):
    k = F.col("p_partkey")
    high = F.when(k % 3 == 0, (k % 8) * (1 << 59)).otherwise(0)
    base = t("part").select("p_partkey", ((k * 2654435761) % 4294967296).bitwiseXOR(high).alias("s"), (1.0 + F.col("p_size") / 10.0).alias("a"))
    images = base.filter("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("image_id"), F.col("s").alias("signature"), F.col("a").alias("aspect"))
    refs = base.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("ref_id"), F.col("s").alias("ref_signature"), F.col("a").alias("ref_aspect"))
    return ql.match_signatures(images, refs)


@query("qlt08_contained", r"""with p as (select item_id * 2 as para_id, text as body from benchmark union all select doc_id * 2 + 1, text from documents),
c as (select para_id, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) as t from p), k as (select t, min(para_id) as para_id from c where length(t) >= 30 group by t)
select a.para_id as inner_id, b.para_id as outer_id from k a join k b on length(b.t) > length(a.t) and contains(concat(' ', b.t, ' '), concat(' ', a.t, ' '))""")
def qlt08(t):
    paras = t("benchmark").select((F.col("item_id") * 2).alias("para_id"), F.col("text").alias("body")).unionByName(t("documents").select((F.col("doc_id") * 2 + 1).alias("para_id"), F.col("text").alias("body")))
    return ql.contained_duplicates(paras)


@query("qlt09_reconcile", """with p as (select doc_id, string_agg(distinct title, '|' order by title) as titles, count(distinct title) as n, count(*) as chunks, min(title) as one from {index_titles} group by 1),
s as (select p.*, case when s.title is null then 'stale' when n > 1 then 'mixed' when one <> s.title then 'title mismatch' else 'ok' end as state from p left join {stored_titles} s using (doc_id)) select doc_id, chunks, titles, state, state <> 'ok' as rebuild from s""")
def qlt09(t):
    return ql.reconcile(t("index_titles"), t("stored_titles"))


@query("qlt10_mixed", "select doc_id, string_agg(distinct title, '|' order by title) as titles from {index_titles} where doc_id in (select doc_id from {stored_titles}) group by 1 having count(distinct title) > 1")
def qlt10(t):
    return ql.mixed_titles(t("index_titles"), t("stored_titles")).select("doc_id", F.array_join("titles", "|").alias("titles"))


@query("qlt11_repair", """with d as (select o_orderkey as doc_id, o_custkey % 400 as path, case when o_orderkey % 3 = 0 then o_orderkey % 700 else null end as source_id from orders), s as (select c_custkey as source_id, c_custkey % 450 as path from customer),
n as (select *, row_number() over (partition by path order by source_id is not null desc, doc_id desc) as n from d), g as (select path, min(source_id) as first_source, count(*) as sources from s group by 1)
select coalesce(n.path, g.path) as path, coalesce(doc_id, -1) as doc_id, case when doc_id is null then 'orphan source' when n > 1 then 'delete' when sources is null then 'orphan document' when sources > 1 then 'several sources' when source_id is distinct from first_source then 'link' else 'keep' end as action from n full join g on g.path = n.path""")
def qlt11(t):
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 400).alias("path"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 700).alias("source_id"))
    return ql.repair_plan(docs, t("customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 450).alias("path")))


@query("qlt12_stale", "select id from {source_files} where id not in (select doc_id * 3 from documents)")
def qlt12(t):
    return ql.stale_links(t("source_files").withColumn("doc_id", F.col("id")), t("documents").select((F.col("doc_id") * 3).alias("doc_id"))).select("id")


@query("qlt12_reviews", """with s as (select o_orderkey::varchar as path, case when o_orderkey % 4 = 0 then null else o_orderkey % 900 end as review_id from orders), r as (select p_partkey as review_id, case when p_partkey % 3 = 0 then null else p_partkey * 2 end as document_id from part where p_partkey < 700)
select path, s.review_id, case when r.review_id is null then 'review is gone' else 'document is gone' end as fault from s left join r using (review_id) where s.review_id is not null and (r.review_id is null or (document_id is not null and document_id not in (select doc_id from documents)))""")
def qlt12_reviews(t):
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    sources = t("orders").select(k.cast("string").alias("path"), F.when(k % 4 != 0, k % 900).alias("review_id"))
    reviews = t("part").filter("p_partkey < 700").select(p.alias("review_id"), F.when(p % 3 != 0, p * 2).alias("document_id"))
    return ql.stale_review_links(sources, reviews, t("documents"))


@query("qlt16_siblings", """select coalesce(parent, -1) as parent_id, name, string_agg(id::varchar, ',' order by id) as ids from (select p_partkey as id, case when p_size % 10 = 0 then null else p_size end as parent, lower(trim(p_brand)) as name from part) x group by 1, 2 having count(*) > 1""")
def qlt16_siblings(t):
    names = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("parent_id"), F.concat(F.lit("　"), F.upper("p_brand"), F.lit(" ")).alias("name"))
    return ql.repeated_siblings(names).select(F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "name", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("qlt13_backlog", "select version_id from {versions} where workflow_status = 'published' and validity_status in ('active', 'legacy_active') and index_status in ('pending', 'failed') and document_id in (select c_custkey from customer where c_custkey % 7 <> 0) order by version_id limit 20")
def qlt13(t):
    return ql.index_backlog(t("versions"), live_docs(t), 20).select("version_id")


@query("qlt14_drafts", """with d as (select * from {versions} where workflow_status = 'draft'), v as (select version_id, unnest(list_filter([case when version_id % 4 <> 0 then null else 'no primary file' end, case when version_id % 6 = 0 then 'no section' end, case when version_id % 5 = 1 then 'no summary' end, case when hardware_version is null then 'no hardware' end], lambda x: x is not null)) as violation from d) select * from v""")
def qlt14(t):
    drafts = t("versions").filter("workflow_status = 'draft'").withColumn("summary", F.when(F.col("version_id") % 5 != 1, "text"))
    files = t("versions").filter("version_id % 4 <> 0").select("version_id", F.lit(True).alias("is_primary"))
    sections = t("versions").select("version_id", F.when(F.col("version_id") % 6 == 0, "  ").otherwise("body").alias("body"))
    return ql.draft_violations(drafts, files, sections)


@query("qlt15_tree", r"""with p as (select page_id, string_split(regexp_extract(url, '//([^?#]*)', 1), '/') as parts from pages), e as (select page_id, parts, unnest(range(1, len(parts) + 1)) as depth from p)
select array_to_string(parts[1:depth], '/') as key, case when depth > 1 then array_to_string(parts[1:depth - 1], '/') else '' end as parent, depth::int as depth, count(distinct page_id) as pages from e group by all""")
def qlt15(t):
    return ql.source_tree(t("pages").select("page_id", F.split(F.regexp_extract("url", r"//([^?#]*)", 1), "/").alias("parts")))


@query("qlt16_paths", "with recursive p(id, path, depth) as (select id, name, 1 from {categories} where parent_id is null union all select c.id, concat(p.path, ' / ', c.name), depth + 1 from p join {categories} c on c.parent_id = p.id) select * from p")
def qlt16(t):
    from quarry.operators.chunking import tree_paths

    return tree_paths(t("categories"))


WIKI = """p as (select *, coalesce(site, 'Confluence') as st, len(title_path) as n, coalesce(len(ancestor_ids), 0) as na from {wiki} where page_id is not null),
up as (select *, list_transform(range(1, n), lambda i: coalesce(case when i <= na then ancestor_ids[i] when i = n - 1 then parent_id end, '')) as ids from p),
w as (select *, list_concat(list_concat([to_json([st])::varchar], list_transform(range(1, n), lambda i: case when ids[i] <> '' then to_json([st, ids[i]])::varchar else to_json(list_concat([st, 'path'], title_path[1:i]))::varchar end)),
  case when attachment_id is null then [to_json([st, page_id])::varchar] else [to_json([st, page_id])::varchar, to_json([st, 'attachment', page_id, attachment_id])::varchar] end) as ks,
  list_concat(list_concat([st], title_path), case when attachment_id is null then [] else [attachment_title] end) as ts from up),
s as (select w.*, unnest(range(1, len(ks) + 1)) as d from w),
named as (select ks[d] as key, case when d > 1 then ks[d - 1] end as parent, ts[d] as title, case when d = 1 then 'site' when d = n + 2 then 'attachment' else 'page' end as kind, d - 1 as depth, doc_id, section_id from s),
nodes as (select key, parent, title, kind, depth from named qualify row_number() over (partition by key order by doc_id, section_id, depth) = 1),
sums as (select ks[d] as key, count(distinct doc_id) as documents, count(distinct case when not navigation_only then section_id end) as sections from s group by 1),
snap as (select to_json([st, page_id])::varchar as parent, st, child_pages from p where attachment_id is null and child_pages is not null qualify row_number() over (partition by st, page_id order by source_version::int desc, doc_id desc) = 1),
kid as (select parent, to_json([st, c])::varchar as key, min(i) as stored from (select parent, st, unnest(child_pages) as c, generate_subscripts(child_pages, 1) as i from snap) z group by 1, 2)"""


@query("qlt15_directory", f"""with {WIKI} select nodes.key, coalesce(nodes.parent, '') as parent, title, kind, depth::int as depth, row_number() over (partition by nodes.parent order by kind = 'attachment', stored nulls last, lower(title), nodes.key) as place, documents, sections
from nodes join sums on sums.key = nodes.key left join kid on kid.parent = nodes.parent and kid.key = nodes.key""")
def qlt15_directory(t):
    return dr.source_directory(t("wiki")).withColumn("parent", F.coalesce("parent", F.lit("")))


@query("qlt15_documents", f"""with {WIKI}, e as (select ks[-1] as key, doc_id, doc_title, section_id, section_index, coalesce(section_title, '正文') as title, navigation_only from w),
g as (select key, doc_id, min(doc_title) as doc_title, count(distinct section_id) filter (not navigation_only) as n, coalesce(string_agg(distinct title, ',' order by title) filter (not navigation_only), '') as titles from e group by 1, 2)
select *, row_number() over (partition by key order by doc_id desc) as place from g""")
def qlt15_documents(t):
    found = dr.node_documents(t("wiki"))
    titles = F.array_join(F.array_sort(F.transform("sections", lambda x: x["title"])), ",")
    return found.select("key", "doc_id", "doc_title", F.size("sections").cast("bigint").alias("n"), titles.alias("titles"), "place")


@query("qlt17_tags", f"with {TAGGED} select doc_id, array_to_string(list_sort(list_distinct(list_concat(tag_ids, case when doc_id % 3 = 0 then [99, 12] else [] end))), ',') as tag_ids from tagged")
def qlt17(t):
    rel = t("tagged_files").filter("file_id % 3 = 0").select(F.col("file_id").alias("doc_id"), F.explode(F.array(F.lit(99), F.lit(12))).alias("tag_id"))
    return ql.merge_tag_relations(tagged(t), rel).select("doc_id", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ",").alias("tag_ids"))


@query("qlt18_publish", """with r as (select document_id, max(version_id) as new_id from {versions} where workflow_status = 'draft' group by 1)
select document_id, version_id, case when version_id = new_id then 'published' when workflow_status = 'published' then 'superseded' else workflow_status end as workflow_status, case when version_id <> new_id and workflow_status = 'published' then new_id else -1 end as superseded_by, (effective_to is null and not (version_id <> new_id and workflow_status = 'published')) as open from {versions} join r using (document_id)""")
def qlt18(t):
    import datetime

    req = t("versions").filter("workflow_status = 'draft'").groupBy("document_id").agg(F.max("version_id").alias("version_id"))
    plan = ql.publish_plan(t("versions"), req, datetime.datetime(2001, 8, 2))
    return plan.select("document_id", "version_id", "workflow_status", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), F.col("effective_to").isNull().alias("open"))


#: Sections with keys by hand: the title in small letters with dots; the place counts only where a title is missing.
KEYED = """o as (select document_id, position, replace(lower(title), ' ', '.') as k, sha256(concat('{"title":', to_json(title), ',"text":', to_json(text), '}')) as h from {old_sections}),
nw as (select document_id, position, case when title is null then 'section' else replace(lower(title), ' ', '.') end as k, sha256(concat('{"title":', to_json(coalesce(title, '')), ',"text":', to_json(text), '}')) as h from (select * from {new_sections} qualify row_number() over (partition by document_id, coalesce(title, '') order by position) = 1) z),
m1 as (select o.document_id, o.position as a, n.position as b, o.k as ok, n.k as nk, o.h = n.h as same from o join nw n on n.document_id = o.document_id and n.k = o.k),
lost as (select * from o where not exists (select 1 from nw n where n.document_id = o.document_id and n.k = o.k) ), came as (select * from nw where not exists (select 1 from o where nw.document_id = o.document_id and nw.k = o.k)),
l1 as (select * from lost qualify count(*) over (partition by document_id, h) = 1), c1 as (select * from came qualify count(*) over (partition by document_id, h) = 1),
m2 as (select l1.document_id, l1.position as a, c1.position as b, l1.k as ok, c1.k as nk, true as same from l1 join c1 on c1.document_id = l1.document_id and c1.h = l1.h),
m as (select * from m1 union all select * from m2),
up as (select document_id, a, b, 1 as n from m union all select m.document_id, m.a, m.b, up.n + 1 from up join m on m.document_id = up.document_id and m.a > up.a and m.b > up.b),
best as (select document_id, max(n) as n from up group by 1)"""


@query("qlt18_align", f"""with recursive {KEYED} select d.document_id, (select count(*) from m where m.document_id = d.document_id and ok = nk and same) as kept, (select count(*) from m where m.document_id = d.document_id and ok = nk and not same) as changed, (select count(*) from m where m.document_id = d.document_id and ok <> nk) as renamed,
(select count(*) from came c where c.document_id = d.document_id and not exists (select 1 from m2 where m2.document_id = c.document_id and nk = c.k)) as added, (select count(*) from lost c where c.document_id = d.document_id and not exists (select 1 from m2 where m2.document_id = c.document_id and ok = c.k)) as removed,
(select count(*) from m where m.document_id = d.document_id) - coalesce((select n from best where best.document_id = d.document_id), 0) as moved from (select distinct document_id from o union select document_id from nw) d""")
def qlt18_align(t):
    """What two versions of each document have in common, section by section; as few sections as possible count as moved."""
    keyed = lambda df: vn.section_keys(df, key="given").withColumn("section_key", F.col("section_key"))
    given = F.regexp_replace(F.lower(F.coalesce("title", F.lit("section"))), " ", ".")
    out = vn.align(keyed(t("old_sections").withColumn("given", given)), keyed(t("new_sections").withColumn("given", given)))
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("kept", "changed", "renamed", "added", "removed")]
    return out.groupBy("document_id").agg(*counts, F.count_if("moved").alias("moved"))


@query("qlt18_keys", r"""with s as (select version_id, row_number() over (partition by version_id order by position) as place, coalesce(title, '') as title, text from {new_sections}),
k as (select version_id, place, concat(case when title = '' then 'section' else trim(regexp_replace(lower(title), '[^a-z0-9]+', '.', 'g'), '.') end, '.', place::varchar) as key, sha256(concat('{"title":', to_json(title), ',"text":', to_json(text), '}')) as h from s)
select version_id, count(*) as n_sections, sha256(string_agg(h, ',' order by place)) as version_hash, md5(string_agg(key, ',' order by place)) as keys from k group by 1""")
def qlt18_keys(t):
    keyed = vn.section_keys(t("new_sections"))
    keys = keyed.groupBy("version_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("position", "section_key")))["section_key"], ",").cast("binary")).alias("keys"))
    return vn.version_hashes(keyed).join(keys, "version_id")


#: Each document's last draft asks to be published: to replace the first served version, all, none, or one of another document, or to coexist.
PUBLISH = """sv as (select document_id, version_id, lower(trim(coalesce(hardware_version, ''))) as hw from {versions} where workflow_status = 'published' and validity_status in ('active', 'legacy_active')),
rq as (select document_id, max(version_id) as version_id from {versions} where workflow_status = 'draft' group by 1),
rs as (select rq.document_id, rq.version_id, case when rq.document_id % 4 = 3 then 'coexist' else 'replace' end as mode,
  case rq.document_id % 4 when 0 then coalesce((select [min(sv.version_id)] from sv where sv.document_id = rq.document_id having count(*) > 0), []) when 1 then coalesce((select list_sort(list(sv.version_id)) from sv where sv.document_id = rq.document_id), []) when 2 then [1::bigint] else [] end as old
  from rq),
jd as (select rs.*, lower(trim(coalesce(v.hardware_version, ''))) as own, v.effective_from, v.effective_to, (select count(*) from sv where sv.document_id = rs.document_id) as n_served,
  (select count(*) from sv where sv.document_id = rs.document_id and list_contains(old, sv.version_id)) as n_hit, (select count(*) from sv where sv.document_id = rs.document_id and not list_contains(old, sv.version_id)) as n_stay,
  (select count(*) from sv where sv.document_id = rs.document_id and not list_contains(old, sv.version_id) and hw = '') as bare, (select count(*) from sv where sv.document_id = rs.document_id and not list_contains(old, sv.version_id) and hw <> '' and hw = lower(trim(coalesce(v.hardware_version, '')))) as same
  from rs join {versions} v on v.version_id = rs.version_id),
ju as (select *, case when effective_from >= effective_to then 'range ends before it begins' when n_hit < len(old) then 'target is not served' when mode = 'coexist' and len(old) > 0 then 'coexistence with targets' when mode = 'replace' and n_served > 0 and len(old) = 0 then 'no target'
  when mode = 'coexist' and own = '' then 'no hardware' when n_stay > 0 and (own = '' or bare > 0) then 'no hardware' when same > 0 then 'same hardware' end as reason from jd)"""


def publication(t):
    served = t("versions").filter("workflow_status = 'published' and validity_status in ('active', 'legacy_active')").groupBy("document_id").agg(F.array_sort(F.collect_list("version_id")).alias("all_"))
    drafts = t("versions").filter("workflow_status = 'draft'").groupBy("document_id").agg(F.max("version_id").alias("version_id")).join(served, "document_id", "left")
    by, none = F.col("document_id") % 4, F.array().cast("array<bigint>")
    every = F.coalesce("all_", none)
    old = F.when(by == 0, F.slice(every, 1, 1)).when(by == 1, every).when(by == 2, F.array(F.lit(1).cast("bigint"))).otherwise(none)
    requests = drafts.select("version_id", F.when(by == 3, "coexist").otherwise("replace").alias("mode"), old.alias("supersedes"))
    first = t("versions").groupBy("document_id").agg(F.when(F.col("document_id") % 3 != 0, F.min(F.when((F.col("workflow_status") == "published") & F.col("validity_status").isin("active", "legacy_active"), F.col("version_id")))).alias("default_version_id"))
    return vn.publish(t("versions"), requests, first, F.lit("2001-08-02").cast("date"))


@query("qlt18_refused", f"with {PUBLISH} select version_id, reason from ju where reason is not null")
def qlt18_refused(t):
    return publication(t).refused


@query("qlt18_relations", f"""with {PUBLISH} select unnest(old) as source_version_id, version_id as target_version_id, 'supersedes' as relation_type from ju where reason is null""")
def qlt18_relations(t):
    return publication(t).relations


@query("qlt18_defaults", f"""with {PUBLISH}, f as (select document_id, case when document_id % 3 <> 0 then min(version_id) filter (workflow_status = 'published' and validity_status in ('active', 'legacy_active')) end as d from {{versions}} group by 1)
select f.document_id, coalesce(case when ju.version_id is not null and (d is null or list_contains(old, d)) then ju.version_id else d end, -1) as default_version_id from f left join ju on ju.document_id = f.document_id and reason is null""")
def qlt18_defaults(t):
    return publication(t).defaults.select("document_id", F.coalesce("default_version_id", F.lit(-1)).alias("default_version_id"))


@query("qlt18_versions", f"""with {PUBLISH}, g as (select * from ju where reason is null)
select v.version_id, case when v.version_id = g.version_id then 'published' when list_contains(old, v.version_id) then 'superseded' else workflow_status end as workflow_status, case when v.version_id = g.version_id then 'active' when list_contains(old, v.version_id) then 'superseded' else validity_status end as validity_status,
cast(case when list_contains(old, v.version_id) then coalesce(v.effective_to, g.effective_from, date '2001-08-02') else v.effective_to end as varchar) as effective_to from {{versions}} v left join g on g.document_id = v.document_id""")
def qlt18_versions(t):
    after = publication(t).versions
    return after.select("version_id", "workflow_status", "validity_status", F.col("effective_to").cast("string").alias("effective_to"))


@query("qlt19_refile", """with r as (select o_orderkey as review_id, o_custkey as owner_id, o_orderpriority as path, case when o_orderkey % 2 = 0 then 'knowledge' else 'breakdown' end as library, case when o_orderkey % 3 = 0 then 'knowledge' else 'breakdown' end as wanted from orders),
w as (select owner_id, path, max(review_id) as twin_id from r where library = wanted group by all) select review_id, case when twin_id is null then 'move' else 'close' end as action, coalesce(twin_id, -1) as twin_id from r left join w using (owner_id, path) where library <> wanted""")
def qlt19(t):
    k = F.col("o_orderkey")
    lib = lambda n: F.when(k % n == 0, "knowledge").otherwise("breakdown")
    return ql.refile_reviews(t("orders").select(k.alias("review_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("path"), lib(2).alias("library"), lib(3).alias("wanted")))
