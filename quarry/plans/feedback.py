"""Registered feedback queries. Their SQL states the rules anew; only fixed word lists are shared."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import feedback as fb

from .dashboard import FB, feedback_sec
from .registry import query
from .retrieval import KNN, ROLLED, rolled


def any_of(text: str, words: list[str]) -> str:
    """SQL: one of the words is in the text."""
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


INCOMING = "i as (select id as feedback_id, case when id % 5 = 0 then user_id + 1 else user_id end as user_id, session_id, case when id % 7 = 0 then id + 5000000 else id end as message_id, case id % 3 when 0 then 'positive' when 1 then 'correction' else 'shrug' end as feedback_type from {messages})"


@query("fb01_ingest", f"""with {INCOMING} select feedback_id, case when feedback_type = 'shrug' then 'unknown type' when m.id is null then 'no message' when m.user_id <> i.user_id then 'foreign session' when m.role <> 0 then 'not an answer' when i.message_id % 4 = 1 then 'repeated' else 'accepted' end as outcome from i left join {{messages}} m on m.id = i.message_id""")
def fb01(t):
    k = F.col("id")
    m = t("messages")
    inc = m.select(k.alias("feedback_id"), F.when(k % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "session_id", F.when(k % 7 == 0, k + 5000000).otherwise(k).alias("message_id"), F.when(k % 3 == 0, "positive").when(k % 3 == 1, "correction").otherwise("shrug").alias("feedback_type"))
    return fb.ingest_feedback(inc, m, inc.filter("message_id % 4 = 1"))


ANALYSED = f"""{FB}, a0 as (select *, trim(coalesce(comment, '')) as tx, coalesce(device, '') <> '' as ctx from f),
a1 as (select *, case when contains(tx, '不是') then 'correction' when contains(tx, '已经确认') or contains(tx, '确认是') then 'confirmation' when contains(tx, '文档') and {any_of("tx", ["正确", "对", "参考"])} then 'confirmation'
  when feedback_type in ('positive', 'confirmation') then 'confirmation' when feedback_type = 'negative' then 'dissatisfaction' when feedback_type in ('correction', 'additional_information', 'irrelevant', 'suspicious') then feedback_type else 'unclear' end as detected,
  case when {any_of("lower(tx)", fb.GLOBAL_WORDS)} then 'global' when contains(lower(tx), '设备') or contains(lower(tx), '本机') then 'device' when {any_of("lower(tx)", fb.FAULT_WORDS)} then 'fault_type' when ctx then 'conversation' else 'feedback' end as scope0,
  {any_of("lower(tx)", fb.CONFLICT_WORDS)} and trim(answer_text) <> '' as conflict from a0),
a2 as (select *, regexp_extract(tx, '(不是|不是说)\\s*([^\\s，,。；;:]+)\\s*[，,。；;:]\\s*(是|而是)\\s*([^\\s，,。；;:]+)', 4) as rightly, trim(case when contains(tx, '确认是') then substr(tx, strpos(tx, '确认是') + 3) else substr(tx, strpos(tx, '已经确认') + 4) end) as said from a1),
k1 as (select feedback_id, 1 as o, 'correction' as claim_type, case when {any_of("tx", ["故障", "根因", "原因"])} then 'root_cause' else 'answer' end as subject, rightly as object, 0.78::double as confidence from a2 where detected = 'correction' and rightly <> ''
  union all select feedback_id, 2, 'confirmation', case when said <> '' then 'fault_cause' else 'answer' end, nullif(said, ''), 0.68 from a2 where detected = 'confirmation' and (contains(tx, '已经确认') or contains(tx, '确认是'))
  union all select feedback_id, 3, 'document_preference', 'document', case when regexp_extract(tx, '文档\\s*([0-9]+)', 1) <> '' then regexp_extract(tx, '文档\\s*([0-9]+)', 1) else 'preferred_document' end, 0.5 from a2 where contains(tx, '文档') and {any_of("tx", ["正确", "对", "参考文档"])}),
k2 as (select * from k1 union all select feedback_id, 4, 'additional_information', 'symptom', left(tx, 255), 0.45 from a2 where detected = 'additional_information' and tx <> '' and feedback_id not in (select feedback_id from k1)
  union all select feedback_id, 5, 'unclear_feedback', 'feedback', left(tx, 255), 0.25 from a2 where detected = 'unclear' and tx <> ''),
k3 as (select k2.*, scope0 as scope, row_number() over (partition by k2.feedback_id order by o) as claim_no from k2 join a2 on a2.feedback_id = k2.feedback_id),
a3 as (select *, feedback_id in (select feedback_id from k2) as claimed, case when conflict and detected <> 'suspicious' then 'high' when scope0 = 'global' then 'high' when detected = 'correction' then 'high' when detected = 'suspicious' then 'critical' when detected in ('irrelevant', 'unclear', 'dissatisfaction') then 'medium' else 'low' end as risk0 from a2)"""


@query("fb02_analyse", f"""with {ANALYSED} select feedback_id, detected, case when detected = 'confirmation' and scope0 = 'feedback' then 'conversation' else scope0 end as scope, conflict, case when conflict and scope0 = 'global' then 'high' else risk0 end as risk,
case when conflict and detected = 'correction' then 'require_human_review' when detected = 'suspicious' then 'require_human_review' when detected in ('correction', 'additional_information') then 'verify' when detected in ('irrelevant', 'dissatisfaction') then 'ignore' else 'store_only' end as action,
array_to_string(list_filter([case when claimed then 'retrieval' end, case when detected in ('correction', 'additional_information') then 'cross_case' end, case when conflict then 'human_review' end], lambda x: x is not null), ',') as needs, case when claimed then 0.78::double else 0.5::double end as confidence from a3""")
def fb02(t):
    out = fb.analyse_feedback(feedback_sec(t))
    return out.select("feedback_id", "detected", "scope", "conflict", "risk", "action", F.array_join("needs", ",").alias("needs"), F.col("analysis_confidence").alias("confidence"))


@query("fb03_claims", f"with {ANALYSED} select feedback_id, claim_no::int as claim_no, claim_type, subject, object, scope, confidence from k3")
def fb03(t):
    return fb.extract_claims(fb.analyse_feedback(feedback_sec(t))).drop("predicate")


#: Claims of benchmark items: what they are about is their first words.
EVID = f"""c as (select item_id as claim_id, case item_id % 5 when 0 then 'a102 power module' when 1 then '不是 fan' else array_to_string(string_split(text, ' ')[1:3], ' ') end as object, case item_id % 2 when 0 then 'correction' else 'confirmation' end as claim_type from benchmark),
cw as (select claim_id, lower(concat_ws(' ', 'answer', 'is', object, 'device', 'user')) as said, list_filter(regexp_split_to_array(concat_ws(' ', claim_type, 'answer', 'is', object, 'device'), '[\\s,，。；;:/|_()-]+'), lambda w: length(w) >= 2) as w0 from c),
ck as (select claim_id, said, list_filter(w0, lambda w, i: list_position(w0, w) = i)[1:8] as words from cw),
s0 as (select item_id as claim_id, doc_id as source_id, case doc_id % 5 when 0 then 'document' when 1 then 'answer' when 2 then 'conversation_context' when 3 then 'working_memory' else 'fault_case' end as source_type, case doc_id % 3 when 0 then 'fan report' when 1 then '确认' else '' end as title, d.text from benchmark b join documents d on d.doc_id % 40 = b.item_id % 40),
s1 as (select *, row_number() over (partition by claim_id, source_type order by source_id desc) as nth from s0),
s2 as (select s1.*, said, words, lower(coalesce(text, '')) as low, case when source_type = 'document' then lower(title) else '' end as t2 from s1 join ck using (claim_id) where source_type <> 'fault_case' or nth <= 8),
s3 as (select *, len(list_filter(words, lambda w: contains(low, lower(w)))) / len(words) as r0, len(list_filter(words, lambda w: contains(low, w))) > 0 as hit, len(list_filter(words, lambda w: contains(lower(title), w))) > 0 as thit,
  case when contains(said, 'a102') and (contains(low, 'fan') or contains(t2, 'fan') or contains(low, '风扇')) then {any_of("said", ["power", "电源", "module", "模块"])}
  else ({any_of("said", fb.NEGATIVE_TERMS)} and {any_of("low", fb.POSITIVE_TERMS)}) or ({any_of("said", fb.POSITIVE_TERMS)} and {any_of("low", fb.NEGATIVE_TERMS)}) end as against from s2),
s4 as (select *, case when r0 = 0 and source_type = 'document' and contains(said, source_id::varchar) then 0.9::double else r0 end as relevance from s3),
s5 as (select *, case source_type when 'document' then case when hit or thit then 0.6::double * relevance else 0 end when 'answer' then case when hit then 0.4::double else 0 end when 'conversation_context' then 0.55::double when 'working_memory' then case when against then 0.2::double else 0.8::double end else case when hit then 0.75::double * relevance else 0 end end as s,
  case source_type when 'document' then case when against then greatest(0.5::double, relevance) else 0 end when 'answer' then case when against then 0.4::double else 0 end when 'conversation_context' then 0 when 'working_memory' then case when against then 0.8::double else 0 end else case when against then 0.5::double * relevance else 0 end end as c from s4 where relevance > 0),
s6 as (select *, case when s > c then 'support' when c > s then 'contradict' when source_type <> 'document' then 'support' end as side from s5),
e as (select claim_id, source_type, source_id, relevance, case when source_type = 'fault_case' and side = 'support' then greatest(0.5, s) else s end as support, case when source_type = 'fault_case' and side = 'contradict' then greatest(0.5, c) else c end as contradiction, side from s6 where side is not null)"""


def evidence(t):
    item, doc = F.col("item_id"), F.col("doc_id")
    words = F.when(item % 5 == 0, "a102 power module").when(item % 5 == 1, "不是 fan").otherwise(F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    claims = t("benchmark").select(item.alias("claim_id"), F.when(item % 2 == 0, "correction").otherwise("confirmation").alias("claim_type"), F.lit("answer").alias("subject"), F.lit("is").alias("predicate"), words.alias("object"), F.lit("device").alias("scope"), F.lit("user").alias("source"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("document", "answer", "conversation_context", "working_memory", "fault_case")]), (doc % 5 + 1).cast("int"))
    docs = t("documents").select(doc.alias("source_id"), kind.alias("source_type"), F.when(doc % 3 == 0, "fan report").when(doc % 3 == 1, "确认").otherwise("").alias("title"), "text", (doc % 40).alias("b"))
    sources = docs.join(t("benchmark").select(item.alias("claim_id"), (item % 40).alias("b")), "b").drop("b")
    return fb.collect_evidence(claims, sources), claims


@query("fb04_evidence", f"with {EVID} select claim_id, source_type, source_id, round(relevance, 6) as relevance, round(support, 6) as support, round(contradiction, 6) as contradiction, side from e")
def fb04(t):
    return evidence(t)[0].select("claim_id", "source_type", "source_id", *[F.round(c, 6).alias(c) for c in ("relevance", "support", "contradiction")], "side")


@query("fb05_verdicts", f"""with {EVID}, v0 as (select claim_id, round(least(1, coalesce(sum(support * relevance) filter (side = 'support'), 0)), 9) as s, round(least(1, coalesce(sum(contradiction * relevance) filter (side = 'contradict'), 0)), 9) as c, count(*) as n from e group by 1),
v as (select c.claim_id, coalesce(s, 0) as s, coalesce(v0.c, 0) as k, coalesce(n, 0) as n from c left join v0 using (claim_id))
select claim_id, round(s, 6) as support, round(k, 6) as contradiction, n, round(least(1, greatest(s, k) + least(0.25::double, n / 20)), 6) as confidence,
case when s > 0 and k > 0 and round(abs(s - k), 9) <= 0.25 then 'uncertain' when s > k and s >= 0.35 and k = 0 then 'supported' when k > s and k >= 0.35 then 'contradicted' when n = 0 then 'insufficient' else 'uncertain' end as verdict from v""")
def fb05(t):
    return fb.verify_claims(*evidence(t)).select("claim_id", F.round("support", 6).alias("support"), F.round("contradiction", 6).alias("contradiction"), "n", F.round("confidence", 6).alias("confidence"), "verdict")


ANOMALY = f"""{FB}, m0 as (select *, list_filter([{", ".join(f"case when contains(lower(coalesce(comment, '')), '{m}') then '{m}' end" for m in fb.MENTIONS)}, case when device <> '' then 'device:' || device end], lambda x: x is not null) as said from f),
m1 as (select *, list({{'s': sec, 't': feedback_type, 'm': said}}) over (partition by user_id order by sec, feedback_id rows between 19 preceding and 1 preceding) as b from m0),
m2 as (select *, list_reverse(list_filter(coalesce(b, []), lambda x: x.s >= sec - 86400)) as day from m1),
m3 as (select *, len(day) as n, list_transform(day, lambda x: x.t) as ty, flatten(list_transform(day, lambda x: x.m)) as ms from m2),
m4 as (select *, list_transform(ty[1:4], lambda x: x in ('positive', 'confirmation')) as pol, coalesce(list_max(list_transform(list_distinct(ms), lambda m: len(list_filter(ms, lambda x: x = m)))), 0) as top from m3),
an as (select feedback_id, n, greatest(0.25::double, least(1, case when n >= 8 then 0.7::double else 1 end * case when n >= 4 and len(list_distinct(ty)) = 1 then 0.75::double else 1 end * case when n >= 4 and (pol = [true, false, true, false] or pol = [false, true, false, true]) then 0.6::double else 1 end
  * case when top >= 4 then 0.8::double else 1 end * case when comment <> '' and length(trim(comment)) <= 2 then 0.85::double else 1 end)) as factor from m4)"""


@query("fb06_anomaly", f"with {ANOMALY} select feedback_id, n::int as in_day, round(factor, 6) as factor from an")
def fb06(t):
    return fb.anomaly_factor(feedback_sec(t)).select("feedback_id", "in_day", F.round("factor", 6).alias("factor"))


STRENGTH = """case verifier_type when 'maintenance_outcome' then 1.0::double when 'human' then 0.95::double when 'expert' then 0.9::double when 'retrieval' then 0.7::double when 'rule' then 0.7::double when 'llm' then 0.6::double when 'cross_case' then 0.8::double else 0.55::double end"""
STRENGTH = f"greatest({STRENGTH}, case when contains(evidence_types, 'fault_case') then 0.9::double when contains(evidence_types, 'document') then 0.75::double when contains(evidence_types, 'working_memory') then 0.7::double when contains(evidence_types, 'conversation_context') then 0.65::double when contains(evidence_types, 'answer') then 0.55::double else 0 end)"


def strengths(t):
    return fb.evidence_strength(feedback_sec(t).withColumn("evidence_types", F.split("evidence_types", ",")))


@query("fb07_strength", f"select feedback_id, round({STRENGTH}, 6) as strength from {{feedback}}")
def fb07(t):
    return strengths(t).select("feedback_id", F.round("strength", 6).alias("strength"))


def reliability_events(t):
    rows = strengths(t).join(fb.anomaly_factor(feedback_sec(t)).select("feedback_id", "factor"), "feedback_id")
    return rows.select("user_id", "feedback_id", "sec", fb.direction(F.col("verification_result")).alias("direction"), (F.col("strength") * F.col("factor")).alias("weight"), (F.col("feedback_type") == "correction").alias("correction"))


RELIABLE = f"""recursive {ANOMALY}, ev as (select user_id, sec, case verification_result when 'support' then 1 else -1 end as way, {STRENGTH} * factor as weight, feedback_type = 'correction' as correction, row_number() over (partition by user_id order by sec, f.feedback_id) as i from f join an using (feedback_id) where verification_result in ('support', 'contradict')),
fold as (select user_id, 0::bigint as i, 0.5::double as score, 0::bigint as last, 0::bigint as verified, 0::bigint as rejected, 0::bigint as corrections, 0::bigint as rightly, 0::double as vw, 0::double as rw, 0::double as cw from (select distinct user_id from ev)
  union all select x.user_id, x.i, least(1, greatest(0, x.score0 + greatest(-0.18::double, least(0.18::double, (x.alpha + x.up) / (x.alpha + x.beta + x.up + x.down) - x.score0)))), x.sec, x.verified + case when x.way > 0 then 1 else 0 end, x.rejected + case when x.way < 0 then 1 else 0 end,
    x.corrections + case when x.correction then 1 else 0 end, x.rightly + case when x.correction and x.way > 0 then 1 else 0 end, x.vw * 0.98::double + x.up, x.rw * 0.98::double + x.down, case when x.correction then x.cw * 0.98::double + x.weight else x.cw end
  from (select y.*, greatest(1, score0 * strength) as alpha, greatest(1, (1 - score0) * strength) as beta, case when way > 0 then greatest(0.05::double, weight) else 0 end as up, case when way < 0 then greatest(0.05::double, weight) else 0 end as down
    from (select ev.*, fold.score as score0, verified, rejected, corrections, rightly, vw, rw, cw, least(12, 2 + 0.25::double * fold.i) * case when fold.i = 0 then 1 else pow(0.98::double, greatest(0, ev.sec - last) / 604800) end as strength from fold join ev on ev.user_id = fold.user_id and ev.i = fold.i + 1) y) x),
rl as (select * from (select *, row_number() over (partition by user_id order by i desc) as back from fold) where back = 1)"""


@query("fb08_reliability", f"with {RELIABLE} select user_id, round(score, 6) as reliability, i as n, verified, rejected, corrections, rightly as right_corrections, round(vw, 6) as verified_weight, round(rw, 6) as rejected_weight, round(cw, 6) as correction_weight from rl")
def fb08(t):
    weights = [F.round(c, 6).alias(c) for c in ("verified_weight", "rejected_weight", "correction_weight")]
    return fb.user_reliability(reliability_events(t)).select("user_id", F.round("reliability", 6).alias("reliability"), "n", "verified", "rejected", "corrections", "right_corrections", *weights)


#: Reliability of half of the users, by a plain share, so that the patches' SQL needs no fold; the others are new.
PATCH = f"""{FB}, known as (select user_id, avg(case when verification_result = 'support' then 1.0::double else 0 end) as reliability, count(*) filter (verification_result = 'support') as verified from f where user_id % 2 = 0 group by 1),
p0 as (select f.*, case when feedback_type in ('confirmation', 'positive') then 'preferred_document' else 'penalty' end as patch_type, lower(trim(coalesce(comment, ''))) as low, coalesce(nullif(reliability, 0), 0.5::double) as r, coalesce(verified, 0) as nv, status in ('verified', 'promoted') or verification_result = 'support' as sure from f left join known using (user_id)),
p1 as (select *, case verifier_type when 'maintenance_outcome' then 1.0::double when 'human' then 0.95::double when 'expert' then 0.9::double when 'retrieval' then 0.75::double when 'rule' then 0.7::double when 'llm' then 0.65::double when 'cross_case' then 0.8::double else 0.6::double end
  * case verification_result when 'support' then 1.0::double when 'uncertain' then 0.45::double else 0.25::double end * (0.45::double + r * 0.55::double) * case patch_type when 'penalty' then 0.9::double else 1 end * (0.55::double + confidence * 0.45::double) as full0 from p0
  where feedback_type <> 'suspicious' and verification_result <> 'contradict' and (feedback_type <> 'negative' or {any_of("low", fb.IRRELEVANT_MARKERS)}) and document_id > 0),
p2 as (select *, case when sure then least(case when nv < 2 then 0.06::double else 1 end, greatest(0.01::double, least(0.25::double, full0))) else greatest(0.01::double, least(0.10::double, case patch_type when 'penalty' then 0.04::double else 0.06::double end * (0.5::double + confidence * 0.5::double) * (0.6::double + r * 0.4::double))) end as w0 from p1),
s as (select feedback_id, user_id, document_id, conversation_id, low, patch_type, case patch_type when 'penalty' then -1 else 1 end as sign, least(w0, case patch_type when 'penalty' then 0.10::double else 0.25::double end) as weight, confidence, case when sure then 'active' else 'candidate' end as status, sec, (sec + case when sure then 21 else 7 end * 86400)::bigint as expires_sec,
  'conversation:' || left(sha1('{{"query": "' || low || '", "scope": "conversation", "values": {{"conversation_id": ' || conversation_id::varchar || '}}}}'), 24) as signature from p2)"""


def patch_users(t):
    good = F.col("verification_result") == "support"
    return t("feedback").filter("user_id % 2 = 0").groupBy("user_id").agg(F.avg(F.when(good, 1.0).otherwise(0.0)).alias("reliability"), F.count_if(good).alias("verified"))


def patches(t):
    return fb.make_patches(feedback_sec(t), patch_users(t))


@query("fb09_patches", f"with {PATCH} select feedback_id, patch_type, sign, round(weight, 6) as weight, status, expires_sec, signature from s")
def fb09(t):
    return patches(t).select("feedback_id", "patch_type", "sign", F.round("weight", 6).alias("weight"), "status", "expires_sec", "signature")


NOW = 1706659200


@query("fb10_expire", f"with {PATCH} select feedback_id, case when expires_sec <= {NOW} then 'expired' else status end as status from s")
def fb10(t):
    return fb.expire_patches(patches(t), NOW).select("feedback_id", "status")


#: One question of each conversation and query vector: what a comment says, as a later question repeats it.
ASKED = """asked as (select query_id, (query_id // 50) % 20 as conversation_id, case (query_id // 50) % 4 when 0 then 'ok' when 1 then 'fan power 1' when 2 then '故障根因不是电源, 而是主板' else 'Fan noise again ' end as question from {query_vectors})"""
LIVE = f"""{PATCH}, {ASKED}, hit as (select query_id, s.*, row_number() over (partition by query_id, signature, document_id, patch_type order by sec desc, feedback_id desc) as n from asked join s on s.conversation_id = asked.conversation_id and s.low = lower(trim(question)) where status = 'active' and expires_sec > {NOW}),
live as (select * from hit where n = 1)"""


def asked(t):
    k = F.floor(F.col("query_id") / 50)
    text = F.element_at(F.array(*[F.lit(x) for x in ("ok", "fan power 1", "故障根因不是电源, 而是主板", "Fan noise again ")]), (k % 4 + 1).cast("int"))
    null = [F.lit(None).cast("string").alias(c) for c in ("device_type", "component", "firmware_version", "fault_type")]
    return t("query_vectors").select("query_id", text.alias("query"), (k % 20).alias("conversation_id"), F.lit(-1).alias("user_id"), F.concat(F.lit("X-"), (k % 3).cast("string")).alias("device"), *null)


@query("fb11_applicable", f"with {LIVE} select query_id, document_id, patch_type, feedback_id from live")
def fb11(t):
    return fb.applicable_patches(asked(t), patches(t), NOW).select("query_id", "document_id", "patch_type", "feedback_id")


@query("fb12_apply", f"""with {KNN}, {ROLLED}, {LIVE}, u as (select query_id, document_id, sum(sign * weight * (0.5::double + 0.5::double * confidence)) as push from live group by 1, 2),
m as (select rolled.query_id, doc_id, rank, doc_score, greatest(-0.25, least(0.25, coalesce(push, 0) * (0.5::double + least(0.5, doc_score)))) as raw from rolled left join u on u.document_id = doc_id and u.query_id = rolled.query_id),
x as (select *, doc_score + case when raw >= 0 then least(raw, doc_score, greatest(0, 1 - doc_score)) else greatest(raw, -doc_score) end as patched from m)
select query_id, doc_id, round(patched, 4) as patched, row_number() over (partition by query_id order by round(patched, 9) desc, rank) as new_rank from x""")
def fb12(t):
    return fb.apply_patches(rolled(t), fb.applicable_patches(asked(t), patches(t), NOW)).select("query_id", "doc_id", F.round("patched", 4).alias("patched"), "new_rank")


def cases(t):
    return t("feedback").select(F.concat_ws("|", F.col("document_id").cast("string"), F.col("conversation_id").cast("string")).alias("case_key"), "feedback_id", "confidence", F.when(F.col("feedback_id") % 3 != 0, F.col("comment")).alias("component"), (F.col("verification_result") == "contradict").alias("contradicted"))


CASES = """k as (select concat_ws('|', document_id::varchar, conversation_id::varchar) as case_key, feedback_id, confidence, case when feedback_id % 3 <> 0 then comment end as component, verification_result = 'contradict' as contradicted, case when feedback_id % 2 = 0 then 0 else 1 end as age from {feedback}),
cs as (select case_key, max(confidence) as confidence, count(*) as n, arg_min(component, age * 1000000 + feedback_id) filter (component is not null) as component, case when bool_or(contradicted) then 'rejected' else 'candidate' end as status from k group by 1)"""


@query("fb13_cases", f"with {CASES} select case_key, confidence, n, coalesce(component, '') as component, status from cs")
def fb13(t):
    c = cases(t)
    out = fb.upsert_cases(c.filter("feedback_id % 2 = 0"), c.filter("feedback_id % 2 = 1"))
    return out.select("case_key", "confidence", F.size("feedback_ids").cast("long").alias("n"), F.coalesce("component", F.lit("")).alias("component"), "status")


@query("fb14_verify", f"""with {CASES}, o as (select concat_ws('|', document_id::varchar, conversation_id::varchar) as case_key, bool_or(verifier_type = 'expert') as expert from {{feedback}} where verifier_type in ('expert', 'maintenance_outcome') group by 1)
select case_key, case when expert then 'expert_verified' when status = 'rejected' then 'rejected' when expert is not null then 'verified' else status end as status, case when expert then greatest(confidence, 0.9) else confidence end as confidence from cs left join o using (case_key)""")
def fb14(t):
    outcomes = t("feedback").filter(F.col("verifier_type").isin("expert", "maintenance_outcome")).select(F.concat_ws("|", F.col("document_id").cast("string"), F.col("conversation_id").cast("string")).alias("case_key"), (F.col("verifier_type") == "expert").alias("expert"))
    return fb.verify_cases(fb.upsert_cases(cases(t), cases(t).limit(0)), outcomes)


@query("fb15_similar", """with q as (select tag_id as query_id, tag_id % 7 as device, case when tag_id % 2 = 0 then null else 'power' end as wanted from {tags}), r as (select query_id, feedback_id as case_id, row_number() over (partition by query_id order by feedback_id desc) as rank from q join {feedback} f on f.document_id = q.device and (wanted is null or contains(comment, wanted))) select * from r where rank <= 4""")
def fb15(t):
    q = t("tags").select(F.col("tag_id").alias("query_id"), (F.col("tag_id") % 7).cast("long").alias("device"), F.when(F.col("tag_id") % 2 != 0, "power").alias("wanted"))
    return fb.similar_cases(q, t("feedback").select(F.col("document_id").alias("device"), F.col("feedback_id").alias("case_id"), F.col("comment").alias("component")), 4).select("query_id", "case_id", "rank")


@query("fb15_fitting", """with q as (select tag_id as query_id, tag_id % 7 as device, case when tag_id % 2 = 0 then null else 'power' end as wanted, case when tag_id % 3 = 0 then 'human' end as device_type, case when tag_id % 5 = 0 then 'pending' end as firmware from {tags}),
r as (select query_id, feedback_id as case_id, row_number() over (partition by query_id order by feedback_id desc) as rank from q join {feedback} f on f.document_id = q.device and (wanted is null or contains(comment, wanted)) and (device_type is null or f.verifier_type = device_type) and (firmware is null or f.status = firmware)) select * from r where rank <= 4""")
def fb15_fitting(t):
    k = F.col("tag_id")
    q = t("tags").select(k.alias("query_id"), (k % 7).cast("long").alias("device"), F.when(k % 2 != 0, "power").alias("wanted"), F.when(k % 3 == 0, "human").alias("device_type"), F.when(k % 5 == 0, "pending").alias("firmware_version"))
    cases = t("feedback").select(F.col("document_id").alias("device"), F.col("feedback_id").alias("case_id"), F.col("comment").alias("component"), F.col("verifier_type").alias("device_type"), F.col("status").alias("firmware_version"))
    return fb.similar_cases(q, cases, 4).select("query_id", "case_id", "rank")


PROMOTED = """c as (select document_id, conversation_id, case when document_id % 4 = 0 then 'expert_verified' when document_id % 4 = 1 then 'verified' when bool_or(verification_result = 'contradict') then 'rejected' else 'candidate' end as status, count(distinct verifier_type) as evidence_count, max(confidence) as confidence, avg(confidence) * 2 as reliability, max(case when feedback_id % 10 = 0 then 'fixed' end) as outcome from {feedback} group by document_id, conversation_id)"""


@query("fb16_promotion", f"""with {PROMOTED} select document_id, conversation_id, case when status = 'expert_verified' then case when evidence_count >= 3 and confidence >= 0.9 then 'require_human_review_for_global_promotion' else 'hold' end
when status = 'verified' then case when outcome is not null then 'promote_to_expert_verified' when confidence >= 0.9 and case when reliability = 0 then 0.5 else reliability end >= 0.85 then 'require_human_review_for_expert' else 'hold' end
when status = 'candidate' and (evidence_count >= 1 or confidence >= 0.72) then 'promote_to_verified' else 'hold' end as promotion from c""")
def fb16(t):
    k, denied = F.col("document_id") % 4, F.bool_or(F.col("verification_result") == "contradict")
    c = t("feedback").groupBy("document_id", "conversation_id").agg(
        denied.alias("denied"), F.count_distinct("verifier_type").alias("evidence_count"), F.max("confidence").alias("confidence"), (F.avg("confidence") * 2).alias("reliability"), F.max(F.when(F.col("feedback_id") % 10 == 0, "fixed")).alias("outcome")
    )
    status = F.when(k == 0, "expert_verified").when(k == 1, "verified").when(F.col("denied"), "rejected").otherwise("candidate")
    return fb.promotion(c.withColumn("status", status), to_global=True).select("document_id", "conversation_id", "promotion")


@query("fb17_memory", f"""with {LIVE}, cl as (select feedback_id, bool_or(feedback_id % 7 in (0, 3)) as vc, bool_or(feedback_id % 11 = 5) as dc from f group by 1),
rc as (select * from (select *, row_number() over (partition by conversation_id order by sec desc, feedback_id desc) as nth from f) where nth <= 20 and feedback_type <> 'suspicious'),
j as (select query_id, rc.*, vc and feedback_id % 13 <> 0 as vc, dc and feedback_id % 13 <> 0 as dc, len(list_filter(list_filter(string_split(lower(trim(question)), ' '), lambda w: length(w) >= 2), lambda w: contains(lower(left(trim(coalesce(comment, '')), 180)), w))) > 0 as related from asked join rc using (conversation_id) join cl using (feedback_id)),
m as (select query_id, case when dc or status = 'rejected' then 'conflict' when related and (feedback_type not in ('negative', 'positive') or vc or status in ('verified', 'promoted')) and (feedback_type in ('correction', 'confirmation', 'additional_information') or vc) and (status in ('verified', 'promoted') or vc) then 'correction' end as kind, feedback_id as ref_id, nth as place from j
  union all select query_id, 'patch', feedback_id, -sec from live
  union all select query_id, 'case', l_orderkey * 10 + l_linenumber, case when l_linenumber = 1 then 0 else 1 end from asked join lineitem on l_partkey % 60 = (query_id // 50) % 3 where l_linenumber <= 2),
r as (select query_id, kind, ref_id, row_number() over (partition by query_id, kind order by place, ref_id desc) as rank from m where kind is not null) select * from r where rank <= 3""")
def fb17(t):
    k = F.col("feedback_id")
    f = feedback_sec(t)
    claims = f.filter(k % 13 != 0).select("feedback_id", F.explode(F.array(F.when((k % 7).isin(0, 3), "verified").otherwise("open"), F.when(k % 11 == 5, "contradicted").otherwise("open"))).alias("claim_status"))
    n = F.col("l_linenumber")
    cases_ = t("lineitem").select((F.col("l_orderkey") * 10 + n).alias("case_id"), F.concat(F.lit("X-"), (F.col("l_partkey") % 60).cast("string")).alias("device"), F.when(n == 1, "expert_verified").when(n == 2, "verified").otherwise("candidate").alias("status"))
    return fb.feedback_memory(asked(t), f, claims, cases_, patches(t), NOW).select("query_id", "kind", "ref_id", "rank")


@query("fb18_audit", f"with {PATCH} select feedback_id, status as was, 'expired' as now from s where expires_sec <= {NOW} and feedback_id % 4 <> 0")
def fb18(t):
    p = patches(t)
    done = t("feedback").filter("feedback_id % 4 = 0").select("feedback_id", F.lit("expire").alias("action"))
    return fb.audit_rows(p, fb.expire_patches(p, NOW), done, "expire").select("feedback_id", "was", "now")


@query("evl09_effect", f"""with {FB}, a as (select feedback_id, min(sec + 60 * (feedback_id % 50) + 5) as applied from f where feedback_id % 3 = 0 group by 1)
select feedback_id, applied is not null as applied, coalesce(applied - sec, -1)::bigint as lag_sec, case when feedback_id % 8 = 7 then -1 else document_id end as target_id, case when feedback_id % 8 = 7 then -1 else 1 end as rank_before from f left join a using (feedback_id)""")
def evl09(t):
    f = feedback_sec(t).withColumn("retrieved", F.when(F.col("feedback_id") % 8 == 7, F.array().cast("array<bigint>")).otherwise(F.array(F.col("document_id"), F.col("document_id") + 1)))
    out = fb.feedback_effect(f, f.filter("feedback_id % 3 = 0").select("feedback_id", (F.col("sec") + 60 * (F.col("feedback_id") % 50) + 5).alias("applied_sec")))
    return out.select("feedback_id", "applied", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("lag_sec", "target_id", "rank_before")])
