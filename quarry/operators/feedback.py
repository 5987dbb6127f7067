"""Feedback learning: ingest, claims, evidence, reliability, patches and cases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.blanks import strip

#: Feedback types, what a given type stands for, and words that mark a scope, a conflict or a kind of text.
TYPES = ["positive", "negative", "correction", "confirmation", "additional_information"]
MEANING = {
    "positive": "confirmation", "confirmation": "confirmation", "negative": "dissatisfaction", "correction": "correction",
    "additional_information": "additional_information", "irrelevant": "irrelevant", "suspicious": "suspicious",
}
GLOBAL_WORDS = ["全局", "所有", "通用", "普遍"]
DEVICE_WORDS = ["设备", "本机", "当前设备", "这个设备", "该设备"]
FAULT_WORDS = ["故障", "原因", "根因", "fault"]
CONFLICT_WORDS = ["不是", "错误", "不对", "冲突", "相反", "错了"]
IRRELEVANT_MARKERS = ["irrelevant", "unrelated", "not relevant", "无关", "不相关", "与我的问题无关"]
PREFERRED_MARKERS = ["correct basis", "right evidence", "正确依据", "正确的依据", "这个文档是正确"]
NEGATIVE_TERMS = ["不是", "错误", "不对", "冲突", "contradict", "contrary"]
POSITIVE_TERMS = ["support", "confirmed", "verified", "correct", "是", "确认"]
CORRECTION = r"(?:不是|不是说)\s*([^\s，,。；;:]+)\s*[，,。；;:]\s*(?:是|而是)\s*([^\s，,。；;:]+)"
#: Mentions that a burst of comments may circle around.
MENTIONS = ["fan", "power", "module", "风扇", "电源", "模块", "a102"]


def text_of(column: Column | str) -> Column:
    """Trimmed text; null is empty."""
    return strip(column)


def has(text: Column, words: list[str]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def clamp(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def ingest_feedback(incoming: DataFrame, messages: DataFrame, existing: DataFrame) -> DataFrame:
    """FB-1: each incoming row with the reason it is refused, or accepted; one row per (user, session, message, type)."""
    keys = ["user_id", "session_id", "message_id", "feedback_type"]
    m = messages.select(F.col("id").alias("message_id"), F.col("user_id").alias("owner"), F.col("role").alias("message_role"))
    e = existing.select(*keys, F.lit(True).alias("known")).distinct()
    rows = incoming.join(m, "message_id", "left").join(e, keys, "left").withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("feedback_id")))
    reason = F.when(~F.col("feedback_type").isin(TYPES), "unknown type").when(F.col("owner").isNull(), "no message").when(F.col("owner") != F.col("user_id"), "foreign session").when(F.col("message_role") != 0, "not an answer").when(F.coalesce("known", F.lit(False)) | (F.col("n") > 1), "repeated").otherwise("accepted")
    return rows.select("feedback_id", reason.alias("outcome"))


def detected_type(given: Column, comment: Column) -> Column:
    """What a comment says it is; without such words, what its given type stands for."""
    text = text_of(comment)
    document = text.contains("文档") & has(text, ["正确", "对", "参考"])
    return F.when(text.contains("不是"), "correction").when(has(text, ["已经确认", "确认是"]) | document, "confirmation").otherwise(lookup(MEANING, F.lower(text_of(given)), "unclear"))


def comment_scope(comment: Column, has_context: Column) -> Column:
    text = F.lower(text_of(comment))
    return F.when(has(text, GLOBAL_WORDS), "global").when(has(text, DEVICE_WORDS), "device").when(has(text, FAULT_WORDS), "fault_type").when(has_context, "conversation").otherwise("feedback")


def claims_of(detected: Column, comment: Column, scope: Column) -> Column:
    """The claims of a comment: an array of (claim_type, subject, predicate, object, scope, confidence)."""
    text = text_of(comment)

    def claim(kind, subject, predicate, value, confidence):
        subject = F.lit(subject) if isinstance(subject, str) else subject
        return F.struct(F.lit(kind).alias("claim_type"), subject.alias("subject"), F.lit(predicate).alias("predicate"), value.cast("string").alias("object"), scope.alias("scope"), F.lit(confidence).alias("confidence"))

    right = F.regexp_extract(text, CORRECTION, 2)
    correction = F.when((detected == "correction") & (right != ""), claim("correction", F.when(has(text, ["故障", "根因", "原因"]), "root_cause").otherwise("answer"), "is", right, 0.78))
    after = lambda word: F.substring(text, F.instr(text, word) + len(word), F.length(text))
    said = F.trim(F.when(text.contains("确认是"), after("确认是")).otherwise(after("已经确认")))
    confirmation = F.when(
        (detected == "confirmation") & has(text, ["已经确认", "确认是"]), claim("confirmation", F.when(said != "", "fault_cause").otherwise("answer"), "is", F.nullif(said, F.lit("")), 0.68)
    )
    number = F.regexp_extract(text, r"文档\s*([0-9]+)", 1)
    document = F.when(text.contains("文档") & has(text, ["正确", "对", "参考文档"]), claim("document_preference", "document", "preferred", F.when(number != "", number).otherwise("preferred_document"), 0.5))
    first = F.array_compact(F.array(correction, confirmation, document))
    more = F.when((F.size(first) == 0) & (detected == "additional_information") & (text != ""), claim("additional_information", "symptom", "mentions", F.left(text, F.lit(255)), 0.45))
    unclear = F.when((detected == "unclear") & (text != ""), claim("unclear_feedback", "feedback", "is", F.left(text, F.lit(255)), 0.25))
    return F.concat(first, F.array_compact(F.array(more, unclear)))


def analyse_feedback(feedback: DataFrame) -> DataFrame:
    """FB-2: detected type, scope, conflict, risk, action, claims and evidence needs of each row.

    ``answer_text`` is what the feedback is about, ``device`` the active context's; both may
    be null. A null comment is empty.
    """
    comment, device = F.col("comment"), F.col("device")
    rows = feedback.withColumn("detected", detected_type(F.col("feedback_type"), comment)).withColumn("said_scope", comment_scope(comment, F.coalesce(device != "", F.lit(False))))
    rows = rows.withColumn("conflict", has(F.lower(text_of(comment)), CONFLICT_WORDS) & (text_of("answer_text") != "")).withColumn("claims", claims_of(F.col("detected"), comment, F.col("said_scope")))
    kind, conflict = F.col("detected"), F.col("conflict")
    risk = F.when(kind == "correction", "high").when(kind == "suspicious", "critical").when(kind.isin("irrelevant", "unclear", "dissatisfaction"), "medium").otherwise("low")
    risk = F.when(F.col("said_scope") == "global", "high").otherwise(risk)
    risk = F.when(conflict & (risk != "critical"), "high").otherwise(risk)
    action = (
        F.when(conflict & (kind == "correction"), "require_human_review")
        .when(kind == "suspicious", "require_human_review")
        .when(kind.isin("correction", "additional_information"), "verify")
        .when(kind.isin("irrelevant", "dissatisfaction"), "ignore")
        .otherwise("store_only")
    )
    needs = F.array_compact(
        F.array(F.when(F.size("claims") > 0, F.lit("retrieval")), F.when(kind.isin("correction", "additional_information"), F.lit("cross_case")), F.when(conflict, F.lit("human_review")))
    )
    scope = F.when((kind == "confirmation") & (F.col("said_scope") == "feedback"), "conversation").otherwise(F.col("said_scope"))
    return (
        rows.withColumn("risk", risk).withColumn("action", action).withColumn("needs", needs).withColumn("scope", scope)
        .withColumn("analysis_confidence", F.when(F.size("claims") > 0, 0.78).otherwise(0.5)).drop("said_scope")
    )


def extract_claims(analysed: DataFrame) -> DataFrame:
    """FB-3: one row per claim, numbered from 1 within its feedback; corrections, confirmations, preferred documents, more information, unclear texts."""
    return analysed.select("feedback_id", F.posexplode("claims").alias("n", "claim")).select("feedback_id", (F.col("n") + 1).alias("claim_no"), "claim.*")


def contradiction_hint(claim: Column, text: Column, title: Column) -> Column:
    """Whether an evidence text speaks against a claim: one denies what the other affirms."""
    fan = claim.contains("a102") & (text.contains("fan") | title.contains("fan") | text.contains("风扇"))
    against = has(claim, NEGATIVE_TERMS) & has(text, POSITIVE_TERMS) | has(claim, POSITIVE_TERMS) & has(text, NEGATIVE_TERMS)
    return F.when(fan, has(claim, ["power", "电源", "module", "模块"])).otherwise(against)


def claim_keywords(*parts: str, most: int = 8) -> Column:
    """The first distinct words of two characters at least."""
    words = F.split(F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts]), r"[\s,，。；;:/|_()-]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, most)


def collect_evidence(claims: DataFrame, sources: DataFrame, most_cases: int = 8) -> DataFrame:
    """FB-4: the sources of a claim that say something of it, with relevance, support, contradiction and side.

    ``sources`` are (claim_id, source_type, source_id, title, text) of the types document,
    answer, conversation_context, working_memory and fault_case; of cases the newest
    ``most_cases`` of a claim count. Relevance is the share of the claim's keywords in the text.
    """
    said = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("subject", "predicate", "object", "scope", "source")]))
    words = claims.select("claim_id", said.alias("claim_text"), claim_keywords("claim_type", "subject", "predicate", "object", "scope").alias("keywords"))
    nth = F.row_number().over(W.partitionBy("claim_id", "source_type").orderBy(F.desc("source_id")))
    # Only cases are counted; the texts of other sources stay where they are. Small letters are made once, not once a keyword.
    limited = F.coalesce(F.col("source_type") == "fault_case", F.lit(True))
    newest = sources.filter(limited).withColumn("nth", nth).filter(F.col("nth") <= most_cases).drop("nth")
    taken = sources.filter(~limited).unionByName(newest)
    taken = taken.withColumns({"low": F.lower(F.coalesce("text", F.lit(""))), "small_title": F.lower(F.coalesce("title", F.lit("")))})
    low, title = F.col("low"), F.col("small_title")
    found = F.size(F.filter("keywords", lambda k: low.contains(F.lower(k)))) / F.greatest(F.size("keywords"), F.lit(1))
    named = (F.col("source_type") == "document") & F.col("claim_text").contains(F.col("source_id").cast("string"))
    kind, rel = F.col("source_type"), F.col("relevance")
    rows = taken.join(words, "claim_id").withColumn("relevance", F.when((found == 0) & named, 0.9).otherwise(found)).filter(rel > 0)
    # A keyword counts here as it is written, against small letters.
    any_word = F.exists("keywords", lambda k: low.contains(k))
    any_title = F.exists("keywords", lambda k: title.contains(k))
    against = contradiction_hint(F.col("claim_text"), low, F.when(kind == "document", title).otherwise(""))
    support = (
        F.when(kind == "document", F.when(any_word | any_title, 0.6 * rel).otherwise(0.0))
        .when(kind == "answer", F.when(any_word, 0.4).otherwise(0.0))
        .when(kind == "conversation_context", 0.55)
        .when(kind == "working_memory", F.when(against, 0.2).otherwise(0.8))
        .when(kind == "fault_case", F.when(any_word, 0.75 * rel).otherwise(0.0))
    )
    contradiction = (
        F.when(kind == "document", F.when(against, F.greatest(F.lit(0.5), rel)).otherwise(0.0))
        .when(kind == "answer", F.when(against, 0.4).otherwise(0.0))
        .when(kind == "working_memory", F.when(against, 0.8).otherwise(0.0))
        .when(kind == "fault_case", F.when(against, 0.5 * rel).otherwise(0.0))
        .otherwise(0.0)
    )
    rows = rows.withColumn("s", support).withColumn("c", contradiction)
    s, c = F.col("s"), F.col("c")
    rows = rows.withColumn("side", F.when(s > c, "support").when(c > s, "contradict").when(kind == "document", None).otherwise("support")).filter("side is not null")
    case = kind == "fault_case"
    return rows.select(
        "claim_id", "source_type", "source_id", "relevance",
        F.when(case & (F.col("side") == "support"), F.greatest(F.lit(0.5), s)).otherwise(s).alias("support"),
        F.when(case & (F.col("side") == "contradict"), F.greatest(F.lit(0.5), c)).otherwise(c).alias("contradiction"), "side",
    )


def verify_claims(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """FB-5: verdict of each claim by the sums of its sides' evidence; sums are rounded to nine digits before they are compared."""
    total = lambda side, c: F.round(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c) * F.col("relevance"))), F.lit(0.0))), 9)
    sums = evidence.groupBy("claim_id").agg(total("support", "support").alias("support"), total("contradict", "contradiction").alias("contradiction"), F.count(F.lit(1)).alias("n"))
    rows = claims.select("claim_id").distinct().join(sums, "claim_id", "left").na.fill(0)
    s, c = F.col("support"), F.col("contradiction")
    confidence = F.least(F.lit(1.0), F.greatest(s, c) + F.least(F.lit(0.25), F.col("n") / 20))
    verdict = (
        F.when((s > 0) & (c > 0) & (F.round(F.abs(s - c), 9) <= 0.25), "uncertain")
        .when((s > c) & (s >= 0.35) & (c == 0), "supported")
        .when((c > s) & (c >= 0.35), "contradicted")
        .when(F.col("n") == 0, "insufficient")
        .otherwise("uncertain")
    )
    return rows.withColumn("confidence", confidence).withColumn("verdict", verdict)


def anomaly_factor(feedback: DataFrame) -> DataFrame:
    """FB-6: a factor from 0.25 to 1 by the user's last 24 hours, of the 19 rows before: volume, sameness, alternation, one mention, short comments."""
    w = W.partitionBy("user_id").orderBy("sec", "feedback_id").rowsBetween(-19, -1)
    low = F.lower(F.coalesce("comment", F.lit("")))
    said = F.array_compact(F.array(*[F.when(low.contains(m), F.lit(m)) for m in MENTIONS], F.when(F.coalesce("device", F.lit("")) != "", F.concat(F.lit("device:"), "device"))))
    rows = feedback.withColumn("said", said).withColumn("before", F.collect_list(F.struct("sec", "feedback_type", "said")).over(w))
    rows = rows.withColumn("day", F.reverse(F.filter("before", lambda x: x["sec"] >= F.col("sec") - 86400)))
    day, n = F.col("day"), F.size("day")
    same = (n >= 4) & F.forall(day["feedback_type"], lambda x: F.lower(x) == F.lower(day[0]["feedback_type"]))
    good = lambda i: F.coalesce(F.lower(F.get(day, F.lit(i))["feedback_type"]).isin("positive", "confirmation"), F.lit(False))
    swings = (n >= 4) & (good(0) != good(1)) & (good(1) != good(2)) & (good(2) != good(3))
    mentions = F.flatten(day["said"])
    circling = F.coalesce(F.array_max(F.transform(F.array_distinct(mentions), lambda m: F.size(F.filter(mentions, lambda x: x == m)))) >= 4, F.lit(False))
    given = F.coalesce("comment", F.lit(""))
    factor = F.lit(1.0)
    for condition, f in ((n >= 8, 0.7), (same, 0.75), (swings, 0.6), (circling, 0.8), ((given != "") & (F.length(F.trim(given)) <= 2), 0.85)):
        factor = factor * F.when(F.coalesce(condition, F.lit(False)), f).otherwise(1.0)
    return rows.select("feedback_id", n.alias("in_day"), clamp(factor, 0.25, 1.0).alias("factor"))


#: Strength of a verification by who made it, raised by the kinds of evidence that it names.
BASE = {"maintenance_outcome": 1.0, "human": 0.95, "expert": 0.9, "retrieval": 0.7, "rule": 0.7, "llm": 0.6, "cross_case": 0.8}
RAISED = {"fault_case": 0.9, "document": 0.75, "conversation_context": 0.65, "working_memory": 0.7, "answer": 0.55}
OTHER_BASE = 0.55


def evidence_strength(verifications: DataFrame) -> DataFrame:
    """FB-7: strength of a verification; ``evidence_types`` is an array. Without a verifier and result it is 0."""
    base = lookup(BASE, F.lower("verifier_type"), OTHER_BASE)
    raised = F.array_max(F.transform("evidence_types", lambda t: lookup(RAISED, F.lower(t), 0.0)))
    none = F.col("verifier_type").isNull() & F.col("verification_result").isNull()
    return verifications.withColumn("strength", F.when(none, 0.0).otherwise(clamp(F.greatest(base, F.coalesce(raised, F.lit(0.0))), 0.0, 1.0)))


def direction(result: Column) -> Column:
    return F.when(F.lower(result) == "support", 1).when(F.lower(result) == "contradict", -1).otherwise(0)


#: Fixed values of the fold: first score, largest step, decay by week and by event, least weight, prior strength.
PRIOR, STEP_CAP, WEEK, DECAY, LEAST_WEIGHT = 0.5, 0.18, 604800.0, 0.98, 0.05
STATE = ["score", "n", "last", "verified", "rejected", "corrections", "right_corrections", "verified_weight", "rejected_weight", "correction_weight"]
START = (PRIOR, 0, 0.0, 0, 0, 0, 0, 0.0, 0.0, 0.0)
RELIABILITY = "user_id long, reliability double, n long, verified long, rejected long, corrections long, right_corrections long, verified_weight double, rejected_weight double, correction_weight double"


def reliability_step(state: tuple, sec: float, way: int, weight: float, correction: bool) -> tuple:
    """One event of FB-8: a beta prior that idle weeks weaken, moved by the event's weight in a capped step."""
    score, n, last, verified, rejected, corrections, right, vw, rw, cw = state
    strength = min(12.0, 2.0 + 0.25 * n) * (DECAY ** (max(0.0, sec - last) / WEEK) if n else 1.0)
    alpha, beta, w = max(1.0, score * strength), max(1.0, (1 - score) * strength), max(LEAST_WEIGHT, weight)
    up, down = (w, 0.0) if way > 0 else (0.0, w)
    target = (alpha + up) / (alpha + beta + w)
    score = min(1.0, max(0.0, score + max(-STEP_CAP, min(STEP_CAP, target - score))))
    if correction:
        corrections, right, cw = corrections + 1, right + (way > 0), cw * DECAY + weight
    return score, n + 1, float(sec), verified + (way > 0), rejected + (way < 0), corrections, right, vw * DECAY + up, rw * DECAY + down, cw


def reliability_row(user, state: tuple) -> dict:
    return {"user_id": user, "reliability": state[0], "n": state[1]} | dict(zip(STATE[3:], state[3:]))


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events in the order of users and time; only the current user's state is held."""
    user, state = None, START
    for frame in frames:
        done = []
        for who, sec, way, weight, correction in zip(frame["user_id"], frame["sec"], frame["direction"], frame["weight"], frame["correction"]):
            if who != user:
                if user is not None:
                    done.append(reliability_row(user, state))
                user, state = who, START
            state = reliability_step(state, sec, way, weight, correction)
        yield pd.DataFrame(done, columns=list(reliability_row(0, START)))
    if user is not None:
        yield pd.DataFrame([reliability_row(user, state)])


def user_reliability(events: DataFrame) -> DataFrame:
    """FB-8: per user the fold of its events (sec, feedback_id, direction, weight, correction) in order.

    Events without direction or weight are skipped; repeated events count once. A user's
    events stream through one task in order, so a very active user takes time, not memory.
    """
    rows = events.filter("user_id is not null and direction <> 0 and weight > 0").dropDuplicates(["feedback_id"])
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "sec", "feedback_id")
    return ordered.mapInPandas(_fold, RELIABILITY)


#: Fixed values of the patch policy.
MAX_WEIGHT, MAX_CANDIDATE, MAX_NEW_USER, MAX_NEGATIVE = 0.25, 0.10, 0.06, 0.05
SCOPES = ["conversation", "device", "fault_type", "user"]
PATCH_TYPES = ["boost", "penalty", "preferred_document", "exclusion"]
VERIFIED_STATUS, VERIFIED_RESULT, BLOCKED_RESULT = ["verified", "promoted", "expert_verified"], ["verified", "expert_verified", "support"], ["contradict", "contradicted", "suspicious"]
PATCH_BASE = {"maintenance_outcome": 1.0, "human": 0.95, "expert": 0.9, "retrieval": 0.75, "rule": 0.7, "llm": 0.65, "cross_case": 0.8}
RESULT_BONUS = {"support": 1.0, "uncertain": 0.45, "insufficient": 0.25, "contradict": 0.0}
DAYS = {"candidate": 7, "active": 21, "verified": 30, "expert_verified": 45}


def query_signature(scope: str, query: Column, values: dict[str, Column]) -> Column:
    """FB-11: scope and 24 hex digits of the SHA-1 of the query in small letters and the scope's values, as sorted JSON."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1)
    inner = [F.concat(F.lit(f'"{name}": '), quoted(values[name])) for name in sorted(values)]
    text = F.concat(F.lit('{"query": '), quoted(F.lower(text_of(query))), F.lit(f', "scope": "{scope}", "values": {{'), F.concat_ws(", ", *inner), F.lit("}}"))
    return F.concat(F.lit(f"{scope}:"), F.left(F.sha1(text.cast("binary")), F.lit(24)))


def make_patches(feedback: DataFrame, reliability: DataFrame) -> DataFrame:
    """FB-9: ranking patches that the policy allows: type, signature, weight, status and expiry.

    ``reliability`` is FB-8's table; a user without it, or with fewer than two verified rows,
    is new. Suspicious and contradicted feedback gives no patch, and neither does a negative
    one that does not call the document irrelevant, nor an unknown document.
    """
    col, known = F.col, reliability.select("user_id", "reliability", "verified")
    kind = F.when(F.lower("feedback_type").isin("confirmation", "positive"), "preferred_document").otherwise("penalty")
    rows = feedback.join(known, "user_id", "left").withColumn("patch_type", kind).withColumn("scope", F.lit("conversation"))
    given, result, who = F.lower(text_of("feedback_type")), F.lower(text_of("verification_result")), F.lower(text_of("verifier_type"))
    low = F.lower(text_of("comment"))
    type_ = col("patch_type")
    allowed = (given != "suspicious") & ~result.isin(BLOCKED_RESULT) & col("scope").isin(SCOPES) & type_.isin(PATCH_TYPES)
    allowed &= ~((given == "positive") & (type_ == "boost"))
    allowed &= ~((given == "negative") & (type_ == "penalty")) | has(low, IRRELEVANT_MARKERS)
    allowed &= ~((type_ == "preferred_document") & (result == "") & (who == "")) | has(low, PREFERRED_MARKERS)
    verified = F.lower(text_of("status")).isin(VERIFIED_STATUS) | result.isin(VERIFIED_RESULT)
    r, c = F.coalesce(F.nullif("reliability", F.lit(0.0)), F.lit(PRIOR)), F.coalesce("confidence", F.lit(0.0))
    pushes = type_.isin("boost", "penalty")
    candidate = clamp(F.when(pushes, 0.04).otherwise(0.06) * (0.5 + c * 0.5) * (0.6 + r * 0.4), 0.01, MAX_CANDIDATE)
    factor = F.when(type_.isin("preferred_document", "boost"), 1.0).otherwise(0.9)
    full = clamp(lookup(PATCH_BASE, who, 0.6) * lookup(RESULT_BONUS, result, 0.3) * (0.45 + r * 0.55) * factor * (0.55 + c * 0.45), 0.01, MAX_WEIGHT)
    full = F.when(F.coalesce("verified", F.lit(0)) < 2, F.least(full, F.lit(MAX_NEW_USER))).otherwise(full)
    weight = F.least(F.when(verified, full).otherwise(candidate), F.when(pushes, MAX_CANDIDATE).otherwise(MAX_WEIGHT))
    weight = F.when((given == "negative") & type_.isin("boost", "preferred_document"), F.least(weight, F.lit(MAX_NEGATIVE))).otherwise(weight)
    status = F.when(verified, "active").otherwise("candidate")
    return rows.filter(allowed & (verified | (type_ != "boost")) & (col("document_id") > 0)).select(
        "feedback_id", "user_id", "document_id", "scope", query_signature("conversation", col("comment"), {"conversation_id": col("conversation_id")}).alias("signature"),
        "patch_type", F.when(type_.isin("boost", "preferred_document"), 1).otherwise(-1).alias("sign"), weight.alias("weight"), clamp(c, 0.0, 1.0).alias("confidence"),
        status.alias("status"), col("sec"), (col("sec") + lookup(DAYS, status, 7) * 86400).alias("expires_sec"),
    )


def expire_patches(patches: DataFrame, as_of: int) -> DataFrame:
    """FB-10."""
    return patches.withColumn("status", F.when(F.col("expires_sec") <= as_of, "expired").otherwise(F.col("status")))


def applicable_patches(contexts: DataFrame, patches: DataFrame, as_of: int) -> DataFrame:
    """FB-11: per query the active patches in force whose signature one of its four scopes has, the newest of each document and type.

    ``contexts`` have query_id, query, user_id, conversation_id, device, device_type,
    component, firmware_version and fault_type; nulls are values as any other.
    """
    values = {"conversation": ["conversation_id"], "device": ["device", "device_type", "component", "firmware_version"], "fault_type": ["fault_type"], "user": ["user_id"]}
    keys = F.array(*[F.struct(F.lit(s).alias("scope"), query_signature(s, F.col("query"), {v: F.col(v) for v in names}).alias("signature")) for s, names in values.items()])
    wanted = contexts.select("query_id", F.inline(keys)).distinct()
    live = patches.filter((F.col("status") == "active") & (F.col("expires_sec") > as_of))
    # The newest of a signature is the same for every query, so it is found before queries and patches meet.
    own = ["scope", "signature", "document_id", "patch_type"]
    rest = [c for c in live.columns if c not in own]
    newest = live.groupBy(*own).agg(F.max_by(F.struct(*rest), F.struct("sec", "feedback_id")).alias("p")).select(*own, "p.*")
    return wanted.join(newest, ["scope", "signature"]).select("query_id", *live.columns)


def apply_patches(ranked: DataFrame, patches: DataFrame, *, query: str = "query_id", key: str = "doc_id", score: str = "doc_score") -> DataFrame:
    """FB-12: scores moved by the sum of patch contributions within bounds, and ranked anew; patches with a query hold for that one."""
    own = [query] if query in patches.columns else []
    sums = patches.groupBy(*own, F.col("document_id").alias(key)).agg(F.sum(F.col("sign") * F.col("weight") * (0.5 + 0.5 * F.col("confidence"))).alias("push"))
    base = F.col(score)
    raw = clamp(F.coalesce("push", F.lit(0.0)) * (0.5 + F.least(F.lit(0.5), base)), -0.25, 0.25)
    moved = F.when(raw >= 0, F.least(raw, base, F.greatest(F.lit(0.0), 1 - base))).otherwise(F.greatest(raw, -base))
    rows = ranked.join(sums, [*own, key], "left").withColumn("patched", base + moved)
    return rows.withColumn("new_rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc(F.round("patched", 9)), "rank")))


def upsert_cases(cases: DataFrame, new: DataFrame) -> DataFrame:
    """FB-13: cases by key: ids unioned, greatest confidence, first known fields, rejected once contradicted."""
    both = cases.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    first = F.min_by("component", F.when(F.col("component").isNotNull(), F.struct("age", "feedback_id")))
    return both.groupBy("case_key").agg(F.array_sort(F.collect_set("feedback_id")).alias("feedback_ids"), F.max("confidence").alias("confidence"), first.alias("component"), F.when(F.bool_or("contradicted"), "rejected").otherwise("candidate").alias("status"))


def verify_cases(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """FB-14: an outcome or an expert makes a case expert-verified with at least 0.9; others are verified unless rejected."""
    rows = cases.join(outcomes.groupBy("case_key").agg(F.bool_or("expert").alias("expert")), "case_key", "left")
    sure = F.col("expert").isNotNull() & F.col("expert")
    status = F.when(sure, "expert_verified").when(F.col("status") == "rejected", "rejected").when(F.col("expert").isNotNull(), "verified").otherwise(F.col("status"))
    return rows.select("case_key", status.alias("status"), F.when(sure, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")).alias("confidence"))


def similar_cases(queries: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """FB-15: the newest ``k`` cases of a query's device whose component holds the query's ``wanted``.

    Where queries have ``device_type`` or ``firmware_version``, a case must have the same;
    a null asks for nothing. Cases keep their columns but those that the query has.
    """
    asked = [c for c in ("device_type", "firmware_version") if c in queries.columns]
    hit = F.col("wanted").isNull() | F.col("component").contains(F.col("wanted"))
    rows = cases.withColumnsRenamed({c: f"case_{c}" for c in asked})
    for c in asked:
        hit &= F.col(c).isNull() | (F.col(c) == F.col(f"case_{c}"))
    found = queries.join(rows, "device").filter(hit).drop(*[f"case_{c}" for c in asked])
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("case_id")))).filter(F.col("rank") <= k)


def promotion(cases: DataFrame, *, to_global: bool = False) -> DataFrame:
    """FB-16: what becomes of a case (status, evidence_count, confidence, reliability, outcome); the global rule is off unless asked for."""
    c = F.col
    sound = c("status") != "rejected"
    outcome = F.coalesce(c("outcome") != "", F.lit(False))
    r = F.coalesce(F.nullif("reliability", F.lit(0.0)), F.lit(PRIOR))
    return cases.withColumn(
        "promotion",
        F.when(F.lit(to_global) & (c("status") == "expert_verified") & (c("evidence_count") >= 3) & (c("confidence") >= 0.9) & sound, "require_human_review_for_global_promotion")
        .when((c("status") == "verified") & outcome, "promote_to_expert_verified")
        .when((c("status") == "verified") & (c("confidence") >= 0.9) & (r >= 0.85), "require_human_review_for_expert")
        .when((c("status") == "candidate") & ((c("evidence_count") >= 1) | (c("confidence") >= 0.72)) & sound, "promote_to_verified")
        .otherwise("hold"),
    )


VERIFIED_CLAIM = ["verified", "expert_verified", "partially_verified"]


def feedback_memory(contexts: DataFrame, feedback: DataFrame, claims: DataFrame, cases: DataFrame, patches: DataFrame, as_of: int, most: int = 3, look_back: int = 20) -> DataFrame:
    """FB-17: what feedback tells a question of a conversation: verified corrections, open conflicts, cases and patches, ``most`` of each.

    ``contexts`` are those of FB-11 with ``device``; ``claims`` (feedback_id, claim_status);
    ``cases`` (case_id, device, status, summary). Of a conversation the newest
    ``look_back`` rows of feedback count, suspicious ones left out.
    """
    states = claims.groupBy("feedback_id").agg(F.bool_or(F.col("claim_status").isin(VERIFIED_CLAIM)).alias("verified_claim"), F.bool_or(F.col("claim_status") == "contradicted").alias("denied_claim"))
    w = W.partitionBy("conversation_id").orderBy(F.desc("sec"), F.desc("feedback_id"))
    recent = feedback.withColumn("nth", F.row_number().over(w)).filter((F.col("nth") <= look_back) & (F.col("feedback_type") != "suspicious")).join(states, "feedback_id", "left").na.fill(False, ["verified_claim", "denied_claim"])
    rows = contexts.select("query_id", "query", "conversation_id").join(recent.drop("device"), "conversation_id")
    terms = F.slice(F.filter(F.split(F.lower(F.left(text_of("query"), F.lit(240))), r"\s+"), lambda t: F.length(t) >= 2), 1, 12)
    low = F.lower(F.left(text_of("comment"), F.lit(180)))
    related = (F.size(terms) == 0) | F.exists(terms, lambda t: low.contains(t))
    good, claim, given = F.col("status").isin("verified", "promoted"), F.col("verified_claim"), F.col("feedback_type")
    useful = related & ~(given.isin("negative", "positive") & ~claim & ~good) & (given.isin("correction", "confirmation", "additional_information") | claim) & (good | claim)
    kind = F.when(F.col("denied_claim") | F.col("status").isin("rejected", "contradicted"), "conflict").when(useful, "correction")
    said = rows.withColumn("kind", kind).filter("kind is not null").select("query_id", "kind", F.col("feedback_id").alias("ref_id"), F.col("nth").cast("long").alias("place"))
    found = applicable_patches(contexts, patches, as_of).select("query_id", F.lit("patch").alias("kind"), F.col("feedback_id").alias("ref_id"), (-F.col("sec")).alias("place"))
    expert = F.when(F.col("status") == "expert_verified", 0).otherwise(1)
    sure = cases.filter(F.col("status").isin("verified", "expert_verified")).select("device", F.col("case_id").alias("ref_id"), expert.cast("long").alias("place"))
    first = sure.withColumn("n", F.row_number().over(W.partitionBy("device").orderBy("place", F.desc("ref_id")))).filter(F.col("n") <= most)
    known = contexts.select("query_id", "device").join(first, "device").select("query_id", F.lit("case").alias("kind"), "ref_id", "place")
    both = said.unionByName(found).unionByName(known)
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "kind").orderBy("place", F.desc("ref_id")))).filter(F.col("rank") <= most).drop("place")


def audit_rows(before: DataFrame, after: DataFrame, audited: DataFrame, action: str, key: str = "feedback_id") -> DataFrame:
    """FB-18: one row for each changed state that is not audited yet."""
    rows = before.select(key, F.col("status").alias("was")).join(after.select(key, F.col("status").alias("now")), key, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return rows.withColumn("action", F.lit(action)).join(audited.select(key, "action").distinct(), [key, "action"], "left_anti")


def feedback_effect(feedback: DataFrame, audits: DataFrame) -> DataFrame:
    """EVL-9: seconds from a feedback to the first patch that it made, and the rank of the target document before.

    ``retrieved`` is the feedback's array of document ids, of which the first is the target.
    """
    first = audits.groupBy("feedback_id").agg(F.min("applied_sec").alias("applied_sec"))
    target = F.get("retrieved", F.lit(0))
    rank = F.nullif(F.array_position("retrieved", target), F.lit(0))
    rows = feedback.join(first, "feedback_id", "left")
    return rows.select("feedback_id", F.col("applied_sec").isNotNull().alias("applied"), (F.col("applied_sec") - F.col("sec")).alias("lag_sec"), target.alias("target_id"), rank.alias("rank_before"))
