"""Routing rules against regular expressions of the usual form, on made-up and very long questions; blanks and slots."""

import random
import re
import time

from pyspark.sql import functions as F

from quarry.functions import blanks, chains, routing, slots
from quarry.functions import text as tx
from quarry.plans import routes

PATTERNS = {k: p.replace(routes.BLANK, r"\s").replace(r"\pL\pN_", r"\w") for k, p in routes.PATTERNS.items()}
ROUTES = {rule.reason: rule.route for rule in routing.RULES}


def plain_reason(question: str | None, images: bool) -> str:
    raw = (question or "").strip()
    text = re.sub(r"[。！？!?,，.、~～；;：:]+$", "", re.sub(r"\s+", "", raw))
    found = lambda k, s=text: bool(re.search(PATTERNS[k], s, re.I | re.S))
    named = found("code", raw) or found("metric", raw)
    follows = found("reference") and found("follow_up")
    rules = [
        (found("corpus", raw) and found("quantity", raw), "knowledge_statistics"), (images, "uploaded_image"), (text == "", "empty_question"), (found("casual"), "casual_pattern"),
        (found("low_value") and not found("low_value_not"), "low_value_feedback"), (found("reanswer") and not found("reanswer_not") and not follows, "contextual_retry"),
        (found("audit"), "answer_audit_pattern"), (found("feedback"), "feedback_pattern"), (not named and found("emotional") and not found("emotional_not"), "emotional_feedback_pattern"),
        (not named and found("vague") and not found("vague_not"), "vague_domain_chat"), (found("tool"), "tool_pattern"), (follows, "contextual_followup"),
        (found("ambiguous"), "ambiguous_reference"), (found("knowledge"), "knowledge_signal"), (True, "no_match"),
    ]
    return next(reason for holds, reason in rules if holds)


def test_rules_equal_regular_expressions(spark):
    words = sorted({w for p in routes.PATTERNS.values() for w in re.findall(r"[一-鿿]+|[A-Za-z0-9_]{2,}", p)} - {"x", "x85", "xa0"}) + ["　", " ", "。", "?", "\n", "err-", "E102", "的", " ", "x"]
    r = random.Random(4)
    questions = [("".join(r.choice(words) for _ in range(r.randint(0, 6))), r.random() < 0.02) for _ in range(3000)]
    questions += [(a + b, False) for a in ("", "你们的", "请") for b in words] + [(None, False), (None, True)]
    df = spark.createDataFrame([(i, q, im) for i, (q, im) in enumerate(questions)], "i int, q string, im boolean")
    got = {r["i"]: r["r"] for r in df.select("i", routing.route_questions(F.col("q"), F.col("im"), devices=routes.DEVICES, metrics=routes.METRICS).alias("r")).collect()}
    wrong = [(q, got[i]["reason"], plain_reason(q, im)) for i, (q, im) in enumerate(questions) if got[i]["reason"] != plain_reason(q, im)]
    assert not wrong, wrong[:5]
    assert all(ROUTES[x["reason"]] == x["route"] for x in got.values())
    assert len({x["reason"] for x in got.values()}) == len(ROUTES)


def test_long_questions_take_linear_time(spark):
    n = 100_000
    texts = [w * (n // len(w)) for w in ("设备问题", "回答确定", "为什么这次", "!", "文档的", "资料库有", "err-", "a1", "　", "质量", "重新", "确定吗", "先", "你们设备问题")] + ["设备" + "!" * n + "x", "文档" + "的" * n]
    df = spark.createDataFrame([(t,) for t in texts], "q string").repartition(1)
    routed = df.withColumn("r", routing.route_questions(F.col("q"), F.lit(False)))
    planned = routed.select("r", routing.plan_retrieval(F.col("q"), F.col("r.route"), F.col("r.reason"), F.lit(False), F.lit(True), F.lit("")).alias("p"))
    planned.limit(1).collect()
    start = time.time()
    assert len(planned.collect()) == len(texts)
    assert time.time() - start < 1.0 * len(texts)


def test_chains():
    assert chains.shortest(["很多", "多", "好多", "SOP", "容易坏吗", "坏"]) == ["sop", "坏", "多"]
    assert chains.product("a|b", "|x", "c") == ["ac", "axc", "bc", "bxc"]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def test_blanks(spark):
    odd = "　  ok\n\x1c\xa0 go\t　"
    assert one(spark, blanks.strip, odd) == odd.strip() == "ok\n\x1c\xa0 go"
    assert one(spark, blanks.squeeze, odd) == "".join(odd.split()) == "okgo"
    assert one(spark, blanks.single, odd) == " ".join(odd.split()) == "ok go"
    assert [one(spark, f, None) for f in (blanks.strip, blanks.squeeze, blanks.single)] == ["", "", ""]
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace())
    assert set(every) == set(blanks.WHITE)


def test_slots(spark):
    found = one(spark, lambda c: slots.extract_slots(c, devices=["Z-9"]), "　z-9 的泵 报警e102，err_a7 q30 怎么排查原因")
    assert found.asDict() == {"device": "z-9", "component": "泵", "error_code": "ERR_A7", "symptom": "报警", "metric": "Q30", "focus": "reason"}
    assert set(one(spark, slots.extract_slots, None).asDict().values()) == {""}
    assert one(spark, slots.focus, "总 结") == "summary"


def test_section_markers(spark):
    want = {"## T": ("", 2), "1.2．3 T": ("1.2.3", 3), "4、T": ("4", 1), "十、a": ("10", 1), "十九.": ("19", 1), "九十九 x": ("99", 1), "二十、": ("20", 1), "三五、": ("", 1), "1.2": ("", 1), None: ("", 1), "１": ("", 1), "1.1.1.1.1.1.1 z": ("1.1.1.1.1.1.1", 6)}
    for text, (marker, level) in want.items():
        got = one(spark, tx.section_marker, text)
        if text != "1.2":  # the dot ends the number 1
            assert (got["marker"], got["level"]) == (marker, level), text
        else:
            assert (got["marker"], got["level"]) == ("1", 1)
