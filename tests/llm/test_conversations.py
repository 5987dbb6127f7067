"""Conversation repair against a plain table of states."""

import os
import random

import brute
import pytest

from quarry.llm import branch, conversations

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df, **sizes):
    rows = conversations.report(df, **sizes).collect()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def odd_rows(n: int, convs: int, seed: int = 3):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "a\nb!", "ü. \x0b", None, "long " * 300]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"]
    return [(r.choice([None, *range(convs)]), r.choice([None, *range(-3, 12)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert reported(df) == brute.conversations([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("sizes", [{}, {"run_turns": 1}, {"run_turns": 3}, {"run_bytes": 10}])
def test_odd_rows_and_runs(spark, sizes):
    """Nulls, ties, copies and clashing columns; runs of any size give the same repair."""
    rows = odd_rows(600, 12)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as copies", "3 as key", "4 as part")
    assert reported(df, **sizes) == brute.conversations(rows)


def test_one_long_conversation_spans_tasks(spark):
    r = random.Random(5)
    rows = [(7, i, r.choice(["user", "assistant", "assistant", "system"]), f"text {i % 400}" + r.choice(["", "."])) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = conversations.runs(conversations.faults(conversations.damage(df.withColumnRenamed("conv_id", "conv"))), run_turns=64).select("part").distinct().count()
        got = reported(df, run_turns=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1 and got == brute.conversations(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.report(df).collect() == [] and conversations.repair(df).collect() == []


def test_repair_keeps_real_outputs(spark):
    rows = [("a", 0, "system", "Be brief."), ("a", 1, "user", "Hi!"), ("a", 2, "user", "Hi!"), ("a", 3, "user", "Well?"), ("a", 4, "assistant", "Fine.")]
    df = spark.createDataFrame(rows, "talk string, turn bigint, role string, text string")
    got = [(r["role"], r["text"], r["edit"]) for r in conversations.repair(df, conv_col="talk").orderBy("part", "run", "place").collect()]
    assert got == [("system", "Be brief.", "K"), ("user", "Hi!", "K"), ("assistant", "", "I"), ("user", "Well?", "K"), ("assistant", "Fine.", "K")]


def all_repairs(items, entry, goal, room=2):
    """Every repair with at most ``room`` inserts in a row: (cost, audit)."""
    follow = branch._NEXT

    def walk(i, state, cost, audit, put):
        if i == len(items) and (state == goal or goal == branch.FINISH and state in (branch.START, branch.ASSISTANT)):
            yield cost, audit
        r = "a" if state == branch.USER else "u"
        if put < room and (i < len(items) or goal == branch.FINISH):
            yield from walk(i, follow[state, r], cost + 2, audit + "I", put + 1)
        if i < len(items):
            item = items[i]
            if isinstance(item, branch.Forced):
                yield from walk(i + 1, state, cost + 3 * item.copies, audit + "D" * item.copies, 0)
            else:
                yield from walk(i + 1, state, cost + 3, audit + "D", 0)
                if (state, item.initial) in follow:
                    yield from walk(i + 1, follow[state, item.initial], cost + item.extra, audit + "K", 0)
                yield from walk(i + 1, follow[state, r], cost + 2 + item.extra, audit + "R", 0)

    return min(walk(0, entry, 0, "", 0), default=None)


def test_search_equals_all_repairs():
    r = random.Random(1)
    for _ in range(600):
        roles = r.choice(["ua", "uas", "usx", "uaaax "])
        items = [branch.Forced(r.randint(1, 2)) if r.random() < 0.2 else branch.Free(r.choice(roles), int(r.random() < 0.3)) for _ in range(r.randint(0, 5))]
        entry, goal = r.choice([(0, 4)] * 3 + [(x, y) for x in range(4) for y in range(5)])
        want = all_repairs(items, entry, goal)
        assert branch.search(items, entry, goal) == want
        if want:
            assert branch.Suffixes(items, goal).least(0, entry) <= want[0]
