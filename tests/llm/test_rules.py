"""Quality rules against plain counts and planted labels."""

import os
import re
from collections import Counter

import pytest

from quarry.llm import rules

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def counted(df):
    return {r["doc_id"]: tuple(r[c] for c in rules.BASE) for r in df.collect()}


def test_counts_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert counted(rules.counts(docs)) == {r["doc_id"]: plain_counts(r["text"]) for r in docs.collect()}


def test_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "a", "a b c d e", "a a a a a a", "x y z u v w x y z u v", "é#　ü |\nq\nq\n q\nq", "1 2 3 4 5 6 1 2 3 4 5 7 3 4 5 6 1", "w " * 30_000 + "end", "\x00 \x1c<>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as w", "2 as l", "3 as n_words")
    assert counted(rules.counts(df)) == {i: plain_counts(t) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    return (*rules.judge(docs, labels), labels)


def test_held_out_accuracy(spark, judged):
    rows, learned, labels = judged
    assert 1 <= len(learned) <= 12 and all("reject if" in str(r) for r in learned)
    held = rows.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0 and not base_failed").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in held)
    assert len(held) > 30 and right >= 0.97 * len(held)
    assert sum(not r["kept"] for r in held if r["quality"]) <= 0.01 * len(held)


def test_rules_are_an_ordered_list(judged):
    rows, learned, _ = judged
    for r in rows.drop("doc_id").limit(300).collect():
        met = [i for i, rule in enumerate(learned, 1) if all((r[t.statistic] >= t.cut) == t.above for t in rule.terms)]
        assert r["rule"] == (met[0] if met else 0)
        assert r["kept"] == (not r["base_failed"] and not met)


def test_best_term_is_the_best_of_all():
    import math

    values = [(3, 0), (3, 1), (7, 0), (7, 0), (12, 1), (40, 0), (1, 1), (80, 1), (80, 1)]  # (symbols, y)
    cuts = rules.STATISTICS["symbols"][0]
    histogram = {"symbols": [[sum(sum(v >= c for c in cuts) == s and y == k for v, y in values) for k in (0, 1)] for s in range(len(cuts) + 1)]}
    p, n = 4, 5

    def gain(above, cut):
        a, b = (sum((v >= cut) == above and y == k for v, y in values) for k in (0, 1))
        return a * (math.log2(a / (a + b)) - math.log2(p / (p + n))) if a else 0

    term, a, b = rules.best_term(histogram)
    assert gain(term.above, term.cut) == pytest.approx(max(gain(x, c) for x in (True, False) for c in cuts))
    assert (a, b) == tuple(sum((v >= term.cut) == term.above and y == k for v, y in values) for k in (0, 1))


def test_no_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x"), (1, "again " * 12)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = sorted(((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in rules.report(docs, none).collect()), key=str)
    assert got == sorted([(1, 10, False, True), (1, 12, True, False), (2, 0, True, False), (None, 1, True, False)], key=str)
    odd = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert rules.report(docs.limit(0), odd).collect() == []
    assert rules.judge(docs, odd)[1] == []
