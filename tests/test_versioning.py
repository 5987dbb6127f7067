"""Section alignment and publication on small rows."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import versioning as vn


def test_longest_increasing_subsequences():
    r = random.Random(1)
    for _ in range(300):
        places = r.sample(range(20), r.randint(0, 8))
        kept = [p for p, k in zip(places, vn.in_order(places)) if k]
        assert kept == sorted(kept)
        assert len(kept) == max(n for n in range(len(places) + 1) if any(list(c) == sorted(c) for c in itertools.combinations(places, n)))


def sections(spark, rows):
    df = spark.createDataFrame([(1, d, p, t, x, k) for d, p, t, x, k in rows], "version_id bigint, document_id bigint, position int, title string, text string, given string")
    return vn.section_keys(df.withColumn("version_id", F.coalesce("document_id", F.lit(-1))), key="given")


def test_alignment(spark):
    old = sections(spark, [(1, 0, "A", "a", "a"), (1, 1, "B", "b", "b"), (1, 2, "C", "c", "c"), (1, 3, "D", "d", "d"), (1, 4, "E", "e", "e"), (2, 0, "X", None, "x"), (None, 0, "N", "n", "n"), (3, 0, "Z", "z", "z"), (3, 1, "Z", "z", "y")])
    new = sections(spark, [(1, 0, "D", "d", "d"), (1, 1, "A", "a", "a"), (1, 2, "B", "b2", "b"), (1, 3, "C", "c", "c2"), (1, 4, "F", "f", "f"), (None, 5, "N", "n", "n"), (3, 0, "Z", "z", "w"), (1, 9, "again", "q", "a")])
    got = {(r.document_id, r.section_key): (r.change, r.moved) for r in vn.align(old, new).collect()}
    assert got == {
        (1, "a"): ("kept", False), (1, "b"): ("changed", False), (1, "c2"): ("renamed", False), (1, "d"): ("kept", True), (1, "e"): ("removed", False), (1, "f"): ("added", False),
        (2, "x"): ("removed", False), (None, "n"): ("kept", False), (3, "z"): ("removed", False), (3, "y"): ("removed", False), (3, "w"): ("added", False),
    }
    assert vn.align(old.limit(0), new.limit(0)).collect() == []


def test_keys(spark):
    rows = [(1, 0, "  My Title: v2! ", "x", None), (1, 1, "设备", "y", " "), (1, 2, None, None, None), (1, 3, "t", "", " own ")]
    assert [r.section_key for r in sections(spark, rows).orderBy("position").collect()] == ["my.title.v2.1", "section.2", "section.3", "own"]


def test_publication(spark):
    rows = [
        (1, 10, "published", "active", "H1", None, None), (2, 10, "published", "legacy_active", None, None, "2024-05-01"), (3, 10, "draft", "inactive", " h2 ", "2024-03-01", None),
        (4, 20, "published", "active", "H1", None, None), (5, 20, "draft", "inactive", "h1", None, None), (6, 30, "draft", "inactive", None, None, None), (7, 30, "draft", "inactive", None, "2024-02-01", "2024-01-01"),
        (8, 40, "draft", "inactive", None, None, None),
    ]
    versions = spark.createDataFrame(rows, "version_id bigint, document_id bigint, workflow_status string, validity_status string, hardware_version string, effective_from string, effective_to string")
    requests = spark.createDataFrame([(3, "replace", [2, 1, 2]), (5, "coexist", None), (6, "replace", None), (7, "replace", []), (8, "replace", [])], "version_id bigint, mode string, supersedes array<bigint>")
    defaults = spark.createDataFrame([(10, 2), (20, 4), (30, None), (40, None)], "document_id bigint, default_version_id bigint")
    plan = vn.publish(versions, requests, defaults, F.lit("2024-06-01"))
    assert {tuple(r) for r in plan.refused.collect()} == {(5, "same hardware"), (7, "range ends before it begins")}
    assert {(r.source_version_id, r.target_version_id) for r in plan.relations.collect()} == {(1, 3), (2, 3)}
    after = {r.version_id: (r.workflow_status, r.validity_status, r.effective_to) for r in plan.versions.collect()}
    assert after[1] == ("superseded", "superseded", "2024-03-01") and after[2] == ("superseded", "superseded", "2024-05-01")
    assert after[3] == after[8] == ("published", "active", None) and after[4] == ("published", "active", None) and after[5] == ("draft", "inactive", None)
    assert {tuple(r) for r in plan.defaults.collect()} == {(10, 3), (20, 4), (30, None), (40, 8)}
