"""The browsing tree, timing sketches and document search on small rows."""

import random

from pyspark.sql import functions as F

from quarry.operators import directory, filters, stats

SCHEMA = "doc_id int, doc_title string, section_id int, section_index int, section_title string, site string, page_id string, title_path array<string>, ancestor_ids array<string>, parent_id string, child_pages array<string>, source_version string, attachment_id string, attachment_title string, navigation_only boolean"


def row(doc, section, page, path, ancestors=None, children=None, version="1", attachment=None, nav=False, site="S", parent=None):
    return (doc, f"d{doc}", section, section, None, site, page, path, ancestors, parent, children, version, attachment, attachment and "file", nav)


def test_tree(spark):
    rows = [
        row(1, 10, "1", ["Home"], children=["3", "2", "3"], version="9"), row(2, 20, "2", ["Home", "b"], ["1"]), row(3, 30, "3", ["Home", "a"], ["1"]), row(4, 40, "9", ["Home", "A"], ["1"]),
        row(5, 50, "1", ["Home"], children=["9"], version="10", attachment="x"), row(6, 60, "7", ["Home", "Lost", "deep"], ["1"], parent="55"), row(6, 61, "7", ["Home", "Lost", "deep"], ["1"], nav=True, parent="55"),
        row(7, 70, None, ["none"]), row(8, 80, "1", ["Home"], children=["2"], version="odd"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = {r.key: r for r in directory.source_directory(df).collect()}
    home = '["S","1"]'
    kids = [r.key for r in sorted((r for r in nodes.values() if r.parent == home), key=lambda r: r.place)]
    # The page's newest own snapshot puts 3 before 2; then come the others by title; the attachment is last.
    assert kids == ['["S","3"]', '["S","2"]', '["S","9"]', '["S","55"]', '["S","attachment","1","x"]']
    assert (nodes['["S"]'].documents, nodes['["S"]'].sections, nodes[home].documents) == (7, 7, 7)
    assert nodes['["S","7"]'].parent == '["S","55"]' and nodes['["S","7"]'].depth == 3 and nodes['["S","55"]'].title == "Lost"
    assert not any("none" in r.title for r in nodes.values())
    docs = {(r.key, r.doc_id): (r.place, [s["section_id"] for s in r.sections]) for r in directory.node_documents(df).collect()}
    assert docs[home, 8] == (1, [80]) and docs[home, 1] == (2, [10]) and docs['["S","7"]', 6] == (1, [60])
    assert directory.source_directory(df.limit(0)).collect() == []


def test_merged_sketches_are_near_exact_quantiles(spark):
    r = random.Random(1)
    rows = [(i // 2, "a" if i % 2 == 0 else "b", 86_400_000 * (i % 7) + (0 if i % 2 == 0 else int(r.lognormvariate(5, 1))), None if i % 9 else "bad") for i in range(20_000)]
    rows = [(q, s, 86_400_000 * (q % 7) + ms % 86_400_000, st) for q, s, ms, st in rows]
    events = spark.createDataFrame(rows, "request_id int, stage string, ms bigint, status string")
    sketches = stats.timing_sketches(events)
    assert sketches.filter("stage = 'a'").count() == 7
    merged = {x.stage: x for x in stats.timing_quantiles(sketches, [0.5, 0.95]).collect()}
    exact = {x.stage: x for x in stats.stage_timing(events).collect()}
    lengths = sorted(ms % 86_400_000 for _, s, ms, _ in rows if s == "b")
    assert merged["a"].n == exact["a"].n == 10_000 and exact["b"].n == 0 and exact["request.total"].n_failed > 0
    for share, value in ((0.5, merged["a"].q_50), (0.95, merged["a"].q_95)):
        rank = sum(x <= value for x in lengths) / len(lengths)
        assert abs(rank - share) < 0.03


def test_search_finds_each_document_once(spark):
    docs = spark.createDataFrame([(1, "ALPHA", 1, [7, 8]), (2, None, 2, [9]), (3, "x", 9, []), (4, "alpha", None, None), (5, "y", 1, None)], "doc_id int, text string, contributor_id int, tag_ids array<int>")
    users = spark.createDataFrame([(1, "Ann Alpha"), (2, None)], "user_id int, full_name string")
    tags = spark.createDataFrame([(7, "alpha", None), (8, "beta", ["Alphabet"]), (9, "c", ["an alpha"])], "tag_id int, name string, aliases array<string>")
    found = filters.search_documents(docs, users, "alpha", ["text"], tags=tags)
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 4, 5]
    page = filters.page_of(found, [F.desc("doc_id")], 2, 1).collect()
    assert [(r.doc_id, r.total) for r in page] == [(4, 4), (2, 4)]
    assert sorted(r.doc_id for r in filters.search_documents(docs, users, "alpha", ["text"]).collect()) == [1, 4, 5]
