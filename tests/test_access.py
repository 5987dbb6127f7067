"""Row access and evaluation of queries without judgements."""

from quarry.operators import evaluation, filters


def test_scopes_rows_and_counts(spark):
    users = spark.createDataFrame([(1, ["read"]), (2, ["own"]), (3, None), (4, []), (2, ["own"])], "user_id int, permissions array<string>")
    rows = spark.createDataFrame([(10, 2), (11, 2), (12, 3), (13, None), (14, 9)], "id int, owner_id int")
    scopes = filters.visible_scopes(users, "read")
    assert {tuple(r) for r in scopes.collect()} == {(1, "all"), (2, "own"), (3, "own"), (4, "own")}
    seen = lambda v: sorted(r.id for r in filters.visible_rows(rows, scopes, v).collect())
    assert [seen(v) for v in (1, 2, 3, 4, 9)] == [[10, 11, 12, 13, 14], [10, 11], [12], [], []]
    assert {tuple(r) for r in filters.visible_counts(rows, scopes).collect()} == {(1, 5), (2, 2), (3, 1), (4, 0)}
    assert {tuple(r) for r in filters.visible_counts(rows.limit(0), scopes).collect()} == {(1, 0), (2, 0), (3, 0), (4, 0)}


def test_unjudged_queries_are_null_and_do_not_count(spark):
    ranked = spark.createDataFrame([(1, "k", 5, 1), (1, "k", 6, 2), (3, "k", 5, 1)], "query_id int, library_type string, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, "k", 6), (2, "k", 1)], "query_id int, library_type string, doc_id int")
    rows = evaluation.retrieval_metrics(ranked, qrels)
    got = {r.query_id: (r.relevant, r.returned, r.hits, r.top1, r.topk, r.mrr, r.precision, r.recall, r.map) for r in rows.collect()}
    assert got == {1: (1, 2, 1, 0, 1, 0.5, 0.5, 1.0, 0.5), 2: (1, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0), 3: (None, 1, None, None, None, None, None, None, None)}
    scored = rows.selectExpr("*", "query_id <> 2 as answered", "if(query_id = 1, true, null) as correct", "query_id / 10 as relevance")
    s = evaluation.run_summary(scored, ["relevance"]).first()
    assert (s.cases, s.topk, s.misses, s.mean_returned, s.answer_rate, s.accuracy, s.mean_relevance) == (3, 0.5, 1, 1.0, 0.6667, 1.0, 0.2)
