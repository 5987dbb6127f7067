"""Invariants on small literal rows, and streams against their batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunking, evaluation, feedback, filters, memory, retrieval
from quarry.sources import readers
from quarry.streaming import jobs


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(column(F.col("c"))).collect()]


def test_query_terms_cut_long_han_runs(spark):
    got = one(spark, tx.query_terms, "The X-200 fan 电源模块", "电源模块无法启动了", None)
    assert got[0] == ["x-200", "fan", "电源模块"]
    assert got[1][0] == "电源模块" and "启动" in got[1] and got[2] == []


def test_alias_match_keeps_to_boundaries(spark):
    df = spark.createDataFrame([("see x-200 now",), ("X-2000",), ("aX-200",), ("(X-200)",)], "c string")
    assert [r[0] for r in df.select(tx.alias_match(F.col("c"), F.lit("X-200"))).collect()] == [True, False, False, True]


def test_parse_refs_in_all_forms(spark):
    got = one(spark, tx.parse_refs, "knowledge:17,1, x", '["breakdown:2", "3"]', None)
    assert [[tuple(r) for r in refs] for refs in got] == [[("knowledge", 17), ("knowledge", 1)], [("breakdown", 2), ("knowledge", 3)], []]


@pytest.mark.parametrize("budget", [7, 50, 600])
def test_lossless_split_restores_the_text(spark, budget):
    random.seed(budget)
    texts = ["", "x" * 1000, "".join(random.choice("ab. \n") for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.lossless_split(df, budget).orderBy("doc_id", "chunk_index").collect():
        assert 0 < len(r.chunk) <= budget
        got[r.doc_id] = got.get(r.doc_id, "") + r.chunk
    assert [got.get(i, "") for i in range(3)] == texts


def test_markers_count_each_level(spark):
    df = spark.createDataFrame([(1, i, level) for i, level in enumerate([1, 2, 2, 3, 1, 2])], "doc_id long, position long, level int")
    assert [r.marker for r in chunking.fill_markers(df).orderBy("position").collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1"]


def test_metrics_of_a_list_that_repeats_a_document(spark):
    ranked = spark.createDataFrame([(1, "k", 5, 1), (1, "k", 5, 2), (1, "k", 6, 3)], "query_id int, library_type string, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, "k", 6)], "query_id int, library_type string, doc_id int")
    r = evaluation.retrieval_metrics(ranked, qrels).first()
    assert (r.returned, r.hits, r.top1) == (3, 1, 0) and r.mrr == pytest.approx(1 / 3) and r.precision == pytest.approx(1 / 3) and r.map == pytest.approx(1 / 3)


def test_claims_of_literal_comments(spark):
    rows = [(1, "negative", "不是风扇，是电源模块"), (2, "positive", "确认是主板"), (3, "positive", "文档 17 是正确的"), (4, "additional_information", "噪音大"), (5, "odd", "hm"), (6, "negative", None)]
    df = spark.createDataFrame(rows, "feedback_id int, feedback_type string, comment string").withColumn("answer_text", F.lit("fan")).withColumn("device", F.lit(None).cast("string"))
    analysed = feedback.analyse_feedback(df)
    got = {(r.feedback_id, r.claim_type, r.object, r.confidence) for r in feedback.extract_claims(analysed).collect()}
    assert got == {(1, "correction", "电源模块", 0.78), (2, "confirmation", "主板", 0.68), (3, "document_preference", "17", 0.5), (4, "additional_information", "噪音大", 0.45), (5, "unclear_feedback", "hm", 0.25)}
    kinds = {r.feedback_id: (r.detected, r.risk, r.action, r.conflict) for r in analysed.collect()}
    assert kinds[1] == ("correction", "high", "require_human_review", True) and kinds[6] == ("dissatisfaction", "medium", "ignore", False)


def test_context_goes_on_and_switches(spark):
    said = ["AX-7 报警 E102", "这个故障的原因", "已经检查过，没有异常", "另一个 K50 设备", "谢谢"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "session_id int, turn_no int, text string")
    got = {r.turn_no: (r.transition, r.score, r.device) for r in memory.context_transition(df).collect()}
    assert got[0][0] == "new" and got[1][:2] == ("continue", pytest.approx(0.67)) and got[3][0] == "switch" and got[4][:2] == ("continue", pytest.approx(0.35))


def test_deep_trees_have_paths_and_cycles_none(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(300)] + [(900, 901, "x"), (901, 900, "y")]
    got = {r.id: (r.path, r.depth) for r in chunking.tree_paths(spark.createDataFrame(rows, "id int, parent_id int, name string")).collect()}
    assert len(got) == 300 and got[0] == ("n0", 1) and got[299] == (" / ".join(f"n{i}" for i in range(300)), 300)


def test_keyword_recall_in_blocks(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "beta"), (3, None), (4, "alphabeta GAMMA")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, ["alpha", "BETA"]), (2, ["x", "gamma"]), (3, ["y"])], "query_id int, terms array<string>")
    for block in (1, 2048):
        got = {(r.query_id, r.doc_id, r.score) for r in filters.keyword_recall(docs, queries, 5, ["text"], block=block).collect()}
        assert got == {(1, 1, 2), (1, 4, 2), (2, 4, 1)}


def test_rrf_keeps_original_ranks(spark):
    rows = [(1, "a", "semantic", "k", 5, 1, 0.9), (1, "a", "semantic", "k", 5, 2, 0.8), (1, "a", "semantic", "k", 6, 3, 0.7), (1, "b", "keyword", "k", 6, 1, 3.0)]
    df = spark.createDataFrame(rows, "query_id int, list string, list_type string, library_type string, doc_id int, rank int, score double")
    got = {r.doc_id: r.fused for r in retrieval.rrf(df, weights={"semantic": 1.0, "keyword": 1.2}).collect()}
    assert got[5] == pytest.approx(1 / 61) and got[6] == pytest.approx(1 / 63 + 1.2 / 61)


def reliability_loop(events):
    """The rule of one user's events (sec, id, direction, weight, correction), written out plainly."""
    score, n, last, counts, kept = 0.5, 0, None, [0, 0, 0, 0], [0.0, 0.0, 0.0]
    for sec, _, way, weight, correction in sorted(events):
        strength = min(12.0, 2.0 + n * 0.25)
        if last is not None:
            strength *= 0.98 ** (max(0, sec - last) / 86400 / 7)
        alpha, beta, moved = max(1.0, score * strength), max(1.0, (1 - score) * strength), max(0.05, weight)
        up, down = (moved, 0) if way > 0 else (0, moved)
        new = (alpha + up) / (alpha + up + beta + down)
        score = min(score + 0.18, max(score - 0.18, new))
        kept[0], kept[1] = kept[0] * 0.98 + up, kept[1] * 0.98 + down
        counts[0 if way > 0 else 1] += 1
        if correction:
            counts[2] += 1
            counts[3] += way > 0
            kept[2] = kept[2] * 0.98 + weight
        n, last = n + 1, sec
    return (score, n, *counts, *kept)


def test_reliability_fold_equals_loop_and_stream(spark, tmp_path):
    random.seed(8)
    events = [(u, 1000 * u + i, 1_700_000_000 + i * 200_000, random.choice([1, 1, -1, 0]), random.random(), random.random() < 0.4) for u in range(5) for i in range(random.randint(1, 30))]
    schema = "user_id long, feedback_id long, sec long, direction int, weight double, correction boolean"
    df = spark.createDataFrame(events, schema)
    want = {u: reliability_loop([(s, i, d, w, c) for v, i, s, d, w, c in events if v == u and d]) for u in range(5) if any(v == u and d for v, _, _, d, _, _ in events)}
    row = lambda r: (r.reliability, r.n, r.verified, r.rejected, r.corrections, r.right_corrections, r.verified_weight, r.rejected_weight, r.correction_weight)
    got = {r.user_id: row(r) for r in feedback.user_reliability(df.unionByName(df)).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u]) and 0 <= got[u][0] <= 1 for u in want)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.reliability_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("reliability").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {r.user_id: row(r) for r in spark.table("reliability").collect()}
    assert last.keys() == want.keys() and all(last[u] == pytest.approx(want[u]) for u in want)


def test_usage_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    df = spark.read.parquet(src).select(F.col("ts").cast("timestamp").alias("created_time"), F.when(F.col("event_type") == "purchase", "parse_x").otherwise("chat").alias("request_type"), F.floor("value").cast("long").alias("total_tokens"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.usage_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda rows: sorted((str(r.window.start), r.business, r.tokens, r.calls) for r in rows)
    assert key(spark.table("usage").collect()) == key(jobs.usage_counts(df).collect())


def test_feedback_loop_hands_each_row_once(spark, tmp_path):
    rows = [(i % 6, f"2024-01-01 00:0{i % 6}:00") for i in range(12)]
    spark.createDataFrame(rows, "feedback_id long, at string").withColumn("created_at", F.to_timestamp("at")).drop("at").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("feedback_id long, created_at timestamp").parquet(str(tmp_path / "in"))
    jobs.feedback_loop(source, lambda df, n: seen.extend(r.feedback_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == list(range(6))


def test_readers(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"question": "q", "ground_truth": "g"}\nbroken\n{"question": "r", "answer": "a", "ground_truth": "g"}\n')
    assert [(r.question, r.answer) for r in readers.read_qa(spark, str(tmp_path / "qa.jsonl")).orderBy("question").collect()] == [("q", "g"), ("r", "a")]
    (tmp_path / "t.jsonl").write_text('{"text": "a"}\n{"text": "b"}\n')
    assert [r.text for r in readers.read_text_only(spark, str(tmp_path / "t.jsonl")).collect()] == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"text": "a", "more": "b"}\n')
    with pytest.raises(Exception, match="text-only"):
        readers.read_text_only(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "x.csv").write_text("a,,c\n1,2,\n,,\n3,4,\n")
    df = readers.read_string_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["a", "column_2"] and df.count() == 2


def test_patches_stay_within_bounds(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.1, 2), (1, 3, 0.5, 3)], "query_id int, doc_id int, doc_score double, rank int")
    patches = spark.createDataFrame([(1, 1, 0.25, 1.0), (2, -1, 0.25, 1.0), (2, -1, 0.25, 1.0)], "document_id int, sign int, weight double, confidence double")
    got = {r.doc_id: r.patched for r in feedback.apply_patches(ranked, patches).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.0) and got[3] == pytest.approx(0.5)


def test_stale_tasks_are_reported_once(spark, tmp_path):
    for n, minute in enumerate((0, 2, 20, 40, 60)):
        rows = [(1 if n < 2 else n + 1, minute * 60_000)]
        df = spark.createDataFrame(rows, "task_id long, ms long").withColumn("at", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("task_id long, ms long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = jobs.stale_stream(source, 5 * 60_000).writeStream.outputMode("append").format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = sorted((r.task_id, r.last_ms) for r in spark.table("stale").collect())
    assert (1, 120_000) in got and len(got) == len(set(got)) and all(task < 5 for task, _ in got)
