"""Steps whose rows must not grow faster than their input, or pass the driver."""

import datetime
import random
import re

from quarry import plans
from quarry.operators import chunking, containment, joins, quality
from quarry.plans import streams

SF = "/root/testdata/sf0.001"


def sent(df) -> str:
    """What a plan broadcasts: the lines below its broadcast exchanges."""
    kept, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is not None:
            kept.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return "\n".join(kept)


def test_tags_send_no_exploded_files_by_the_driver(spark):
    assert "file_id" not in sent(plans.QUERIES["qlt03_assign"](spark, SF))


def test_long_paragraphs_are_cut_without_recursion(spark):
    text = "word, " * 20_000
    got = chunking.pack_paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string"), 30_000).collect()
    assert [(r.chunk_index, r.chunk) for r in got] == [(0, " ".join(["word,"] * 15_000))]


def test_small_keys_meet_without_blocks_and_large_ones_with_them(spark):
    r, day = random.Random(3), datetime.date(2024, 1, 1)
    moment = lambda: r.choice([None, *[day + datetime.timedelta(days=r.randint(0, 90)) for _ in range(5)]])
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([None, 1, 2]), r.choice([None, "x", "y"]), moment(), moment()) for i in range(120)]
    df = spark.createDataFrame(rows, "version_id int, doc int, model int, site string, effective_from date, effective_to date")
    for keys, wild in ((["doc", "model"], []), (["doc"], ["model", "site"])):
        every = [sorted(map(tuple, joins.overlapping_pairs(df, keys, wild, few=few).collect())) for few in (0, 20, 1000)]
        assert every[0] and every[0] == every[1] == every[2]


def test_signatures_with_constant_bits_meet_few_references(spark):
    r = random.Random(5)
    sign = lambda: r.getrandbits(20) << 9 | 0b101
    refs = [(i, sign(), 1.0) for i in range(60)]
    images = [(i, s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 8))) if i % 2 else sign(), r.choice([0.9, 1.0, 1.5])) for i, s in enumerate(x[1] for x in refs * 3)]
    images = [(i, s - (1 << 64) if s >> 63 else s, a) for i, s, a in images]
    for most in (0, 1, 3, 6):
        got = quality.match_signatures(spark.createDataFrame(images, "image_id int, signature long, aspect double"), spark.createDataFrame(refs, "ref_id int, ref_signature long, ref_aspect double"), most)
        want = {}
        for i, s, a in images:
            near = [(((s ^ t) & (1 << 64) - 1).bit_count(), j) for j, t, _ in refs if a != 1.5]
            want |= {i: min(x for x in near if x[0] <= most)} if any(x[0] <= most for x in near) else {}
        assert {x.image_id: (x.distance, x.ref_id) for x in got.collect()} == want
    bands, free = quality._bands(spark.createDataFrame([(x[1],) for x in refs], "signature long"), 6)
    assert sorted(map(len, bands)) == [5, 5, 5, 5] and free == 3


def test_replayed_rows_are_dealt_out_and_their_state_is_kept_on_disk(spark, monkeypatch):
    seen, name = {}, "spark.sql.streaming.stateStore.providerClass"
    before, kept = spark.conf.get(name), streams.finished
    monkeypatch.setattr(streams, "finished", lambda s, label, start: seen.update(provider=s.conf.get(name)) or kept(s, label, start))
    monkeypatch.setattr(streams.jobs, "activity", lambda df, run=streams.jobs.activity: seen.update(plan=df._jdf.queryExecution().logical().toString()) or run(df))
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert plans.QUERIES["str05_activity_stream"](spark, SF).count() > 0
        assert "HDFSBacked" in spark.conf.get(name)
    finally:
        spark.conf.set(name, before)
    assert "RocksDB" in seen["provider"] and "Repartition" in seen["plan"]


def test_evaluation_makes_no_row_for_each_query_and_relevant_document(spark):
    for name in ("evl01_metrics_at_k", "evl02_map", "evl03_mrr", "evl04_metrics", "evl04_unjudged", "evl05_run", "evl05_summary"):
        text = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join Inner, \(cast\(label|Join Inner, \(label#\d+L? = label", text), name


def test_patches_and_cases_are_cut_before_queries_meet_them(spark):
    plan = lambda name: plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan("fb11_applicable")
    assert "windowspecdefinition(device" in plan("fb17_memory")


def test_only_cases_are_sorted_to_be_counted(spark):
    plan = plans.QUERIES["fb04_evidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("row_number")


def test_containment_marks_few_windows_and_loses_no_pair(spark):
    r, words = random.Random(4), [f"word{i}" for i in range(30)]
    rows = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(80)]
    rows += [w[a : r.randint(a + 1, len(w))] for w in rows for a in [r.randint(0, len(w) - 1)]]
    texts = [" ".join(w) for w in [*rows, ["x" * 35], ["a", "x" * 35, "b"]]]  # one long word, too
    first = {t: i for i, t in reversed(list(enumerate(texts))) if len(t) >= 30}
    want = sorted((i, j) for a, i in first.items() for b, j in first.items() if a != b and f" {a} " in f" {b} ")
    df = spark.createDataFrame(list(enumerate(texts)), "para_id long, body string")
    assert sorted(map(tuple, quality.contained_duplicates(df).collect())) == want
    long = spark.createDataFrame([(1, 5000, [r.getrandbits(62) for _ in range(5000)])], "para_id long, n_words int, words array<long>")
    assert containment.marks(long, 8).count() < 5000 / 3
