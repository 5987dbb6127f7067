"""Every stage of the pipeline against plain code, on the documents that its predecessor kept."""

import brute
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(documents in, documents out) of each stage, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema=None) if name == "mixing" else stage(spark, docs, SF)
        if name != "mixing":
            assert docs.columns == columns
            schema = docs.schema
            docs = spark.createDataFrame(docs.collect(), schema)
        out[name] = (before, docs.collect())
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_quality_keeps_rows_as_they_are(stages):
    before, after = stages["quality"]
    assert 0 < len(after) < len(before) and set(after) <= set(before)


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = stages["near_duplicates"]
    want = brute.near({r.doc_id: r.text for r in before}, 5)
    assert set(by_id(after)) == {i for i, (_, component) in want.items() if i == component}
    assert set(after) <= set(before)


def test_repeats_are_cut(stages):
    before, after = stages["repeats"]
    want = brute.repeats({r.doc_id: (r.text or "").encode() for r in before})
    assert len(after) == len(before)
    for r in after:
        if want[r.doc_id][1] == 0:
            assert r == by_id(before)[r.doc_id]
        else:
            assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text)


def test_contaminated_documents_go(stages, spark):
    before, after = stages["decontamination"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = brute.contamination({r.doc_id: r.text for r in before}, items)
    assert set(by_id(after)) == {i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}


def test_mixing_repeats_whole_rows(stages):
    before, after = stages["mixing"]
    known = by_id(before)
    assert after and all(r.text == known[r.doc_id].text and 1 <= r.mix_copy <= r.mix_copies for r in after)
    assert len({(r.doc_id, r.mix_copy) for r in after}) == len(after)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_odd_tables(spark, empty):
    """Null, blank, tied and long texts and repeated rows: each stage keeps the columns and, but for the last, no row twice as often."""
    rows = [] if empty else [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "one"), (6, "x " * 20_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = [r.doc_id for r in out.collect()]
        assert set(found) <= {i for i, _ in rows} and (name == "mixing" or (out.columns == docs.columns and len(found) <= len(rows)))
        if name in ("near_duplicates", "decontamination") and not empty:
            assert {1, 2, 3, 4} <= set(found) and (name == "decontamination" or 5 not in found)
