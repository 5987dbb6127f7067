"""The learning loop under kills and replays, and the backlog queue step by step."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.streaming import backlog, ledger


def tables(led, names):
    return {n: sorted(tuple(str(x) for x in r) for r in led.read(n).collect()) for n in names}


def steps_of(broken=()):
    """Two states; keys that ``broken`` lists fail in the second one; calls are counted by the rows in the first."""

    def first(rows, n, read):
        return rows.select("feedback_id", F.upper("text").alias("said"), F.lit(n).alias("done_in"), F.lit(None).cast("string").alias("error"))

    def second(rows, n, read):
        joined = rows.join(read("analysis").select("feedback_id", "said"), "feedback_id")
        return joined.select("feedback_id", F.length("said").alias("n"), F.when(F.col("feedback_id").isin(*broken) if broken else F.lit(False), "no luck").alias("error"))

    return {"analysis": first, "audit": second}


def batch(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}", "own") for i in ids], "feedback_id bigint, text string, status string")


def test_a_batch_that_runs_twice_leaves_the_same_tables(spark, tmp_path):
    led = ledger.Ledger(spark, f"file://{tmp_path}/a")
    ledger.learn_batch(led, steps_of(), batch(spark, 1, 2, 2, 3), 0)
    names = ["analysis", "audit", "outcome"]
    before = tables(led, names)

    def killed(rows, n, read):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        ledger.learn_batch(led, steps_of() | {"audit": killed}, batch(spark, 3, 4), 1)
    assert led.read("analysis").filter("feedback_id = 4").count() == 1  # written, but the batch was not committed
    ledger.learn_batch(led, steps_of(), batch(spark, 3, 4), 1)
    once = tables(led, names)
    ledger.learn_batch(led, steps_of(), batch(spark, 3, 4), 1)
    assert tables(led, names) == once
    assert all(set(before[n]) <= set(once[n]) for n in names)
    got = {r.feedback_id: (r.status, r.attempt) for r in ledger.outcomes(led).collect()}
    assert got == {i: ("completed", 1) for i in (1, 2, 3, 4)}


def test_failed_rows_are_retried_and_states_are_not_redone(spark, tmp_path):
    led = ledger.Ledger(spark, f"file://{tmp_path}/b")
    ledger.learn_batch(led, steps_of(broken=[2]), batch(spark, 1, 2), 0)
    got = {r.feedback_id: (r.status, r.attempt, r.state, r.error) for r in ledger.outcomes(led).collect()}
    assert got == {1: ("completed", 1, None, None), 2: ("retry", 1, "audit", "no luck")}
    ledger.learn_batch(led, steps_of(broken=[2]), batch(spark, 1, 2), 1)
    ledger.learn_batch(led, steps_of(), batch(spark, 1), 2)
    got = {r.feedback_id: (r.status, r.attempt) for r in ledger.outcomes(led).collect()}
    assert got == {1: ("completed", 1), 2: ("completed", 3)}
    assert sorted((r.feedback_id, r.done_in) for r in led.read("analysis").collect()) == [(1, 0), (2, 0)]
    assert sorted(r.feedback_id for r in led.read("audit").collect()) == [1, 2]
    kept = led.read("outcome").select("row.status").distinct().collect()
    assert [r[0] for r in kept] == ["own"]  # a column of the row with the name of one of ours


def test_a_loop_without_rows(spark, tmp_path):
    led = ledger.Ledger(spark, f"file://{tmp_path}/c")
    assert ledger.outcomes(led) is None
    ledger.learn_batch(led, steps_of(), batch(spark, 1).limit(0), 0)
    assert ledger.outcomes(led).collect() == []


class Map:
    """A map state in memory."""

    def __init__(self):
        self.rows = {}

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)

    def iterator(self):
        return iter(list(self.rows.items()))


def queue(limit=2, lease=3):
    p = backlog.BacklogProcessor(limit, lease)
    p.queue, p.held = Map(), Map()

    def run(*events):
        columns = [x.rsplit(" ", 1)[0] for x in backlog.EVENTS.split(", ")]
        out = next(p.handleInputRows((0,), iter([pd.DataFrame([dict.fromkeys(columns) | e for e in events], columns=columns)]), None))
        return [(int(r.tick), int(r.version_id), int(r.attempt)) for r in out.itertuples()]

    return run


def change(version, document=None, wanted=True, tick=0):
    return {"kind": "change", "tick": tick, "version_id": version, "document_id": document or version, "wanted": wanted}


def tick(n):
    return {"kind": "tick", "tick": n}


def result(version, attempt, ok, at):
    return {"kind": "result", "tick": at, "version_id": version, "attempt": attempt, "ok": ok}


def test_versions_leave_once_and_failures_come_back():
    run = queue()
    assert run(*(change(v) for v in (5, 3, 4))) == []
    assert run(tick(1)) == [(1, 3, 1), (1, 4, 1)]
    assert run(result(3, 1, True, 1), result(4, 1, False, 1), tick(2)) == [(2, 4, 2), (2, 5, 1)]
    assert run(change(3, wanted=False, tick=2), result(4, 1, False, 1), tick(3)) == []  # an old result gives nothing back
    assert run(result(4, 2, True, 2), result(4, 2, True, 2), result(5, 1, True, 2), tick(4)) == []


def test_a_lost_lease_runs_out():
    run = queue(limit=1, lease=3)
    run(change(1), change(2))
    assert run(tick(1), tick(2), tick(3), tick(4)) == [(1, 1, 1), (2, 2, 1), (4, 1, 2)]
    assert run(result(1, 1, True, 1), tick(5)) == [(5, 2, 2)]  # the first attempt's late result is not the second's


def test_held_documents_wait():
    run = queue()
    assert run(change(1, 10), change(2, 20), {"kind": "hold", "tick": 3, "document_id": 10}) == []
    assert run(tick(1)) == [(1, 2, 1)]
    assert run(result(2, 1, True, 1), tick(2)) == []
    assert run(tick(3)) == [(3, 1, 1)]


def test_withdrawn_versions_are_not_leased():
    run = queue()
    run(change(1), change(2), change(1, wanted=False, tick=1))
    assert run(tick(2)) == [(2, 2, 1)]


def test_many_versions_take_few_calls_of_the_state():
    p, calls = backlog.BacklogProcessor(3, 2), []
    p.queue, p.held = Map(), Map()
    for state in (p.queue, p.held):
        state.updateValue = lambda k, v, put=state.updateValue: (calls.append(k), put(k, v))
    columns = [x.rsplit(" ", 1)[0] for x in backlog.EVENTS.split(", ")]
    rows = [change(v, v) for v in range(1, 20_001)] + [{"kind": "hold", "tick": 9, "document_id": v} for v in range(1, 20_001, 2)]
    for batch in (rows, [tick(1)]):
        out = next(p.handleInputRows((0,), iter([pd.DataFrame([dict.fromkeys(columns) | e for e in batch], columns=columns)]), None))
    assert list(out["version_id"]) == [2, 4, 6] and len(calls) < 100


def test_changes_of_one_tick_follow_each_other():
    run = queue(limit=9)
    assert run(change(1, 10), change(1, 11), change(2, wanted=False), change(2, 20), change(3), change(3, wanted=False), tick(0)) == [(0, 1, 1), (0, 2, 1)]
    assert run(change(1, wanted=False, tick=1), change(1, 12, tick=1), tick(1)) == [(1, 1, 1)]
