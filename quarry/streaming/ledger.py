"""STR-1: the feedback learning loop over a stream, with an idempotent ledger.

Each state of a feedback's way has a table in the ledger; a row there says that the state is
done. Tables are written batch by batch, each batch to a folder of its own that a second run
replaces, and a batch looks at earlier batches only. So a batch that was killed between its
writes and its commit, and runs again, leaves the same tables. A row whose step reports an
error goes to ``retry``, keeps the states that it has passed, and is taken up by the next batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states of a feedback between pending and completed, in order, and its last ones.
STATES = ["analysis", "claim_extraction", "evidence_verification", "reliability_update", "patch_decision", "case_decision", "audit"]
COMPLETED, RETRY = "completed", "retry"
OUTCOME = "outcome"
#: A step gets the rows that have reached its state, the number of the batch, and the tables of earlier states and batches.
Step = Callable[[DataFrame, int, Callable[[str], DataFrame]], DataFrame]


class Ledger:
    """Tables of batches under one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Replaces what the batch has in the table, and reads it back."""
        path = f"{self.path}/{table}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        """All batches of a table, or those before one; None where nothing was ever written."""
        if not self.exists(table):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return rows if before is None else rows.filter(F.col("batch") < before)


def _without(rows: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    return rows if known is None else rows.join(known.select(key).distinct(), key, "left_anti")


def learn_batch(ledger: Ledger, steps: dict[str, Step], rows: DataFrame, batch: int, *, key: str = "feedback_id") -> DataFrame:
    """One batch: new rows and those to retry, each state once; returns the batch's outcomes (key, status, attempt, state, error).

    A step returns ``key`` and ``error`` (null where it went well) beside its own columns. A
    key that came before, in this batch or an earlier one, is not new. Only the last
    batch's retries are read: each batch takes up all of them.
    """
    before = ledger.read(OUTCOME, batch)
    fresh = _without(rows.filter(F.col(key).isNotNull()).dropDuplicates([key]), before, key)
    fresh = fresh.select(key, F.struct(*rows.columns).alias("row"), F.lit(1).alias("attempt"))
    if before is not None:
        last = before.filter(F.col("batch") == before.agg(F.max("batch")).first()[0])
        fresh = fresh.unionByName(last.filter(F.col("status") == RETRY).select(key, "row", (F.col("attempt") + 1).alias("attempt")))
    taken = ledger.write("taken", fresh, batch)
    going, failed = taken.select("row.*"), None
    for state in STATES:
        if state not in steps:
            continue
        todo = _without(going, ledger.read(state, batch), key)
        done = ledger.write(f"{state}_tried", steps[state](todo, batch, ledger.read), batch)
        wrong = done.filter("error is not null").groupBy(key).agg(F.min("error").alias("error")).withColumn("state", F.lit(state))
        failed = wrong if failed is None else failed.unionByName(wrong)
        ledger.write(state, _without(done.drop("error"), wrong, key), batch)
        going = _without(going, wrong, key)
    out = taken.join(failed, key, "left") if failed is not None else taken.withColumns({"error": F.lit(None).cast("string"), "state": F.lit(None).cast("string")})
    return ledger.write(OUTCOME, out.withColumn("status", F.when(F.col("error").isNull(), COMPLETED).otherwise(RETRY)), batch)


def learning_loop(source: DataFrame, steps: dict[str, Step], path: str, checkpoint: str, *, key: str = "feedback_id", interval: str | None = None):
    """Starts the loop over a stream of feedback rows; without ``interval`` it ends when all that is there is read.

    ``path`` and ``checkpoint`` are shared folders. What a batch reads of the ledger is pruned
    to the keys that it takes up; tables may be compacted by batch.
    """
    ledger = Ledger(source.sparkSession, path)
    writer = source.writeStream.foreachBatch(lambda df, n: learn_batch(ledger, steps, df, n, key=key) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def outcomes(ledger: Ledger, key: str = "feedback_id") -> DataFrame | None:
    """The last outcome of each feedback."""
    rows = ledger.read(OUTCOME)
    if rows is None:
        return None
    return rows.groupBy(key).agg(F.max_by(F.struct("status", "attempt", "state", "error"), "batch").alias("o")).select(key, "o.*")
