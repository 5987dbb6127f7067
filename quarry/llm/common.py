"""Pieces that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.lineage import materialise, shared_dir

__all__ = ["bound_batches", "documents", "fold", "hash_sample", "lower_ascii", "materialise", "shared_dir", "slices", "smallest_hashes", "text_bytes", "unused_names"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch to ``BATCH_BYTES``, where the session allows more; only memory depends on it.

    Spark reads the setting when a job starts, so it cannot be put back when an operator
    returns. It is one constant, so the order of calls does not matter.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches, rows: int = 500, size: int = 8 << 20):
    """Arrow batches cut to at most ``rows`` rows and some ``size`` bytes: what a worker expands at once."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def text_bytes(column: Column | str) -> Column:
    """UTF-8 bytes of a text column; null is the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fold(column: Column | str, k: int = 5) -> Column:
    """crc32 of the id as text, modulo ``k``: the fixed split into training and held-out rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % k


def smallest_hashes(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows of a narrow table whose ids have the smallest hashes.

    A count sets a hash bound that half as many rows again pass, so that the order and
    limit, which meet in one task, see a bounded number of rows.
    """
    total = df.count()
    h = F.xxhash64(id_col)
    if total > 2 * rows:
        df = df.filter(h < int(-(2**63) + 2**64 * (1.5 * rows + 1000) / total) if 1.5 * rows + 1000 < total else F.lit(True))
    return df.orderBy(h, id_col).limit(rows)


def hash_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows of the ``rows`` ids with the smallest hash: ids are chosen first, so that no texts meet in one task."""
    chosen = smallest_hashes(df.select(F.col(id_col).alias("sample_id_")), "sample_id_", rows)
    return df.join(F.broadcast(chosen.distinct()), F.col(id_col) == F.col("sample_id_"), "left_semi")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for inner columns that no column of ``df`` has, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
