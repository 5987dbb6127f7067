"""Near-duplicates by SetSketch: bands of registers, joint likelihood estimate, exact check.

1. A map pass gives each document its set size, a fingerprint of its shingle set and its
   registers. Documents with equal sets are one from here on, under their smallest id.
2. Bands of registers are bucket keys. Every member of a bucket is paired with the
   bucket's smallest id (its pivot) only, never with all others.
3. A pair that the likelihood estimate does not rule out is confirmed on full sets.
   Confirmed links give components.
4. What that may have missed is exact and in blocks: of the documents that share a pivot,
   those outside the largest component are compared with all of them whose component
   differs. A task holds two blocks of bounded size and gives back confirmed links only.
5. Components over all links; each document looks up that of its representative.

With 28 bands of 4 registers a pair at similarity 0.8 escapes all buckets with
probability below 1e-6, and more similar pairs with less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import bound_batches, materialise, slices, text_bytes, unused_names
from .graph import components

BAND, SLACK, BLOCK, BROADCAST_IDS = 4, 0.2, 500, 1_000_000


def _shingle_sets(batch: pa.RecordBatch, k: int):
    """The shingle set of each text of a batch. Words lie between ASCII white space; A-Z are lower-cased."""
    words, sizes = sketch.word_hashes(batch.column("raw").to_pylist())
    ends = np.cumsum(sizes)
    return (sketch.shingles(words[end - size : end], k) for end, size in zip(ends.tolist(), sizes.tolist()))


def _sketches(k: int):
    def run(batches):
        for batch in slices(batches):
            n, one, two, regs = [], [], [], []
            for x in _shingle_sets(batch, k):
                n.append(len(x))
                one.append(int(np.add.reduce(x).view(np.int64)) if len(x) else 0)
                two.append(int(np.bitwise_xor.reduce(sketch.scramble(x)).view(np.int64)) if len(x) else 0)
                regs.append(sketch.registers(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "n": pa.array(n, pa.int64()), "h1": pa.array(one, pa.int64()), "h2": pa.array(two, pa.int64()), "regs": pa.array(regs, pa.binary())}
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in slices(batches):
            sets = list(_shingle_sets(batch, k))
            regs = [sketch.registers(x).tobytes() for x in sets]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "regs": pa.array(regs, pa.binary()), "set": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets without repeats."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Of pairs with registers and sets, those that pass the estimate and the exact test."""
    least = percent / 100 - SLACK

    def run(batches):
        for batch in batches:
            sets = [[np.frombuffer(b, np.uint64) for b in batch.column(c).to_pylist()] for c in ("set_a", "set_b")]
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, sketch.REGISTERS) for c in ("regs_a", "regs_b")]
            n = [np.array([len(s) for s in side], np.float64) for side in sets]
            near = 100 * np.minimum(*n) >= percent * np.maximum(*n)
            near &= sketch.slope(least, (regs[0] > regs[1]).sum(1), (regs[0] < regs[1]).sum(1), *n) > 0
            keep = [i for i in np.flatnonzero(near).tolist() if similar(sets[0][i], sets[1][i], percent)]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(pa.array(keep, pa.int64())), "b": batch.column("b").take(pa.array(keep, pa.int64()))})

    return run


def _across(percent: int):
    """Links between the two sides of a block whose components differ, one for each row and component."""
    least = percent / 100 - SLACK

    def run(pdf):
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(x) or not len(y):
            return pdf.iloc[:0][["id", "pivot"]].set_axis(["a", "b"], axis=1)
        sets = [np.frombuffer(b, np.uint64) for b in y["set"]]
        regs = np.frombuffer(b"".join(y["regs"]), np.uint16).reshape(-1, sketch.REGISTERS)
        sizes = np.array([len(s) for s in sets], np.float64)
        group, ids = y["component"].to_numpy(), y["id"].to_numpy()
        out = []
        for own, component, reg, raw in zip(x["id"], x["component"], x["regs"], x["set"]):
            reg, one = np.frombuffer(reg, np.uint16), np.frombuffer(raw, np.uint64)
            near = (group != component) & (100 * np.minimum(sizes, len(one)) >= percent * np.maximum(sizes, len(one)))
            at = np.flatnonzero(near)
            larger, smaller = (reg > regs[at]).sum(1), (reg < regs[at]).sum(1)
            at = at[sketch.slope(least, larger, smaller, float(len(one)), sizes[at]) > 0]
            linked = set()
            for i in at.tolist():
                if group[i] not in linked and similar(one, sets[i], percent):
                    linked.add(group[i])
                    out.append((own, ids[i]))
        return pdf.iloc[:0][["id", "pivot"]].set_axis(["a", "b"], axis=1) if not out else type(pdf)(out, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document id: n_shingles and component_id, the smallest id that links reach.

    Null, empty and blank texts have no shingles and link with nothing, not even with each
    other. Ids must name one text; repeated rows of an id are one document. Ids are of an
    integer type. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    raw = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    id_type = raw.schema["id"].dataType.simpleString()
    known = materialise(raw.mapInArrow(_sketches(k), f"id {id_type}, n long, h1 long, h2 long, regs binary"), "sketch")
    full = known.filter("n > 0")
    equal = full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(sketch.REGISTERS // BAND - 1)), lambda j: F.xxhash64(j, F.substring("regs", j * (2 * BAND) + 1, F.lit(2 * BAND))))
    keyed = equal.select(F.col("rep").alias("id"), F.explode(bands).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last")
    members = materialise(keyed.join(buckets.select("key", "pivot"), "key").select("pivot", "id").distinct(), "members")

    wanted = members.select("id").distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = materialise(raw.join(wanted, "id", "left_semi").mapInArrow(_sets(k), f"id {id_type}, regs binary, set binary"), "sets")

    side = [sets.select(F.col("id").alias(c), F.col("regs").alias(f"regs_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab"]
    stars = members.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    links = materialise(stars.join(side[0], "a").join(side[1], "b").mapInArrow(_confirm(percent), f"a {id_type}, b {id_type}"), "links")
    first = components(links)

    placed = members.join(first, members["id"] == first["node"], "left").select("pivot", "id", F.coalesce("component", "id").alias("component"))
    shares = placed.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("rows"))
    cores = shares.groupBy("pivot").agg(F.max_by("component", F.struct("rows", "component")).alias("core"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.max("rows").alias("in_core")).filter("parts > 1")
    cores = materialise(cores, "cores")
    if cores.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        cores = F.broadcast(cores)
    open_rows = placed.join(cores, "pivot").join(sets, "id")
    rows = open_rows.withColumn("wide", F.ceil(F.col("rows") / BLOCK)).withColumn("high", F.ceil((F.col("rows") - F.col("in_core")) / BLOCK))
    columns = ["pivot", "id", "component", "regs", "set"]
    outside = rows.filter("component <> core").select(*columns, F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.col("high")).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("q"))
    inside = rows.select(*columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("p"), F.pmod(F.xxhash64("id"), F.col("wide")).alias("q"))
    rest = outside.unionByName(inside).groupBy("pivot", "p", "q").applyInPandas(_across(percent), f"a {id_type}, b {id_type}")
    links = materialise(links.unionByName(rest), "links")
    final = components(links)

    reps = equal.select("n", "h1", "h2", "rep").join(final, F.col("rep") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    found = known.select("id", "n", "h1", "h2").distinct().join(reps, ["n", "h1", "h2"], "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, on four-word shingles."""
    found = near_duplicates(docs, k=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicate(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component; repeated rows of an id stay together, and so do rows with a null id or without words."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    (name,) = unused_names(docs, "gone_id")
    gone = materialise(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct(), "gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
