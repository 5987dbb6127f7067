"""Suffix-array dedup: bytes that lie in a string of 100 bytes which also starts earlier.

Suffixes of a whole corpus are too many to shuffle, so they are narrowed down exactly.

1. Each document's strings fall into runs by their content-defined anchor (``anchors``).
   Runs are dealt by anchor hash. A run whose block equals an earlier one is a later copy
   whole. Runs that share an anchor with different blocks stay open; all others are unique.
2. Open runs fetch their bytes. Suffixes of those with one anchor meet in one task, are
   put in suffix order, and the nearest smaller positions before and after each give its
   longest previous factor; 100 or more means an earlier copy.
3. The starts found in 1 and 2 become removed spans, which meet the texts once more.

Whatever a task can see by itself is settled there, and only its first copies travel. An
anchor with very many blocks (a passage that a third of all documents share) is marked,
and its strings are dealt one by one by their own content instead.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import SPAN, mix
from .common import bound_batches, materialise, slices, text_bytes, unused_names

PIECE, SEEN = 1 << 20, 200_000
DUP, OPEN, HOT, MARKED = 0, 1, 2, 3


@dataclass(frozen=True)
class Limits:
    """How much a task holds; results do not depend on it.

    Runs of a task are settled ``local_runs`` at a time. Of an anchor's distinct blocks in
    such a lot, ``local_blocks`` travel as runs and the rest as single strings; so does an
    anchor with over ``hot_blocks`` blocks in all. ``meet`` blocks at least are sorted at once.
    """

    local_runs: int = 1_000_000
    local_blocks: int = 64
    hot_blocks: int = 2048
    meet: int = 3000


_ROW = "k long, kind int, g long, id long, a long, n long"


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's row differs from the row before in these columns."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _joined(ids: np.ndarray, a: np.ndarray, n: np.ndarray):
    """Adjacent runs of a document made one."""
    order = np.lexsort((a, ids))
    ids, a, n = ids[order], a[order], n[order]
    first = _new(ids)
    first[1:] |= a[1:] > a[:-1] + n[:-1]
    at = np.flatnonzero(first)
    end = np.maximum.reduceat(a + n, at) if len(at) else a
    return ids[at], a[at], end - a[at]


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _later(k, g, ids, a):
    """In an order by (k, g, id, a): where a block starts, and which rows are later copies of its first."""
    fresh = _new(k, g)
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return fresh, (ids != ids[first]) | (a != a[first])


def _local(parts, limits: Limits):
    k, g, ids, a, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((a, ids, g, k))
    k, g, ids, a, n = (x[order] for x in (k, g, ids, a, n))
    fresh, later = _later(k, g, ids, a)
    di, da, dn = _joined(ids[later], a[later], n[later])
    k, g, ids, a, n = (x[fresh] for x in (k, g, ids, a, n))
    start = np.flatnonzero(_new(k))
    size = np.diff(np.append(start, len(k)))
    rank, size = np.arange(len(k)) - np.repeat(start, size), np.repeat(size, size)
    kind = np.where(rank >= limits.local_blocks, HOT, np.where(size > limits.local_blocks, MARKED, OPEN))
    out = [np.concatenate(x) for x in zip((mix(di.astype(np.uint64)).view(np.int64), np.zeros(len(di), np.int64), di, da, dn, np.full(len(di), DUP)), (k, g, ids, a, n, kind))]
    hot = out[5] == HOT
    out[0] = np.where(hot, mix(out[2].astype(np.uint64)).view(np.int64), out[0])
    for i in range(0, len(out[0]), 50_000):
        s = slice(i, i + 50_000)
        yield _table(k=out[0][s], kind=out[5][s].astype(np.int32), g=out[1][s], id=out[2][s], a=out[3][s], n=out[4][s])


def _runs(batches, limits: Limits):
    """Runs of this task's documents, with what can be settled among them."""
    parts, held, texts, size = [], 0, [], 0

    def flush():
        data = np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)
        lengths = np.array([len(t) for _, _, t in texts])
        ends = np.cumsum(lengths)
        start, count, key, block = anchors.runs(data, ends)
        doc = np.searchsorted(ends, start, side="right")
        ids, shift = np.array([i for i, _, _ in texts], np.int64), np.array([s for _, s, _ in texts], np.int64)
        parts.append((key, block, ids[doc], start - (ends - lengths)[doc] + shift[doc], count))
        texts.clear()
        return len(start)

    for batch in slices(batches):
        for i, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
            for at in range(0, max(1, len(raw) - SPAN + 1), PIECE):
                texts.append((i, at, raw[at : at + PIECE + SPAN - 1]))
                size += len(texts[-1][2])
                if size >= PIECE:
                    held, size = held + flush(), 0
            if held >= limits.local_runs:
                yield from _local(parts, limits)
                parts, held = [], 0
    if texts:
        flush()
    if parts:
        yield from _local(parts, limits)


def _whole_groups(batches, least: int = 1):
    """Batches in the order of k, cut so that rows with one k are never apart."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        k = table.column("k").to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
        if rows >= least:
            least = 2 * rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _settle(batches, limits: Limits):
    """Of runs in the order (k, g, id, a): later copies, and first blocks of anchors with several blocks."""
    for table in _whole_groups(batches, 20_000):
        k, kind, g, ids, a, n = (table.column(c).to_numpy() for c in ("k", "kind", "g", "id", "a", "n"))
        settled = (kind == DUP) | (kind == HOT)
        out = [[x[settled]] for x in (ids, kind, a, n, k)]
        k, kind, g, ids, a, n = (x[~settled] for x in (k, kind, g, ids, a, n))
        if len(k):
            fresh, later = _later(k, g, ids, a)
            group = np.cumsum(_new(k)) - 1
            blocks = np.bincount(group, weights=fresh)[group]
            hot = np.bincount(group, weights=kind == MARKED)[group] > 0
            hot |= blocks > limits.hot_blocks
            state = np.where(later, DUP, np.where(hot, HOT, OPEN))
            keep = later | (fresh & ((blocks > 1) | hot))
            for part, x in zip(out, (ids, state.astype(np.int32), a, n, k)):
                part.append(x[keep])
        ids, kind, a, n, k = map(np.concatenate, out)
        yield _table(id=ids, kind=kind, a=a, n=n, k=k)


def _fetch(batches):
    """The bytes of open runs, and the strings of hot ones one by one unless a smaller place has shown them here."""
    seen: dict[bytes, tuple[int, int]] = {}
    for batch in slices(batches):
        out = {name: [] for name in ("k", "id", "a", "n", "block")}

        def add(*row):
            for column, value in zip(out.values(), row):
                column.append(value)

        plan = batch.column("plan")
        sizes, flat = plan.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), plan.flatten()
        kind, a, n, k = (flat.field(c).to_numpy() for c in ("kind", "a", "n", "k"))
        ends = np.cumsum(sizes)
        for row in np.flatnonzero(sizes).tolist():
            raw, i = batch.column("raw")[row].as_py(), batch.column("id")[row].as_py()
            for j in range(int(ends[row] - sizes[row]), int(ends[row])):
                if kind[j] == OPEN:
                    add(int(k[j]), i, int(a[j]), int(n[j]), raw[a[j] : a[j] + n[j] - 1 + SPAN])
                elif kind[j] == HOT:
                    for at in range(int(a[j]), int(a[j] + n[j])):
                        string = raw[at : at + SPAN]
                        before = seen.get(string)
                        if before is not None and before < (i, at):
                            if out["block"] and out["block"][-1] is None and out["id"][-1] == i and out["a"][-1] + out["n"][-1] == at:
                                out["n"][-1] += 1
                            else:
                                add(xxhash.xxh3_64_intdigest(string) - 2**63, i, at, 1, None)  # the key only spreads it
                            continue
                        if before is None and len(seen) >= SEEN:
                            seen.clear()
                        seen[string] = (i, at)
                        add(xxhash.xxh3_64_intdigest(string) - 2**63, i, at, 1, string)
        types = {"block": pa.binary()}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})


def _factor(batches, limits: Limits):
    """Starts with a longest previous factor of a whole string, among the blocks with one k."""
    for table in _whole_groups(batches, limits.meet):
        ids, a, n = (table.column(c).to_numpy() for c in ("id", "a", "n"))
        blocks = table.column("block").to_pylist()
        known = np.array([b is None for b in blocks], bool)
        out = [[ids[known], a[known], n[known]]]
        use = np.flatnonzero(~known)
        if len(use):
            data = np.frombuffer(b"".join(blocks[j] for j in use), np.uint8)
            size = n[use] + SPAN - 1
            owner = np.repeat(np.arange(len(use)), n[use])
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n[use]) - n[use], n[use])
            place_id, place_at = ids[use][owner], a[use][owner] + step
            rows = np.lib.stride_tricks.sliding_window_view(data, SPAN)[(np.cumsum(size) - size)[owner] + step]
            suffixes = np.ascontiguousarray(rows).view(f"S{SPAN}").ravel()
            order = np.argsort(suffixes, kind="stable")
            rank = np.empty(len(order), np.int64)
            by_place = np.lexsort((place_at, place_id))
            rank[by_place] = np.cumsum(_new(place_id[by_place], place_at[by_place]))
            longest = anchors.previous_factors(rows[order], rank[order])
            later = order[longest >= SPAN]
            out.append([place_id[later], place_at[later], np.ones(len(later), np.int64)])
        found = _joined(*(np.concatenate(x) for x in zip(*out)))
        yield _table(id=found[0], a=found[1], n=found[2])


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(id, raw) of every row, and (id, spans) of those with later copies; spans hold runs of starts (a, n)."""
    spark = docs.sparkSession
    bound_batches(spark)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"))
    dealt = raw.filter("id is not null").mapInArrow(lambda b: _runs(b, limits), _ROW).repartition("k").sortWithinPartitions("k", "g", "id", "a")
    plan = materialise(dealt.mapInArrow(lambda b: _settle(b, limits), "id long, kind int, a long, n long, k long"), "runs")
    wanted = plan.filter(F.col("kind") != DUP).groupBy("id").agg(F.collect_list(F.struct("kind", "a", "n", "k")).alias("plan"))
    # Left joins on either side of the same texts, so that Spark shuffles the texts once.
    fetched = raw.join(wanted, "id", "left").mapInArrow(_fetch, "k long, id long, a long, n long, block binary")
    found = fetched.repartition("k").sortWithinPartitions("k").mapInArrow(lambda b: _factor(b, limits), "id long, a long, n long")
    starts = plan.filter(F.col("kind") == DUP).select("id", "a", "n").unionByName(found)
    return raw, starts.groupBy("id").agg(F.collect_list(F.struct("a", "n")).alias("spans"))


def cut(raw: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of removed runs."""
    kept, at, spans, end = [], 0, 0, -1
    for a, n in sorted(starts):
        if a > end:
            kept.append(raw[at:a])
            spans += 1
        end = max(end, a + n - 1 + SPAN)
        at = end
    kept.append(raw[at:])
    left = b"".join(kept)
    return left, len(raw) - len(left), spans


def _starts(batch, name: str = "spans") -> list[list[tuple[int, int]]]:
    return [[(s["a"], s["n"]) for s in spans or ()] for spans in batch.column(name).to_pylist()]


def _digest(batches):
    for batch in slices(batches):
        texts = batch.column("raw").to_pylist()
        rows = [cut(raw, starts) for raw, starts in zip(texts, _starts(batch))]
        yield _table(
            doc_id=batch.column("id"),
            n_bytes=[len(raw) for raw in texts],
            n_removed=[r[1] for r in rows],
            n_spans=[r[2] for r in rows],
            kept_sha256=[hashlib.sha256(r[0]).hexdigest() for r in rows],
        )


def report(docs: DataFrame, *, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row.

    Null texts are empty and lose nothing, as do texts under 100 bytes and rows without an
    id, which are no sources either. Ids must name one text: repeated rows of an id are one
    document, and get equal results. Ids are whole numbers.
    """
    raw, spans = removed_spans(docs, limits=limits)
    return raw.join(spans, "id", "left").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with later copies cut out of the texts; all rows and columns stay.

    A character of which some bytes are cut goes whole. ``length_col``, where there is such
    a column, becomes the new number of characters. Null texts stay null.
    """
    _, spans = removed_spans(docs, id_col=id_col, text_col=text_col)
    names = docs.columns
    id_name, spans_name = unused_names(docs, "repeat_id", "repeat_spans")
    at = names.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = [
                text if text is None or not starts else cut(text.encode(), starts)[0].decode(errors="ignore")
                for text, starts in zip(batch.column(at).to_pylist(), _starts(batch, spans_name))
            ]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    marked = docs.join(spans.select(F.col("id").alias(id_name), F.col("spans").alias(spans_name)), F.col(id_col) == F.col(id_name), "left").drop(id_name)
    out = marked.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
