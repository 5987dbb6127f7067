"""Exact and approximate nearest vectors for whole tables of queries (VEC-1, VEC-2). Scores are inner products.

Nothing is collected but a bounded sample to train an index: its cells and code books have a
size that does not depend on the data.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of queries and of chunks: one product of two blocks is what a task holds at once.
QUERY_BLOCK, CHUNK_BLOCK = 2048, 4096
#: So many query blocks (some MB each) are broadcast; more are dealt over a grid with so many columns.
FEW_BLOCKS, COLUMNS = 4, 64
#: Rows that train an index, and those of them that serve as its test queries; nearest chunks that a query re-ranks exactly.
TRAIN_ROWS, TEST_ROWS, SHORTLIST = 20_000, 200, 100
#: Scores that a task holds as one matrix: a product of two blocks is taken in strips of queries.
STRIP = 1 << 20
_BLOCK = "part bigint, payload binary, vectors binary"


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank; Spark cuts each partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(raw: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(rows, -1)


def _row(table: pa.Table, part: int) -> dict:
    """One block: the vectors as one matrix, the other columns as they are."""
    vectors = np.ascontiguousarray(_matrix(table.column("vector_"), table.num_rows), "<f8")
    return {"part": pa.array([part], pa.int64()), "payload": [_ipc(table.drop_columns(["vector_"]))], "vectors": [vectors.tobytes()]}


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` rows, packed where the rows lie."""

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - size))
                batch, size = batch.slice(rows - size), size + held[-1].num_rows
                if size == rows:
                    yield pa.RecordBatch.from_pydict(_row(pa.Table.from_batches(held), 0))
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(_row(pa.Table.from_batches(held), 0))

    return df.mapInArrow(pack, _BLOCK)


def _parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    """One block for each of ``parts`` parts by hash of the key."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.table(_row(table.drop_columns(["part_"]), table.column("part_")[0].as_py()))

    return df.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(parts))).groupBy("part_").applyInArrow(pack, _BLOCK)


def _first(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` rows of each group with the greatest score, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) < k]


def _strips(queries: np.ndarray, rows: int):
    """Where each strip of queries begins, and the strip: its scores with ``rows`` rows are at most ``STRIP``."""
    step = max(1, STRIP // max(1, rows))
    for at in range(0, len(queries), step):
        yield at, queries[at : at + step]


def _cells(batches, names: tuple[str, ...]):
    """The named values of one row after the other, binary ones where they lie: a batch has many blocks, and is not copied."""
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i in range(batch.num_rows):
            yield [c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in columns]


class _Best:
    """The best ``k`` chunks of each query of one block, over the chunk blocks that a task meets."""

    def __init__(self, payload: bytes, vectors: bytes, query_id: str, chunk_id: str, k: int):
        self.ids = _table(payload).column(query_id).combine_chunks()
        self.matrix = np.frombuffer(vectors, "<f8").reshape(len(self.ids), -1)
        self.chunk_id, self.query_id, self.k, self.held, self.size = chunk_id, query_id, k, [], 0

    def add(self, payload: bytes | pa.Buffer, vectors: bytes | pa.Buffer) -> None:
        table = _table(payload)
        chunks = np.frombuffer(vectors, "<f8").reshape(table.num_rows, -1).T
        for at, strip in _strips(self.matrix, table.num_rows):
            score = strip @ chunks
            if table.num_rows > self.k:
                least = np.partition(score, -self.k, axis=1)[:, -self.k]
                q, c = np.nonzero(score >= least[:, None])
            else:
                q, c = (x.ravel() for x in np.indices(score.shape))
            found = table.take(pa.array(c)).append_column("q_", pa.array(q + at, pa.int32())).append_column("score", pa.array(score[q, c]))
            self.held.append(found)
            self.size += found.num_rows
            if self.size > 3 * self.k * len(self.ids):
                self.held = [self.merged()]
                self.size = self.held[0].num_rows

    def merged(self) -> pa.Table:
        table = pa.concat_tables(self.held)
        tie = np.array(table.column(self.chunk_id).to_pylist())
        return table.take(pa.array(_first(table.column("q_").to_numpy(), table.column("score").to_numpy(), tie, self.k)))

    def batches(self, names: list[str]):
        table = self.merged()
        table = table.append_column(self.query_id, self.ids.take(table.column("q_").combine_chunks()))
        yield from table.select(names).to_batches(max_chunksize=10_000)


def knn(queries: DataFrame, chunks: DataFrame, k: int, *, allow: DataFrame | None = None, on: list[str] | None = None, query_id: str = "query_id", chunk_id: str = "chunk_pk", vector: str = "embedding", query_block: int = QUERY_BLOCK, few: int = FEW_BLOCKS) -> DataFrame:
    """Exact top ``k`` chunks of every query (VEC-1): the chunk's columns, query_id, score, rank.

    Queries and chunks are packed into blocks; each pair of blocks is multiplied once, and a
    task keeps the best ``k`` of each query over all blocks that it meets, before anything is
    shuffled. Up to ``few`` query blocks are broadcast, and chunks stay where they are; more
    are joined over a grid (query block x column), for which chunks are read once and sent to
    each row of it. ``allow`` restricts chunks by a semi join on ``on``. Rows without a vector
    are left out; ties go to the smaller chunk id; query ids name one vector each.
    """
    if allow is not None:
        chunks = chunks.join(allow.select(*on).distinct(), on, "left_semi")
    rest = [c for c in chunks.columns if c != vector]
    base = chunks.filter(F.col(vector).isNotNull()).select(*rest, F.col(vector).cast("array<double>").alias("vector_"))
    asked = queries.filter(F.col(vector).isNotNull()).select(query_id, F.col(vector).cast("array<double>").alias("vector_"))
    out = T.StructType([*(f for f in base.schema.fields if f.name != "vector_"), asked.schema[query_id], T.StructField("score", T.DoubleType())])
    rows = max(1, -(-asked.count() // query_block))
    right = _parts(asked, query_id, rows).select("part", F.col("payload").alias("asked"), F.col("vectors").alias("matrix"))
    left = _blocks(base, CHUNK_BLOCK).select("payload", "vectors")
    if rows <= few:
        cells = left.crossJoin(F.broadcast(right))
    else:
        left = left.withColumn("column", F.floor(F.rand(7) * COLUMNS).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))))
        cells = left.join(right.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1)))).hint("merge"), ["part", "column"])  # a broadcast would bring every column's copy to the driver

    def best(batches):
        held: dict[int, _Best] = {}
        for part, asked_, matrix, payload, vectors in _cells(batches, ("part", "asked", "matrix", "payload", "vectors")):
            if part not in held:
                if len(held) >= max(1, few):
                    yield from held.pop(next(iter(held))).batches(out.names)
                held[part] = _Best(asked_.to_pybytes(), matrix.to_pybytes(), query_id, chunk_id, k)  # kept for longer than the batch
            held[part].add(payload, vectors)
        for found in held.values():
            yield from found.batches(out.names)

    found = cells.select("part", "asked", "matrix", "payload", "vectors").mapInArrow(best, out)
    return top_per_key(found, [query_id], [F.desc("score"), F.asc(chunk_id)], k)


class Index(NamedTuple):
    """Cells, product-quantisation code books (part, code, values) of what is left of a vector without its cell, cells a chunk lies in, and cells a query probes."""

    centres: np.ndarray
    books: np.ndarray
    spill: int
    probes: int

    def near(self, vectors: np.ndarray) -> np.ndarray:
        """Cells by distance, for chunks."""
        return np.argsort((self.centres**2).sum(1) - 2 * vectors @ self.centres.T, axis=1, kind="stable")

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """Cells in the order in which queries probe them."""
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def codes(self, rest: np.ndarray) -> np.ndarray:
        """Nearest code of each part."""
        parts, _, width = self.books.shape
        split = rest.reshape(len(rest), parts, width)
        return np.stack([np.argmin((self.books[m] ** 2).sum(1) - 2 * split[:, m] @ self.books[m].T, axis=1) for m in range(parts)], axis=1).astype(np.uint8)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def train_index(chunks: DataFrame, k: int, *, cells: int = 128, probes: int = 10, recall: float = 0.95, train_rows: int = TRAIN_ROWS, cell_rows: int = 10, seed: int = 2, chunk_id: str = "chunk_pk", vector: str = "embedding") -> Index | None:
    """An index fitted on the ``train_rows`` chunks with the smallest hashes; None without vectors.

    There are ``cells`` cells, fewer only where the sample has not ``cell_rows`` rows for each.
    A chunk lies in so many of its nearest cells (``spill``) that ``probes`` cells hold ``recall``
    of the nearest ``k`` within the sample, of some of its rows: one where vectors cluster,
    more where they do not.
    """
    sample = chunks.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(chunk_id), chunk_id).limit(train_rows)
    drawn = sample.select(F.col(vector).cast("array<double>").alias("v")).toArrow().column("v")
    if not len(drawn):
        return None
    x = _matrix(drawn, len(drawn))
    centres = _kmeans(x, max(1, min(cells, len(x) // cell_rows)), seed)
    own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
    width = next(w for w in (4, 3, 2, 1) if x.shape[1] % w == 0)
    rest = (x - centres[own]).reshape(len(x), -1, width)
    books = np.stack([_kmeans(rest[:, m], min(256, max(1, len(x) // 4)), seed + m, 8) for m in range(rest.shape[1])])
    index = Index(centres, books, 1, min(probes, len(centres)))
    asked = x[:TEST_ROWS]
    nearest = np.argsort(-(asked @ x.T), axis=1)[:, : k + 1]
    order, probed = index.near(x), index.probed(asked)
    met = np.zeros(len(nearest.ravel()), bool)
    spill = 0
    while spill < len(centres) and (not spill or met.mean() < recall):
        met |= (order[nearest, spill].ravel()[:, None] == np.repeat(probed, nearest.shape[1], axis=0)).any(1)
        spill += 1
    return index._replace(spill=spill)


def _lists(index: Index, chunks: DataFrame, chunk_id: str, vector: str) -> DataFrame:
    """cell, id, code: every chunk in its ``spill`` nearest cells, as the codes of what is left without the cell."""
    sent = chunks.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", chunks.schema[chunk_id].dataType), T.StructField("code", T.BinaryType())])

    def run(batches):
        ix = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("v"), part.num_rows)
                cell = ix.near(x)[:, : ix.spill]
                row = np.repeat(np.arange(len(x)), cell.shape[1])
                codes = ix.codes(x[row] - ix.centres[cell.ravel()])
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.ravel(), pa.int32()), "id": part.column("id").take(pa.array(row)), "code": [c.tobytes() for c in codes]})

    rows = chunks.filter(F.col(vector).isNotNull()).select(F.col(chunk_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, schema)


def _probes(index: Index, queries: DataFrame, query_id: str, vector: str) -> DataFrame:
    """query_id, cell and v: each query once for each cell that it probes."""
    sent = queries.sparkSession.sparkContext.broadcast(index)
    rows = queries.filter(F.col(vector).isNotNull()).select(query_id, F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = sent.value.probed(_matrix(batch.column("v"), batch.num_rows))
                row = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns), pa.array(cells.ravel(), pa.int32())], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def scanned(index: Index, queries: DataFrame, chunks: DataFrame, *, query_id: str = "query_id", chunk_id: str = "chunk_pk", vector: str = "embedding") -> DataFrame:
    """query_id and how many list entries its probes compare (a chunk counts once for each cell that holds it)."""
    sizes = _lists(index, chunks, chunk_id, vector).groupBy("cell").agg(F.count(F.lit(1)).alias("entries"))
    return _probes(index, queries, query_id, vector).join(F.broadcast(sizes), "cell").groupBy(query_id).agg(F.sum("entries").alias("entries"))


def ann(queries: DataFrame, chunks: DataFrame, k: int, *, index: Index | None = None, shortlist: int = SHORTLIST, query_id: str = "query_id", chunk_id: str = "chunk_pk", vector: str = "embedding", **training) -> DataFrame:
    """VEC-2: approximate top ``k`` by inverted lists: the chunk's columns, query_id, score, rank.

    Every chunk is indexed. Lists and probing queries of a cell meet in blocks, a long list in
    several; each query takes the best ``shortlist`` of a block by the sums of a lookup table
    of its products with the code books. The shortlists' best are scored exactly. Without
    ``index`` one is trained (``train_index``). Rows without a vector are left out.
    """
    index = index or train_index(chunks, k, chunk_id=chunk_id, vector=vector, **training)
    kinds = {query_id: queries.schema[query_id].dataType, chunk_id: chunks.schema[chunk_id].dataType}
    if index is None:
        empty = chunks.drop(vector).withColumn(query_id, F.lit(None).cast(kinds[query_id])).withColumn("score", F.lit(0.0)).limit(0)
        return top_per_key(empty, [query_id], [F.asc(chunk_id)], k)
    sent = chunks.sparkSession.sparkContext.broadcast(index)
    total, asked = chunks.count(), queries.count()
    cut = lambda n, block: max(1, -(-n // (len(index.centres) * block)))
    listed = _lists(index, chunks, chunk_id, vector).withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(cut(total * index.spill, CHUNK_BLOCK))))
    probed = _probes(index, queries, query_id, vector).withColumn("cut", F.pmod(F.xxhash64(query_id), F.lit(cut(asked * index.probes, QUERY_BLOCK))))

    def pack(table: pa.Table) -> pa.Table:
        own = table.drop_columns(["cell", "cut"])
        return pa.table({"cell": table.column("cell").slice(0, 1), "block": [_ipc(own)]})

    lists = listed.groupBy("cell", "cut").applyInArrow(pack, "cell int, block binary")
    groups = probed.groupBy("cell", "cut").applyInArrow(pack, "cell int, block binary").select("cell", F.col("block").alias("asked"))
    near = T.StructType([T.StructField(query_id, kinds[query_id]), T.StructField(chunk_id, kinds[chunk_id]), T.StructField("near", T.DoubleType())])

    def look_up(batches):
        ix = sent.value
        parts, _, width = ix.books.shape
        for cell, block, asked_ in _cells(batches, ("cell", "block", "asked")):
            entries, ask = _table(block), _table(asked_)
            codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(entries.num_rows, -1)
            for at, q in _strips(_matrix(ask.column("v"), ask.num_rows), len(codes)):  # cells are uneven: a block may be many times the mean
                score = np.repeat((q @ ix.centres[cell])[:, None], len(codes), axis=1)
                split = q.reshape(len(q), parts, width)
                for m in range(parts):
                    score += (split[:, m] @ ix.books[m].T)[:, codes[:, m]]
                if len(codes) > shortlist:
                    c = np.argpartition(-score, shortlist - 1, axis=1)[:, :shortlist]
                else:
                    c = np.tile(np.arange(len(codes)), (len(q), 1))
                row = np.repeat(np.arange(len(q)), c.shape[1])
                table = pa.table({query_id: ask.column(query_id).take(pa.array(row + at)), chunk_id: entries.column("id").take(pa.array(c.ravel())), "near": score[row, c.ravel()]})
                yield from table.to_batches(max_chunksize=10_000)

    found = lists.join(groups, "cell").mapInArrow(look_up, near).groupBy(query_id, chunk_id).agg(F.max("near").alias("near"))
    short = top_per_key(found, [query_id], [F.desc("near"), F.asc(chunk_id)], shortlist, "place").select(query_id, chunk_id)
    scored = short.join(queries.select(query_id, F.col(vector).cast("array<double>").alias("asked_")), query_id).join(chunks, chunk_id)
    scored = scored.withColumn("score", inner(F.col("asked_"), F.col(vector).cast("array<double>"))).select(*[c for c in chunks.columns if c != vector], query_id, "score")
    return top_per_key(scored, [query_id], [F.desc("score"), F.asc(chunk_id)], k)
