"""Hashed maximum-entropy language model with a class-factored softmax.

log P(text) is the sum over its tokens of

    log P(class | context) + log P(subclass | class, context) + log P(word | subclass)    head words
    log P(class | context) + log P(word | class, previous class)                          tail words

* Texts are split once, into a table of 64-bit word hashes that every later pass reads.
* The most frequent words (a bounded head) have a class by the words they stand next to,
  and by their frequency a subclass; the most frequent have one of their own. All other
  words share a few tail classes.
* Class and subclass are softmaxes whose logits are sums of weight rows, picked by hashed
  features: the previous word, the word before it (skip), pairs of previous classes, and a
  skip pair; for subclasses the previous and the skip word, each with the class. Tasks take
  gradient steps over their own documents; their changes, weighted by how often each row
  was used, are summed by Spark, round by round, in levels of bounded size. The number of
  rows grows with the root of the training tokens, as vocabularies do, up to ``MOST_BITS``.
* A tail word has one weight for each class that it has followed. These weights grow with
  the corpus: they are a partitioned table with a row for each word, never sent to a task
  whole. Their gradients need only the sums over a tail class and previous class, which are
  a few grouped sums for each step. Scoring joins the table to the words that texts use.

The weights of the softmaxes depend on how the input is dealt to tasks, since tasks step
on their own documents; one layout of files gives one result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold, materialise, slices, text_bytes
from .sketch import word_hashes

HEAD, CONTEXT, GROUPS, BANDS, TAIL, WIDE, ROUNDS = 131_072, 256, 6, 5, 2, 32, 2
LEAST_BITS, MOST_BITS, TOKENS_AT_LEAST = 13, 19, 1 << 24
STEP, BATCH, BLOCK_ROWS, LOCAL_WORDS, FAN_IN, PLACES = 0.4, 4096, 256, 600_000, 64, 16
#: Weight of the pull of tail weights towards 0, and the largest steps that they take.
PULL, STEPS = 1.0, (2.0, 1.0)
#: The end token; no word hashes to it but by chance.
END = 0x2D06800538D394C2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.ones(WIDE, np.float32)
_TOKENS = "id {}, train boolean, tokens binary"


def _tokenise(batches):
    """Word hashes of each text, closed by the end token."""
    for batch in slices(batches):
        words, sizes = word_hashes(batch.column("raw").to_pylist())
        ends = np.cumsum(sizes + 1)
        tokens = np.full(len(words) + len(sizes), END, np.uint64)
        keep = np.ones(len(tokens), bool)
        keep[ends - 1] = False
        tokens[keep] = words
        flat, at = tokens.tobytes(), (8 * np.append(0, ends)).tolist()
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "train": batch.column("train"), "tokens": pa.array([flat[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())})


def tokenised(docs: DataFrame) -> DataFrame:
    """The written table of (id, train, tokens) of documents (id, train, raw)."""
    bound_batches(docs.sparkSession)
    return materialise(docs.mapInArrow(_tokenise, _TOKENS.format(docs.schema["id"].dataType.simpleString())), "tokens")


def _batches(batches):
    """Batches with their concatenated word hashes and the texts' token counts."""
    for batch in slices(batches, 500, 1 << 20):
        raws = batch.column("tokens").to_pylist()
        yield batch, np.frombuffer(b"".join(raws), np.uint64), np.fromiter(map(len, raws), np.int64, len(raws)) // 8


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return words, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def _counted(parts, name: str = "word"):
    """Sums of (key, count) arrays, handed on whenever a task holds many keys."""
    held, size = [], 0

    def out(words, n):
        for i in range(0, len(words), 100_000):
            yield {name: pa.array(_signed(words[i : i + 100_000])), "n": pa.array(n[i : i + 100_000])}

    for words, n in parts:
        held.append((words, n))
        size += len(words)
        if size > LOCAL_WORDS:
            held = [_summed(held)]
            size = len(held[0][0])
            if size > LOCAL_WORDS // 2:
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*_summed(held))


def _count(batches):
    """Word counts."""
    for columns in _counted(np.unique(tokens, return_counts=True) for _, tokens, _ in _batches(batches)):
        yield pa.RecordBatch.from_pydict(columns)


def _together(sizes: np.ndarray) -> np.ndarray:
    """Whether each token and the next are of one text."""
    out = np.ones(int(sizes.sum()) - 1, bool)
    out[np.cumsum(sizes)[:-1] - 1] = False
    return out


def _adjacent(context):
    """How often each pair of frequent words is adjacent."""

    def run(batches):
        frequent = context.value
        places, size = _Places(frequent), len(frequent) + 1
        pairs = np.zeros(size**2, np.int64)
        for _, tokens, sizes in _batches(batches):
            at = places.of(tokens)
            pairs += np.bincount((at[:-1] * size + at[1:])[_together(sizes)], minlength=len(pairs))
        pairs = pairs.reshape(size, size)
        pairs[-1] = pairs[:, -1] = 0
        pairs = pairs.ravel()
        seen = np.flatnonzero(pairs)
        if len(seen):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(seen), "n": pa.array(pairs[seen])})

    return run


def _near(head, groups):
    """For each head word, how often the words on either side are of each group of frequent words."""

    def run(batches):
        order, group = head.value, groups.value
        places = _Places(order)
        counts = np.zeros((len(order) + 1) * (GROUPS + 1), np.int64)
        for _, tokens, sizes in _batches(batches):
            at = places.of(tokens)
            side, together = group[at], _together(sizes)
            for word, other in ((at[:-1], side[1:]), (at[1:], side[:-1])):
                np.add.at(counts, (word * (GROUPS + 1) + other)[together & (other < GROUPS)], 1)
        counts = counts.reshape(-1, GROUPS + 1)[:-1, :-1]
        rows = np.flatnonzero(counts.sum(1))
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            columns = {f"g{g}": pa.array(counts[part, g]) for g in range(GROUPS)}
            yield pa.RecordBatch.from_pydict({"word": pa.array(part.astype(np.int64))} | columns)

    return run


def _find(order: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token in the sorted head, or its length."""
    if not len(order):
        return np.zeros(len(tokens), np.int64)
    at = np.searchsorted(order, tokens)
    return np.where(order[np.minimum(at, len(order) - 1)] == tokens, at, len(order))


class _Places:
    """``_find`` by a table of leading bits; slots that several head words share are searched."""

    BITS = 20

    def __init__(self, order: np.ndarray):
        self.order = order
        slot = self._slot(order)
        self.table = np.full(1 << self.BITS, len(order), np.int32)
        self.table[slot] = np.arange(len(order))
        shared = np.bincount(slot, minlength=1 << self.BITS) > 1
        self.table[shared] = -1

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(tokens)].astype(np.int64)
        many = np.flatnonzero(at < 0)
        at[many] = _find(self.order, tokens[many])
        end = len(self.order)
        return np.where(np.append(self.order, np.uint64(0))[at] == tokens, at, end)


def _cluster(pairs: np.ndarray, k: int) -> np.ndarray:
    """Groups of frequent words that stand next to each other: spectral clustering of adjacency counts.

    k-means on the leading eigenvectors, from the most frequent word and then words that are
    both frequent and unlike the centres so far.
    """
    near = np.sqrt(pairs + pairs.T)
    np.fill_diagonal(near, 0)  # words that texts repeat say nothing of their neighbours
    near += near.mean() / 2
    degree = near.sum(1)
    values, vectors = np.linalg.eigh(near / np.sqrt(degree[:, None] * degree[None, :]))
    x = vectors[:, -k:] * values[-k:]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = x[[int(degree.argmax())]]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmax(np.sqrt(degree) * (1 - (x @ centres.T).max(1)))]])
    for _ in range(30):
        own = (x @ centres.T).argmax(1)
        centres = np.array([(x[own == c] * degree[own == c, None]).sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    return own


@dataclass
class Model:
    order: np.ndarray  # head words, sorted
    count: np.ndarray  # their counts
    kind: np.ndarray  # class of each head word
    sub: np.ndarray  # subclass of each head word
    inside: np.ndarray  # log P(word | subclass) of each head word
    bits: int  # 2**bits hashed rows; then the bias of classes, then of subclasses by class
    weights: np.ndarray  # rows of WIDE logits
    total: int = 0
    distinct: int = 0

    def prepare(self) -> None:
        """Lookup tables that a task makes for itself, once."""
        self.places = _Places(self.order)
        self.kinds = np.append(self.kind, 0)
        self.subs = np.append(self.sub, 0)
        self.end_kind = self.classes(np.array([END], np.uint64))[1][0]

    def classes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head (its length for tail words) and class of each token."""
        at = self.places.of(tokens)
        return at, np.where(at < len(self.order), self.kinds[at], WIDE - TAIL + tail_class(tokens))

    def _row(self, x: np.ndarray, family: int) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31)) ^ np.uint64(family << 20)) * _ODD
        return ((x ^ (x >> np.uint64(32))) * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def features(self, tokens: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight rows of each token's context, those of its subclass, and the previous class. Before a text is the end token."""
        first = np.cumsum(sizes) - sizes
        age = np.arange(len(tokens)) - np.repeat(first, sizes)

        def back(x, n, filler):
            return np.where(age >= n, np.concatenate([np.full(n, filler, x.dtype), x[:-n]])[: len(x)], filler)

        end = np.uint64(END)
        w1, w2 = back(tokens, 1, end), back(tokens, 2, end)
        before = back(kinds, 1, self.end_kind)
        c1, c2, c3 = before.astype(np.uint64), *(back(kinds, n, self.end_kind).astype(np.uint64) for n in (2, 3))
        outer = np.stack([self._row(x, i) for i, x in enumerate((w1, w2, c1 << np.uint64(8) | c2, c2 << np.uint64(8) | c3))])
        own = kinds.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        inner = np.stack([self._row(w1 + own, 4), self._row(w2 + own, 5), (1 << self.bits) + 1 + kinds])
        return outer, inner, before

    def logits(self, f: np.ndarray, *common: int) -> np.ndarray:
        z = np.take(self.weights, f[0], axis=0)
        for row in f[1:]:
            z += np.take(self.weights, row, axis=0)
        for row in common:
            z += self.weights[row]
        if z.max(initial=0) > 60 or z.min(initial=0) < -60:  # far from where single precision ends; rows seldom get there
            z -= z.max(1, keepdims=True)
        return z

    def log_softmax(self, f: np.ndarray, y: np.ndarray, *common: int) -> np.ndarray:
        out = np.empty(len(y))
        for i in range(0, len(y), BATCH):
            z, own = self.logits(f[:, i : i + BATCH], *common), y[i : i + BATCH]
            out[i : i + BATCH] = z[np.arange(len(own)), own]
            out[i : i + BATCH] -= np.log(np.exp(z, out=z) @ _ONES)
        return out

    def log_head(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head and previous class of each token, and the natural log of its factors except that of tail words."""
        at, kinds = self.classes(tokens)
        outer, inner, before = self.features(tokens, kinds, sizes)
        out = self.log_softmax(outer, kinds, 1 << self.bits)
        head = np.flatnonzero(at < len(self.order))
        out[head] += self.log_softmax(inner[:, head], self.subs[at[head]]) + self.inside[at[head]]
        return at, before, out


def tail_class(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(40)) % np.uint64(TAIL)).astype(np.int64)


def _sums(x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the runs of rows that begin at ``start``, longest first: their order, lengths and sums."""
    n = np.diff(start, append=len(x))
    order = np.argsort(n.astype(np.uint16), kind="stable")[::-1]
    start, n = start[order], n[order]
    out = np.take(x, start, axis=0)
    for k in range(1, min(PLACES, int(n[0]))):
        m = len(n) - int(np.searchsorted(n[::-1], k, side="right"))
        out[:m] += np.take(x, start[:m] + k, axis=0)
    for i in range(len(n) - int(np.searchsorted(n[::-1], PLACES, side="right"))):
        out[i] += np.dot(np.ones(n[i] - PLACES, np.float32), x[start[i] + PLACES : start[i] + n[i]])
    return order, n, out


def _order(flat: np.ndarray) -> np.ndarray:
    """Stable order of row numbers: 16 bits at a time, which sort by radix."""
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    return order if flat.max(initial=0) < 1 << 16 else order[np.argsort((flat[order] >> 16).astype(np.uint16), kind="stable")]


class _Trainer:
    """Gradient steps on a task's own copy of the weights."""

    def __init__(self, model: Model):
        self.model = model
        self.squares = np.full(len(model.weights), 1.0, np.float32)
        self.used = np.zeros(len(model.weights), np.float32)

    def step(self, f: np.ndarray, y: np.ndarray, *common: int) -> None:
        """One step down the gradient of the mean of -log softmax of ``y``, in steps that shrink as a row is used."""
        w, n = self.model.weights, len(y)
        g = self.model.logits(f, *common)
        np.exp(g, out=g)
        g *= (1 / (g @ _ONES))[:, None]
        g[np.arange(n), y] -= 1
        flat = f.ravel()
        order = _order(flat)
        flat = flat[order]
        edges = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        rows = flat[edges]
        longest, used, change = _sums(np.take(g, np.tile(np.arange(n), len(f))[order], axis=0), edges)
        rows = rows[longest]
        squares = self.squares[rows] + (change * change) @ _ONES
        self.squares[rows] = squares
        change *= (STEP / np.sqrt(squares))[:, None]
        w[rows] = np.take(w, rows, axis=0) - change
        self.used[rows] += used
        for row in common:
            whole = g.sum(0)
            self.squares[row] += (whole * whole).sum()
            w[row] -= STEP / np.sqrt(self.squares[row]) * whole
            self.used[row] += len(y)


def _train(sent):
    """Steps over this task's documents; yields the change of each block of weight rows, times its use."""

    def run(batches):
        model = sent.value
        start, part = model.weights, TaskContext.get().partitionId()
        model = Model(model.order, model.count, model.kind, model.sub, model.inside, model.bits, start.copy())
        model.prepare()
        trainer = _Trainer(model)
        for _, tokens, sizes in _batches(batches):
            at, kinds = model.classes(tokens)
            outer, inner, _ = model.features(tokens, kinds, sizes)
            for i in range(0, len(tokens), BATCH):
                trainer.step(outer[:, i : i + BATCH], kinds[i : i + BATCH], 1 << model.bits)
            head = np.flatnonzero(at < len(model.order))
            inner, y = inner[:, head], model.subs[at[head]]
            for i in range(0, len(y), BATCH):
                trainer.step(inner[:, i : i + BATCH], y[i : i + BATCH])
        change, used = model.weights - start, trainer.used
        change *= used[:, None]
        for i in range(0, len(used), BLOCK_ROWS):
            if used[i : i + BLOCK_ROWS].any():
                columns = {"used": used[i : i + BLOCK_ROWS], "change": change[i : i + BLOCK_ROWS]}
                yield pa.RecordBatch.from_pydict({"block": pa.array([i]), "part": pa.array([part])} | {k: pa.array([v.tobytes()]) for k, v in columns.items()})

    return run


_BLOCKS = "block long, part long, used binary, change binary"


def _sum_block(pdf):
    total = {c: sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf[c]).astype(np.float32).tobytes() for c in ("used", "change")}
    return pdf.iloc[:1].assign(**total)


def gradient_sums(blocks: DataFrame, tasks: int) -> DataFrame:
    """Sums of the blocks of all tasks, in levels, so that no group holds over ``FAN_IN`` of them."""
    while True:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInPandas(_sum_block, _BLOCKS)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return blocks


def _tail_counts(sent):
    """How often each tail word follows each class, the class in the lowest bits of a second column."""

    def run(batches):
        model = sent.value
        model.prepare()
        held, size = [], 0

        def out():
            word, before, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((before, word))
            word, before, n = word[order], before[order], n[order]
            start = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (before[1:] != before[:-1])))
            n = np.add.reduceat(n, start)
            for i in range(0, len(start), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_pydict({"word": pa.array(_signed(word[start[s]])), "k": pa.array(before[start[s]].astype(np.int32)), "n": pa.array(n[s])})
            held.clear()

        for _, tokens, sizes in _batches(batches):
            at, kinds = model.classes(tokens)
            age = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            before = np.where(age > 0, np.append(model.end_kind, kinds[:-1]), model.end_kind)
            tail = np.flatnonzero(at == len(model.order))
            if len(tail):
                held.append((tokens[tail], before[tail], np.ones(len(tail), np.int64)))
                size += len(tail)
                if size > LOCAL_WORDS:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return run


@dataclass
class Tail:
    """Weights of tail words by the class before: sums by tail class and class before, of which each step makes new ones."""

    size: np.ndarray  # by tail class: counts, half a count for each word and for one unknown word
    follow: np.ndarray  # by tail class * WIDE + class before: tokens
    norms: list[np.ndarray]  # the normalisers before each step and after the last

    def prior(self, word: np.ndarray, c: np.ndarray) -> np.ndarray:
        """P(word | tail class) without context, from its count ``c``."""
        return (c + 0.5) / self.size[tail_class(word)]

    def weight(self, word: np.ndarray, k: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weight of a word that followed class ``k`` in ``n`` of its ``c`` tokens, after a step for each normaliser."""
        key = tail_class(word) * WIDE + k
        expected, w = self.follow[key] * self.prior(word, c), np.zeros(len(word))
        for norm, most in zip(self.norms, STEPS):
            e = expected * np.exp(w) / norm[key]
            w += np.clip((n - e - PULL * w) / (e + PULL), -most, most)
        return w

    def log(self, word: np.ndarray, k: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(word | tail class, class before)."""
        return np.log(self.prior(word, c) / self.norms[-1][tail_class(word) * WIDE + k]) + np.where(n > 0, self.weight(word, k, c, n), 0)

    def log_unseen(self, word: Column, k: Column, c: Column) -> Column:
        """``log`` of a word that was never seen after that class, whose weight is 0."""
        at = lambda values, place: F.element_at(F.array(*[F.lit(float(x)) for x in values]), place + 1)
        return F.log((F.coalesce(c, F.lit(0)) + F.lit(0.5)) / at(self.size, tail_of(word)) / at(self.norms[-1], tail_of(word) * WIDE + k))


def tail_of(word: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(word, 40), F.lit(TAIL)).cast("int")


def _pairs(batch):
    """Word, class before, count and joint count of each pair of a batch of tail words."""
    after, size = batch.column("after"), batch.column("after").value_lengths().to_numpy(zero_copy_only=False)
    flat = after.flatten()
    word, c = (np.repeat(batch.column(x).to_numpy(zero_copy_only=False), size) for x in ("word", "c"))
    return word.view(np.uint64), flat.field("k").to_numpy(zero_copy_only=False).astype(np.int64), c, flat.field("n").to_numpy(zero_copy_only=False), size


def _by_key(sent, value):
    """Sums of ``value`` of the pairs by tail class and class before."""

    def run(batches):
        total = np.zeros(TAIL * WIDE)
        for batch in batches:
            word, k, c, n, _ = _pairs(batch)
            total += np.bincount(tail_class(word) * WIDE + k, weights=value(sent.value, word, k, c, n), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"key": pa.array(seen), "x": pa.array(total[seen])})

    return run


def _tail_logs(sent):
    """Tail words with their log probabilities by class before."""

    def run(batches):
        for batch in batches:
            word, k, c, n, size = _pairs(batch)
            logs = pa.array(sent.value.log(word, k, c, n))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {"word": batch.column("word"), "c": batch.column("c"), "ks": pa.ListArray.from_arrays(offsets, pa.array(k.astype(np.int32))), "logs": pa.ListArray.from_arrays(offsets, logs)}
            )

    return run


def fit_tail(train: DataFrame, model: Model) -> tuple[DataFrame, Tail]:
    """(word, c, ks, logs) for each tail word, with its log probabilities ``logs`` after the classes ``ks``, and the sums of the weights' steps."""
    send = train.sparkSession.sparkContext.broadcast
    counted = train.mapInArrow(_tail_counts(send(model)), "word long, k int, n long")
    # A tail word has few tokens and WIDE classes before it at most, so a group is small.
    per = counted.groupBy("word", "k").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("k", "n")).alias("after"))
    words = materialise(per, "tail")
    sizes = {r["t"]: r for r in words.groupBy(tail_of(F.col("word")).alias("t")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tail = Tail(np.array([float(sizes[t]["n"] + 0.5 * (sizes[t]["v"] + 1)) if t in sizes else 0.5 for t in range(TAIL)]), np.zeros(TAIL * WIDE), [])

    def by_key(value) -> np.ndarray:
        out = np.zeros(TAIL * WIDE)
        for r in words.mapInArrow(_by_key(send(tail), value), "key long, x double").groupBy("key").agg(F.sum("x").alias("x")).collect():
            out[r["key"]] = r["x"]
        return out

    tail.follow = by_key(lambda tail, word, k, c, n: n)
    tail.norms.append(np.ones(TAIL * WIDE))
    for _ in STEPS:
        tail.norms.append(1 + by_key(lambda tail, word, k, c, n: tail.prior(word, c) * np.expm1(tail.weight(word, k, c, n))))
    return words.mapInArrow(_tail_logs(send(tail)), "word long, c long, ks array<int>, logs array<double>"), tail


def _score(sent):
    """Per text: token counts, head sums, the model's class terms, and its tail words with the class before and their number."""

    def run(batches):
        model = sent.value
        model.prepare()
        head_base = np.append(np.log10((model.count + 0.5) / (model.total + 0.5 * (model.distinct + 1))), 0.0)
        for batch, tokens, sizes in _batches(batches):
            at, before, logp = model.log_head(tokens, sizes)
            first = np.cumsum(sizes) - sizes
            known = at < len(model.order)
            rest = np.flatnonzero(~known)
            doc = np.repeat(np.arange(len(sizes)), sizes)[rest]
            word, k = tokens[rest], before[rest]
            order = np.lexsort((k, word, doc))
            doc, word, k = doc[order], word[order], k[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]) | (k[1:] != k[:-1])
            start = np.flatnonzero(fresh)
            n = np.diff(np.append(start, len(doc)))
            offsets = np.searchsorted(doc[start], np.arange(len(sizes) + 1))
            tail = pa.StructArray.from_arrays([pa.array(_signed(word[start])), pa.array(k[start].astype(np.int32)), pa.array(n)], ["word", "k", "n"])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "n_tokens": pa.array(sizes),
                    "n_head": pa.array(np.add.reduceat(known, first, dtype=np.int64)),
                    "base_head": pa.array(np.add.reduceat(head_base[at], first)),
                    "score_head": pa.array(np.add.reduceat(logp, first)),
                    "tail": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tail),
                }
            )

    return run


def counts(train: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(word, n) over all training texts; the most frequent of them as context words; their adjacency counts."""
    words = materialise(train.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = words.orderBy(F.desc("n"), "word").limit(CONTEXT).collect()
    frequent = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    size = len(frequent) + 1
    pairs = np.zeros(size**2)
    found = train.mapInArrow(_adjacent(train.sparkSession.sparkContext.broadcast(frequent)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in found.collect():
        pairs[r["pair"]] = r["n"]
    return words, frequent, pairs.reshape(size, -1)[:-1, :-1]


def frequent_words(words: DataFrame, most: int = HEAD) -> DataFrame:
    """At most ``most`` or so of the most frequent words, by levels of their counts; of the last level those with the least hashes.

    Words seen once stay in the tail, so that its classes learn where new words come.
    """
    words = words.filter("n > 1")
    level = F.floor(F.log2("n") * 256).cast("int")
    sizes = sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    left = most
    for r in sizes:
        if r["words"] > left:
            # Words are uniform 64-bit hashes, so a bound on them takes a share of a level.
            share = F.shiftrightunsigned("word", 1) < int(2**63 * left / r["words"])
            return words.filter((level > r["level"]) | ((level == r["level"]) & share))
        left -= r["words"]
    return words


def _bands(own: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and subclasses of head words: within each group, bands of falling frequency and equal mass."""
    kind, sub = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for g in range(GROUPS):
        at = np.flatnonzero(own == g)
        at = at[np.argsort(-count[at], kind="stable")]
        before = np.cumsum(count[at]) - count[at]
        band = np.minimum(before * (BANDS * WIDE) // max(1, count[at].sum()), BANDS * WIDE - 1)
        kind[at], sub[at] = g * BANDS + band // WIDE, band % WIDE
    return kind, sub


def _log_shares(mass: np.ndarray) -> np.ndarray:
    """Logs of the shares of each row; what has no words has next to none."""
    share = mass / np.maximum(mass.sum(1, keepdims=True), 1)
    return np.log(np.maximum(share, 1e-13))


def row_bits(total: int) -> int:
    """Bits of the hashed rows' number: it grows with the root of the training tokens, as a vocabulary does."""
    return int(min(MOST_BITS, max(LEAST_BITS, LEAST_BITS + math.log2(max(1, total) / TOKENS_AT_LEAST) / 2)))


def fit(train: DataFrame) -> tuple[Model, DataFrame, Tail]:
    """Train on a written table of tokens; gives the model, the table of tail words and its sums."""
    spark = train.sparkSession
    send = spark.sparkContext.broadcast
    words, frequent, pairs = counts(train)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent_words(words).toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    head, count = top["word"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order]

    group = np.full(len(head) + 1, GROUPS, np.int64)
    if len(frequent) > GROUPS:
        at = _find(head, frequent)
        group[at[at < len(head)]] = _cluster(pairs, GROUPS)[at < len(head)]
    sums = [F.sum(f"g{g}").alias(f"g{g}") for g in range(GROUPS)]
    near = train.mapInArrow(_near(send(head), send(group)), "word long, " + ", ".join(f"g{g} long" for g in range(GROUPS))).groupBy("word").agg(*sums).toPandas()
    side = np.zeros((len(head), GROUPS))
    side[near["word"].to_numpy(np.int64)] = near[[f"g{g}" for g in range(GROUPS)]].to_numpy()
    share = (side + 0.1) / (side.sum(0, keepdims=True) + 1)
    kind, sub = _bands(share.argmax(1), count)
    mass = np.bincount(kind * WIDE + sub, weights=count, minlength=WIDE * WIDE)
    bits = row_bits(int(total))
    model = Model(head, count, kind, sub, np.log(count / mass[kind * WIDE + sub]), bits, np.zeros(((1 << bits) + 1 + WIDE, WIDE), np.float32), int(total), int(distinct))
    rest, tail = fit_tail(train, model)

    seen = mass.reshape(WIDE, WIDE).astype(float)
    sizes = seen.sum(1)
    sizes[WIDE - TAIL :] += np.reshape(tail.follow, (TAIL, WIDE)).sum(1) + 0.5
    model.weights[(1 << bits) + 1 :] = _log_shares(seen)
    model.weights[1 << bits] = _log_shares(sizes[None])[0]
    for i in range(ROUNDS):
        part = train.filter(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == i) if ROUNDS > 1 else train
        blocks = part.mapInArrow(_train(send(model)), _BLOCKS)
        weights = model.weights.copy()
        for r in gradient_sums(blocks, part.rdd.getNumPartitions()).toLocalIterator():
            used, change = (np.frombuffer(r[c], np.float32) for c in ("used", "change"))
            weights[r["block"] : r["block"] + len(used)] += change.reshape(len(used), -1) / np.maximum(used, 1)[:, None]
        model.weights = weights
    return model, rest, tail


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for every row; training rows are those whose crc32 fold of five is not 1.

    A null text is empty: one end token. Repeated rows each get their row, and count as
    often. A null id trains. Without training rows every token is unknown. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col) != 1, F.lit(True)).alias("train"), text_bytes(text_col).alias("raw"))
    tokens = tokenised(raw)
    model, rest, tail = fit(tokens.filter("train"))
    id_type = raw.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, n_head long, base_head double, score_head double, tail array<struct<word:long,k:int,n:long>>"
    heads = materialise(tokens.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    col, n = F.col, F.col("n")
    base = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    logp = F.coalesce(F.get("logs", F.array_position("ks", col("k")).cast("int") - 1), tail.log_unseen(col("word"), col("k"), col("c")))
    used = heads.select("row", F.inline("tail"))
    tails = (
        used.join(rest, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.when(col("c") > 0, n).otherwise(0)).alias("n_tail"), F.sum(n * base).alias("base_tail"), F.sum(n * logp).alias("score_tail"))
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return heads.drop("tail").join(tails, "row", "left").select(
        col("id").alias(id_col),
        F.coalesce(fold("id") == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (col("n_head") + zero("n_tail")).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (col("base_head") + zero("base_tail")).alias("base_score"),
        ((col("score_head") + zero("score_tail")) / math.log(10)).alias("score"),
    )
