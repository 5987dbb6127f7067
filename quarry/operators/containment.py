"""What a text must share with each text that holds it: hashes of word windows, chosen by content (QLT-8).

Of every ``RUN`` windows of ``k`` words in a row the one with the smallest hash counts. Which
one that is depends on these words alone, so a text's choice is among the choice of each text
that holds it. Texts too short for a run count as one window, for which longer texts look by a
bitmap of bounded size, which may say yes too often, never no.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.lineage import materialise

#: Windows of a run. As many as a window has words, so that a changed word makes a run of its own, and copies with a change have a window that nobody else has.
RUN = 8
#: A bitmap has so many bits for each entry, and as a power of two so many in all. Words that a task expands at once.
BITS_EACH, LEAST_BITS, MOST_BITS, WORDS = 32, 16, 28, 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(words: np.ndarray, most: int):
    """(size, hashes of the windows of that size, by first word) for sizes up to ``most``; they run over the ends of texts."""
    sums = words.copy()
    for size in range(1, min(most, len(words)) + 1):
        if size > 1:
            sums = sums[:-1] * _FACTOR + words[size - 1 :]
        yield size, _mixed(sums, size)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), ((hashes * _FACTOR) >> np.uint64(64 - bits)).astype(np.int64)


def _slices(batches):
    """(ids, words of all texts in a row, number of words of each), of some ``WORDS`` words at once."""
    for batch in batches:
        lists, ids = batch.column("words"), batch.column("para_id")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
            part = lists.slice(at, to - at)
            yield ids.slice(at, to - at), part.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(np.r_[ends[at - 1] if at else 0, ends[at:to]])
            at = to


def _wholes(short: int):
    """size and hash of each text of at most ``short`` words, as one window."""

    def run(batches):
        for _, words, sizes in _slices(batches):
            first = np.cumsum(sizes) - sizes
            for size, hashes in _windows(words, short):
                found = hashes[first[sizes == size]]
                yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(found), size, np.int32)), "hash": pa.array(found.view(np.int64))})

    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Spark sets 64 bits at a time; the driver sees 2^28 bits at most."""

    def places(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(at >> 6), "mask": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

    data = np.zeros(1 << bits - 6, np.int64)
    for r in hashes.mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        data[r["word"]] = r["mask"]
    return data.view(np.uint8)


def marks(texts: DataFrame, k: int) -> DataFrame:
    """para_id, win, need: the windows that each text (para_id, n_words, words: their hashes) has for others to ask for.

    Where the text itself asks for a window, ``need`` says for how many it asks; elsewhere it is 0.
    """
    most = k + RUN - 2
    short = materialise(texts.filter(F.col("n_words") <= most).mapInArrow(_wholes(most), "size int, hash long"), "short")
    found = {r["size"]: r["n"] for r in short.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a size
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, sum(found.values()))).bit_length()))
    sent = texts.sparkSession.sparkContext.broadcast((_bitmap(short.select("hash"), bits) if found else None, frozenset(found)))

    def run(batches):
        bitmap, asked = sent.value
        holds = lambda at: (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        for ids, words, sizes in _slices(batches):
            text = np.repeat(np.arange(len(sizes)), sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the text's end
            row, win, own = [], [], []
            for size, hashes in _windows(words, max([k, *asked])):
                fits = left[: len(hashes)] >= size
                if size == k:
                    least = hashes
                    for step in (1, 2, 4):  # of two, four and eight in a row
                        least = np.minimum(least[:-step], least[step:])
                    run_ = np.flatnonzero(left[: len(least)] > most)
                    row.append(text[run_])
                    win.append(least[run_])
                    own.append(np.ones(len(run_), bool))
                if size in asked:
                    one, two = _places(hashes, bits)
                    hit = np.flatnonzero(fits & holds(one))
                    hit = hit[holds(two[hit])]
                    row.append(text[hit])
                    win.append(hashes[hit])
                    own.append(sizes[text[hit]] == size)
            if not row:
                continue
            row, win, own = np.concatenate(row), np.concatenate(win), np.concatenate(own)
            order = np.lexsort((~own, win, row))
            row, win, own = row[order], win[order], own[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (win[1:] != win[:-1])][: len(row)]
            row, win, own = row[new], win[new], own[new]
            need = np.where(own, np.bincount(row, weights=own, minlength=len(sizes)).astype(np.int32)[row], 0).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"para_id": ids.take(pa.array(row)), "win": pa.array(win.view(np.int64)), "need": pa.array(need)})

    kind = texts.schema["para_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"para_id {kind}, win long, need int")
