"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

A window is ``size`` consecutive words of an item (all its words if it has fewer).

1. The words of all items are counted over all documents; in each window the word that is
   rarest in the corpus is its prefix. A document that contains the window contains it.
2. One pass over the documents looks for prefix words. Only windows that lie around one,
   within the document and of a length that some item window has, are candidates; those
   whose hash no item window has are dropped. Both tests are bitmaps of bounded size that
   let some too many through, never too few.
3. What is left, a document's places with their words, is joined with the item windows,
   word for word, and its spans are united.

Items and their windows stay in Spark throughout: neither they nor the candidates pass
through the driver, and the documents are read twice whatever the number of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import bound_batches, lower_ascii, materialise, slices, text_bytes, unused_names
from .maxent import _counted
from .sketch import scramble, word_hashes

#: The separators of the contract's words, in hexadecimal ranges.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
#: A bitmap has so many bits for each entry, and as a power of two so many in all.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 28
BROADCAST_ROWS, SALTS = 100_000, 16

_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text, as ``WORD`` finds them after A-Z are lower-cased."""
    return raw.translate(_TABLE).split()


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """One row per distinct window: its words and the sorted ids of the items that have it."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
    cut = F.transform(starts, lambda i: F.slice("w", i + 1, F.least(n, F.lit(size))))
    return (
        items.select(F.col(item_id).cast("string").alias("item"), words.alias("w"))
        .filter((n > 0) & F.col("item").isNotNull())
        .select("item", F.explode(F.array_distinct(cut)).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def window_hashes(tokens: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the runs of ``length`` word hashes from each start on."""
    powers, inverse = anchors._powers(0, len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers[:-1], out=sums[1:])
    return scramble((sums[start + length] - sums[start]) * inverse[start] + np.uint64(length))


class Bitmap:
    """A set of hashes, of which two bits each are kept; it may say yes too often, never no."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        other = scramble(hashes ^ np.uint64(0x5851F42D4C957F2D))
        return np.concatenate([hashes >> np.uint64(64 - bits), other >> np.uint64(64 - bits)]).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, self.bits)
        seen = (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return seen[: len(hashes)] & seen[len(hashes) :]


def bitmap(hashes: DataFrame, most: int) -> Bitmap:
    """The bitmap of a column ``hash`` of at most ``most`` different values, of which Spark makes 64 bits at a time."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, most)).bit_length()))

    def places(batches):
        for batch in slices(batches, 100_000):
            at = np.unique(Bitmap.places(batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            yield pa.RecordBatch.from_pydict({"word": pa.array(at >> 6), "mask": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

    data = np.zeros(1 << bits - 6, np.int64)
    for r in hashes.mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        data[r["word"]] = r["mask"]
    return Bitmap(bits, data.view(np.uint8))


def _hashed_windows(batches):
    """Windows as the documents' side writes them: words joined by blanks, and the hashes of the window and of its words."""
    for batch in slices(batches, 5000):
        windows = [[w.encode() for w in window] for window in batch.column("window").to_pylist()]
        flat, sizes = word_hashes([b" ".join(window) for window in windows], _GAPS)
        first, found = np.cumsum(sizes) - sizes, np.empty(len(windows), np.uint64)
        for length in np.unique(sizes).tolist():
            at = sizes == length
            found[at] = window_hashes(flat, first[at], length)
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array(found.view(np.int64)),
                "words": pa.array([b" ".join(w) for w in windows], pa.binary()),
                "n": pa.array(sizes.astype(np.int32)),
                "tokens": pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat.view(np.int64))),
                "items": batch.column("items"),
            }
        )


def _count(vocabulary):
    """Counts of the items' words, and of the few others that the bitmap lets through."""

    def parts(batches):
        for batch in slices(batches):
            tokens, _ = word_hashes(batch.column("raw").to_pylist(), _GAPS)
            yield np.unique(tokens[vocabulary.value.has(tokens)], return_counts=True)

    def run(batches):
        for columns in _counted(parts(batches), "token"):
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _candidates(prefixes, windows, lengths: list[int]):
    """Per document its number of words and the places that may hold an item window, with their words."""

    def run(batches):
        for batch in slices(batches):
            raws = batch.column("raw").to_pylist()
            tokens, sizes = word_hashes(raws, _GAPS)
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            near = np.concatenate([[0], np.cumsum(prefixes.value.has(tokens))])
            found = []
            for length in lengths:
                start = np.arange(max(0, len(tokens) - length + 1))
                start = start[(near[start + length] > near[start]) & (start + length <= ends[doc[start]])]
                key = window_hashes(tokens, start, length)
                ok = windows.value.has(key)
                found.append((start[ok], key[ok], np.full(int(ok.sum()), length)))
            start, key, length = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(start, kind="stable")
            start, key, length = start[order], key[order], length[order]
            own = start - (ends - sizes)[doc[start]]
            split = {d: words_of(raws[d]) for d in np.unique(doc[start]).tolist()}
            text = [b" ".join(split[d][s : s + n]) for d, s, n in zip(doc[start].tolist(), own.tolist(), length.tolist())]
            places = pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(text, pa.binary())], ["start", "n", "key", "words"])
            offsets = np.searchsorted(start, np.append(ends - sizes, len(tokens))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "h": batch.column("h"), "n_words": pa.array(sizes), "places": pa.ListArray.from_arrays(pa.array(offsets), places)})

    return run


def _united(batches):
    """Union of a document's spans, which come in any order: start, end, start, end ..."""
    for batch in batches:
        out = []
        for spans in batch.column("found").to_pylist():
            one: list[int] = []
            for s in sorted((s["start"], s["n"]) for s in spans):
                if one and s[0] <= one[-1]:
                    one[-1] = max(one[-1], s[0] + s[1])
                else:
                    one += [s[0], s[0] + s[1]]
            out.append(one)
        yield pa.RecordBatch.from_pydict(
            {
                "row": batch.column("row"),
                "n_hit": pa.array([sum(x[1::2]) - sum(x[::2]) for x in out], pa.int64()),
                "spans": pa.array(out, pa.list_(pa.int32())),
                "items": batch.column("items"),
            }
        )


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, size: int) -> DataFrame:
    """Per document row: id, h (a hash of its text), n_words, n_hit, spans and items, the last three null where nothing is hit."""
    bound_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast
    cut = item_windows(items, item_id, item_text, size)
    windows = materialise(cut.mapInArrow(_hashed_windows, "key long, words binary, n int, tokens array<long>, items array<string>"), "windows")
    raw = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), text_bytes(text_col).alias("raw"))
    id_type = raw.schema["id"].dataType.simpleString()

    size_of = windows.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("words"), F.sort_array(F.collect_set("n")).alias("lengths")).first()
    lengths = size_of["lengths"] or [size]  # at most ``size`` of them
    words = bitmap(windows.select(F.explode("tokens").alias("hash")), size_of["words"] or 0)
    counted = raw.select("raw").mapInArrow(_count(send(words)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # A word may be in a third of all windows: its windows look in several copies of its count.
    copies = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = windows.select("key", "words", F.explode("tokens").alias("token"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    ranked = placed.join(copies, ["token", "salt"], "left").groupBy("key", "words").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("hash"))
    sent = send(bitmap(ranked.select("hash"), size_of["windows"])), send(bitmap(windows.select(F.col("key").alias("hash")), size_of["windows"]))
    schema = f"id {id_type}, h long, n_words long, places array<struct<start:int,n:int,key:long,words:binary>>"
    rows = materialise(raw.mapInArrow(_candidates(*sent, lengths), schema).withColumn("row", F.monotonically_increasing_id()), "candidates")

    places = rows.select("row", F.inline("places"))
    # Windows that occur, each once: tasks drop repeats before the shuffle, so a common passage is no hot key here.
    met = materialise(places.select("key", "words").distinct().join(windows.select("key", "words", "items"), ["key", "words"]), "met")
    if met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hits = places.join(F.broadcast(met), ["key", "words"])
    else:
        # Each place looks in one of several copies of the windows that occur, so a common passage is spread.
        copies = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = places.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(copies, ["key", "words", "salt"])
    per = hits.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    united = per.mapInArrow(_united, "row long, n_hit long, spans array<int>, items array<string>")
    return rows.drop("places").join(united, "row", "left").drop("row")


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted ids), spans (start, end, ... of hit words).

    Null and wordless texts have no words and no hits; items without words or id have no
    windows; repeated rows each get their row; other columns are ignored.
    """
    found = _found(docs, items, id_col, text_col, item_id, item_text, size)
    return found.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans")
    )


def contaminated(n_hit="n_hit", n_words="n_words") -> Column:
    """The contract's rule: at least a twentieth of the words lie in item windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest columns of ``find_contamination``, which says what odd rows give."""
    found = find_contamination(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Documents without the contaminated ones; the columns stay as they are.

    A row goes if its id and text are those of a contaminated one; null and wordless texts
    stay, and so does everything where there are no items.
    """
    found = _found(docs, items, id_col, text_col, "item_id", "text", size)
    names = unused_names(docs, "gone_id", "gone_text")
    gone = materialise(found.filter(contaminated()).select(F.col("id").alias(names[0]), F.col("h").alias(names[1])).distinct(), "gone")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1])), "left_anti")
