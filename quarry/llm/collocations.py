"""Phrase collocation mining with counting quotient filters.

Words are counted per language; those that reach the threshold (no phrase with another one can)
get dense ids, and texts are kept as id streams, cut where a piece ends. Level by level, each
task counts the n-grams of its streams in a counting quotient filter and sends it in slices of
the quotient; the filters of a slice are merged in order, and n-grams that reach the threshold
come back out of them. An n-gram is only counted where both (n-1)-grams within reach it, which
a bitmap of bounded size tells: it lets some others through, which costs time, and loses none.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quotient
from .common import bound_batches, materialise

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words with ids of their own, broadcast: the most frequent. Phrases with others that reach the threshold are counted as text.
TABLE = 1 << 19
#: Bits of a bitmap at most (16 MB); occurrences a slice of the filters has at most, on average; n-grams a task counts before it sends a filter.
MOST_BITS, SLICE, HELD = 1 << 27, 1 << 22, 1 << 21
_MARKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10)
_CUT = b"\xff"  # in no UTF-8 text


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text, with ``_CUT`` between pieces."""
    return raw.translate(_MARKS).replace(_CUT, b" \xff ").split()


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, f over all words."""

    def run(batches):
        held: dict[str, Counter] = {}

        def send():
            for lang, c in held.items():
                c.pop(_CUT, None)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.binary()).cast(pa.string()), "f": pa.array(c.values(), pa.int64())})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > 250_000:
                yield from send()
        yield from send()

    return texts.mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def bitmap(places: DataFrame, bits: int) -> bytearray:
    """A bitmap with the bits set that ``places`` (column ``p``) lists; it comes in parts of 64 KB, whatever the number of places."""
    masks = places.groupBy(F.expr("p div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(p % 8 as int)))").alias("mask"))
    parts = masks.groupBy(F.shiftright("byte", 16).alias("part")).applyInArrow(_part, "part bigint, bits binary")
    out = bytearray(max(1, bits // 8))
    for row in parts.toLocalIterator():
        at = row["part"] << 16
        size = min(1 << 16, len(out) - at)
        out[at : at + size] = row["bits"][:size]
    return out


def _part(table: pa.Table) -> pa.Table:
    out = np.zeros(1 << 16, np.uint8)
    out[table.column("byte").to_numpy() & 0xFFFF] = table.column("mask").to_numpy()
    return pa.table({"part": pa.array([table.column("byte")[0].as_py() >> 16], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})


def _size(rows: int) -> int:
    """Bits of a bitmap for so many entries: 32 for each, within bounds; a power of two."""
    return min(MOST_BITS, 1 << max(12, (32 * rows).bit_length()))


def _place(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    x = (left ^ right * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x >> np.uint64(65 - bits.bit_length())


def _hit(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (marks[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Vocabulary(NamedTuple):
    """Broadcast (lang, word) by id - 1, and the bits an id takes."""

    sent: Broadcast
    bits: int


def vocabulary_of(spark: SparkSession, rows: list) -> Vocabulary:
    words = [(r["lang"], r["word"]) for r in rows]
    return Vocabulary(spark.sparkContext.broadcast(words), max(1, len(words).bit_length()))


def _ids(words: list[tuple[str, str]]) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(words, 1):
        out.setdefault(lang, {})[word.encode()] = i
    return out


def id_streams(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as runs of 32-bit ids; 0 stands for the end of a piece or text and for words without an id."""
    sent = vocabulary.sent

    def run(batches):
        known, ids, size = _ids(sent.value), [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                get = known.get(lang, {}).get
                ids.append(np.array([*(get(w, 0) for w in tokens(text)), 0], np.int32))
                size += len(ids[-1])
                if size >= 1 << 18:
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([np.concatenate(ids).tobytes()], pa.binary())})
                    ids, size = [], 0
        if ids:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([np.concatenate(ids).tobytes()], pa.binary())})

    return materialise(texts.mapInArrow(run, "ids binary"), "collocation-ids")


def _windows(ids: np.ndarray, k: int, bits: int, marks: np.ndarray | None, size: int):
    """Permuted n-grams of k ids, all present, whose two (k-1)-grams the bitmap has."""
    n = len(ids) - k + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2
    good = ids[:n] > 0
    for j in range(1, k):
        good &= ids[j : n + j] > 0
    at = np.flatnonzero(good)
    if marks is not None:
        starts = np.unique(np.r_[at, at + 1])
        hit = _hit(marks, _place(*quotient.permute(*quotient.pack([ids[starts + j] for j in range(k - 1)], bits), k - 1, bits), size))
        on = np.zeros(len(ids) + 1, bool)
        on[starts[hit]] = True
        at = at[on[at] & on[at + 1]]
    return quotient.permute(*quotient.pack([ids[at + j] for j in range(k)], bits), k, bits)


def level(streams: DataFrame, vocabulary: Vocabulary, k: int, marks: bytearray | None, slices: int, *, least: int = LEAST, held: int = HELD) -> DataFrame:
    """left, right (permuted halves), lang, phrase and f of the n-grams of k ids that occur ``least`` times."""
    spark, bits, words = streams.sparkSession, vocabulary.bits, vocabulary.sent
    sent = spark.sparkContext.broadcast(None if marks is None else np.frombuffer(bytes(marks), np.uint8))
    size = len(marks) * 8 if marks is not None else 0
    top = min(slices, quotient.halves(k, bits)[0])

    def send(parts):
        left, right, counts = quotient.merge(parts, k, bits) if len(parts) > 1 else parts[0]
        part = left >> np.uint64(quotient.halves(k, bits)[0] - top)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for i, j in zip(first, np.r_[first[1:], len(left)]):
            yield int(part[i]), quotient.encode(left[i:j], right[i:j], counts[i:j], k, bits, top)

    def build(batches):
        parts, total = [], 0
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                found = _windows(np.frombuffer(raw, np.int32), k, bits, sent.value, size)
                if len(found[0]):
                    parts.append(quotient.count(*found, None, k, bits))
                    total += len(parts[-1][0])
                if total >= held:
                    parts = [quotient.merge(parts, k, bits)]
                    total = len(parts[0][0])
                    if total >= held // 2:
                        yield from _blobs(send(parts))
                        parts, total = [], 0
        if parts:
            yield from _blobs(send(parts))

    def combine(batches):
        now, parts, total = None, [], 0

        def done():
            left, right, counts = quotient.merge(parts, k, bits)
            enough = counts >= least
            left, right, counts = left[enough], right[enough], counts[enough]
            rows = quotient.unpack(*quotient.restore(left, right, k, bits), k, bits)
            table = words.value
            phrases = [" ".join(table[i - 1][1] for i in row) for row in rows.tolist()]
            langs = [table[i - 1][0] for i in rows[:, 0].tolist()]
            for i in range(0, len(counts), 10_000):
                j = slice(i, i + 10_000)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs[j], pa.string()), "phrase": pa.array(phrases[j], pa.string()), "f": pa.array(counts[j], pa.int64()),
                    "left": pa.array(left[j].astype(np.int64)), "right": pa.array(right[j].astype(np.int64))})

        for batch in batches:
            for part, raw in zip(batch.column("slice").to_pylist(), batch.column("filter").to_pylist()):
                if part != now:
                    if parts:
                        yield from done()
                    now, parts, total = part, [], 0
                parts.append(quotient.decode(raw, k, bits, part))
                total += len(parts[-1][0])
                if total >= held:
                    parts = [quotient.merge(parts, k, bits)]
                    total = 0
        if parts:
            yield from done()

    filters = streams.mapInArrow(build, "slice bigint, filter binary")
    merged = filters.repartition("slice").sortWithinPartitions("slice").mapInArrow(combine, "lang string, phrase string, f bigint, left bigint, right bigint")
    return materialise(merged, f"collocation-{k}")


def _blobs(rows):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if len(held) >= 4096 or size >= 4 << 20:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([r[0] for r in held], pa.int64()), "filter": pa.array([r[1] for r in held], pa.binary())})
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([r[0] for r in held], pa.int64()), "filter": pa.array([r[1] for r in held], pa.binary())})


def _marks_of(found: DataFrame, rows: int) -> bytearray:
    """The bitmap of one level's n-grams."""
    size = _size(rows)

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_numpy().astype(np.uint64) for c in ("left", "right"))
            yield pa.RecordBatch.from_pydict({"p": pa.array(_place(left, right, size).astype(np.int64))})

    return bitmap(found.select("left", "right").mapInArrow(run, "p bigint"), size)


def other_phrases(texts: DataFrame, frequent: DataFrame, rows: int, vocabulary: Vocabulary, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, f of n-grams with a word that reaches the threshold but has no id, counted as text.

    A bitmap tells words that may reach it; what it lets through besides is far below in the end.
    """
    spark, size = texts.sparkSession, _size(rows)

    def place(batches):
        for batch in batches:
            hashes = [xxhash.xxh64_intdigest(f"{a}\0{b}") for a, b in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())]
            yield pa.RecordBatch.from_pydict({"p": pa.array((np.array(hashes, np.uint64) >> np.uint64(65 - size.bit_length())).astype(np.int64))})

    marks = spark.sparkContext.broadcast(bytes(bitmap(frequent.select("lang", "word").mapInArrow(place, "p bigint"), size)))
    sent, shift = vocabulary.sent, 65 - size.bit_length()

    def run(batches):
        known: dict[str, set] = {}
        for lang, word in sent.value:
            known.setdefault(lang, set()).add(word.encode())
        held: Counter = Counter()

        def send():
            rows = list(held.items())
            held.clear()
            for i in range(0, len(rows), 10_000):
                part = rows[i : i + 10_000]
                yield pa.RecordBatch.from_pydict({"lang": [r[0][0] for r in part], "phrase": [r[0][1].decode() for r in part], "f": pa.array([r[1] for r in part], pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own, head = known.get(lang, set()), lang.encode() + b"\0"
                run_of, other = [], []

                def flush():
                    for i in range(len(run_of)):
                        for k in range(2, min(longest, len(run_of) - i) + 1):
                            if any(other[i : i + k]):
                                held[lang, b" ".join(run_of[i : i + k])] += 1
                    run_of.clear()
                    other.clear()

                for word in tokens(text):
                    if word in own:
                        run_of.append(word)
                        other.append(False)
                        continue
                    p = xxhash.xxh64_intdigest(head + word) >> shift
                    if word != _CUT and marks.value[p >> 3] >> (p & 7) & 1:
                        run_of.append(word)
                        other.append(True)
                    else:
                        flush()
                flush()
                if len(held) > 300_000:
                    yield from send()
        yield from send()

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, table: int = TABLE, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    bound_batches(docs.sparkSession)
    texts = _texts(docs, lang_col, text_col)
    counted = materialise(word_counts(texts), "collocation-words")
    sizes = materialise(counted.groupBy("lang").agg(F.sum("f").alias("n")), "collocation-sizes")
    frequent = counted.filter(F.col("f") >= least)
    rows, words = (int(x or 0) for x in frequent.agg(F.count(F.lit(1)), F.sum("f")).first())
    out = [frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")]
    vocabulary = vocabulary_of(docs.sparkSession, frequent.orderBy(F.desc("f"), "lang", "word").limit(table).collect())
    if rows:
        streams, marks = id_streams(texts, vocabulary), None
        slices = max(4, (words // SLICE).bit_length())
        for k in range(2, longest + 1):
            found = level(streams, vocabulary, k, marks, slices, least=least)
            out.append(found.select("lang", "phrase", F.lit(k).alias("size"), "f"))
            if k < longest:
                here = found.count()
                if not here:
                    break
                marks = _marks_of(found, here)
    if rows > table:
        others = materialise(other_phrases(texts, frequent, rows, vocabulary, longest).filter(F.col("f") >= least), "collocation-others")
        out.append(others.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole, sizes


def collocations(docs: DataFrame, *, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, a, phrase.

    A phrase is 2 to 5 words within a piece that occurs ``least`` times (a). Of its cuts in two
    the one of the lowest floor(1000 * a * n / (l * r)) counts, the first of equal ones. A phrase
    that lies in a longer one as frequent as itself is left out. Null languages are ``und``,
    null and empty texts have no words, repeated rows count again, other columns do not matter.
    """
    found, sizes = frequent_phrases(docs, **options)
    found = materialise(found, "collocation-phrases")
    longer = found.filter("size > 1")
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    f = lambda side: found.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_phrase"), F.col("f").alias(side))
    inside = longer.filter("size > 2").select("lang", "size", "phrase", "f", F.explode(F.expr("sequence(2, size - 1)")).alias("k"))
    inside = inside.select("lang", "phrase", "f", "k", F.explode(F.expr("sequence(1, size - k + 1)")).alias("i"))
    inside = inside.groupBy(F.col("lang").alias("in_lang"), part(F.col("i"), F.col("k")).alias("in_phrase")).agg(F.max("f").alias("most"))
    kept = longer.join(inside, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left").filter("most is null or 100 * most < 100 * f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(f("l"), (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase"))).join(f("r"), (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    cuts = cuts.join(sizes.withColumnRenamed("lang", "n_lang"), F.col("lang") == F.col("n_lang"))
    score = F.expr("(cast(a as decimal(18, 0)) * cast(n as decimal(17, 0)) * cast(1000 as decimal(4, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of a language are the best of the best of its 64 parts, so no task sorts all phrases of one.
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
