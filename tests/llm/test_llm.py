"""Operators against plain versions, planted cases, round trips and odd tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import anchors, decontaminate, gif, graph, language, licenses, maxent, mixing, neardup, quality, repeats, sketch, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def frame(spark, texts, parts=3):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "é" * 300), (7, "x " * 40000)]


def odd(spark, *, empty=False):
    """Null, blank, tied and very long texts, repeated rows, and columns whose names clash with inner ones."""
    df = frame(spark, [] if empty else [*ODD, (7, "x " * 40000)])
    for name in ("id", "raw", "score", "media", "spans", "items", "regs", "component", "n_words", "part", "y"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 8)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


# GIF


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 5000, bytes(range(256)) * 60, os.urandom(30_000), b"ab" * 40_000])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_payload_and_digest(spark):
    texts = [(i, t) for i, t in ODD]
    got = {r.doc_id: r for r in gif.report(frame(spark, texts)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature


def two_frame_gif(disposal, transparent, interlaced=False):
    """A 4 x 4 canvas: a full frame of colour 1, then a 2 x 2 frame of colours 2 and 0 in its middle."""
    head = b"GIF89a" + bytes([4, 0, 4, 0, 0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = head

    def lzw2(pixels):
        bits, width, codes = "", 3, [4, *pixels, 5]
        free = 6
        for i, c in enumerate(codes):
            bits = format(c, f"0{width}b") + bits
            if 1 < i < len(codes):
                free += 1
                if free == 1 << width and width < 12:
                    width += 1
        n = -(-len(bits) // 8)
        return int(bits, 2).to_bytes(n, "little")

    for left, top, w, h, pixels, how in ((0, 0, 4, 4, [1] * 16, disposal), (1, 1, 2, 2, [2, 0, 0, 2], 0)):
        flag = how << 2 | (transparent is not None)
        out += b"\x21\xf9\x04" + bytes([flag, 7, 0, transparent or 0, 0])
        out += b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, 0x40 if interlaced else 0]) + b"\x02"
        data = lzw2(pixels)
        out += bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


@pytest.mark.parametrize(("disposal", "under"), [(1, (255, 0, 0)), (2, (0, 0, 0)), (3, (0, 0, 0))])
def test_gif_disposal_and_transparency(disposal, under):
    first, second = gif.frames(two_frame_gif(disposal, 0), canvases=True)
    assert first["delay_ms"] == 70 and tuple(first["canvas"][0, 0]) == (255, 0, 0)
    assert tuple(second["canvas"][1, 1]) == (0, 255, 0)  # colour 2
    assert tuple(second["canvas"][1, 2]) == under  # transparent: what the first frame left
    assert sum(second["histogram"]) == 16


def test_gif_column_of_broken_files(spark):
    good = gif.encode(b"x" * 192)
    df = spark.createDataFrame([(1, good), (2, good[:-30]), (3, b"nonsense"), (4, None)], "k int, media binary")
    got = {r.k: r for r in gif.with_frames(df).collect()}
    assert bytes(got[1].frames[0].pixels) == b"x" * 192 and got[1].media_error is None
    assert got[2].media_error and got[3].media_error == "not a GIF" and got[4].frames is None


def deferred_stream(data, bits=8):
    """A plain LZW encoder that never clears its full table."""
    clear = 1 << bits
    table, free, width = {bytes([i]): i for i in range(clear)}, clear + 2, bits + 1
    text, at = [format(clear, f"0{width}b")[::-1]], b""
    for c in data:
        longer = at + bytes([c])
        if longer in table:
            at = longer
            continue
        text.append(format(table[at], f"0{width}b")[::-1])
        if free < 4096:
            table[longer] = free
            width = max(width, free.bit_length())
            free += 1
        at = bytes([c])
    text += [format(table[at], f"0{width}b")[::-1], format(clear + 1, f"0{width}b")[::-1]]
    bits_out = "".join(text)
    return bytes(int(bits_out[i : i + 8][::-1], 2) for i in range(0, len(bits_out), 8))


def gif_of(stream, width, height):
    blocks = b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255))
    head = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes([0xF7, 0, 0]) + bytes(v for i in range(256) for v in (i, i, i))
    return head + b"\x2c" + bytes(4) + head[6:10] + b"\0\x08" + blocks + b"\0\x3b"


def test_gif_with_deferred_clear_codes(spark):
    data = random.Random(5).randbytes(300 * 200)
    stream = deferred_stream(data)
    assert gif.lzw_decode(stream, 8, len(data)) == data
    media = [(1, gif_of(stream, 300, 200)), (2, gif_of(stream[: len(stream) // 2], 300, 200)), (3, gif_of(stream[:3000] + b"\xff" * 3000, 300, 200)), (4, gif_of(gif.lzw_encode(data[:600]), 300, 200))]
    got = {r.k: r for r in gif.with_frames(spark.createDataFrame(media, "k int, media binary")).collect()}
    assert bytes(got[1].frames[0].pixels) == data and got[1].media_error is None
    assert all(got[k].frames == [] and got[k].media_error for k in (2, 3, 4))


@pytest.mark.parametrize("bits", range(2, 9))
def test_gif_of_each_code_size(bits):
    """Codes of the least width, each run closed before the table asks for wider ones."""
    data = bytes(random.Random(bits).randrange(1 << bits) for _ in range(600))
    out, clear = "", 1 << bits
    for i in range(0, len(data), clear - 2):
        for code in (clear, *data[i : i + clear - 2]):
            out += f"{code:0{bits + 1}b}"[::-1]
    out += f"{clear + 1:0{bits + 1}b}"[::-1]
    stream = bytes(int(out[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(out), 8))
    assert gif.lzw_decode(stream, bits, len(data)) == data


@pytest.mark.parametrize("data", [b"a" * 20_000, b"abcab" * 5000, random.Random(3).randbytes(25_000), ("the cat and the dog " * 900).encode()])
def test_gif_equals_slow_decoder(data):
    media = gif.encode(gif.payload_of(data))
    assert [f["pixels"] for f in gif.frames(media)] == brute.gif_samples(media)
    assert [f["histogram"] for f in gif.frames(media)] == [f["histogram"] for f in gif.frames(media, canvases=True)]


def test_gif_of_huge_claims(spark):
    head = b"GIF89a" + b"\xff\xff\xff\xff" + bytes([0, 0, 0]) + b"\x3b"
    frame_ = b"GIF89a\x01\0\x01\0" + bytes([0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes(4) + b"\xff\xff\xff\xff" + b"\0\x02\x02\x44\x01\0\x3b"
    got = {r.k: r for r in gif.with_frames(spark.createDataFrame([(1, head), (2, frame_)], "k int, media binary")).collect()}
    assert "too large" in got[1].media_error and "too large" in got[2].media_error and got[1].frames == []


def test_gif_column_replaces_its_namesake(spark):
    df = spark.createDataFrame([("old", 1, "abc")], "media string, k int, text string")
    out = gif.with_media(df)
    assert out.columns == ["media", "k", "text"] and next(gif.frames(bytes(out.first().media)))["pixels"].rstrip() == b"abc"


# Language model


def test_maxent_base_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(frame(spark, [(100_000 + i, t) for i, t in ODD]))
    rows = maxent.score(docs).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in docs.collect()}
    counts = Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        w = texts[r.doc_id]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_tokens == len(w)
        assert r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == total
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def hashed(text):
    return [*sketch.word_hashes([text.encode()])[0].tolist(), maxent.END]


def token_table(spark, texts):
    raw = spark.createDataFrame([(i, True, t.encode()) for i, t in enumerate(texts)], "id long, train boolean, raw binary").repartition(3)
    return maxent.tokenised(raw)


def test_context_words_are_those_of_all_documents(spark):
    texts = [" ".join(f"w{(i + j) % 300}" for j in range(3 + i % 5)) for i in range(3000)] + ["hot " * 9000]
    words, frequent, pairs = maxent.counts(token_table(spark, texts))
    want, beside = Counter(), Counter()
    for t in texts:
        w = hashed(t)
        want.update(w)
        beside.update(zip(w, w[1:]))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert {r.word: r.n for r in words.collect()} == {signed(w): n for w, n in want.items()}
    top = sorted(want, key=lambda w: (-want[w], signed(w)))[: maxent.CONTEXT]
    assert frequent.tolist() == sorted(top)
    assert all(pairs[i, j] == beside[a, b] for i, a in enumerate(sorted(top)) for j, b in enumerate(sorted(top)))


def test_maxent_score_equals_brute_force(spark):
    """Scores token by token, and the probabilities of all words and one unknown word sum to one."""
    texts = [prose(30, i) + (" fish chips" if i % 3 else " rare%d" % i) for i in range(60)]
    model, words, tail = maxent.fit(token_table(spark, texts))
    model.prepare()
    table = {r.word % 2**64: (r.c, dict(zip(r.ks, r.logs))) for r in words.collect()}
    for text in (texts[0], texts[1], "never seen words here", ""):
        tokens = hashed(text)
        array = np.array(tokens, np.uint64)
        at, before, logp = model.log_head(array, np.array([len(tokens)]))
        for i in np.flatnonzero(at == len(model.order)):
            c, known = table.get(tokens[i], (0, {}))
            t = (tokens[i] >> 40) % maxent.TAIL
            logp[i] += known[before[i]] if before[i] in known else np.log((c + 0.5) / tail.size[t] / tail.norms[-1][t * maxent.WIDE + before[i]])
        assert logp.sum() == pytest.approx(brute.log_probability(model, table, tail, tokens), rel=1e-4)
    start = hashed(texts[0])[:4]
    unknown = [next(w for w in range(5 << 40, 1 << 63, 1 << 40) if (w >> 40) % maxent.TAIL == t) for t in range(maxent.TAIL)]
    every = [int(w) for w in model.order] + list(table) + unknown
    # The end token pads what lies before a text, so it goes last in each; the difference of two prefixes is one word's probability.
    whole = lambda w: brute.log_probability(model, table, tail, [*start, w, maxent.END]) - brute.log_probability(model, table, tail, [*start, w, maxent.END][-1:])
    assert every and np.isfinite([whole(w) for w in every[:5]]).all()
    last = np.array(start, np.uint64)
    p = 0.0
    for w in every:
        tokens = np.append(last, np.uint64(w))
        at, before, logp = model.log_head(tokens, np.array([len(tokens)]))
        x = logp[-1]
        if at[-1] == len(model.order):
            c, known = table.get(w, (0, {}))
            t = (w >> 40) % maxent.TAIL
            x += known[before[-1]] if before[-1] in known else np.log((c + 0.5) / tail.size[t] / tail.norms[-1][t * maxent.WIDE + before[-1]])
        p += np.exp(x)
    assert p == pytest.approx(1, rel=1e-3)


def test_head_is_filled_by_hash_where_counts_tie(spark):
    words = spark.range(4000).select(F.xxhash64("id").alias("word"), F.lit(2).cast("long").alias("n"))
    assert 800 < maxent.frequent_words(words, 1000).count() < 1200
    assert maxent.row_bits(10) == maxent.LEAST_BITS < maxent.row_bits(10**10) < maxent.row_bits(10**12) == maxent.row_bits(10**14) == maxent.MOST_BITS


def test_gradient_sums_in_levels(spark):
    rows = [(b, part, np.full(4, part, np.float32).tobytes(), np.full(8, part, np.float32).tobytes()) for b in (0, 256) for part in range(150)]
    got = {r.block: (np.frombuffer(r.used, np.float32), np.frombuffer(r.change, np.float32)) for r in maxent.gradient_sums(spark.createDataFrame(rows, maxent._BLOCKS), 150).collect()}
    assert got.keys() == {0, 256} and all((u == sum(range(150))).all() and (c == sum(range(150))).all() for u, c in got.values())


# Decontamination


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_decontamination_equals_brute_force(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    two = random.Random(4)
    items = [(1, prose(30, 1)), (2, prose(13, 2)), (3, "short item here"), (4, None), (5, "  "), (6, prose(40, 1)), (7, " ".join(two.choice("xy") for _ in range(300)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, prose(50, 9) + " " + items[0][1] + " " + prose(20, 8)), (2, items[1][1].upper().replace(" ", ", ")), (3, "A SHORT-item,HERE!"), (4, prose(60, 7)), (5, None), (6, ""), (7, " ".join(items[0][1].split()[5:17])), (8, items[1][1] + " " + items[1][1])]
    docs += [(9, " ".join(two.choice("xy") for _ in range(400)) + " " + items[6][1][60:200])]
    want = brute.contamination(dict(docs), dict(items))
    got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find_contamination(frame(spark, docs), bench).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {i for i, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)} and {4, 5, 6, 7} <= kept


def test_decontamination_of_repeated_ids(spark):
    bench = spark.createDataFrame([(1, prose(13, 2))], "item_id long, text string")
    docs = frame(spark, [(1, prose(13, 2)), (1, prose(40, 3)), (None, prose(13, 2)), (None, "kept")])
    assert sorted(r.text for r in decontaminate.decontaminate(docs, bench).collect()) == sorted([prose(40, 3), "kept"])


# Classifiers


@pytest.mark.parametrize(("name", "report"), [("quality", quality.report), ("toxic", toxicity.report)])
def test_classifiers_on_held_out_rows(spark, name, report):
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = report(docs, known).join(known, "doc_id").filter("held_out").toPandas()
    assert (rows["predicted"] == rows[name]).mean() > 0.97
    assert rows["score"].between(0, 1).all()
    ranks, y = rows["score"].rank(), rows[name] == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (~y).sum()
    assert auc > 0.95


def test_discriminant_prefers_the_nearer_class():
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(0, 1, (300, 3)), r.normal(3, 0.5, (200, 3))])
    model = quality.Discriminant(x, np.repeat([0, 1], [300, 200]))
    p = model.score(np.array([[0.0, 0, 0], [3, 3, 3], [-30, -30, -30]]))
    assert p[0] < 0.1 and p[1] > 0.9 and p[2] < 0.1


def test_language_fuses_evidence(spark):
    docs = spark.createDataFrame([(i, ("the cat sat on the mat and the dog " if i % 2 else "der hund und die katze sind nicht im haus ") * 20, "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    page = lambda i, host, lang, body: (i, f"https://{host}/p/{i}", f"<html lang='{lang}'><script>der die das</script><p>{body}</p></html>")
    rows = [page(i, "a.example.de", "de", "der hund und die katze") for i in range(10)] + [page(20 + i, "b.example.com", "en", "the cat and the dog") for i in range(10)]
    rows += [(40, "https://a.example.de/x", "<html lang='de'></html>"), (41, "https://b.example.com/x", ""), (42, None, None), (43, "nonsense", "<p>the dog sat on the mat</p>")]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == 24 and all(got[i].lang == "de" for i in range(10)) and all(got[20 + i].lang == "en" for i in range(10))
    assert got[40].lang == "de" and got[41].lang == "en" and got[43].lang == "en" and got[42].lang in ("de", "en")
    none = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs.limit(0))
    assert none.filter("lang is null").count() == 24


def test_licences_by_family(spark):
    texts = [(1, "text\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-SA 4.0."), (3, "He lost his licence in the rain."), (4, "plain text"), (5, None), (6, "a\n\nThis work is licensed under the GNU General Public License, version 3."), (7, "The license plate of the red car")]
    texts += [(100 + i, prose(40, i)) for i in range(60)]
    got = {r.doc_id: (r.n_candidates, r.families) for r in licenses.report(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i][1] for i in range(1, 8)] == ["mit", "cc-by-sa", "", "", "", "gpl-3.0", ""] and got[4][0] == 0


# Mixing


def test_mixing_meets_its_rates(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    mixed = mixing.mix(df, weights={"a": 3.0, "b": 1.0})
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["a"] == pytest.approx(22_500, rel=0.03) and got["b"] == pytest.approx(7_500, rel=0.05) and None not in got
    spread = mixed.filter("source = 'a'").groupBy("doc_id").agg(F.max("mix_copies").alias("k"), F.count(F.lit(1)).alias("n"))
    assert spread.filter("k <> n").count() == 0
    assert mixing.mix(df).select("mix_key").distinct().count() == mixing.mix(df).count()


def test_poisson_of_a_large_rate(spark):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(900.0)).alias("c")).first().c
    assert cdf[-1] == pytest.approx(1.0, abs=1e-9) and cdf[899] == pytest.approx(0.5, abs=0.02)


def test_mixing_of_a_rare_source(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, "rare").otherwise("common").alias("source"))
    mixed = mixing.mix(df, weights={"rare": 1.0, "common": 1.0})
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["rare"] == pytest.approx(10_000, rel=0.05) and got["common"] == pytest.approx(10_000, rel=0.05)


def test_mixing_of_large_rates_equals_sql(spark):
    import duckdb
    from quarry.llm.sql import OP8

    n = 600_000
    con = duckdb.connect()
    con.execute(f"create table documents as select range as doc_id, case when range < 6 then concat('rare', range) else 'common' end as source from range({n})")
    columns = "doc_id, source, rate, copies, copy, shuffle_key"
    want = con.execute(f"select {columns} from ({OP8}) where source <> 'common' order by doc_id, copy").fetchall()
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6, F.concat(F.lit("rare"), "id")).otherwise("common").alias("source"))
    got = mixing.report(df).filter("source <> 'common'").orderBy("doc_id", "copy").select(*columns.split(", ")).collect()
    assert min(r.rate for r in got) > 500 and [tuple(r) for r in got] == want


@pytest.mark.parametrize("rate", [0.3, 144.0, 380.0, 900.0, 40_000.0])
def test_poisson_table_may_start_late(spark, rate):
    r = F.lit(rate)
    row = spark.range(1).select(mixing.poisson_start(r).alias("first"), mixing.poisson_cdf(r, mixing.poisson_start(r)).alias("cdf")).first()
    total = 0.0
    for k in range(len(row.cdf)):
        at = row.first + k
        total += math.exp(at * math.log(rate) - rate - math.lgamma(at + 1))
        assert row.cdf[k] == pytest.approx(total, rel=1e-7, abs=1e-12)
    assert row.cdf[-1] == pytest.approx(1.0, abs=1e-9) and len(row.cdf) < 30 * rate**0.5 + 400


# Repeats


def repeat_cases():
    a, b = prose(60, 1), prose(40, 2)
    texts = [(5, a), (3, b + " tail " + a[50:250]), (9, a), (2, "é" + a[:160]), (7, "ab" * 300), (8, "short"), (11, None), (12, ""), (13, prose(5, 3) + b[:130]), (14, "x" * 99), (15, "x" * 99)]
    passage = prose(20, 4)[:150]
    return texts + [(100 + i, f"{prose(6, 50 + i)} {passage} {prose(6, 90 + i)}") for i in range(40)]


@pytest.mark.parametrize(("blocks", "hot", "runs"), [(64, 2048, 10**6), (2, 3, 50)])
def test_repeats_equal_brute_force(spark, blocks, hot, runs):
    limits = repeats.Limits(local_blocks=blocks, hot_blocks=hot, local_runs=runs, meet=40)
    texts = repeat_cases()
    want = brute.repeats({i: (t or "").encode() for i, t in texts})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(frame(spark, texts, 4), limits=limits).collect()}
    assert got == want


def test_previous_factors_by_definition():
    r = np.random.default_rng(3)
    text = r.integers(0, 2, 300).astype(np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(text, anchors.SPAN)
    rows = np.ascontiguousarray(np.vstack([rows, rows[:20]]))
    order = np.argsort(rows.view(f"S{anchors.SPAN}").ravel(), kind="stable")
    place = r.permutation(len(rows))
    got = anchors.previous_factors(rows[order], place[order])
    for k, i in enumerate(order):
        same = [int(np.argmin(np.append(rows[i] == rows[j], False))) for j in range(len(rows)) if place[j] < place[i]]
        assert got[k] == max(same, default=0)


def test_removing_repeats_keeps_columns_and_characters(spark):
    base = prose(40, 1).replace("a", "ü")
    out = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, [(1, base), (2, "new " + base + " tail"), (3, None)])).collect()}
    assert out[1].text == base and out[3].text is None
    assert out[2].text == "new  tail" or out[2].text == "new tail" and out[2].n_chars == len(out[2].text)


# Near-duplicates


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    texts = [(i, t) for i, t in ODD[:6]]
    for g in range(12):
        base = prose(60, 200 + g).split()
        for c in range(12):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = "edit" + str(r.randint(0, 10**6))
            texts.append((1000 * (g + 1) + c, " ".join(words)))
    for k in (4, 5):
        want = brute.near(dict(texts), k)
        got = {row.doc_id: (row.n_shingles, row.component_id) for row in neardup.near_duplicates(frame(spark, texts + texts[-1:]), k=k).collect()}
        assert got == want


def test_word_hashes_tell_words_apart(monkeypatch):
    texts = [b"The cat\tSAT", b"", b"  ", "the cat sat \u00e9\u00c9 x" .encode(), b"a b ab aa b a " * 50, bytes(range(256))]
    for piece in (sketch.PIECE, 4):
        monkeypatch.setattr(sketch, "PIECE", piece)
        hashes, sizes = sketch.word_hashes(texts)
        words = [w for t in texts for w in t.lower().split()]
        assert sizes.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
        assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(hashes.tolist(), words)))


def test_sketch_merges_and_estimates():
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3200], r.integers(0, 2**63, 800, dtype=np.uint64)])
    x, y = sketch.registers(a), sketch.registers(b)
    assert (sketch.merge(x, y) == sketch.registers(np.union1d(a, b))).all()
    got = sketch.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), 4000.0, 4000.0)[0]
    assert got == pytest.approx(3200 / 4800, abs=0.2)


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (101, 101)], "a long, b long"))
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


# Odd tables


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    docs, bench = odd(spark, empty=empty), spark.createDataFrame([(1, None), (2, "x x x")], "item_id long, text string")
    ids = [] if empty else [1, 2, 3, 4, 5, 6, 7, 7]
    by_id = lambda df, c: sorted((r.doc_id, r[c]) for r in df.collect())
    raw = {i: (t or "").encode() for i, t in ODD}
    assert by_id(gif.report(docs), "n_bytes") == [(i, len(raw[i])) for i in ids]
    assert by_id(maxent.score(docs), "n_tokens") == [(i, len(raw[i].split()) + 1) for i in ids]
    assert by_id(decontaminate.report(docs, bench), "n_hit") == [(i, 40_000 if i == 7 else 0) for i in ids]
    for report in (quality.report, toxicity.report):
        assert by_id(report(docs, labels(spark)), "held_out") == [(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in ids]
    assert by_id(licenses.report(docs), "n_candidates") == [(i, 0) for i in ids]
    cut = 0 if empty else repeats.report(docs).filter("n_removed > 0").select("doc_id").distinct().count()
    assert by_id(repeats.report(docs), "n_bytes") == [(i, len(raw[i])) for i in ids] and cut == (0 if empty else 2)
    assert by_id(neardup.report(docs), "component_id") == ([] if empty else [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7)])
    assert {r.doc_id for r in mixing.mix(docs).collect()} <= set(ids)
    for out in (quality.keep_good(docs, labels(spark)), decontaminate.decontaminate(docs, bench), repeats.remove_repeats(docs), neardup.deduplicate(docs)):
        assert out.columns == docs.columns and out.count() <= len(ids)


def test_inner_names_do_not_clash(spark):
    """Columns that have the operators' inner names come through with their values."""
    docs = frame(spark, [(1, prose(40, 1)), (2, prose(40, 2))])
    names = ["rate", "cdf", "first", "n", "mix_source", "gone_id", "gone_text", "repeat_id", "repeat_spans", "quality_score", "row", "h", "places"]
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([(1, "nothing here")], "item_id long, text string")
    for out in (mixing.mix(docs), decontaminate.decontaminate(docs, bench), repeats.remove_repeats(docs), neardup.deduplicate(docs), quality.keep_good(docs, labels(spark))):
        assert set(docs.columns) <= set(out.columns) and all(r[name] == "clash" for r in out.collect() for name in names)


def test_language_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "https://a.b/c", "<p>" + "der hund " * 50_000 + "</p>"), (3, "", "")], "page_id long, url string, html string")
    for name in ("id", "host", "declared", "raw", "lang", "prior", "salt"):
        pages = pages.withColumn(name, F.lit("clash"))
    rows = language.identify(pages, docs).collect()
    assert sorted(r.page_id for r in rows) == [1, 1, 2, 3] and {r.page_id: r.lang for r in rows}[2] == "de"
    assert language.identify(pages.limit(0), docs).count() == 0
    many = docs.filter("lang is not null").unionByName(spark.createDataFrame([(i, "le chat", "fr") for i in range(3)] + [(9, "il gatto", "it")], docs.schema))
    langs, logs = language.text_model(many, most_langs=3)
    assert langs == ["en", "fr", language.OTHERS] or langs == sorted(["de", "fr", language.OTHERS])
    whole = language.text_model(many.withColumn("lang", F.when(F.col("lang") == langs[0], langs[0]).when(F.col("lang") == "fr", "fr").otherwise(language.OTHERS)))
    assert whole[0] == langs and (whole[1] == logs).all()
    assert {r.lang for r in language.identify(pages, many, most_langs=3).collect()} <= set(langs)


def test_own_gifs_have_no_bound(monkeypatch):
    """A text whose frames pass the bound for foreign files is still read back whole."""
    import pyarrow as pa

    text = b"abc " * 5000
    monkeypatch.setattr(gif, "MOST_PIXELS", 1000)
    media = gif.encode(text + b" " * (-len(text) % 192))
    with pytest.raises(ValueError, match="too large"):
        list(gif.frames(media))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "n_bytes": [len(text)], "media": [media]})
    (out,) = gif._digest(iter([batch]))
    payload = text + b" " * (-len(text) % 192)
    assert out.to_pylist()[0]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and out.to_pylist()[0]["payload_bytes"] == len(payload)


def test_rows_without_an_id_are_not_held_out(spark):
    docs = spark.createDataFrame([(None, "a text of some words"), (1, "another")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for report in (quality.report, toxicity.report):
        assert {r.doc_id: r.held_out for r in report(docs, none).collect()}[None] is False
