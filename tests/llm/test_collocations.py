"""Collocation mining and its filters against plain counting."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import collocations, quotient

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, least, top=2000):
    """Rows of (lang, text) -> set of (lang, rank, phrase, a, l, r, n, score), by dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in f.items():
        found = {p: c for p, c in own.items() if c >= least and len(p) > 1}
        gone = {p[i : i + k] for p, c in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= 100 * own[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def mined(df, **options):
    rows = [tuple(r) for r in collocations.collocations(df, **options).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("least,table", [(100, 1 << 19), (20, 1 << 19), (20, 30)])
def test_whole_table(spark, least, table):
    """With a small table of ids the other words' phrases are counted as text: the same result."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r["lang"], r["text"]) for r in df.collect()], least)
    assert len(want) > 20 and mined(df, least=least, table=table) == want


def test_odd_texts(spark):
    rows = [(None, "a b c. a b c\td"), ("und", "A B C"), ("en", None), ("en", ""), ("", " x  y\x0bx y!x y"), ("fr", "ü \x00 ü \x00\nü \x00"), (None, "a b c. a b c\td"), ("en", "one"), ("z", "w " * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as n")
    for least in (1, 2, 3):
        assert mined(df, least=least) == plain(rows, least)
    assert mined(df, least=1, top=3) == plain(rows, 1, 3)


def test_no_rows(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert mined(df) == set()
    assert mined(spark.createDataFrame([("en", "a b c")], "lang string, text string")) == set()


def test_small_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_size", lambda rows: 1 << 12)
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert mined(df, least=10) == plain([(r["lang"], r["text"]) for r in df.collect()], 10)


@pytest.mark.parametrize("k", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 3, 12, 17, 21])
def test_filters_are_lossless(k, bits):
    r = np.random.default_rng(k * bits)
    for n in (0, 1, 3000):
        ids = [np.r_[c, c[: n // 6], np.repeat(c[:1], 400)] for c in (r.integers(0, 1 << bits, n) for _ in range(k))]
        packed = quotient.pack(ids, bits)
        assert (quotient.unpack(*packed, k, bits) == np.stack(ids, 1)).all()
        mixed = quotient.permute(*packed, k, bits)
        assert all((a == b).all() for a, b in zip(quotient.restore(*mixed, k, bits), packed))
        counted = quotient.count(*mixed, None, k, bits)
        assert sorted(counted[2].tolist()) == sorted(Counter(map(tuple, np.stack(ids, 1).tolist())).values())
        top = min(2, quotient.halves(k, bits)[0])
        part = counted[0] >> np.uint64(quotient.halves(k, bits)[0] - top)
        slices = [[x[part == s] for x in counted] for s in range(1 << top)]
        back = [quotient.decode(quotient.encode(*s, k, bits, top), k, bits, i) for i, s in enumerate(slices)]
        assert all((a == b).all() for s, t in zip(slices, back) for a, b in zip(s, t))
        merged = quotient.merge([*back, counted], k, bits)
        assert (merged[0] == counted[0]).all() and (merged[1] == counted[1]).all() and (merged[2] == 2 * counted[2]).all()


def test_filters_are_compact():
    r = np.random.default_rng(0)
    ids = [r.integers(0, 1 << 17, 1 << 16) for _ in range(3)]
    counted = quotient.count(*quotient.permute(*quotient.pack(ids, 17), 3, 17), None, 3, 17)
    assert len(quotient.encode(*counted, 3, 17)) < 8 * len(counted[0])  # of 51 bits and a counter each
