"""Masking, tags, signatures and overlaps against plain loops."""

import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import joins, quality


def masked(spark, values, terms, skip):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r["m"] for r in df.select("i", quality.mask_json(F.col("s"), terms, skip).alias("m")).orderBy("i").collect()]


def test_json_is_masked_at_any_depth(spark):
    deep = {"a": ["Foo", {"b": {"c": [["foo", 1, 2.5, True, None]], "keep": {"d": ["foo"]}}}], "keep": "foo", "n": 10**30, "设备": "设备x"}
    want = {"a": ["[F]", {"b": {"c": [["[F]", 1, 2.5, True, None]], "keep": {"d": ["foo"]}}}], "keep": "foo", "n": 10**30, "设备": "[D]x"}
    cases = [json.dumps(deep), "foo", "{foo", None, "", " [\"foo\\n\"]", "3", "{}", "[" * 5000, '{"x":"foobar FOO"}', '"foo"']
    got = masked(spark, cases, {"foo": "[F]", "设备": "[D]", "foobar": "[FB]"}, ["keep"])
    assert json.loads(got[0]) == want and "设备" in got[0]
    assert got[1:5] == ["foo", "{foo", None, ""] and got[5] == '["[F]\\n"]' and got[6:9] == ["3", "{}", "[" * 5000]
    assert got[9] == '{"x": "[FB] [F]"}' and got[10] == '"foo"'


def test_signatures_equal_a_plain_loop(spark):
    r = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    refs = [(i, r.getrandbits(64), math.exp(r.uniform(-1, 1))) for i in range(60)] + [(99, 0, 1.0), (98, 0, 1.0)]
    images = []
    for i in range(400):
        _, s, a = r.choice(refs)
        for b in r.sample(range(64), r.randint(0, 9)):
            s ^= 1 << b
        images.append((i, s, a * math.exp(r.uniform(-0.4, 0.4))))
    images += [(1000, None, 1.0), (1001, 0, 0.0), (1002, 0, None), (1003, 0, 1.0), (1004, 0, 1.0)]
    want = {}
    for i, s, a in images:
        near = [((s ^ t).bit_count(), j) for j, t, b in refs if s is not None and a and abs(math.log(a / b)) <= 0.3 and (s ^ t).bit_count() <= 6]
        if near:
            want[i] = min(near)
    left = spark.createDataFrame([(i, None if s is None else signed(s), a) for i, s, a in images], "image_id int, signature bigint, aspect double")
    right = spark.createDataFrame([(j, signed(t), b) for j, t, b in refs], "ref_id int, ref_signature bigint, ref_aspect double")
    got = {x.image_id: (x.distance, x.ref_id) for x in quality.match_signatures(left, right).collect()}
    assert got == want and len(want) > 100


def test_tags_equal_a_plain_loop(spark):
    names = ["AX-200", "AX-2000", "200+", "brand", "brand 7", "设备", "设备 图", "C++", "a.b", "x-AX-200", "(q)", ""]
    files = ["ax-200 report.pdf", "d/AX-2000.v2.txt", "c:\\AX-200\\brand 7 brand", "200+1", "x200+.doc", "设备图.png", "设备 图", "c++", "c+++", "a.b.c", "( 2000 - TS相关-NCMR 报告) z", "(zz-TS相关-NCMR报告)", "(q)", ".hidden", None]
    tags = spark.createDataFrame([(i, n, [f"alias {i}"]) for i, n in enumerate(names)], "tag_id int, name string, more array<string>")
    df = spark.createDataFrame(list(enumerate(files)), "file_id int, file_name string")

    def plain(name):
        stem = re.sub(r"(?s)(.)\.[^.]*\Z", r"\1", (name or "").replace("\\", "/").rsplit("/", 1)[-1])
        alone = lambda a: re.search(rf"(?<![A-Z0-9+]){re.escape(a)}(?![A-Z0-9+])", stem, re.I)
        own = [[a for a in (n, f"alias {i}") if a] for i, n in enumerate(names)]
        found = [i for i, aliases in enumerate(own) if any(map(alone, aliases))]
        model = re.search(r"^\(\s*([^()]+?)\s*-\s*TS相关\s*-\s*NCMR\s*报告", stem, re.I)
        return found or [i for i, aliases in enumerate(own) if model and model[1].lower() in {a.rsplit("-", 1)[-1].lower() for a in aliases}]

    got = {r.file_id: r.tag_ids for r in quality.assign_tags(df, tags, aliases="more").collect()}
    assert got == {i: plain(n) for i, n in enumerate(files) if plain(n)}


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_overlaps_equal_a_plain_loop(spark, kind):
    r = random.Random(8)
    day = datetime.date(2024, 1, 1) if kind == "date" else datetime.datetime(2024, 1, 1)
    step = datetime.timedelta(days=1) if kind == "date" else datetime.timedelta(hours=7)
    moment = lambda: r.choice([None, *[day + step * r.randint(0, 40) for _ in range(5)]])
    rows = [(i, r.choice([1, 1, 1, 2, None]), r.choice([None, 1, 2]), r.choice([None, "x", "y"]), moment(), moment()) for i in range(150)]
    df = spark.createDataFrame(rows, f"version_id int, doc int, model int, site string, effective_from {kind}, effective_to {kind}")

    def meet(a, b):
        return not (a[5] and b[4] and a[5] <= b[4]) and not (b[5] and a[4] and b[5] <= a[4])

    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and meet(a, b)]
    same = {(a[0], b[0]) for a, b in pairs if a[1:3] == b[1:3]}
    loose = {(a[0], b[0]) for a, b in pairs if a[1] is not None and a[1] == b[1] and all(x is None or y is None or x == y for x, y in zip(a[2:4], b[2:4]))}
    got = joins.validity_conflicts(df, ["doc", "model"]).collect()
    assert {tuple(x) for x in got} == same and len(got) == len(same)
    got = joins.scope_overlaps(df, "doc", ["model", "site"]).collect()
    assert {tuple(x) for x in got} == loose and len(got) == len(loose)
