"""Licence scans: a trained paragraph classifier over sparse word n-grams, all of it on the JVM.

A paragraph is a line. Paragraphs that share a telling word pair (not of two function words)
with a template are scored by a multinomial logistic regression over unigrams and bigrams;
a believed family must share enough such pairs with one of its templates, so a paragraph
without any is unknown whatever its score, and is not scored. The least probability at which a family is believed is what the
scanned corpus's own near misses (scored paragraphs that no template confirms) seldom
reach. Training rows are variants of the templates, a few near misses, and a bounded
sample of the corpus's plain paragraphs. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, materialise

#: Documents that give plain paragraphs for training, quantile of near misses' scores that is still unknown, least share of bigrams.
PLAIN_DOCS, QUANTILE, LEAST_BELIEF, LEAST_SHARED, MOST_BAR = 400, 0.999, 0.5, 0.6, 0.95
UNKNOWN = "unknown"

#: Notices by family, as they are commonly written.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    ],
}
#: Paragraphs that speak of licences and name no family.
NEAR_MISSES = [
    "He lost his driving license on the way home.",
    "The license plate of the car was covered in mud.",
    "Copyright 2021 by the authors. All rights reserved.",
    "A warranty of two years covers all parts of the pump.",
    "The restaurant waits for its liquor licence.",
    "License fees are due at the end of each month.",
    "Please ask the publisher about licensing and permissions.",
    "The redistribution of wealth was debated in parliament.",
    "The talk was about the history of copyright law.",
    "You need a fishing licence to fish in this lake.",
    "All photographs are copyright of their owners.",
    "The version of the public license office was published in general terms.",
]
#: Function words, of which two make no telling pair.
FUNCTION = "a an and any are as at be by can for from in is it may not of on or that the this to you with".split()
_BEFORE = ["", "Copyright 2020 the authors. ", "Note: ", "Code and data: ", "This file is part of the project. ", "(c) 2019 Example Ltd. "]
_AFTER = ["", " See the file LICENSE for details.", " All rights reserved.", " No warranty is given.", " and more text follows here in the same paragraph"]


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits, dots and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.slice(pairs, F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<string>"))


def telling(pairs: Column) -> Column:
    """Word pairs that are not of two function words."""
    common = lambda p, i: F.split(p, " ")[i].isin(FUNCTION)
    return F.filter(pairs, lambda p: ~(common(p, 0) & common(p, 1)))


def _pattern(pairs: list[str]) -> str:
    """What a text in small letters holds if two neighbouring tokens of it are one of the pairs."""
    quoted = lambda word: "\\Q" + word + "\\E"
    after: dict[str, list[str]] = {}
    for pair in pairs:
        first, second = pair.split(" ")
        after.setdefault(first, []).append(quoted(second))
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(quoted(first) + r"[^\p{L}\p{N}]+(?:" + "|".join(rest) + ")" for first, rest in after.items()) + ")"


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals."""
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.inline(structs))


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "paragraph"))


class Scanner:
    """A fitted classifier with its templates."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        self.families = [*TEMPLATES, UNKNOWN]
        templates = _rows(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], ["family", "template"])
        grams = F.array_distinct(telling(bigrams(tokens(F.col("template")))))
        self.templates = templates.select("family", grams.alias("grams_of")).groupBy("family").agg(F.collect_list("grams_of").alias("family_templates"))
        self.pairs = sorted(r[0] for r in templates.select(F.explode(grams)).distinct().collect())  # of the templates above: a fixed set
        around = _rows(spark, [(b, a) for b in _BEFORE for a in _AFTER], ["before", "after"])
        known = templates.crossJoin(F.broadcast(around)).select("family", F.concat("before", "template", "after").alias("paragraph"))
        misses = _rows(spark, [(UNKNOWN, b + m) for m in NEAR_MISSES for b in _BEFORE[:3]], ["family", "paragraph"])
        sample = hash_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", PLAIN_DOCS)
        plain = self._grams(_paragraphs(sample, "id", "text").filter(F.length("paragraph") > 0)).filter(~self._near("pairs")).select(F.lit(UNKNOWN).alias("family"), "paragraph")
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double") - 1
        train = materialise(self._grams(known.unionByName(misses).unionByName(plain).withColumn("label", label)), "licence-train")
        self.counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(train.filter(F.col("family") != UNKNOWN))
        self.model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False).fit(self.counts.transform(train))

    @staticmethod
    def _grams(df: DataFrame) -> DataFrame:
        words = tokens(F.col("paragraph"))
        return df.withColumn("words", words).withColumn("pairs", bigrams(F.col("words"))).withColumn("grams", F.concat("words", "pairs"))

    def _near(self, pairs: str) -> Column:
        """Whether some word pair is a telling one of a template."""
        return F.arrays_overlap(pairs, F.array(*[F.lit(x) for x in self.pairs]))

    def _may_be_near(self, text: str) -> Column:
        """True wherever ``_near`` is, and seldom elsewhere: it needs no tokens."""
        return F.lower(text).rlike(_pattern(self.pairs))

    def _predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.counts.transform(df)).withColumn("p", vector_to_array("probability"))
        guess = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.col("prediction").cast("int") + 1)
        return scored.withColumn("family_guess", guess).withColumn("probability_of", F.array_max("p"))

    def paragraphs(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per paragraph that shares a telling word pair with a template: id, line (from 0), paragraph, family, probability, shared.

        ``family`` is unknown where belief is under the bar, which the paragraphs that no
        template confirms set for all documents at once, or where no template confirms it.
        """
        lines = _paragraphs(docs.filter(self._may_be_near(text_col)), id_col, text_col).filter(self._may_be_near("paragraph"))
        near = self._grams(lines).filter(self._near("pairs"))
        scored = self._predict(near).join(F.broadcast(self.templates), F.col("family_guess") == F.col("family"), "left")
        own = F.array_distinct(telling(F.col("pairs")))
        share = F.transform("family_templates", lambda t: F.size(F.array_intersect(t, own)) / F.greatest(F.least(F.size(t), F.size(own)), F.lit(1)))
        rows = scored.select("id", "line", "paragraph", "family_guess", "probability_of", F.coalesce(F.array_max(share), F.lit(0.0)).alias("shared"))
        rows = materialise(rows, "licence-scan")
        believed = F.col("family_guess") != UNKNOWN
        bar = rows.filter(believed & (F.col("shared") < LEAST_SHARED)).agg(F.percentile_approx("probability_of", QUANTILE)).first()[0]
        sure = believed & (F.col("shared") >= LEAST_SHARED) & (F.col("probability_of") >= max(LEAST_BELIEF, min(bar or 0.0, MOST_BAR)))
        return rows.select("id", "line", "paragraph", F.when(sure, F.col("family_guess")).otherwise(UNKNOWN).alias("family"), F.col("probability_of").alias("probability"), "shared")


def report(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_candidates, n_confirmed, families (sorted, comma-joined) and the line of the first.

    Null and empty texts have no candidates; repeated rows of an id get the sum over them;
    other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = Scanner(docs).paragraphs(docs)
    known = F.col("family") != UNKNOWN
    per = found.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(known.cast("long")).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("families"),
        F.min(F.when(known, F.col("line"))).alias("first_line"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(per, F.col("doc_id") == F.col("id"), "left").select("doc_id", zero("n_candidates"), zero("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), "first_line")
