"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of
the input. A document's number of copies is the inverse of the Poisson distribution at a
uniform number that a hash of its id and a seed gives, so a rerun or a lost executor
gives the same copies. The copies are then dealt over all partitions by another hash.
All of it is DataFrame work: rates are one small grouped aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused_names

SEED, POWER, BROADCAST_SOURCES = "mix-1", 0.5, 10_000
#: From here on Stirling's series is exact to a double, and a table may start there.
LEAST_START = 100


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def poisson_start(rate: Column) -> Column:
    """Where a table of the distribution may start: the mass below is under exp(-72), far less than a step of ``uniform``."""
    low = F.floor(rate - 12 * F.sqrt(rate)).cast("long")
    return F.when(low >= LEAST_START, low).otherwise(F.lit(0).cast("long"))


def poisson_cdf(rate: Column, first: Column | None = None) -> Column:
    """The distribution function at ``first`` (0), first + 1, ... until nothing that a double can show is left."""
    first = F.lit(0).cast("long") if first is None else first
    top = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("long")
    x = F.greatest(first, F.lit(1)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    log_first = F.when(first == 0, -rate).otherwise(x - rate + x * F.ln(rate / x) - F.ln(2 * math.pi * x) / 2 - series)
    start = F.struct(log_first.alias("lp"), F.array(F.exp(log_first)).alias("cdf"))

    def step(acc, k):
        lp = acc["lp"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(lp.alias("lp"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(lp))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(first + 1, top), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, *, source_col: str = "source", power: float = POWER, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """Per source: n, rate, and the Poisson distribution at that rate from ``first`` copies on.

    The target weight is ``weights[source]`` (0 where missing), or else the source's count
    to ``power``. ``size`` is the output's size as a multiple of the input's.
    """
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(given[F.col("mix_source")], F.lit(0.0)).cast("double")
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_n") * size / F.col("n")).otherwise(0.0)
    rates = counts.crossJoin(F.broadcast(total)).withColumn("rate", rate).withColumn("first", poisson_start(F.col("rate")))
    return rates.select("mix_source", "n", "rate", "first", poisson_cdf(F.col("rate"), F.col("first")).alias("cdf"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, power: float = POWER, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """``docs`` with each row repeated, plus mix_rate, mix_copies, mix_copy (from 1) and mix_key.

    Rows come out in the order of a global shuffle: dealt to partitions by hash and sorted
    by ``mix_key`` inside. A null source is a source of its own; equal ids get equal
    counts, a null id is the id "null"; an empty table stays empty. Columns of ``docs`` that
    have the names of the four new ones are replaced; any other name may occur.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_rate", "mix_copies", "mix_copy", "mix_key")])
    source, first, cdf, u = unused_names(docs, "mix_source", "mix_first", "mix_cdf", "mix_u")
    rates = source_rates(docs, source_col=source_col, power=power, weights=weights, size=size)
    rates = rates.select(F.col("mix_source").alias(source), F.col("rate").alias("mix_rate"), F.col("first").alias(first), F.col("cdf").alias(cdf))
    if rates.select(source).limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    copies = F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    one = F.lit(1).cast("long")
    dealt = (
        docs.join(rates, F.col(source_col).eqNullSafe(F.col(source)), "inner")
        .withColumn(u, uniform(F.lit(seed), F.col(id_col)))
        .withColumn("mix_copies", copies.cast("long"))
        .withColumn("mix_copy", F.explode(F.sequence(one, F.greatest("mix_copies", one))))
        .filter("mix_copy <= mix_copies")  # a filter on mix_copies alone is pushed through the lambda into a join without the id
        .withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(id_col).cast("string"), F.col("mix_copy").cast("string")).cast("binary")))
    )
    return dealt.select(*docs.columns, "mix_rate", "mix_copies", "mix_copy", "mix_key").repartition(F.col("mix_key")).sortWithinPartitions("mix_key", "mix_copy")


def report(docs: DataFrame) -> DataFrame:
    """Every copy of every document: its source's rate, its count and its place in the shuffle.

    Odd rows are those of ``mix``: null sources count as one, repeated rows each get their
    copies, texts do not matter.
    """
    mixed = mix(docs.select("doc_id", "source"))
    return mixed.select("doc_id", "source", F.round("mix_rate", 9).alias("rate"), F.col("mix_copies").alias("copies"), F.col("mix_copy").alias("copy"), F.col("mix_key").alias("shuffle_key"))
