"""Language of pages by Bayesian evidence fusion.

The posterior of a page's language is proportional to the likelihood of its text (byte
trigrams counted over all documents by their language), that of the language its markup
declares, and a prior of its host. The prior is smoothed along the address: host towards
domain, domain towards suffix, suffix towards all pages. Priors and the reliability of
declarations are grouped sums of the text posteriors; a page's own share is taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, slices, text_bytes

BINS, EFFECTIVE, SMOOTH, PRIOR, FLOOR, BROADCAST_HOSTS, MOST_LANGS, SALTS = 1 << 14, 60.0, 0.5, 8.0, 1e-4, 100_000, 500, 16
OTHERS = "other languages"
_ODD = np.uint32(0x9E3779B1)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed byte trigrams of the letters; runs of anything else are one blank."""
    x = np.frombuffer(b" " + b" ".join(raw.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64)
    x = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * _ODD
    return (x >> np.uint32(18)).astype(np.int64)


def _count(batches):
    """Trigram counts of this task's documents by language."""
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw").to_pylist()):
            counts = held.setdefault(lang, np.zeros(BINS, np.int64))
            counts += np.bincount(trigrams(raw), minlength=BINS)
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bin": pa.array(at), "n": pa.array(counts[at])})


def text_model(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from all documents that name a language.

    Each label is a language of its own. Past ``most_langs`` labels those with the fewest
    documents (ties: the last in order) are one language, ``OTHERS``, with all their texts.
    """
    bound_batches(docs.sparkSession)
    raw = docs.select(F.lower(F.trim(F.col(lang_col))).alias("lang"), text_bytes(text_col).alias("raw")).filter("lang <> ''")
    rows = raw.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs + 1).collect()
    if len(rows) > most_langs:
        own = [r["lang"] for r in rows[: most_langs - 1]]
        raw = raw.withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(OTHERS))
    rows = raw.mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.full((len(langs), BINS), SMOOTH)
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["bin"].to_numpy(int)] += rows["n"].to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[#\w]+;", " ")


def declared(html: Column) -> Column:
    """The two- or three-letter code of the root element's lang attribute, empty if there is none."""
    return F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-zA-Z]{2,3})\b""", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _posterior(model):
    def run(batches):
        logs = model.value
        for batch in slices(batches):
            rows = []
            for raw in batch.column("raw").to_pylist():
                x = trigrams(raw)
                z = logs[:, x].sum(1) if len(x) else np.zeros(len(logs))
                # Neighbouring trigrams are not independent: a text counts as so many at most.
                z *= min(1.0, EFFECTIVE / max(1, len(x)))
                p = np.exp(z - z.max())
                rows.append(p / p.sum())
            names = [c for c in batch.schema.names if c != "raw"]
            columns = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(columns | {"text_p": pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))})

    return run


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", most_langs: int = MOST_LANGS) -> DataFrame:
    """One row per page row: id, lang, probability, text_lang, text_probability, declared, host.

    A null or wordless page has a uniform text likelihood and goes by declaration and host; a
    null or odd address has the empty host. Ties go to the first language in order. Without
    labelled documents there are no languages and the result's lang is null. Repeated rows
    each get their row and weigh on their host; other columns are ignored. Labels past
    ``most_langs`` are one language (``text_model``).
    """
    spark = pages.sparkSession
    langs, logs = text_model(docs, text_col=text_col, lang_col=lang_col, most_langs=most_langs)
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), declared(html).alias("declared"), text_bytes(visible_text(html)).alias("raw"))
    if not langs:
        null = F.lit(None)
        return base.select(F.col("id").alias(id_col), null.cast("string").alias("lang"), null.cast("double").alias("probability"), null.cast("string").alias("text_lang"), null.cast("double").alias("text_probability"), "declared", "host")
    schema = base.drop("raw").withColumn("text_p", F.array().cast("array<double>")).schema
    scored = materialise(base.mapInArrow(_posterior(spark.sparkContext.broadcast(logs)), schema), "pages")
    each = range(len(langs))
    p = [F.col("text_p")[i] for i in each]
    cols = [f"p{i}" for i in each]
    sums = [F.sum(x).alias(c) for x, c in zip(p, cols)]

    # Nested sums: hosts in domains in suffixes in all; each level is a small grouped aggregate.
    by_host = materialise(scored.groupBy("host").agg(*sums), "hosts").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    again = [F.sum(c).alias(c) for c in cols]
    by_domain = by_host.groupBy("domain").agg(*again)
    by_suffix = by_host.groupBy("suffix").agg(*again)
    whole = by_host.agg(*again)
    level = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") if c in cols else F.col(c) for c in df.columns])
    hosts = level(by_host, "h").join(level(by_domain, "d"), "domain").join(level(by_suffix, "s"), "suffix").crossJoin(F.broadcast(level(whole, "w")))
    # P(declared | language), from the pages' text posteriors; a count for each declaration seen.
    said = level(scored.groupBy("declared").agg(*sums), "c")
    kinds = said.count()
    if by_host.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rows = scored.join(F.broadcast(hosts), "host", "left")
    else:
        # A host may hold a third of all pages: its pages look in several copies of its sums.
        copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], "left")
    rows = rows.join(F.broadcast(said), "declared", "left")  # codes of two or three letters: some 18,000 at most

    def smoothed(tags: str) -> list[Column]:
        """Shares of each language at the first tag's level, its own page taken out, with the coarser levels as prior."""
        prior = [F.lit(1.0 / len(langs)) for _ in each]
        for tag in reversed(tags):
            left = [F.greatest(F.col(f"{tag}_p{i}") - p[i], F.lit(0.0)) for i in each]
            total = sum(left[1:], left[0])
            prior = [(left[i] + PRIOR * prior[i]) / (total + PRIOR) for i in each]
        return prior

    prior = smoothed("hdsw")
    rows = rows.withColumn("prior", F.array(*prior))
    said_p = [
        F.when(F.col("declared") == "", F.lit(1.0)).otherwise((F.greatest(F.col(f"c_p{i}") - p[i], F.lit(0.0)) + 1.0) / (F.greatest(F.col(f"w_p{i}") - p[i], F.lit(0.0)) + float(kinds))) for i in each
    ]
    joint = F.array(*[(p[i] + FLOOR) * (F.col("prior")[i] + FLOOR) * said_p[i] for i in each])
    rows = rows.withColumn("joint", joint).withColumn("sum", F.aggregate("joint", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return rows.select(
        F.col("id").alias(id_col), best(F.col("joint")).alias("lang"), (F.array_max("joint") / F.col("sum")).alias("probability"),
        best(F.col("text_p")).alias("text_lang"), F.array_max("text_p").alias("text_probability"), "declared", "host",
    )
