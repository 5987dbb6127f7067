"""Vector and hybrid retrieval over batches of queries. Scores are inner products of unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import normalise_term

from .vectors import ann, inner, knn, top_per_key

__all__ = ["ann", "inner", "knn", "top_per_key"]
KEY = ["library_type", "doc_id"]


def knn_threshold(queries: DataFrame, chunks: DataFrame, k: int, min_score: float, **options) -> DataFrame:
    """VEC-3: the top ``k``, then those that reach ``min_score``."""
    return knn(queries, chunks, k, **options).filter(F.col("score") >= min_score)


def merge_candidates(df: DataFrame, keys: list[str]) -> DataFrame:
    """VEC-4: one row per key, the one with the greatest score (ties: smallest chunk id)."""
    best = F.struct(F.col("score"), -F.col("chunk_pk"))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), best).alias("best")).select(*keys, "best.*")


def domain_rescore(cands: DataFrame, terms: str = "terms", text: str = "text", title: str = "title", *, aliases: str | None = None, malus: float = 0.10) -> DataFrame:
    """VEC-5: a bonus for the share of a query's terms in text and title, a malus where none matches; without terms the score stays.

    ``aliases`` names a map column from a term to its other names. Blanks, underscores and
    hyphens are alike, and case is ignored.
    """
    body, head = normalise_term(F.coalesce(text, F.lit(""))), normalise_term(F.coalesce(title, F.lit("")))
    wanted = F.array_distinct(terms)
    names = lambda t: F.array_union(F.array(t), F.coalesce(F.element_at(aliases, t), F.array().cast("array<string>"))) if aliases else F.array(t)
    inside = lambda where, t: F.exists(names(t), lambda a: where.contains(normalise_term(a)))
    n = F.size(wanted)
    matched = F.size(F.filter(wanted, lambda t: inside(head, t) | inside(body, t)))
    titled = F.size(F.filter(wanted, lambda t: inside(head, t)))
    bonus = F.least(F.lit(0.15), 0.08 + 0.06 * matched / n + 0.03 * titled / n)
    new = F.when(n == 0, F.col("score")).when(matched > 0, F.least(F.lit(1.0), F.col("score") + bonus)).otherwise(F.greatest(F.lit(0.0), F.col("score") - malus))
    return cands.withColumn("rescored", new)


def rollup_documents(cands: DataFrame, *, min_score: float = 0.5, k: int = 10, query: str = "query_id", weights: tuple[float, ...] = (0.6, 0.3, 0.1)) -> DataFrame:
    """VEC-6: documents by the weighted mean of their best three chunks; weights renormalised where there are fewer.

    Where chunks have a ``version_id``, versions of a document of the knowledge library are
    apart. Where they have ``section_id`` or ``image_url``, that library's documents list
    them, distinct, by falling score of the chunk.
    """
    versioned = "version_id" in cands.columns
    rows = cands.filter(F.col("score") >= min_score)
    known = F.col("library_type") == "knowledge"
    if versioned:
        rows = rows.withColumn("version_id", F.when(known, F.coalesce("version_id", F.lit(0))).otherwise(F.lit(0)))
    keys = [query, *KEY, *(["version_id"] if versioned else [])]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("chunk_pk")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place"))
    best = F.col("place") <= len(weights)
    lists = {c: f"{c}s" for c in ("section_id", "image_url") if c in cands.columns}

    def in_order(c: str) -> Column:
        wanted = known & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.array_distinct(F.array_sort(F.collect_list(F.when(wanted, F.struct("place", c))))[c])

    collected = [in_order(c).alias(name) for c, name in lists.items()]
    docs = rows.withColumn("place", place).groupBy(*keys).agg(
        (F.sum(F.when(best, F.col("score") * F.when(best, weight))) / F.sum(F.when(best, weight))).alias("doc_score"),
        F.min_by("chunk_pk", "place").alias("best_chunk"),
        F.count(F.when(best, 1)).alias("n_chunks"),
        *collected,
    )
    return top_per_key(docs, [query], [F.desc(F.round("doc_score", 9)), F.asc("library_type"), F.asc("doc_id"), *([F.asc("version_id")] if versioned else [])], k)


def rrf(lists: DataFrame, *, weights: dict[str, float], k: int = 60, query: str = "query_id", key: list[str] = KEY) -> DataFrame:
    """VEC-8: reciprocal-rank fusion of (query, list, list_type, rank, key, score).

    The first rank of a key in a list counts, and repeats still use up ranks.
    """
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("list_type")], F.lit(1.0))
    first = lists.groupBy(query, "list", "list_type", *key).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return first.groupBy(query, *key).agg(
        F.sum(weight / (k + F.col("rank"))).alias("fused"),
        F.max("score").alias("best_score"),
        F.sort_array(F.collect_list(F.struct("list", "rank"))).alias("provenance"),
    )


def rrf_bonus(fused: DataFrame, k: int, *, query: str = "query_id", filters: str = "soft_hits", in_title: str = "title_hits", in_text: str = "text_hits") -> DataFrame:
    """VEC-9: capped bonuses for soft filters and primary terms, then the top ``k`` of the sum."""
    soft = F.least(F.lit(0.01), 0.002 * F.col(filters))
    primary = F.least(F.lit(0.02), 0.012 * F.col(in_title) + 0.008 * F.col(in_text))
    final = fused.withColumn("final", F.col("fused") + soft + primary)
    return top_per_key(final, [query], [F.desc(F.round("final", 9)), F.asc("library_type"), F.asc("doc_id")], k)


def resolve_versions(ranked: DataFrame, versions: DataFrame, docs: DataFrame, *, query: str = "query_id") -> DataFrame:
    """VEC-7: rows of served versions (or without a version), no unversioned twin of a versioned document, no document left with several versions, live documents only."""
    served = versions.select("version_id").distinct()
    kept = ranked.join(served, "version_id", "left_semi").unionByName(ranked.filter(F.col("version_id").isNull()))
    w = W.partitionBy(query, "doc_id")
    kept = kept.withColumn("versioned_", F.max(F.col("version_id").isNotNull().cast("int")).over(w)).filter((F.col("versioned_") == 0) | F.col("version_id").isNotNull())
    several = kept.groupBy(query, "doc_id").agg(F.count_distinct("version_id").alias("n")).filter("n > 1")
    return kept.drop("versioned_").join(several, [query, "doc_id"], "left_anti").join(docs.select("doc_id", "title"), "doc_id", "inner")


def grade_evidence(cands: DataFrame, scores: DataFrame, *, query: str = "query_id", key: str = "chunk_pk") -> tuple[DataFrame, DataFrame]:
    """VEC-11: candidates graded strong, partial or irrelevant (a missing score is 0), and a roll-up per query."""
    value = F.coalesce("grade_score", F.lit(0))
    graded = cands.join(scores, [query, key], "left").withColumn("grade", F.when(value >= 80, "strong").when(value >= 60, "partial").otherwise("irrelevant"))
    strong, partial = F.bool_or(F.col("grade") == "strong"), F.bool_or(F.col("grade") == "partial")
    per = graded.groupBy(query).agg(F.when(strong, "strong").when(partial, "partial").otherwise("none").alias("evidence"), (strong | partial).alias("sufficient"))
    return graded, per


def rank_supported(cands: DataFrame, *, query: str = "query_id") -> DataFrame:
    """VEC-14: supported candidates only, graded ones first by grade, the rest by score."""
    order = [F.desc(F.col("grade_score").isNotNull()), F.desc_nulls_last("grade_score"), F.desc("score"), F.asc("chunk_pk")]
    return cands.filter(F.coalesce("supported", F.lit(False))).withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))


def plan_queries(levels: DataFrame, *, query: str = "query_id") -> DataFrame:
    """VEC-10: of (query, level, kind, text) the first of each key over the levels; one rewrite at most where the original is there."""
    key = F.when(F.col("kind") == "keyword", F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")).otherwise(F.regexp_replace(F.lower("text"), r"[\s\p{P}]", ""))
    first = levels.withColumn("key", key).filter("key <> ''").withColumn("n", F.row_number().over(W.partitionBy(query, "kind", "key").orderBy("level", "text"))).filter("n = 1")
    has = F.max((F.col("level") == 0).cast("int")).over(W.partitionBy(query))
    nth = F.row_number().over(W.partitionBy(query, F.col("level") == 1).orderBy("kind", "text"))
    return first.withColumn("has_original", has).withColumn("nth", nth).filter((F.col("level") != 1) | (F.col("has_original") == 0) | (F.col("nth") == 1)).select(query, "level", "kind", "text")


#: Words of a cause or a remedy; the last one does not make an answer complete.
ACTION_WORDS = ["原因", "排查", "检查", "处理", "解决", "措施", "建议"]


def judge_sufficiency(cands: DataFrame, analyses: DataFrame, *, least: int = 1, query: str = "query_id") -> DataFrame:
    """VEC-12: per query what its candidates support, what is missing, and whether to answer, refine or plan anew.

    ``cands`` are (query, doc_id, title, text); ``analyses`` (query, primary_terms,
    requested, symptoms, joint). A candidate supports if it has a primary term (where there
    are any) and a word of cause or remedy (where something is requested).
    """
    clean = F.filter(F.transform("primary_terms", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    asks = analyses.select(query, clean.alias("terms"), (F.trim(F.coalesce("requested", F.lit(""))) != "").alias("requested"), F.transform("symptoms", F.lower).alias("symptoms"), F.coalesce("joint", F.lit(False)).alias("joint"))
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    any_of = lambda words: low.rlike("|".join(words))
    rows = cands.select(query, "doc_id", low.alias("low_"), any_of(ACTION_WORDS).alias("acts"), any_of(ACTION_WORDS[:-1]).alias("cause")).join(asks, query)
    hit = F.filter("terms", lambda t: F.col("low_").contains(t))
    rows = rows.withColumn("hit", hit).withColumn("primary", (F.size("terms") == 0) | (F.size("hit") > 0))
    rows = rows.withColumn("supports", F.col("primary") & (F.col("acts") | ~F.col("requested"))).withColumn("shown", F.filter("symptoms", lambda x: F.col("low_").contains(x)))
    docs = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("doc_id"))))
    per = rows.groupBy(query).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("matched"), docs(F.col("supports")).alias("supporting"), docs(~F.col("primary") & (F.size("terms") > 0)).alias("irrelevant"), docs(F.lit(True)).alias("all_docs"),
        F.array_distinct(F.flatten(F.collect_set("shown"))).alias("shown"), F.bool_or(F.col("supports") & F.col("cause")).alias("caused"), F.count(F.lit(1)).alias("n"),
    )
    full = asks.join(per, query, "left")
    none = F.array().cast("array<string>")
    matched, supports = F.coalesce("matched", none), F.coalesce(F.size("supporting"), F.lit(0)) > 0
    missing = F.array_compact(
        F.concat(
            F.when(F.col("joint"), F.transform(F.array_except("symptoms", F.coalesce("shown", none)), lambda x: F.concat(F.lit("symptom: "), x))).otherwise(none),
            F.array(F.when(F.col("joint"), F.lit("joint cause")), F.when((F.size("terms") > 0) & (F.size(matched) == 0), F.lit("primary term")), F.when(F.col("requested") & supports & ~F.coalesce("caused", F.lit(False)), F.lit("cause or remedy"))),
        )
    )
    rows = full.withColumn("missing", missing)
    bare = F.size("missing") == 0
    verdict = lambda relevance, action, rest: F.struct(relevance.alias("relevance"), action.alias("next_action"), rest.alias("missing"))
    fill = lambda text: F.when(bare, F.array(F.lit(text))).otherwise(F.col("missing"))
    out = (
        F.when(F.col("n").isNull(), verdict(F.lit("none"), F.lit("refine"), F.array(F.lit("documents"))))
        .when(supports, verdict(F.when(bare & (F.size("supporting") >= 2), "strong").otherwise("partial"), F.when(bare & (F.size("supporting") >= least), "answer").otherwise("refine"), F.col("missing")))
        .when((F.size("terms") > 0) & (F.size(matched) > 0), verdict(F.lit("partial"), F.lit("refine"), fill("cause or remedy")))
        .otherwise(verdict(F.lit("weak"), F.lit("replan"), fill("main entity")))
    )
    ids = F.array().cast(cands.select(F.array("doc_id")).schema[0].dataType)
    weak = out["relevance"] == "weak"
    return rows.select(
        query, matched.alias("matched"), F.coalesce("supporting", ids).alias("supporting"), F.when(weak, F.col("all_docs")).otherwise(F.coalesce("irrelevant", ids)).alias("irrelevant"),
        out["relevance"].alias("relevance"), out["next_action"].alias("next_action"), F.array_join(out["missing"], ",").alias("missing"),
    )


def refine_queries(judged: DataFrame, *, query: str = "query_id", most: int = 3) -> DataFrame:
    """VEC-13: entity and missing aspect as the keyword and semantic queries of a second round, ``most`` of each."""
    targets = F.slice(F.split("missing", ","), 1, 5)
    keyword = F.transform(targets, lambda t: F.struct(F.lit("keyword").alias("kind"), F.concat_ws(" ", "entity", t).alias("text")))
    semantic = F.transform(targets, lambda t: F.struct(F.lit("semantic").alias("kind"), F.concat(F.lit("what is known of "), t, F.lit(" for "), "entity").alias("text")))
    both = F.concat(F.slice(keyword, 1, most), F.slice(semantic, 1, most))
    return judged.filter("missing <> ''").select(query, F.inline(both))


def tree_evidence(chunks: DataFrame, most: int = 8, *, query: str = "query_id") -> DataFrame:
    """VEC-15: chunks of mind maps (query, doc_id, path, text, terms) that hold a term, by hits in text, focus and path and by shortness of the path."""
    low, n = F.lower("text"), F.greatest(F.size("terms"), F.lit(1))
    held = lambda where: F.size(F.filter("terms", lambda t: where.contains(F.lower(t))))
    focus, whole = F.lower(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(""))), F.lower(F.array_join("path", " "))
    score = 0.4 * held(low) / n + 0.3 * held(focus) / n + 0.2 * held(whole) / n + 0.1 / F.greatest(F.lit(1), F.size("path"))
    rows = chunks.filter(held(low) > 0).withColumn("score", F.round(score, 9))
    return top_per_key(rows, [query, "doc_id"], [F.desc("score"), F.asc("text")], most)


def evidence_snippets(sections: DataFrame, *, before: int = 250, after: int = 1250, most: int = 8, query: str = "query_id") -> DataFrame:
    """VEC-15: windows around the first hit of each term, in order, the first ``most`` of a document.

    A hit inside the window before it opens none; without a hit the window is the text's
    beginning. Texts and terms are compared in small letters; an empty text has no window.
    """
    low = F.lower("text")
    hits = F.array_sort(F.array_distinct(F.filter(F.transform("terms", lambda t: F.position(F.lower(t), low)), lambda x: x > 0)))
    spots = F.when((F.size(hits) == 0) & (F.coalesce("text", F.lit("")) != ""), F.array(F.lit(1))).otherwise(hits)
    zero = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc, x):
        window = F.struct(F.greatest(F.lit(1), x - before).cast("int").alias("s"), F.least(F.length("text") + 1, x + after).cast("int").alias("e"))
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) > 0) & (x < last["e"]), acc).otherwise(F.concat(acc, F.array(window)))

    rows = sections.filter(F.col("text").isNotNull()).select(query, "doc_id", "text", F.posexplode(F.slice(F.aggregate(spots, zero, step), 1, most)).alias("n", "w"))
    return rows.select(query, "doc_id", "n", F.substring("text", F.col("w.s"), F.col("w.e") - F.col("w.s")).alias("snippet"))
