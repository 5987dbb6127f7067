"""Corpus quality, masking, de-duplication and reconciliation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.blanks import strip
from quarry.functions.text import alias_match
from quarry.sources.lineage import materialise

from .containment import marks


def mask_text(column: Column, terms: dict[str, str]) -> Column:
    """QLT-1: terms replaced one after the other, longest first; letters of either case where a term has Latin letters."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        if any("a" <= c.lower() <= "z" for c in term):
            column = F.regexp_replace(column, "(?i)" + "".join("\\" + c if not c.isalnum() else c for c in term), terms[term])
        else:
            column = F.replace(column, F.lit(term), F.lit(terms[term]))
    return column


def _masked(value, rules: list[tuple], skip: set[str]):
    """A parsed JSON value with its texts masked at any depth; what lies under a skipped key stays."""
    if isinstance(value, str):
        for pattern, mask in rules:
            value = pattern.sub(lambda _, mask=mask: mask, value)
        return value
    if isinstance(value, list):
        return [_masked(x, rules, skip) for x in value]
    if isinstance(value, dict):
        return {k: x if k in skip else _masked(x, rules, skip) for k, x in value.items()}
    return value


def mask_json(column: Column, terms: dict[str, str], skip: list[str]) -> Column:
    """QLT-2: the texts in a JSON object or list masked as ``mask_text`` does, at any depth; numbers, nesting and what skipped keys hold stay.

    A value of unknown shape has no schema, so this runs in Arrow batches of Python. The result
    is written with a blank after commas and colons, other scripts as they are. Text that is
    no JSON object or list stays as it is, and so do null and values nested too deeply to be read.
    """
    rules = [(re.compile(re.escape(t), re.IGNORECASE if re.search("[A-Za-z]", t) else 0), terms[t]) for t in sorted(terms, key=lambda t: (-len(t), t))]
    left = set(skip)

    def one(text):
        if text is None or not text.strip().startswith(("[", "{")):
            return text
        try:
            return json.dumps(_masked(json.loads(text), rules, left), ensure_ascii=False)
        except (ValueError, RecursionError):
            return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(column)


#: A file name that begins with a short model number.
SHORT_MODEL = r"(?i)\A\(\s*([^()]+?)\s*-\s*TS相关\s*-\s*NCMR\s*报告"


def assign_tags(files: DataFrame, tags: DataFrame, *, aliases: str | None = None, short_model: str = SHORT_MODEL) -> DataFrame:
    """QLT-3: tags (tag_id, name, and a column of other names) of files (file_id, file_name).

    A tag is a file's where one of its names stands alone in the file's name (``alias_match``).
    Where none does, the short model number in front (group 1 of ``short_model``) gives the tags
    of which a name ends in it after its last hyphen. A name meets only files that have one of
    its words, the one that the fewest names have; names without Latin letters and digits meet
    files with their first character. Files without tags have no row.
    """
    given = F.array("name") if aliases is None else F.array_union(F.array("name"), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    names = tags.select("tag_id", F.explode(given).alias("alias")).select("tag_id", F.trim("alias").alias("alias")).filter("alias <> ''").distinct()
    runs = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9+]+)"), F.lit(1)))
    words = names.select("alias", "tag_id", F.explode_outer(runs("alias")).alias("word"))
    often = words.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rare = words.join(often, "word", "left").groupBy("tag_id", "alias").agg(F.min_by("word", F.struct("often", -F.length("word"), "word")).alias("word"))
    keyed = rare.select("tag_id", "alias", F.coalesce("word", F.left(F.lower("alias"), F.lit(1))).alias("key"))
    stem = F.substring_index(F.translate("file_name", "\\", "/"), "/", -1)
    files = files.select("file_id", F.regexp_replace(stem, r"(?s)(.)\.[^.]*\z", "$1").alias("file_name"))
    low = F.lower("file_name")
    others = F.array_distinct(F.split(F.regexp_replace(low, "[a-z0-9+ ]", ""), ""))  # no name begins with a blank
    asked = files.select("file_id", "file_name", F.explode(F.array_union(runs("file_name"), others)).alias("key")).filter("key <> ''")
    # Spark does not see that an explode makes rows, and would send the files' words to every executor by way of the driver.
    hit = asked.join(keyed.hint("merge"), "key").filter(alias_match(F.col("file_name"), F.col("alias"))).select("file_id", "tag_id")
    model = files.select("file_id", F.lower(F.regexp_extract("file_name", short_model, 1)).alias("model")).filter("model <> ''").join(hit.select("file_id").distinct().hint("merge"), "file_id", "left_anti")
    short = model.join(names.select("tag_id", F.lower(F.substring_index("alias", "-", -1)).alias("model")).hint("merge"), "model").select("file_id", "tag_id")
    return hit.unionByName(short).groupBy("file_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tag_ids"))


def tag_conflicts(tags: DataFrame) -> DataFrame:
    """QLT-4: names and aliases that several tags have."""
    names = tags.select("tag_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("alias"))
    return names.groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.count_distinct("tag_id").alias("n_tags")).filter("n_tags > 1")


def drop_repeated_blocks(blocks: DataFrame, *, key: str = "doc_id", short: int = 120) -> DataFrame:
    """QLT-5: blocks (page, block) without those that stand max(3, pages // 2) times or more in a document of three or more pages.

    Where there is a ``kind``, header and footer blocks of at most ``short`` characters go, too.
    """
    rows = blocks.withColumn("norm_", F.regexp_replace(F.lower(F.trim("block")), r"\s+", " "))
    if "kind" in blocks.columns:
        rows = rows.filter(~(F.coalesce("kind", F.lit("")).isin("header", "footer") & (F.length("norm_") <= short)))
    pages = rows.groupBy(key).agg(F.count_distinct("page").alias("pages_"))
    counted = rows.withColumn("seen_", F.count(F.lit(1)).over(W.partitionBy(key, "norm_"))).join(pages, key)
    return counted.filter((F.col("pages_") < 3) | (F.col("seen_") < F.greatest(F.lit(3), F.floor(F.col("pages_") / 2)))).drop("norm_", "seen_", "pages_")


def drop_repeated_images(images: DataFrame, least: int, area: float) -> DataFrame:
    """QLT-6: images without small ones whose hash is on ``least`` slides or more."""
    common = images.groupBy("doc_id", "sha1").agg(F.count_distinct("slide").alias("slides")).filter(F.col("slides") >= least).select("doc_id", "sha1")
    return images.filter(F.col("area") > area).unionByName(images.filter(F.col("area") <= area).join(common, ["doc_id", "sha1"], "left_anti"))


def _bands(signatures: DataFrame, most: int) -> tuple[list[list[int]], int]:
    """Bits of 64 that are not the same in all rows, in bands, and how many of the first bands may differ in one bit.

    Of ``most`` differences, some band of the first has one at most, or one of the others none.
    """
    sums = signatures.agg(F.count(F.lit(1)), *[F.sum(F.shiftrightunsigned("signature", i).bitwiseAND(1)) for i in range(64)]).first()
    rows, ones = sums[0], sums[1:]
    uneven = sorted((abs(2 * n - rows), i) for i, n in enumerate(ones) if n not in (None, 0, rows))
    count = most // 2 + 1
    return [sorted(i for _, i in uneven[b::count]) for b in range(count)], most % count + 1 if most else 0


def match_signatures(images: DataFrame, refs: DataFrame, most: int = 6, aspect: float = 0.30) -> DataFrame:
    """QLT-7: image_id, ref_id and distance of the nearest reference within ``most`` different bits of 64 and an aspect's log ratio of ``aspect``.

    The bits that differ at all are dealt to ``most`` // 2 + 1 bands, evenly by how often they
    are set, so that no band is the same in all rows. Where two signatures differ in ``most``
    bits, one band differs in one bit at most (in none, for the last bands), so images are
    looked up by band and aspect range among references that offer each band and its
    neighbours, and are compared in full. Equal images are looked up once. Ties go to the
    smaller reference; images without signature or with an aspect of 0 or less match nothing.
    """
    step = F.floor(F.log("aspect") / aspect)
    good = images.filter("signature is not null and aspect > 0")
    asked = good.select(F.col("signature").cast("bigint").alias("signature"), F.col("aspect").cast("double").alias("aspect")).distinct()
    known = refs.select("ref_id", F.col("ref_signature").cast("bigint").alias("ref_signature"), F.col("ref_aspect").cast("double").alias("aspect")).filter("ref_signature is not null and aspect > 0")
    bands, free = _bands(asked.select("signature").unionByName(known.select(F.col("ref_signature").alias("signature"))), most)
    bits = lambda s, band: sum((F.shiftleft(F.shiftrightunsigned(s, bit).bitwiseAND(1), i) for i, bit in enumerate(band)), F.lit(0).cast("bigint"))
    near = lambda x, i: [x, *[x.bitwiseXOR(F.lit(1 << j).cast("bigint")) for j in range(len(bands[i]))]] if i < free else [x]
    key = lambda i, x: F.struct(F.lit(i).alias("band"), x.alias("bits"))
    asked = asked.withColumns({"step": step, "key": F.explode(F.array(*[key(i, bits(F.col("signature"), band)) for i, band in enumerate(bands)]))})
    known = known.withColumn("step", F.explode(F.array(step - 1, step, step + 1))).withColumnRenamed("aspect", "ref_aspect")
    known = known.withColumn("key", F.explode(F.array(*[key(i, x) for i, band in enumerate(bands) for x in near(bits(F.col("ref_signature"), band), i)])))
    distance = F.bit_count(F.col("signature").bitwiseXOR(F.col("ref_signature")))
    # Spark does not see how many rows an explode makes, and would send them all by way of the driver.
    near = asked.join(known.hint("merge"), ["step", "key"]).withColumn("distance", distance).filter((F.col("distance") <= most) & (F.abs(F.log(F.col("aspect") / F.col("ref_aspect"))) <= aspect))
    best = near.groupBy("signature", "aspect").agg(F.min(F.struct("distance", "ref_id")).alias("m")).select(F.col("signature").alias("s_"), F.col("aspect").alias("a_"), "m.ref_id", "m.distance")
    return good.join(best.hint("merge"), (F.col("signature").cast("bigint") == F.col("s_")) & (F.col("aspect").cast("double") == F.col("a_"))).select("image_id", "ref_id", "distance")


def contained_duplicates(paras: DataFrame, k: int = 8, least: int = 30) -> DataFrame:
    """QLT-8: (inner_id, outer_id) of paragraphs of which one holds the other, punctuation aside; equal ones count under their smallest id.

    A contained paragraph's windows, chosen by content (``containment``), are among its
    container's, so the join is on the hash of the rarest of them alone. Texts meet only for
    the pairs that this leaves, and are compared whole.
    """
    clean = F.trim(F.regexp_replace(F.lower("body"), r"[^\p{L}\p{N}]+", " "))
    words = F.split("t", " ")
    base = paras.select("para_id", clean.alias("t")).filter(F.length("t") >= least).groupBy("t").agg(F.min("para_id").alias("para_id"))
    base = materialise(base.withColumn("n_words", F.size(words)), "texts")
    offered = materialise(marks(base.select("para_id", "n_words", F.transform(words, lambda w: F.xxhash64(w)).alias("words")), k), "windows")
    counts = offered.groupBy("win").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A window that nobody else has rules its paragraph out: only those whose windows all recur stay.
    asked = offered.filter("need > 0").join(counts, "win").groupBy("para_id").agg(F.min(F.struct("n", "win")).alias("m"), F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
    rare = asked.filter("shared = need").select(F.col("para_id").alias("inner_id"), F.col("m.win").alias("win"))
    pairs = materialise(rare.join(offered.select("win", F.col("para_id").alias("outer_id")), "win").filter("inner_id <> outer_id").select("inner_id", "outer_id"), "pairs")
    ids = pairs.select(F.explode(F.array("inner_id", "outer_id")).alias("para_id")).distinct()
    texts = base.join(ids, "para_id", "left_semi")
    inner = texts.select(F.col("para_id").alias("inner_id"), F.col("t").alias("inner_t"))
    outer = texts.select(F.col("para_id").alias("outer_id"), F.col("t").alias("outer_t"))
    held = F.concat(F.lit(" "), "outer_t", F.lit(" ")).contains(F.concat(F.lit(" "), "inner_t", F.lit(" ")))
    return pairs.join(inner, "inner_id").join(outer, "outer_id").filter(held).select("inner_id", "outer_id")


def reconcile(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """QLT-9: each indexed document ok, stale, with another title, or with mixed titles."""
    per = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_set("title")).alias("titles"), F.count(F.lit(1)).alias("chunks"))
    joined = per.join(docs.select("doc_id", F.col("title").alias("stored")), "doc_id", "left")
    state = F.when(F.col("stored").isNull(), "stale").when(F.size("titles") > 1, "mixed").when(F.col("titles")[0] != F.col("stored"), "title mismatch").otherwise("ok")
    return joined.select("doc_id", "chunks", F.array_join("titles", "|").alias("titles"), state.alias("state"), (state != "ok").alias("rebuild"))


def mixed_titles(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """QLT-10: known documents whose chunks bear several non-blank titles."""
    known = chunks.filter(F.trim("title") != "").join(docs.select("doc_id"), "doc_id", "left_semi")
    return known.groupBy("doc_id").agg(F.array_sort(F.collect_set("title")).alias("titles")).filter(F.size("titles") > 1)


def repair_plan(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """QLT-11: what to do with each document and source of a path: keep, delete, link, orphans either way, several sources."""
    d = docs.withColumn("linked", F.col("source_id").isNotNull()).withColumn("n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("linked"), F.desc("doc_id"))))
    s = sources.groupBy("path").agg(F.min("source_id").alias("first_source"), F.count(F.lit(1)).alias("sources"))
    rows = d.join(s, "path", "full_outer")
    action = F.when(F.col("doc_id").isNull(), "orphan source").when(F.col("n") > 1, "delete").when(F.col("sources").isNull(), "orphan document").when(F.col("sources") > 1, "several sources").when(~F.col("source_id").eqNullSafe(F.col("first_source")), "link").otherwise("keep")
    return rows.select("path", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), action.alias("action"))


def stale_links(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """QLT-12: files whose linked document is gone."""
    return sources.filter("doc_id is not null").join(docs.select("doc_id"), "doc_id", "left_anti")


def stale_review_links(sources: DataFrame, reviews: DataFrame, docs: DataFrame) -> DataFrame:
    """QLT-12: (path, review_id, fault) of files whose review is gone, or is closed upon a document that is gone.

    ``sources`` have path and review_id, ``reviews`` review_id and document_id (null: open).
    """
    linked = sources.filter("review_id is not null").join(reviews.select(F.col("review_id").alias("r_"), "document_id"), F.col("review_id") == F.col("r_"), "left")
    rows = linked.join(docs.select(F.col("doc_id").alias("d_")).distinct(), F.col("document_id") == F.col("d_"), "left")
    fault = F.when(F.col("r_").isNull(), "review is gone").when(F.col("document_id").isNotNull() & F.col("d_").isNull(), "document is gone")
    return rows.withColumn("fault", fault).filter("fault is not null").select("path", "review_id", "fault")


def repeated_siblings(categories: DataFrame) -> DataFrame:
    """QLT-16: (parent_id, name, ids) of names that several children of one parent have, white space and case aside; roots are siblings, too."""
    same = categories.groupBy("parent_id", F.lower(strip("name")).alias("name")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return same.filter(F.size("ids") > 1)


def index_backlog(versions: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """QLT-13: served versions whose index is missing, of live documents, the first ``n``."""
    want = versions.filter("workflow_status = 'published' and validity_status in ('active', 'legacy_active') and index_status in ('pending', 'failed')")
    return want.join(docs.select("document_id"), "document_id", "left_semi").orderBy("version_id").limit(n)


def draft_violations(drafts: DataFrame, files: DataFrame, sections: DataFrame) -> DataFrame:
    """QLT-14: one row per draft and broken rule."""
    f = files.groupBy("version_id").agg(F.bool_or("is_primary").alias("has_file"))
    s = sections.groupBy("version_id").agg(F.bool_or(F.trim("body") != "").alias("has_body"))
    rows = drafts.join(f, "version_id", "left").join(s, "version_id", "left")
    rules = F.array_compact(F.array(F.when(~F.coalesce("has_file", F.lit(False)), "no primary file"), F.when(~F.coalesce("has_body", F.lit(False)), "no section"), F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", "no summary"), F.when(F.col("hardware_version").isNull(), "no hardware")))
    return rows.select("version_id", F.explode(rules).alias("violation"))


def source_tree(pages: DataFrame) -> DataFrame:
    """QLT-15: nodes (key, parent, depth) of all path prefixes, each once, with the number of pages below."""
    each = pages.select("page_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    key = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    nodes = each.select("page_id", "depth", key(F.col("depth")).alias("key"), F.when(F.col("depth") > 1, key(F.col("depth") - 1)).otherwise("").alias("parent"))
    return nodes.groupBy("key", "parent", "depth").agg(F.count_distinct("page_id").alias("pages"))


def merge_tag_relations(docs: DataFrame, relations: DataFrame) -> DataFrame:
    """QLT-17: a document's own tags with those of the old relation table."""
    old = relations.groupBy("doc_id").agg(F.collect_set("tag_id").alias("old"))
    empty = F.array().cast("array<int>")
    return docs.join(old, "doc_id", "left").select("doc_id", F.array_sort(F.array_union(F.coalesce("tag_ids", empty), F.coalesce("old", empty))).alias("tag_ids"))


def publish_plan(versions: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """QLT-18: versions after publishing: the requested one active, those active before superseded with an end."""
    rows = versions.join(requests.select("document_id", F.col("version_id").alias("new_id")), "document_id")
    new = F.col("version_id") == F.col("new_id")
    old = ~new & (F.col("workflow_status") == "published")
    return rows.select(
        "document_id", "version_id", F.when(new, "published").when(old, "superseded").otherwise(F.col("workflow_status")).alias("workflow_status"),
        F.when(old, F.coalesce("effective_to", F.lit(as_of))).otherwise(F.col("effective_to")).alias("effective_to"), F.when(old, F.col("new_id")).alias("superseded_by"),
    )


def refile_reviews(reviews: DataFrame) -> DataFrame:
    """QLT-19: pending reviews of the wrong library: closed in favour of the newest twin (owner, path) of the right one, else moved."""
    right = reviews.filter("library = wanted")
    twin = right.groupBy("owner_id", "path").agg(F.max("review_id").alias("twin_id"))
    wrong = reviews.filter("library <> wanted").join(twin, ["owner_id", "path"], "left")
    return wrong.select("review_id", F.when(F.col("twin_id").isNull(), "move").otherwise("close").alias("action"), F.coalesce("twin_id", F.lit(-1)).alias("twin_id"))
