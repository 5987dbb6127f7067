"""Column expressions on text: all of them run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import single, squeeze, strip

CJK = r"一-鿿"
#: Words that carry no meaning of their own in a question.
STOP = "the a an of to in is are was and or how what why who for with on at by be it this that".split()


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def query_terms(column: Column, most: int = 40) -> Column:
    """EXP-1: Latin and code terms in small letters; Han runs up to 6, longer ones as 4-, 3- and 2-grams; no stop words; the first distinct ones."""
    text = F.coalesce(column, F.lit(""))
    latin = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9_\-.]*)"), F.lit(1)), F.lower)
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), F.lit(1))
    han = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 6, F.array(r)).otherwise(F.concat(_grams(r, 4), _grams(r, 3), _grams(r, 2)))))
    kept = F.filter(F.concat(latin, han), lambda t: ~t.isin(STOP))
    return F.slice(F.array_distinct(kept), 1, most)


#: Words that say nothing of what a memory is about.
MEMORY_STOP = ["the", "and", "for", "with", "this", "that", "issue", "problem", "问题", "故障", "怎么", "处理", "解决"]


def memory_keywords(column: Column, most: int = 80) -> Column:
    """EXP-2: Latin words, numbers, and Han runs over two characters cut into pairs, in order; the first distinct ones."""
    text = F.coalesce(column, F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"([A-Za-z][A-Za-z0-9_-]+|\d+(?:\.\d+)?|[{CJK}]+)"), F.lit(1)), F.lower)
    parts = F.flatten(F.transform(found, lambda t: F.when(t.rlike(f"^[{CJK}]{{3,}}$"), _grams(t, 2)).otherwise(F.array(t))))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: ~t.isin(MEMORY_STOP))), 1, most)


def compact(column: Column) -> Column:
    """Small letters without white space."""
    return squeeze(F.lower(column))


def text_similarity(a: Column, b: Column, keys_a: Column, keys_b: Column) -> Column:
    """EXP-3: 1 for equal compact texts, 0.86 for one inside the other (six characters at least), else Jaccard of keywords; 0 where a text or its keywords are empty."""
    x, y = compact(a), compact(b)
    inside = (F.length(x) >= 6) & (F.length(y) >= 6) & (x.contains(y) | y.contains(x))
    union = F.size(F.array_union(keys_a, keys_b))
    return F.when((x != "") & (x == y), 1.0).when(inside, 0.86).otherwise(F.when(union > 0, F.size(F.array_intersect(keys_a, keys_b)) / union).otherwise(0.0))


def alias_match(text: Column, alias: Column) -> Column:
    """EXP-4: the alias in the text, not next to a letter, digit or plus sign."""
    return F.rlike(text, F.concat(F.lit(r"(?i)(?<![A-Z0-9+])\Q"), alias, F.lit(r"\E(?![A-Z0-9+])")))


def normalise_term(column: Column) -> Column:
    """EXP-5: small letters; runs of blanks, underscores and hyphens as one blank."""
    return F.regexp_replace(F.lower(column), r"[\s_\-]+", " ")


def contains_term(text: Column, aliases: Column) -> Column:
    norm = normalise_term(text)
    return F.exists(aliases, lambda a: norm.contains(normalise_term(a)))


def parse_list(column: Column) -> Column:
    """EXP-6: items of a JSON list, a JSON scalar, or a comma-separated text."""
    text = F.trim(F.coalesce(column, F.lit("")))
    as_list = F.from_json(text, "array<string>")
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    split = F.transform(F.split(text, ","), lambda x: F.trim(x))
    items = F.when(text.startswith("[") & as_list.isNotNull(), as_list).when(text.startswith('"') & scalar.isNotNull(), F.array(scalar)).otherwise(split)
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def parse_refs(column: Column) -> Column:
    """EXP-7: references from objects (doc_id or id), ``library:id`` or digits; others are dropped."""

    def one(item):
        number = F.coalesce(F.get_json_object(item, "$.doc_id"), F.get_json_object(item, "$.id"))
        plain = F.regexp_extract(item, r"^(?:\w+:)?(\d+)$", 1)
        library = F.coalesce(F.get_json_object(item, "$.library"), F.nullif(F.regexp_extract(item, r"^(\w+):\d+$", 1), F.lit("")), F.lit("knowledge"))
        return F.struct(library.alias("library"), F.coalesce(number, F.nullif(plain, F.lit(""))).cast("long").alias("doc_id"))

    return F.filter(F.transform(parse_list(column), one), lambda r: r["doc_id"].isNotNull())


def parse_tag_ids(column: Column) -> Column:
    """EXP-8: distinct whole numbers of a list in any of its forms, full-width commas included."""
    return F.transform(F.array_distinct(F.filter(parse_list(F.translate(column, "，", ",")), lambda x: x.rlike("^[0-9]+$"))), lambda x: x.cast("int"))


def stable_key(columns: list[Column], algorithm: str = "sha1", n: int = 12) -> Column:
    """EXP-9: the first ``n`` hex digits of a hash of the columns joined by a bar; null reads as nothing."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary")
    return F.left(F.sha1(text) if algorithm == "sha1" else F.sha2(text, 256), F.lit(n))


def query_key(column: Column) -> Column:
    """EXP-10: small letters without blanks and punctuation; symbols stay."""
    return F.regexp_replace(F.lower(column), r"[\s\p{P}]", "")


def clean_title(column: Column, fallback: str = "untitled") -> Column:
    """EXP-11: trimmed and squeezed, at most 100 characters, never empty."""
    text = F.left(single(column), F.lit(100))
    return F.when(text == "", fallback).otherwise(text)


def han_part(column: Column) -> Column:
    """EXP-11: of a label with parts in several scripts the one that has Han characters, if there is just one."""
    parts = F.filter(F.split(column, r"\s*/\s*"), lambda p: p.rlike(f"[{CJK}]"))
    return F.when(F.size(parts) == 1, parts[0]).otherwise(column)


_HAN = "一二三四五六七八九"


def _han_number(text: Column) -> Column:
    """1 to 99 in Han numerals; null for anything else."""
    digit = lambda c: F.when(F.length(c) == 1, F.nullif(F.instr(F.lit(_HAN), c), F.lit(0)))
    tens, ones = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    with_ten = F.coalesce(digit(tens), F.when(tens == "", 1), F.lit(0)) * 10 + F.coalesce(digit(ones), F.lit(0))
    return F.when(text.contains("十"), with_ten).otherwise(digit(text))


def section_marker(column: Column) -> Column:
    """EXP-13: (marker, level) of a heading.

    The marker is a dotted number (wide dots as plain ones) or a Han numeral as digits, where a
    mark or blank follows; else empty. The level is the count of number signs, or of the number's
    parts, 6 at most, else 1.
    """
    text = strip(column)
    hashes = F.regexp_extract(text, r"(?U)\A(#{1,6})\s", 1)
    dotted = F.translate(F.regexp_extract(text, r"(?U)\A(\d+(?:[.．]\d+)*)[、.．\s]", 1), "．", ".")
    han = _han_number(F.regexp_extract(text, r"(?U)\A([一二三四五六七八九十]+)[、.．\s]", 1))
    marker = F.when(dotted != "", dotted).otherwise(F.coalesce(F.nullif(han, F.lit(0)).cast("string"), F.lit("")))
    parts = F.least(F.size(F.split(dotted, r"\.")), F.lit(6))
    level = F.when(hashes != "", F.length(hashes)).when(dotted != "", parts).otherwise(1)
    return F.struct(marker.alias("marker"), level.alias("level"))


def document_code(column: Column) -> Column:
    """EXP-14."""
    return F.concat(F.lit("KB-"), F.lpad(column.cast("string"), 6, "0"))


OFFSET = 1_000_000_000


def encode_id(column: Column, library: Column) -> Column:
    """EXP-15: ids of the knowledge library are moved by a fixed offset."""
    return F.when(library == "knowledge", column + OFFSET).otherwise(column)


def decode_id(column: Column) -> Column:
    return F.struct(F.when(column >= OFFSET, "knowledge").otherwise("breakdown").alias("library"), (column % OFFSET).alias("id"))
