"""Corpus chunking over text that is already extracted. Folds run inside one row or one group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.blanks import squeeze, strip
from quarry.sources.lineage import materialise


def window_chunks(docs: DataFrame, size: int, overlap: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-1: windows of ``size`` words that share ``overlap`` words: doc_id, chunk_index, chunk, n_words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    n, step = F.size("w"), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step) - 1, F.lit(0)).cast("int"))
    base = docs.select(doc_id, words.alias("w")).filter(F.size("w") > 0)
    parts = base.select(doc_id, F.posexplode(F.transform(starts, lambda i: F.slice("w", i * step + 1, F.lit(size)))).alias("chunk_index", "part"))
    return parts.select(doc_id, "chunk_index", F.array_join("part", " ").alias("chunk"), F.size("part").alias("n_words"))


def _pack(pieces: Column, budget: int, joiner: str, tail: int = 0) -> Column:
    """Greedy packing of an array of texts into chunks of at most ``budget`` characters; the last ``tail`` ones of a chunk open the next."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, piece):
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(piece) + len(joiner) > budget)
        head = F.right(acc["cur"], F.lit(tail)) if tail else F.lit("")
        joined = F.when(acc["cur"] == "", piece).otherwise(F.concat(acc["cur"], F.lit(joiner), piece))
        fresh = F.when(head == "", piece).otherwise(F.concat(head, F.lit(joiner), piece))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(full, fresh).otherwise(joined).alias("cur"))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def words_in(text: Column) -> Column:
    """The default token count: words of letters and digits, and every other visible character."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1)))


def pack_paragraphs(docs: DataFrame, budget: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-2: paragraphs (lines) packed while their tokens stay within a budget; a paragraph over it is a chunk of its own, cut to it.

    Tokens are words and single marks, so counts of lines add up, and a text is packed by
    sums over its lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda p: strip(p)), lambda p: p != "")
    counted = F.transform(lines, lambda p: F.struct(p.alias("p"), words_in(p).alias("n")))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(acc, row):
        full = (F.size(acc["cur"]) > 0) & (acc["n"] + row["n"] > budget)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(row["p"])).otherwise(F.concat(acc["cur"], F.array(row["p"]))).alias("cur"),
            F.when(full, row["n"]).otherwise(acc["n"] + row["n"]).alias("n"),
        )

    packed = F.aggregate(counted, zero, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
    head = rf"^(?:\s*(?:[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}])){{0,{budget}}}+"  # possessive: a loop, where a greedy group would recurse for each token
    chunk = F.transform(packed, lambda c: F.regexp_extract(F.array_join(c, "\n"), head, 0))
    return docs.select(doc_id, F.posexplode(chunk).alias("chunk_index", "chunk"))


def overlap_split(docs: DataFrame, most: int = 1800, overlap: int = 180, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-4: words packed by characters, each chunk opening with the tail of the one before."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda p: p != "")
    return docs.select(doc_id, F.posexplode(_pack(pieces, most, " ", overlap)).alias("chunk_index", "chunk"))


def _cuts(text: str, budget: int) -> list[str]:
    """Pieces of at most ``budget`` characters that join to the text: at a line end, else a sentence end in the second half, else anywhere."""
    out = []
    while len(text) > budget:
        at = text.rfind("\n", budget // 2, budget) + 1
        if not at:
            at = max(text.rfind(c, budget // 2, budget) for c in ".!?。！？") + 1
        at = at or budget
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def lossless_split(docs: DataFrame, budget: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-3: pieces whose concatenation is the text. Map-only; a cut depends on what is left of the text, so no fold."""

    def run(frames):
        for pdf in frames:
            rows = [(i, j, piece) for i, t in zip(pdf["id_"], pdf["t_"]) for j, piece in enumerate(_cuts(t or "", budget))]
            yield pd.DataFrame(rows, columns=[doc_id, "chunk_index", "chunk"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("t_")).mapInPandas(run, f"{doc_id} {kind}, chunk_index int, chunk string")


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(doc_id, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "s"))


def table_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """Runs of lines with bars: doc_id, table_no, first line and number of lines (gaps and islands)."""
    w = W.partitionBy(doc_id).orderBy("line")
    rows = lines_of(docs, doc_id, text).withColumn("bar", F.col("s").contains("|")).withColumn("run", F.sum(F.when(F.col("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    return rows.filter("bar").groupBy(doc_id, F.col("run").alias("table_no")).agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max(F.size(F.split("s", r"\|"))).alias("n_cells")).filter(F.col("n_lines") >= least)


def batch_rows(rows: DataFrame, most_rows: int, most_chars: int, *, key: str = "table") -> DataFrame:
    """CHK-7: greedy batches of ordered rows (n, t) by number and characters: key, batch (from 0), first n, number of rows.

    Rows stream through a task in order, and only the open batch's totals are held.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        now, batch, first, count, chars = None, 0, 0, 0, 0
        for pdf in frames:
            out = []
            for k, n, size in zip(pdf["k"], pdf["n"], pdf["size"]):
                if k != now or count >= most_rows or chars + size > most_chars:
                    if count:
                        out.append((now, batch, first, count))
                    batch = batch + 1 if k == now else 0
                    now, first, count, chars = k, n, 0, 0
                count, chars = count + 1, chars + size
            yield pd.DataFrame(out, columns=[key, "batch", "first", "n_rows"])
        if count:
            yield pd.DataFrame([(now, batch, first, count)], columns=[key, "batch", "first", "n_rows"])

    sized = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("n").cast("long").alias("n"), F.length(F.coalesce("t", F.lit(""))).alias("size"))
    return sized.repartition("k").sortWithinPartitions("k", "n").mapInPandas(run, f"{key} {kind}, batch int, first long, n_rows long")


def assemble_chunks(pieces: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """CHK-8: chunks with a title prefix, a stable id and their metadata as JSON."""
    joined = pieces.join(docs.select(doc_id, "title", "library"), doc_id)
    text = F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), "chunk")
    meta = F.to_json(F.struct("library", F.col(doc_id).alias("source_doc_id"), "chunk_index"))
    return joined.select(doc_id, "chunk_index", F.left(F.sha1(F.concat_ws("|", "library", F.col(doc_id).cast("string"), F.col("chunk_index").cast("string")).cast("binary")), F.lit(16)).alias("chunk_id"), text.alias("text"), meta.alias("metadata"))


def field_chunks(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """CHK-9: one chunk for each non-blank field."""
    part = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("chunk")) for f in fields])).alias("p")
    return df.select(row_id, part).select(row_id, "p.field", "p.chunk").filter(F.trim("chunk") != "")


def tree_paths(nodes: DataFrame, sep: str = " / ") -> DataFrame:
    """CHK-10, QLT-16: the path and depth of every node (id, parent_id, name) of a forest of any depth.

    Each round joins a node's open path with that of the node above it, so the number of
    rounds is the logarithm of the depth. Nodes under no root (a cycle) have no path.
    """
    paths = nodes.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.lit(1).alias("depth"))
    left = None
    while True:
        paths = materialise(paths, "paths")
        before, left = left, paths.filter("up is not null").count()
        if not left or left == before:
            return paths.filter("up is null").select("id", "path", "depth")
        above = paths.select(F.col("id").alias("above"), F.col("up").alias("above_up"), F.col("path").alias("above_path"), F.col("depth").alias("above_depth"))
        joined = paths.join(above, F.col("up") == F.col("above"), "left").filter("up is null or above is not null")
        paths = joined.select("id", "above_up", "path", "above_path", "depth", "above_depth").select(
            "id", F.col("above_up").alias("up"), F.concat_ws(sep, "above_path", "path").alias("path"), (F.col("depth") + F.coalesce("above_depth", F.lit(0))).alias("depth")
        )


def tree_chunks(nodes: DataFrame) -> DataFrame:
    """CHK-10: the path of each leaf, and each node with more than one child with its children's names."""
    paths = tree_paths(nodes)
    kids = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("kids"), F.count(F.lit(1)).alias("n"))
    leaves = paths.join(kids, paths["id"] == kids["parent_id"], "left_anti").select("id", F.lit("path").alias("kind"), F.col("path").alias("chunk"))
    branches = paths.join(kids.filter("n > 1"), paths["id"] == kids["parent_id"]).select("id", F.lit("branch").alias("kind"), F.concat_ws(": ", "path", "kids").alias("chunk"))
    return leaves.unionByName(branches)


def merge_short(sections: DataFrame, least: int = 80, *, doc_id: str = "doc_id", title: str | None = None) -> DataFrame:
    """CHK-11: sections under ``least`` non-blank characters and without a table join the one before; their titles, where there are any, are joined by a slash."""
    w = W.partitionBy(doc_id).orderBy("position")
    short = (F.length(squeeze("body")) < least) & ~F.coalesce("body", F.lit("")).rlike(r"(?m)^[ \t]*\|.*\|[ \t]*$")
    rows = sections.withColumn("g", F.sum(F.when(short & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("position", F.coalesce("body", F.lit("")).alias("body"), *([F.col(title).alias("title")] if title else []))))
    named = [F.array_join(F.filter(parts["title"], lambda x: x != ""), " / ").alias("title")] if title else []
    return rows.groupBy(doc_id, "g").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("merged"), F.array_join(parts["body"], "\n").alias("body"), *named)


def heading_blocks(lines: DataFrame, heading: Column, cap: int, *, doc_id: str = "doc_id", table: Column | None = None) -> DataFrame:
    """CHK-12: blocks that a heading opens, cut where they pass ``cap`` characters, with the last heading carried along.

    A run of ``table`` lines is a block of its own, and is not cut.
    """
    w = W.partitionBy(doc_id).orderBy("line")
    rows = lines.withColumn("h", F.coalesce(heading, F.lit(False))).withColumn("t", F.lit(False) if table is None else F.coalesce(table, F.lit(False)))
    opens = F.col("h") | (F.col("t") != F.coalesce(F.lag("t").over(w), F.lit(False)))
    rows = rows.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(w)).withColumn("title", F.last(F.when(F.col("h"), F.col("s")), ignorenulls=True).over(w))
    b = W.partitionBy(doc_id, "block").orderBy("line")
    before = F.coalesce(F.sum(F.length("s")).over(b.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", F.when(F.col("t"), 0).otherwise(F.floor(before / cap)))
    return rows.groupBy(doc_id, "block", "part").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.min("title").alias("title"), F.bool_or("t").alias("is_table"))


def fill_markers(sections: DataFrame, *, doc_id: str = "doc_id", levels: int = 6) -> DataFrame:
    """CHK-13: outline numbers from levels (1 to 6): a fold with one counter per level."""
    zero = F.struct(F.array(*[F.lit(0)] * levels).alias("c"), F.array().cast("array<struct<position:bigint,marker:string>>").alias("out"))

    def step(acc, row):
        c = F.transform(acc["c"], lambda v, i: F.when(i + 1 < row["level"], F.greatest(v, F.lit(1))).when(i + 1 == row["level"], v + 1).otherwise(0))
        marker = F.array_join(F.transform(F.slice(c, F.lit(1), row["level"]), lambda v: v.cast("string")), ".")
        return F.struct(c.alias("c"), F.concat(acc["out"], F.array(F.struct(row["position"].alias("position"), marker.alias("marker")))).alias("out"))

    rows = sections.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), F.col("level").cast("int").alias("level")))).alias("rows"))
    return rows.select(doc_id, F.inline(F.aggregate("rows", zero, step, lambda a: a["out"])))


def parse_directory(lines: DataFrame, column: str = "s") -> DataFrame:
    """CHK-14: marker, title, page and level of the lines of a table of contents."""
    pattern = r"^\s*(\d+(?:\.\d+)*)\s+(.*?)\s*\.{2,}\s*(\d+)\s*$"
    got = lambda i: F.regexp_extract(column, pattern, i)
    return lines.filter(F.col(column).rlike(pattern)).select("*", got(1).alias("marker"), got(2).alias("title"), got(3).cast("int").alias("page"), F.size(F.split(got(1), r"\.")).alias("level"))


def fit_context(refs: DataFrame, most: int, *, query: str = "query_id") -> DataFrame:
    """CHK-15: blocks in rank order until the budget is full; the last one is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return refs.withColumn("before", before).filter(F.col("before") < most).withColumn("text", F.left("text", (most - F.col("before")).cast("int"))).drop("before")
