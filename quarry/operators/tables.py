"""Pipe tables in texts (CHK-5, CHK-6): found line by line in one pass, then chunked by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunking import pack_paragraphs

#: A separator line, and what makes a header that of records.
SEPARATOR = re.compile(r"^\|\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$")
RECORD_KEYS = (
    "devicecode errorcode code 错误码 错误代码 故障码 报警码 description vendorcode workflowstep devicename position 设备码 设备名称 描述 处理方法 原因 解决方案".split()
)
GROUP_ROWS = 18
_ROW = "table_no int, line int, header array<string>, row_no int, cells array<string>"


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def runs(text: str) -> Iterator[tuple[int, list[str], bool]]:
    """(first line, lines, whether they are a table) of a text: runs of lines between bars, of which the second is a separator, and what lies between."""
    start, held, bars = 0, [], False
    for i, line in enumerate(text.splitlines()):
        bar = (s := line.strip()).startswith("|") and s.endswith("|")
        if held and bar != bars:
            yield start, held, bars and len(held) > 1 and bool(SEPARATOR.match(held[1].strip()))
            start, held = i, []
        held.append(line)
        bars = bar
    if held:
        yield start, held, bars and len(held) > 1 and bool(SEPARATOR.match(held[1].strip()))


def extract_tables(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-5: doc_id, table_no (from 1), line (of the header, from 0), header, row_no (from 1) and cells of every row of every table.

    Null texts have none. A table without rows gives one row with a null row_no. Rows leave
    as they are read, so that a large table is never held.
    """
    schema = T.StructType([docs.schema[doc_id], *T.StructType.fromDDL(_ROW).fields])

    def rows(batches):
        for batch in batches:
            for key, body in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                n = 0
                for line, held, table in runs(body or ""):
                    n += table
                    if table:
                        header = _cells(held[0])
                        for j, row in enumerate(held[2:], 1):
                            yield key, n, line, header, j, _cells(row)
                        if len(held) == 2:
                            yield key, n, line, header, None, None

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(schema), []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
        for row in rows(batches):
            held.append(row)
            if len(held) == 5000:
                yield pack()
                held.clear()
        if held:
            yield pack()

    return docs.select(doc_id, text).mapInArrow(run, schema)


def without_tables(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CHK-5: each text with a one-line stub in the place of a table, and without blank lines."""

    def rest(body: str) -> str:
        kept = []
        for _, held, table in runs(body):
            stub = f"【表格：{' / '.join(c for c in _cells(held[0]) if c)}，共{len(held) - 2}行，已按表格记录单独向量化。】" if table else None
            kept += [stub] if table else [x for x in held if x.strip()]
        return "\n".join(kept).strip()

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda x: rest(x or ""))

    return docs.select(doc_id, run(F.col(text)).alias("rest"))


def is_record_header(header: Column) -> Column:
    """CHK-6: whether rows of a table with this header are records of their own: codes and names."""
    keys = F.array_distinct(F.filter(F.transform(header, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9一-鿿]+", "")), lambda k: k != ""))
    any_of = lambda *words: F.exists(keys, lambda k: F.greatest(*[k.contains(w).cast("int") for w in (*words, words[0])]) > 0)
    known = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in RECORD_KEYS]))) >= 2
    return known | any_of("errorcode", "错误码") | (any_of("code", "码") & any_of("name", "名称"))


def _field_text(header: Column, cells: Column) -> Column:
    """``key: value`` lines of the cells that hold something; a column without a name is ``字段`` and its number."""
    n = F.greatest(F.size(header), F.size(cells))

    def line(i):
        key = F.coalesce(F.nullif(F.trim(F.get(header, i)), F.lit("")), F.concat(F.lit("字段"), (i + 1).cast("string")))
        value = F.trim(F.get(cells, i))
        return F.when(value != "", F.concat(key, F.lit(": "), value))

    return F.array_join(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), line)), "\n")


def _rendered(rows: Column) -> Column:
    """Rows as a pipe table of even width; rows of blanks are left out, and the first of the others is the header."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    clean = F.transform(full, lambda r: F.transform(r, lambda c: F.trim(F.replace(c, F.lit("|"), F.lit(" ")))))

    def drawn(table):
        wide = F.array_max(F.transform(table, lambda r: F.size(r)))
        lines = F.transform(table, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")

    return F.when(F.size(full) > 0, F.transform(F.array(clean), drawn)[0]).otherwise("")


def table_chunks(rows: DataFrame, *, doc_id: str = "doc_id", group: int = GROUP_ROWS) -> DataFrame:
    """CHK-6: chunks of tables as ``extract_tables`` gives them: doc_id, table_no, chunk_no (from 0), kind, row_start, row_end, line, text, embedding_text.

    A table of records gives a chunk for each row that holds something, as lines of key and
    value (for embedding, with the bare values below); any other gives groups of ``group``
    rows under its header.
    """
    full = rows.filter("row_no is not null").withColumn("record", is_record_header(F.col("header")))
    text = _field_text(F.col("header"), F.col("cells"))
    values = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    records = full.filter("record").withColumn("text", text).filter("text <> ''")
    keys = [doc_id, "table_no"]
    records = records.select(*keys, (F.col("row_no") - 1).alias("chunk_no"), F.lit("record_row").alias("kind"), F.col("row_no").alias("row_start"), F.col("row_no").alias("row_end"), "line", "text", F.concat_ws("\n", "text", F.nullif(values, F.lit(""))).alias("embedding_text"))
    parts = full.filter("not record").withColumn("chunk_no", F.floor((F.col("row_no") - 1) / group).cast("int"))
    parts = parts.groupBy(*keys, "chunk_no").agg(F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"), F.first("line").alias("line"), F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("row_no", "cells")))["cells"].alias("rows"))
    parts = parts.withColumn("text", _rendered(F.concat(F.array("header"), F.col("rows")))).filter("text <> ''")
    return records.unionByName(parts.select(*keys, "chunk_no", F.lit("row_group").alias("kind"), "row_start", "row_end", "line", "text", F.col("text").alias("embedding_text")))


def assemble_sections(docs: DataFrame, sections: DataFrame, *, budget: int = 1200, doc_id: str = "doc_id") -> DataFrame:
    """CHK-8: every chunk of sections, texts and tables, with its prefix, a stable chunk_id and its metadata as JSON.

    ``docs`` have doc_id, title and tags; ``sections`` section_id, doc_id, section_title,
    marker, heading_path, text and images (arrays may be null). The prefix lists tags, title,
    marker, section title (the document's where there is none) and, for texts, the path of
    headings. A text without its tables is packed by paragraphs within ``budget`` tokens; a
    section of images only has a chunk that names it; one of neither has none.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    own = docs.select(doc_id, text("title").alias("title"), F.array_join(F.filter(F.coalesce("tags", none), lambda x: x != ""), "，").alias("tags"))
    base = sections.select(
        doc_id, "section_id", "section_title", text("marker").alias("marker"), F.array_join(F.coalesce("heading_path", none), " / ").alias("path"), text("text").alias("text"), F.size(F.coalesce("images", none)).alias("n_images")
    ).join(own, doc_id).withColumn("section_title", F.coalesce(F.nullif(text("section_title"), F.lit("")), "title"))
    rest = without_tables(base.select("section_id", "text"), doc_id="section_id").withColumnRenamed("rest", "text")
    packed = pack_paragraphs(rest, budget, doc_id="section_id")
    named = base.filter("n_images > 0").select("section_id", F.lit(0).alias("chunk_index"), F.concat(F.lit("图片所在章节："), "section_title").alias("chunk"))
    packed = packed.unionByName(named.join(packed.select("section_id").distinct(), "section_id", "left_anti"))
    line = lambda name, c: F.concat(F.lit(f"{name}："), F.col(c))
    head = [F.when(F.col("tags") != "", line("标签", "tags")), line("文档标题", "title"), line("目录编号", "marker"), line("目录标题", "section_title")]
    key = F.col("section_id").cast("string")
    texts = base.join(packed, "section_id").withColumns({
        "content": F.concat_ws("\n", *head, F.when(F.col("path") != "", line("章节路径", "path")), line("章节正文", "chunk")),
        "chunk_id": F.concat(F.lit("knowledge-section-"), key, F.lit("-text-"), F.col("chunk_index").cast("string")), "kind": F.lit("section_text"), "table_no": F.lit(None).cast("int"),
    })
    tabled = table_chunks(extract_tables(base.select("section_id", "text"), doc_id="section_id"), doc_id="section_id").withColumnRenamed("text", "chunk")
    rows = F.concat(F.lit("表格"), F.col("table_no").cast("string"), F.lit(" 行 "), F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string"), F.lit("："))
    parts = base.join(tabled, "section_id").withColumns({
        "content": F.concat_ws("\n", *head, rows, "chunk"), "embedding_content": F.concat_ws("\n", *head, "embedding_text"), "chunk_index": F.col("chunk_no"),
        "chunk_id": F.concat(F.lit("knowledge-table-section-"), key, F.lit("-t"), F.col("table_no").cast("string"), F.lit("-g"), F.col("chunk_no").cast("string")),
    })
    columns = [doc_id, "section_id", "chunk_id", "kind", "table_no", "chunk_index", "content", "embedding_content"]
    both = texts.withColumn("embedding_content", F.col("content")).select(*columns, "section_title", "marker").unionByName(parts.select(*columns, "section_title", "marker"))
    meta = F.to_json(F.struct(F.col(doc_id).alias("source_doc_id"), "section_id", "section_title", F.col("marker").alias("section_type"), F.col("chunk_index").alias("subchunk_index"), "kind", "chunk_id", F.length("content").alias("chunk_size")))
    return both.withColumn("metadata", meta).select(*columns, "metadata")
