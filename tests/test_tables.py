"""Pipe tables on literal texts."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, tables

RULE = "| --- | :---: |"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def rows(spark, text):
    return [(r.table_no, r.line, r.header, r.row_no, r.cells) for r in tables.extract_tables(docs(spark, text)).orderBy("table_no", "row_no").collect()]


def test_tables_and_what_is_none(spark):
    text = "intro\n| a | b |\n" + RULE + "\n| 1 | 2 |\n  || x |  \n|\n\n| no | rule |\n| 1 | 2 |\n| only |\nend\n| c |\n| --- |\n| a | b\n| h | i |\n" + RULE
    assert rows(spark, text) == [
        (1, 1, ["a", "b"], 1, ["1", "2"]), (1, 1, ["a", "b"], 2, ["x"]), (1, 1, ["a", "b"], 3, [""]), (2, 14, ["h", "i"], None, None),
    ]
    assert rows(spark, None) == rows(spark, "") == rows(spark, "| a |") == []
    rest = tables.without_tables(docs(spark, text, None, "  \n x \n")).orderBy("doc_id").collect()
    assert rest[0].rest.split("\n") == ["intro", "【表格：a / b，共3行，已按表格记录单独向量化。】", "| no | rule |", "| 1 | 2 |", "| only |", "end", "| c |", "| --- |", "| a | b", "【表格：h / i，共0行，已按表格记录单独向量化。】"]
    assert [r.rest for r in rest[1:]] == ["", "x"]


@pytest.mark.parametrize("header,record", [
    (["Error Code", "x"], True), (["设备名称", "原 因"], True), (["编码", "名称"], True), (["code", "x"], False), (["description", "position"], True), (["description", "Description!"], False), ([""], False), (["错误码表"], True),
])
def test_record_headers(spark, header, record):
    df = spark.createDataFrame([(header,)], "h array<string>")
    assert df.select(tables.is_record_header(F.col("h"))).first()[0] is record


def test_chunks(spark):
    records = "| Error Code |  | 处理方法 |\n| --- | --- | --- |\n| E1 | two | |\n|  |  |  |\n| E2 | | fix | more |"
    plain = "| a | b |\n" + RULE + "\n" + "\n".join(f"| {i} |" for i in range(40)) + "\n| x | y | z |"
    got = tables.table_chunks(tables.extract_tables(docs(spark, records + "\n\n" + plain))).orderBy("table_no", "chunk_no").collect()
    assert [(r.table_no, r.chunk_no, r.kind, r.row_start, r.row_end) for r in got] == [(1, 0, "record_row", 1, 1), (1, 2, "record_row", 3, 3), (2, 0, "row_group", 1, 18), (2, 1, "row_group", 19, 36), (2, 2, "row_group", 37, 41)]
    assert got[0].text == "Error Code: E1\n字段2: two" and got[0].embedding_text == got[0].text + "\nE1 two"
    assert got[1].text == "Error Code: E2\n处理方法: fix\n字段4: more"
    assert got[4].text.split("\n") == ["| a | b |  |", "| --- | --- | --- |", "| 36 |  |  |", "| 37 |  |  |", "| 38 |  |  |", "| 39 |  |  |", "| x | y | z |"]


def test_a_large_table_leaves_row_by_row(spark):
    n = 30_000
    text = "| a | b |\n" + RULE + "\n" + "\n".join(f"| {i} | v |" for i in range(n))
    found = tables.extract_tables(docs(spark, text))
    assert found.count() == n and found.agg(F.max("row_no")).first()[0] == n


def test_short_sections_and_blocks(spark):
    rows_ = [(1, 0, "x" * 100, "A"), (1, 1, "short", "B"), (1, 2, "| t | u |", ""), (1, 3, "s", "D"), (2, 0, "tiny", None), (2, 1, None, "Z")]
    df = spark.createDataFrame(rows_, "doc_id int, position int, body string, title string")
    got = [(r.doc_id, r.position, r.merged, r.title) for r in chunking.merge_short(df, title="title").orderBy("doc_id", "position").collect()]
    assert got == [(1, 0, 2, "A / B"), (1, 2, 2, "D"), (2, 0, 2, "Z")]
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(["# one", "a" * 9, "b" * 9, "| t |", "| u |", "tail", "# two", "c"])], "doc_id int, line int, s string")
    got = [(r.block, r.part, r.first_line, r.n_lines, r.title, r.is_table) for r in chunking.heading_blocks(lines, F.col("s").startswith("#"), 12, table=F.col("s").startswith("|")).orderBy("first_line").collect()]
    assert got == [(1, 0, 0, 2, "# one", False), (1, 1, 2, 1, "# one", False), (2, 0, 3, 2, "# one", True), (3, 0, 5, 1, "# one", False), (4, 0, 6, 2, "# two", False)]
