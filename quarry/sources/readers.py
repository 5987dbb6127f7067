"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-1: a typed scan of one table of the domain model."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{directory}/{name}.parquet")


QA = "question string, answer string, ground_truth string, source_text string, source_file string"


def read_qa(spark: SparkSession, path: str, *, lines: bool = True) -> DataFrame:
    """SRC-2: question and answer pairs from JSON lines or a JSON array; malformed lines are dropped."""
    df = spark.read.schema(QA).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(path)
    return df.select("question", F.coalesce("answer", "ground_truth").alias("answer"), "source_text", "source_file").filter("question is not null")


def read_text_only(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: JSON lines with exactly the key ``text``; any other line fails the read."""
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("m", F.from_json("value", "map<string,string>"))
    good = F.col("m").isNotNull() & (F.map_keys("m") == F.array(F.lit("text")))
    return rows.select(F.when(good, F.col("m")["text"]).otherwise(F.raise_error(F.concat(F.lit("not a text-only line: "), F.left("value", F.lit(80))))).alias("text"))


def read_string_csv(spark: SparkSession, path: str, *, encoding: str = "UTF-8", max_rows: int = 2000) -> DataFrame:
    """SRC-4: a CSV of strings; blank names become ``column_i``, all-null rows and columns go; at most ``max_rows`` rows (the feature's limit)."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, multiLine=True)
    df = df.toDF(*[f"column_{i + 1}" if not c.strip() or c.startswith("_c") else c.strip() for i, c in enumerate(df.columns)]).dropna("all").limit(max_rows)
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if filled[i]])


def scan_chunk_metadata(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """SRC-5: the index without its vectors; the scan does not read that column."""
    return chunks.select(*[c for c in chunks.columns if c != vector])


def replace_chunks(existing: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """SNK-1: the index with all chunks of the new rows' documents replaced."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_version(chunks: DataFrame, versions: DataFrame, key: str = "version_id") -> DataFrame:
    """SNK-2: the index without the chunks of some versions."""
    return chunks.join(versions.select(key).distinct(), key, "left_anti")


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """SNK-3: text that a sheet would run as a formula is quoted."""
    return df.select(*[F.regexp_replace(c, r"^([=+\-@])", "'$1").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
