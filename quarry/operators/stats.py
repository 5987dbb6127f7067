"""Aggregations of the knowledge base: statistics, dashboards, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def library_statistics(docs: DataFrame, reviews: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-1: per library live, vectorised and other documents, pending reviews and source files."""
    a = docs.filter("is_deleted = 0").groupBy("library").agg(F.count(F.lit(1)).alias("documents"), count_where(F.col("vectorized") == 1).alias("vectorized"), count_where(F.col("vectorized") == 0).alias("waiting"))
    b = reviews.filter("status = 'pending'").groupBy("library").agg(F.count(F.lit(1)).alias("pending_reviews"))
    c = files.groupBy("library").agg(F.count(F.lit(1)).alias("source_files"))
    names = ["documents", "vectorized", "waiting", "pending_reviews", "source_files"]
    return a.join(b, "library", "full_outer").join(c, "library", "full_outer").select("library", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def category_counts(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """AGG-2: documents of every category, and of none."""
    counts = docs.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    known = categories.join(counts, categories["id"] == counts["category_id"], "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    lost = counts.join(categories, counts["category_id"] == categories["id"], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return known.unionByName(lost.select(F.lit("uncategorised").alias("name"), "n"))


IMAGE_TOKENS, REFERENCE_TOKENS = 578, 258


def token_summary(usage: DataFrame, messages: DataFrame) -> DataFrame:
    """AGG-3: token sums, calls, the parse share, tokens of each message role, and what images and references cost."""
    parse = F.col("request_type").startswith("parse")
    a = usage.agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("calls"),
        F.sum(F.when(parse, F.col("total_tokens")).otherwise(0)).alias("parse_tokens"), F.round(F.avg("total_tokens")).cast("long").alias("mean_tokens"),
        (count_where(F.col("request_type") == "parse_image") * IMAGE_TOKENS).alias("image_tokens"),
    )
    b = messages.agg(
        F.sum(F.when(F.col("role") == 1, F.col("token_count")).otherwise(0)).alias("question_tokens"), F.sum(F.when(F.col("role") == 0, F.col("token_count")).otherwise(0)).alias("answer_tokens"),
        (count_where(F.col("ai_reference_doc_ids") != "") * REFERENCE_TOKENS).alias("reference_tokens"),
    )
    return a.crossJoin(b).withColumn("qa_tokens", F.col("total_tokens") - F.col("parse_tokens"))


def business(column: Column) -> Column:
    return F.when(column.startswith("parse"), "parse").otherwise("qa")


def token_daily(usage: DataFrame, first: str, last: str) -> DataFrame:
    """AGG-4: tokens by day and business type, with a row of zeros for days without calls."""
    days = usage.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    parse = F.col("request_type").startswith("parse")
    per = usage.groupBy(F.to_date("created_time").alias("day")).agg(F.sum(F.when(parse, F.col("total_tokens")).otherwise(0)).alias("parse_tokens"), F.sum(F.when(~parse, F.col("total_tokens")).otherwise(0)).alias("qa_tokens"))
    return days.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("parse_tokens", F.lit(0)).alias("parse_tokens"), F.coalesce("qa_tokens", F.lit(0)).alias("qa_tokens"))


def token_months(usage: DataFrame) -> DataFrame:
    """AGG-4: tokens of each month with calls by business type, and their sum up to then: the month's total and the whole history."""
    parse = F.coalesce(F.col("request_type").startswith("parse"), F.lit(False))
    per = usage.filter("created_time is not null").groupBy(F.date_format("created_time", "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum(F.when(parse, F.col("total_tokens"))), F.lit(0)).alias("parse_tokens"), F.coalesce(F.sum(F.when(~parse, F.col("total_tokens"))), F.lit(0)).alias("qa_tokens")
    )
    total = per.withColumn("month_total", F.col("parse_tokens") + F.col("qa_tokens"))
    return total.withColumn("so_far", F.sum("month_total").over(W.partitionBy(F.lit(0)).orderBy("month")))  # a row a month


def token_hourly(usage: DataFrame, day: str) -> DataFrame:
    """AGG-5: tokens of each of a day's 24 hours."""
    hours = usage.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    per = usage.filter(F.to_date("created_time") == F.lit(day).cast("date")).groupBy(F.hour("created_time").alias("hour")).agg(F.sum("total_tokens").alias("tokens"))
    return hours.join(per, "hour", "left").select("hour", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def trend_series(facts: dict[str, DataFrame], slices: list[tuple[str, int, int, int]]) -> DataFrame:
    """AGG-6: counts of each fact table (column ``sec``) in slices (range name, number, start, end), zeros included.

    The slices are a small literal table; each fact table is read once.
    """
    spark = next(iter(facts.values())).sparkSession
    rows = F.array(*[F.struct(F.lit(n).alias("range"), F.lit(i).alias("slice"), F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end")) for n, i, s, e in slices])
    grid = F.broadcast(spark.range(1).select(F.inline(rows)))
    out = grid.select("range", "slice")
    for name, df in facts.items():
        counts = df.join(grid, (F.col("sec") >= F.col("start")) & (F.col("sec") < F.col("end"))).groupBy("range", "slice").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, ["range", "slice"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def active_users(sources: list[DataFrame]) -> DataFrame:
    """AGG-7: distinct users over all activity sources."""
    union = sources[0].select("user_id")
    for df in sources[1:]:
        union = union.unionByName(df.select("user_id"))
    return union.agg(F.count_distinct("user_id").alias("active_users"))


def tag_usage(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """AGG-8: documents of each tag (unknown tags do not count), those without a known tag, and whether a tag is frequent."""
    each = docs.select("doc_id", F.explode(F.array_distinct("tag_ids")).alias("tag_id")).join(tags.select("tag_id"), "tag_id", "left_semi")
    counts = each.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    per = tags.join(counts, "tag_id", "left").select(F.col("name"), F.coalesce("n", F.lit(0)).alias("n"))
    none = docs.join(each.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("untagged").alias("name"), "n")
    return per.unionByName(none).withColumn("frequent", F.col("n") >= 2)


def tag_counts(docs: DataFrame, reviews: DataFrame, tags: DataFrame) -> DataFrame:
    """AGG-9: documents and pending reviews of each tag."""
    def per(df, name):
        return df.select(F.explode(F.array_distinct("tag_ids")).alias("tag_id")).groupBy("tag_id").agg(F.count(F.lit(1)).alias(name))

    joined = tags.join(per(docs, "documents"), "tag_id", "left").join(per(reviews, "pending"), "tag_id", "left")
    return joined.select("tag_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("pending", F.lit(0)).alias("pending"))


def hot_documents(refs: DataFrame, k: int) -> DataFrame:
    """AGG-10: the ``k`` most often cited documents of parsed references (library, doc_id)."""
    counts = refs.groupBy("library", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    top = counts.orderBy(F.desc("hits"), "library", "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hits"), "library", "doc_id")))  # k rows only


def rate(part: Column, base: Column) -> Column:
    """AGG-11: percent of a base, at most 100; 0 without one."""
    return F.when(base > 0, F.least(F.lit(100.0), part * 100.0 / base)).otherwise(0.0)


def percent_change(now: Column, before: Column) -> Column:
    """AGG-12: change in percent; from nothing to something is 100."""
    return F.when(before > 0, (now - before) * 100.0 / before).when(now > 0, 100.0).otherwise(0.0)


def top_users(users: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """AGG-13: enabled users by their operations and questions."""
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("ops"), count_where(F.col("event_type") == "question").alias("questions"))
    rows = users.filter("status = 1").join(counts, "user_id", "left").select("user_id", "full_name", F.coalesce("ops", F.lit(0)).alias("ops"), F.coalesce("questions", F.lit(0)).alias("questions"))
    return rows.orderBy(F.desc("ops"), F.desc("questions"), "user_id").limit(k)


def task_progress(items: DataFrame, as_of: int, timeout: int) -> DataFrame:
    """AGG-14: per task: success, failed and active items, and whether the last start of an active one is too old."""
    last = F.max(F.when(F.col("status") == "active", F.col("start_sec")))
    per = items.groupBy("task_id").agg(count_where(F.col("status") == "success").alias("success"), count_where(F.col("status") == "failed").alias("failed"), count_where(F.col("status") == "active").alias("active"), F.coalesce(last, F.min("start_sec")).alias("last"))
    return per.withColumn("stale", (F.col("active") > 0) & (as_of - F.col("last") > timeout)).withColumn("elapsed", F.when(F.col("stale"), as_of - F.col("last")).otherwise(0)).drop("last")


def file_inventory(files: DataFrame) -> DataFrame:
    """AGG-15: number and size of files by extension and top folder."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(ext.alias("extension"), F.substring_index("path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def status_inventory(files: DataFrame) -> DataFrame:
    """AGG-16: rows by status; a missing status is unknown."""
    return files.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def collect_fields(table: DataFrame, row_id: str, key_map: dict[str, list[str]], most: int = 8, width: int = 120) -> DataFrame:
    """AGG-17: for each target field the first distinct values of the columns whose name holds one of its keys."""
    columns = [c for c in table.columns if c != row_id]
    out = None
    for field, keys in key_map.items():
        hit = [c for c in columns if any(k.lower() in c.lower() for k in keys)]
        for place, c in enumerate(hit):
            part = table.select(F.lit(field).alias("field"), F.lit(place).alias("place"), F.col(row_id).alias("row"), F.lit(c).alias("origin"), F.trim(F.col(c).cast("string")).alias("value"))
            out = part if out is None else out.unionByName(part)
    rows = out.filter("value <> ''").withColumn("value", F.left("value", F.lit(width)))
    first = rows.groupBy("field", F.lower("value").alias("k")).agg(F.min(F.struct("row", "place", "origin", "value")).alias("v"))
    kept = first.withColumn("n", F.row_number().over(W.partitionBy("field").orderBy("v.row", "v.place", "k"))).filter(F.col("n") <= most)
    text = F.struct("n", F.concat(F.lit("["), "v.origin", F.lit("] "), "v.value").alias("t"))
    return kept.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list(text))["t"], "; ").alias("values"))


def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-18: rows and columns of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


def model_register(models: DataFrame, aliases: DataFrame, revisions: DataFrame) -> DataFrame:
    """AGG-19: each model with its sorted aliases and revisions."""
    a = aliases.groupBy("model_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    r = revisions.groupBy("model_id").agg(F.array_sort(F.collect_set("revision")).alias("revisions"))
    empty = F.array().cast("array<string>")
    return models.join(a, "model_id", "left").join(r, "model_id", "left").select("model_id", "name", F.coalesce("aliases", empty).alias("aliases"), F.coalesce("revisions", empty).alias("revisions"))


def normalise_usage(calls: DataFrame) -> DataFrame:
    """AGG-20: input falls back to prompt tokens, output to completion tokens, the total to their sum; then a roll-up."""
    i, o = F.coalesce("input_tokens", "prompt_tokens", F.lit(0)), F.coalesce("output_tokens", "completion_tokens", F.lit(0))
    return calls.select("model", "request_type", i.alias("i"), o.alias("o"), F.coalesce("total_tokens", i + o).alias("t")).groupBy("model", "request_type").agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("t").alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


def _timed(events: DataFrame) -> DataFrame:
    """Events with the milliseconds to their request's next one, and a row ``request.total`` for each request; its status is the last that is not ok."""
    w = W.partitionBy("request_id").orderBy("ms", "stage")
    status = F.coalesce("status", F.lit("ok")) if "status" in events.columns else F.lit("ok")
    rows = events.withColumn("status", status).withColumn("elapsed", F.lead("ms").over(w) - F.col("ms"))
    whole = rows.groupBy("request_id").agg(F.min("ms").alias("ms"), (F.max("ms") - F.min("ms")).alias("elapsed"), F.max_by("status", F.when(F.col("status") != "ok", F.struct("ms", "stage"))).alias("fault"))
    whole = whole.select("request_id", F.lit("request.total").alias("stage"), "ms", F.coalesce("fault", F.lit("ok")).alias("status"), "elapsed")
    return rows.select("request_id", "stage", "ms", "status", "elapsed").unionByName(whole)


def stage_timing(events: DataFrame) -> DataFrame:
    """AGG-21: for each stage, and for whole requests (``request.total``): how many, total, largest, exact median and 95th percentile of milliseconds, and how many did not end well.

    ``events`` have request_id, stage, ms and may have a status (null is ok). A stage lasts
    until its request's next event, so its last one has no length.
    """
    percentile = lambda p: F.percentile("elapsed", p)
    return _timed(events).groupBy("stage").agg(
        F.count("elapsed").alias("n"), F.sum("elapsed").alias("total_ms"), F.max("elapsed").alias("max_ms"), percentile(0.5).alias("p50_ms"), percentile(0.95).alias("p95_ms"), F.count_if(F.col("status") != "ok").alias("n_failed")
    )


def timing_sketches(events: DataFrame, k: int = 200) -> DataFrame:
    """AGG-21: one row a day and stage: the day's number of lengths and a quantile sketch of bounded size; days are merged by ``timing_quantiles``."""
    day = F.date_from_unix_date(F.floor(F.col("ms") / 86_400_000).cast("int"))
    return _timed(events).filter("elapsed is not null").groupBy(day.alias("day"), "stage").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("elapsed", k).alias("sketch"))


def timing_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """AGG-21: quantiles of each stage over the days of ``sketches``, without the events: stage, n, and q_<percent> for each share.

    With sketches of size 200 the rank of a quantile is off by some 1.3 % (99 % of the time).
    """
    merged = sketches.groupBy("stage").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select("stage", "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"q_{round(100 * q)}") for q in shares])
