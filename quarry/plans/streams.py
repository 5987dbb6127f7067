"""Registered readers and streams. Their input is a driver table, written to the shared folder as files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import feedback as fb
from quarry.sources import readers as rd
from quarry.sources.lineage import shared_dir
from quarry.streaming import backlog as bl
from quarry.streaming import jobs
from quarry.streaming import ledger as lg

from .dashboard import FB, feedback_sec
from .feedback import ANALYSED, PATCH, RELIABLE, STRENGTH, patch_users, reliability_events
from .relational import live_docs
from .registry import files_query


def written(df: DataFrame, label: str, kind: str = "parquet", **options) -> str:
    """The folder to which ``df`` was written."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


def finished(spark: SparkSession, label: str, start) -> DataFrame:
    """What a stream over all that is there hands to its sink, batch by batch; ``start(sink, checkpoint)`` starts it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    start(lambda df, n: df.write.mode("append").parquet(f"{path}/out"), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


SCHEMA = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType())])


@files_query("src01_load", "select c_custkey, c_name, c_mktsegment from customer")
def src01(spark, sf_dir, t):
    return rd.load(spark, sf_dir, "customer", SCHEMA)


@files_query("src02_qa", "select left(text, 40) as question, md5(text) as answer, item_id::varchar as source_file from benchmark where item_id % 7 <> 0")
def src02(spark, sf_dir, t):
    k = F.col("item_id")
    answer = F.struct(F.left("text", F.lit(40)).alias("question"), F.when(k % 2 == 0, F.col("text")).alias("answer"), F.col("text").alias("ground_truth"), k.cast("string").alias("source_file"))
    lines = t("benchmark").select(F.when(k % 7 == 0, "{broken").otherwise(F.to_json(answer)).alias("value"))
    return rd.read_qa(spark, written(lines, "qa", "text")).select("question", F.md5(F.col("answer").cast("binary")).alias("answer"), "source_file")


@files_query("src03_texts", "select md5(text) as text, count(*) as n from documents where text is not null group by 1")
def src03(spark, sf_dir, t):
    lines = t("documents").filter("text is not null").select(F.to_json(F.struct("text")).alias("value"))
    return rd.read_text_only(spark, written(lines, "texts", "text")).groupBy(F.md5(F.col("text").cast("binary")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


@files_query("src04_csv", "select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as column_3 from supplier order by supplier.s_suppkey limit 2000")
def src04(spark, sf_dir, t):
    rows = t("supplier").select(F.col("s_suppkey").alias("s_suppkey"), "s_name", F.col("s_nationkey").alias(" "), F.lit(None).cast("string").alias("nothing"))
    return rd.read_string_csv(spark, written(rows, "csv", "csv", header="true"))


#: The columns that a stream of feedback needs.
OPEN = ["feedback_id", "user_id", "feedback_type", "comment", "answer_text", "device"]


def feedback_files(t, *extra: str) -> tuple[str, T.StructType]:
    """Each row of feedback twice, as a source may deliver it."""
    rows = t("feedback").select(*OPEN, F.col("created_at").cast("timestamp").alias("created_at"), *extra)
    both = rows.unionByName(rows)
    return written(both, "feedback"), both.schema


def loop_steps(t) -> dict[str, lg.Step]:
    """The states of the learning loop by the batch operators. A verification that arrives later makes its feedback wait."""
    known = t("feedback").select("feedback_id", "verification_result", "verifier_type", F.split("evidence_types", ",").alias("evidence_types"), F.when(F.col("feedback_id") % 17 == 0, 1).otherwise(0).alias("arrives"))
    users = patch_users(t)
    fine = F.lit(None).cast("string").alias("error")

    def analysis(rows, n, tables):
        return fb.analyse_feedback(rows.withColumns({"comment": F.col("comment"), "device": F.col("device")})).select("feedback_id", "detected", "scope", "risk", "action", "claims", fine)

    def claims(rows, n, tables):
        found = fb.extract_claims(tables("analysis").join(rows.select("feedback_id"), "feedback_id", "left_semi"))
        return rows.select("feedback_id").join(found, "feedback_id", "left").withColumn("error", fine)

    def evidence(rows, n, tables):
        there = rows.select("feedback_id").join(known.filter(F.col("arrives") <= n), "feedback_id", "left")
        missing = F.when(F.col("arrives").isNull(), "no verification yet")
        return fb.evidence_strength(there).select("feedback_id", "verification_result", "strength", missing.alias("error"))

    def reliability(rows, n, tables):
        seen = tables("evidence_verification").select("feedback_id", fb.direction(F.col("verification_result")).alias("direction"), F.col("strength").alias("weight"))
        return rows.select("feedback_id", "user_id").join(seen, "feedback_id").withColumn("error", fine)

    def patch(rows, n, tables):
        made = fb.make_patches(rows, users).select("feedback_id", "patch_type", "weight", "signature")
        return rows.select("feedback_id").join(made, "feedback_id", "left").withColumn("error", fine)

    def case(rows, n, tables):
        sure = tables("evidence_verification").filter("verification_result = 'support'").select("feedback_id", F.lit("verified").alias("case_status"))
        return rows.select("feedback_id", "device").join(sure, "feedback_id", "left").withColumn("error", fine)

    def audit(rows, n, tables):
        return rows.select("feedback_id", F.lit("feedback_learning_completed").alias("action"), F.lit(n).alias("in_batch"), fine)

    return dict(zip(lg.STATES, (analysis, claims, evidence, reliability, patch, case, audit)))


def in_turn(*parts: DataFrame) -> tuple[str, T.StructType]:
    """A folder of one file for each part, in the order in which a stream that takes a file at a time reads them."""
    path = f"{shared_dir(parts[0].sparkSession)}/parts-{uuid.uuid4().hex}"
    for part in parts:
        part.repartition(1).write.mode("append").parquet(path)  # one task writes, but does not make, the rows
    return path, parts[0].schema


def one_by_one(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@files_query("str01_feedback", f"""with {ANALYSED}, {PATCH.removeprefix(FB).lstrip(", ")}
select feedback_id, 'completed' as status, case when feedback_id % 17 = 0 and feedback_id % 2 = 0 then 2 else 1 end as attempt, detected, case when detected = 'confirmation' and scope0 = 'feedback' then 'conversation' else scope0 end as scope,
  case when conflict and scope0 = 'global' then 'high' else risk0 end as risk, (select count(*) from k3 where k3.feedback_id = a3.feedback_id) as n_claims, round({STRENGTH}, 6) as strength, coalesce(s.patch_type, '') as patch_type, coalesce(round(s.weight, 6), 0) as weight from a3 left join s using (feedback_id)""")
def str01(spark, sf_dir, t):
    """The learning loop over three files: even rows, odd rows and even ones again, and a last one; a verification that is late makes a row go twice."""
    rows = feedback_sec(t).drop("evidence_types")
    even, odd = rows.filter("feedback_id % 2 = 0"), rows.filter("feedback_id % 2 = 1")
    path, schema = in_turn(even.unionByName(even), odd.unionByName(even), odd)
    ledger = lg.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    # A batch is one file: its rows are dealt out, so that no task holds all of them.
    source = one_by_one(spark, path, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "feedback_id")
    lg.learning_loop(source, loop_steps(t), ledger.path, f"{ledger.path}-checkpoint").awaitTermination()
    out = lg.outcomes(ledger).select("feedback_id", "status", "attempt")
    claims = ledger.read("claim_extraction").groupBy("feedback_id").agg(F.count("claim_no").alias("n_claims"))
    for part in (ledger.read("analysis").select("feedback_id", "detected", "scope", "risk"), claims, ledger.read("evidence_verification").select("feedback_id", F.round("strength", 6).alias("strength"))):
        out = out.join(part, "feedback_id")
    made = ledger.read("patch_decision").select("feedback_id", F.coalesce("patch_type", F.lit("")).alias("patch_type"), F.coalesce(F.round("weight", 6), F.lit(0.0)).alias("weight"))
    return out.join(made, "feedback_id")


@files_query("str02_reliability", f"with {RELIABLE} select user_id, round(score, 6) as reliability, i as n, verified, rejected from rl where i > 0")
def str02(spark, sf_dir, t):
    """The running reliability after all events: that of the batch fold."""
    events = reliability_events(t)
    path = written(events, "events")
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        stream = jobs.reliability_stream(spark.readStream.schema(events.schema).parquet(path))
        start = lambda sink, checkpoint: stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        rows = finished(spark, "reliability", start)
    finally:
        spark.conf.set(key, before)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("reliability", "n", "verified", "rejected"), "n").alias("r")).select("user_id", F.round("r.reliability", 6).alias("reliability"), "r.n", "r.verified", "r.rejected")


@files_query("str03_evaluation", "select strftime(date_trunc('day', created_at), '%Y-%m-%d') as day, count(*) as n from {feedback} group by 1")
def str03_evaluation(spark, sf_dir, t):
    """The periodic evaluation job: rows that are new since the last run, each counted once."""
    path, schema = feedback_files(t)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    counts = lambda sink: lambda df, n: sink(df.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).count(), n)
    rows = finished(spark, "evaluation", lambda sink, checkpoint: jobs.feedback_loop(source, counts(sink), checkpoint))
    return rows.groupBy("day").agg(F.sum("count").alias("n"))


@files_query("str06_stale", "with e as (select user_id as task_id, max(epoch_us(ts) // 1000)::bigint as last_ms from events group by 1), m as (select max(last_ms) as top from e) select task_id, last_ms from e, m where last_ms + 3600000 <= top - 60000")
def str06(spark, sf_dir, t):
    """Tasks without events for an hour before the last of all."""
    rows = t("events").select(F.col("user_id").cast("long").alias("task_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("ts").cast("timestamp").alias("at"))
    path = written(rows, "tasks")
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        stream = jobs.stale_stream(spark.readStream.schema(rows.schema).parquet(path), 3_600_000)
        start = lambda sink, checkpoint: stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        return finished(spark, "stale", start).select("task_id", "last_ms")
    finally:
        spark.conf.set(key, before)


TICKS, HELD_UNTIL, SHARDS = 6, 3, 4


@files_query("str03_backlog", f"""with recursive q as (select version_id, document_id, document_id % 4 as shard from {{versions}} where workflow_status = 'published' and validity_status in ('active', 'legacy_active') and index_status in ('pending', 'failed')
  and document_id in (select c_custkey from customer where c_custkey % 7 <> 0)),
r as (select 0 as tick, version_id, document_id, shard, 0 as attempt, false as leased, false as gone from q
  union all select tick + 1, version_id, document_id, shard, attempt + takes::int, takes, takes and not (version_id % 3 = 0 and attempt = 0)
  from (select *, free and row_number() over (partition by shard, free order by version_id) <= 20 as takes from (select *, document_id % 10 <> 1 or tick + 1 >= {HELD_UNTIL} as free from r where not gone) x) y where tick < {TICKS})
select tick::bigint as tick, shard::int as shard, version_id, attempt::int as attempt, gone as ok from r where leased""")
def str03(spark, sf_dir, t):
    """The backlog queue replayed: six ticks over four shards. Versions divisible by three fail at first; documents that end in 1 are held until the third tick."""
    base = f"{shared_dir(spark)}/backlog-{uuid.uuid4().hex}"
    changes = bl.candidates(t("versions"), live_docs(t)).filter("wanted").withColumn("tick", F.lit(0))
    holds = t("customer").filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("document_id"), F.lit(HELD_UNTIL).alias("tick")).withColumn("until", F.col("tick"))
    first = bl.events("change", changes).unionByName(bl.events("hold", holds))
    ticks = [bl.events("tick", spark.range(1).select(F.lit(n).alias("tick"))) for n in range(1, TICKS + 1)]
    path, schema = in_turn(first, *ticks)
    bl.events("result", changes.limit(0)).write.parquet(f"{base}/results/batch=-1")
    results = spark.readStream.schema(schema).parquet(f"{base}/results/*")
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    parts = "spark.sql.shuffle.partitions"
    before, usual = spark.conf.get(key), spark.conf.get(parts)
    spark.conf.set(key, provider)
    spark.conf.set(parts, SHARDS)  # a partition of state costs time in every batch, and has no rows where it has no shard
    try:
        leases = bl.backlog_stream(one_by_one(spark, path, schema).unionByName(results), shards=SHARDS)
        settle = lambda df: df.select("version_id", "document_id", "attempt", ((F.col("version_id") % 3 != 0) | (F.col("attempt") > 1)).alias("ok"))
        run = bl.work(leases, settle, f"{base}/results", f"{base}/checkpoint", interval=None, log=f"{base}/log")
        run.processAllAvailable()
        run.stop()
    finally:
        spark.conf.set(key, before)
        spark.conf.set(parts, usual)
    return spark.read.parquet(f"{base}/log").select("tick", "shard", "version_id", "attempt", "ok")


#: Where the replayed stream's second file begins, and up to where its third one repeats what came before.
SECOND, REPEATED = "timestamp '2024-01-30 12:00:00'", "timestamp '2024-01-29 18:00:00'"


def replayed(spark, rows: DataFrame, time: str, stream, *by: str) -> DataFrame:
    """What a stream in update mode has last said of each window, over two files in order of time and a late one.

    Spark drops late rows by the watermark of the batch before: that of the first file.
    """
    at = F.col(time)
    path, schema = in_turn(rows.filter(at < F.expr(SECOND)), rows.filter(at >= F.expr(SECOND)), rows.filter(at < F.expr(REPEATED)))
    # A batch is one file, so its rows are dealt out before each becomes many; the state of all windows does not fit a heap.
    out = stream(one_by_one(spark, path, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by))
    start = lambda sink, checkpoint: out.writeStream.outputMode("update").foreachBatch(lambda df, n: sink(df.withColumn("said", F.lit(n)), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        return finished(spark, "replayed", start)
    finally:
        spark.conf.set(key, before)


@files_query("str04_usage_stream", f"""with m as (select max(created_time) - interval 24 hour as mark from {{usage_log}} where created_time < {SECOND}), e as (select *, date_trunc('hour', created_time) as h from {{usage_log}}),
late as (select e.* from e, m where created_time < {REPEATED} and h + interval 1 hour > mark), r as (select * from e union all select * from late)
select strftime(h, '%Y-%m-%d %H') as hour, case when request_type like 'parse%' then 'parse' else 'qa' end as business, sum(total_tokens)::bigint as tokens, count(*) as calls from r group by 1, 2""")
def str04_stream(spark, sf_dir, t):
    """STR-4 as it runs: rows that come again are counted again where their hour is still open, and dropped where the watermark has passed it."""
    rows = t("usage_log").select(F.col("created_time").cast("timestamp").alias("created_time"), "request_type", "total_tokens")
    said = replayed(spark, rows, "created_time", jobs.usage_counts)
    last = said.groupBy("window", "business").agg(F.max_by(F.struct("tokens", "calls"), "said").alias("l"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "business", "l.tokens", "l.calls")


@files_query("str05_activity_stream", f"""with m as (select max(created_at) - interval 24 hour as mark from {{feedback}} where created_at < {SECOND}), e as (select user_id, created_at from {{feedback}}),
w as (select user_id, created_at, unnest(generate_series(date_trunc('hour', created_at) - interval 23 hour, date_trunc('hour', created_at), interval 1 hour)) as start from e),
late as (select w.* from w, m where created_at < {REPEATED} and start + interval 24 hour > mark), r as (select * from w union all select * from late)
select user_id, strftime(start, '%Y-%m-%d %H') as hour, count(*) as n from r group by 1, 2""")
def str05_stream(spark, sf_dir, t):
    """STR-5 as it runs, with late rows."""
    rows = t("feedback").select("user_id", F.col("created_at").cast("timestamp").alias("created_at"))
    said = replayed(spark, rows, "created_at", jobs.activity, "user_id")
    return said.groupBy("user_id", "window").agg(F.max_by("n", "said").alias("n")).select("user_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n")
