"""Streams run to their end over the tables (``availableNow``), and the guarded reads before them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicspark.plans.catalog import query
from civicspark.sources.tables import shared_folder, table
from civicspark.streaming import incremental

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_in_batches(spark: SparkSession, df: DataFrame, batch: Column, batches: int, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The rows as a stream of files, one micro-batch for each value of ``batch`` (from 0), in that order.

    A batch is written by all tasks, as many files as they make, and ``start`` runs the stream from its checkpoint
    over what is new, to its end; without a bound on files a run is one micro-batch.
    """
    path = fresh_folder(spark, "stream-in")
    for number in range(batches):
        df.where(batch == number).write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query("x1_x5_x6_imported_state", """
WITH e AS (SELECT user_id, ts, event_id, event_type, event_id % 4 AS wave FROM events WHERE event_id % 4 < 3 OR user_id % 3 = 0)
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS modified, (SELECT max(ts) FROM events WHERE event_id % 4 = 3) AS baseline FROM e GROUP BY 1""")
def imported_state(spark: SparkSession, sf: str) -> DataFrame:
    """Events in four micro-batches that are out of order, the last one touching some users only; the baseline of the next run beside."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts").where("event_id % 4 < 3 or user_id % 3 = 0")
    # of equal moments the larger event holds, as part of the order
    rows = e.groupBy("user_id", (F.col("event_id") % 4).alias("wave")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "wave", F.struct("x.ts", "x.event_id").alias("modified"), "x.event_type")
    path = fresh_folder(spark, "import")
    run_in_batches(spark, rows, F.col("wave"), 4, lambda stream: incremental.import_stream(stream.drop("wave"), f"{path}/table", f"{path}/check", key="user_id", ranges=16))
    runs = table(spark, sf, "events").groupBy((F.col("event_id") % 4).alias("run")).agg(F.max("ts").alias("end_state")).withColumns({"started": F.make_timestamp(F.lit(2024), F.lit(1), F.col("run").cast("int") + 1, F.lit(0), F.lit(0), F.lit(0)), "baseline": F.lit(None).cast("timestamp")})
    return incremental.imported(spark, f"{path}/table").select("user_id", "event_type", F.col("modified.ts").alias("modified")).join(F.broadcast(incremental.baseline(runs)), F.lit(True))


@query("x2_x4_guarded_reads", """
WITH b AS (SELECT max(ts) FILTER (event_id % 2 = 0) - INTERVAL 10 DAY AS baseline FROM events), e AS (SELECT event_type, ts, ts + INTERVAL 1 HOUR * (event_id % 5) AS created, baseline FROM events, b)
SELECT event_type AS collection, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'created' ELSE 'full' END AS mode,
  count(*) FILTER (CASE event_type WHEN 'click' THEN ts >= baseline WHEN 'view' THEN created >= baseline ELSE true END) AS n, greatest(max(ts) FILTER (CASE event_type WHEN 'click' THEN ts >= baseline WHEN 'view' THEN created >= baseline ELSE true END), max(baseline)) AS mark
FROM e GROUP BY 1 HAVING n > 0 OR mode <> 'full'""")
def guarded(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of event as a collection: clicks honour the first filter, views only the second, others none. Moments are texts with mixed offsets."""
    e = table(spark, sf, "events")
    base: dt.datetime = e.where("event_id % 2 = 0").agg(F.max("ts") - F.expr("interval 10 days")).first()[0]
    offset = F.col("event_id") % 3

    def written(at: Column) -> Column:
        shifted = lambda hours: F.date_format(at + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(offset == 0, F.concat(shifted(2), F.lit("+02:00"))).when(offset == 1, F.concat(shifted(0), F.lit("Z"))).otherwise(shifted(0))

    created = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 5).cast("int"))
    items = e.select("event_type", "ts", created.alias("made"), written(F.col("ts")).alias("modified"), written(created).alias("created"))
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # the names of the collections, which are configured
    out = None
    for kind in kinds:
        mine = items.where(F.col("event_type") == kind)
        honest = lambda field, at, mine=mine, kind=kind: lambda: mine.where(F.col(at) >= F.lit(base)) if (kind, field) in (("click", "modified"), ("view", "created")) else mine
        got, mode = incremental.ladder([("modified", honest("modified", "ts")), ("created", honest("created", "made")), ("full", lambda mine=mine: mine)], base, fresh_folder(spark, "read"))
        told = got.agg(F.count(F.lit(1)).alias("n")).join(incremental.high_water(got, "modified", F.lit(base)), F.lit(True)).select(F.lit(kind).alias("collection"), F.lit(mode).alias("mode"), "n", "mark")
        out = told if out is None else out.unionByName(told)
    return out


@query("x9_thread_stream", r"""
WITH c AS (SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text, turn % 3 > 0 AS followup, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) BETWEEN 1 AND 250 AND regexp_full_match(text, '[\p{L}\p{N}\s.,;:!?()\[\]{}„“«»"''’`\-–—/&%+*#@=_|~°§$€]+')),
w AS (SELECT *, k % 5 AS place, list(text) OVER (PARTITION BY conv_id, k // 5 ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS said FROM c)
SELECT conv_id, turn, CASE WHEN followup AND place > 0 THEN right(list_aggregate(said, 'string_agg', ' · '), 750) ELSE text END AS query, followup AND place > 0 AS concatenated, (place + 1)::INT AS turns, k > 0 AND place = 0 AS forced_break FROM w""")
def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as threads in three micro-batches; two turns of three are follow-ups. The stream's own session keeps its state on disk."""
    own = spark.newSession()
    own.conf.set(STORE, ROCKS)
    c = table(own, sf, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 3 > 0).alias("followup"))
    wave = F.when(F.col("turn") < 2, 0).when(F.col("turn") < 6, 1).otherwise(2)
    path = fresh_folder(spark, "threads")
    start = lambda turns: incremental.thread_state(turns).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode("append").trigger(availableNow=True).start()
    run_in_batches(own, c, wave, 3, start)
    return spark.read.parquet(f"{path}/out")


@query("x10_facet_stream", "SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'day', ts::DATE::VARCHAR, count(*) FROM events GROUP BY 2")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    """Facet counts after the last of two micro-batches."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("date").alias("day"))
    path = fresh_folder(spark, "facets")
    run_in_batches(spark, e, F.col("event_id") % 2, 2, lambda stream: incremental.facet_stream(stream, ["event_type", "day"], f"{path}/out", f"{path}/check"))
    return spark.read.parquet(f"{path}/out/version=1")


@query("a16_run_report", """
WITH e AS (SELECT DISTINCT user_id % 10 AS run, event_type AS type, event_type || '|' || user_id AS id, CASE WHEN event_type = 'view' THEN 'modified' ELSE 'new' END AS status FROM events)
SELECT run, type, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'modified') AS modified FROM e GROUP BY GROUPING SETS ((run, type), (run), ())""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("type"), F.concat_ws("|", "event_type", "user_id").alias("id"), F.when(F.col("event_type") == "view", "modified").otherwise("new").alias("status"))
    return incremental.run_report(rows)
