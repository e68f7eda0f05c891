"""Incremental imports and streams: marks, late data, sessions, thread state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from civicspark.functions.text import allowed_query, trimmed
from civicspark.sources.entities import latest, upsert
from civicspark.sources.tables import removed


def baseline(runs: DataFrame) -> DataFrame:
    """The start of the next run: end state of the latest finished run, else its own start, else the epoch."""
    last = F.max_by(F.coalesce("end_state", "baseline"), "started")
    return runs.agg(F.coalesce(last, F.lit("1970-01-01").cast("timestamp")).alias("baseline"))


def instant(text: Column) -> Column:
    """The moment that an ISO text with any offset names; without an offset it is in UTC, a day alone is its beginning."""
    text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    whole = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(whole)


def ladder(reads: Sequence[tuple[str, Callable[[], DataFrame]]], baseline: dt.datetime, path: str) -> tuple[DataFrame, str]:
    """(items, mode): the first read that kept to its filter, written to ``path``; the last one is the full read.

    reads: (field, read) in order, each filtered by its source on that text field since the baseline; the last
    entry reads in full, whatever its name. A source that honours a filter cannot send an item older than the
    baseline, so each read is watched while it is written: one older item shows that the filter was ignored,
    and the next read takes its place. Items without the field, or whose field is no moment, show nothing.
    """
    for place, (field, read) in enumerate(reads):
        seen = Observation()
        watched = read().observe(seen, F.count_if(instant(F.col(field)) < F.lit(baseline)).alias("older")) if place < len(reads) - 1 else read()
        watched.write.mode("overwrite").parquet(path)
        if place == len(reads) - 1 or not seen.get["older"]:
            return watched.sparkSession.read.parquet(path), field
    raise ValueError("a ladder needs a full read at its end")


def high_water(items: DataFrame, field: str, baseline: Column) -> DataFrame:
    """One row ``mark``: the latest moment of the items, whatever their offsets, but never before the baseline."""
    return items.agg(F.greatest(F.max(instant(F.col(field))), baseline).alias("mark"))


def classify(incoming: DataFrame, known: DataFrame, key: str = "id", modified: str = "modified") -> DataFrame:
    """Adds status: new, modified (newer than the known one) or skipped (as old or older)."""
    joined = incoming.join(known.select(key, F.col(modified).alias("known_modified"), F.lit(True).alias("is_known")), key, "left")
    newer = F.col("known_modified").isNull() | (F.col(modified) > F.col("known_modified"))
    return joined.withColumn("status", F.when(F.col("is_known").isNull(), "new").when(newer, "modified").otherwise("skipped")).drop("known_modified", "is_known")


def run_counts(items: DataFrame) -> DataFrame:
    """(run, type, new, modified), each item of a run counted once."""
    once = items.dropDuplicates(["run", "id"])
    return once.groupBy("run", "type").agg(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "modified").alias("modified"))


def run_report(items: DataFrame) -> DataFrame:
    """(run, type, new, modified) with totals in one pass: type null for a run, run and type null for all; each item of a run counts once."""
    once = items.dropDuplicates(["run", "id"])
    sets = once.groupingSets([[F.col("run"), F.col("type")], [F.col("run")], []], F.col("run"), F.col("type"))
    return sets.agg(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "modified").alias("modified"))


def sessions(events: DataFrame, by: str, when: str, gap: str = "30 days 23 hours 59 minutes 59.999999 seconds", late: str = "1 day") -> DataFrame:
    """Session windows of a stream or a table; the default gap keeps events up to 30 whole days apart together."""
    timed = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late) if events.isStreaming else events
    return timed.groupBy(by, F.session_window(when, gap).alias("session")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def windowed_counts(events: DataFrame, when: str, kind: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding window counts by kind."""
    timed = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late) if events.isStreaming else events
    return timed.groupBy(F.window(when, size, slide or size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which version each key range is in after a batch: as many entries as there are ranges."""
    rows = spark.read.schema("range int, version long").json(f"{path}/manifest/batch={number}").collect() if number >= 0 else []
    return {r["range"]: r["version"] for r in rows}


def import_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", modified: str = "modified", ranges: int = 64) -> StreamingQuery:
    """A table of the latest row of each key, kept in ranges of keys; a batch rewrites the ranges that it touches.

    A batch reads the touched ranges, upserts its rows (older ones of a known key change nothing, undated ones
    win) and writes these ranges as a version of its own. Then it writes its manifest, which says for every
    range which version holds: that is the commit, readers see the batch from then on. A batch that is run
    again, or whose first try failed, starts from the manifest before it and gives the same. What a batch has
    replaced is removed when the next one is committed, so readers of the last manifest are never cut off.
    """

    def folder(version: int, place: int) -> str:
        return f"{path}/data/version={version}/range={place}"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, number - 1)
        dealt = batch.withColumn("range", F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int"))
        touched = sorted(r[0] for r in dealt.select("range").distinct().collect())  # at most ``ranges``
        kept = [folder(before[t], t) for t in touched if t in before]
        fresh = latest(dealt, key, modified)
        if kept:
            stored = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*kept).drop("version").withColumn("range", F.col("range").cast("int"))
            fresh = upsert(stored, dealt, key, modified)
        fresh.repartition(max(1, len(touched)), "range").write.mode("overwrite").partitionBy("range").parquet(f"{path}/data/version={number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "range int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={number}")
        for place, version in _manifest(spark, path, number - 2).items() if number > 1 else ():
            if before[place] != version:
                removed(spark, folder(version, place))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def imported(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``import_stream`` as its last committed batch left it."""
    number = spark.read.schema("range int, version long").json(f"{path}/manifest").agg(F.max("batch")).first()[0]
    folders = [f"{path}/data/version={v}/range={r}" for r, v in sorted(_manifest(spark, path, number).items())]
    return spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*folders).drop("version", "range")


def _turns_of_a_thread(by: str, keep: int, most: int, cap: int, idle: int | None) -> Callable[..., Iterator[pd.DataFrame]]:
    """The last turns of a thread, carried from batch to batch; see ``thread_state``."""

    def advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        said, n = state.get if state.exists else ([], 0)
        said, out = list(said), []
        turns = sorted((t for batch in rows for t in zip(batch["turn"], batch["text"], batch["followup"])), key=lambda t: t[0])
        for turn, text, followup in turns:
            broken = n >= most
            if broken:
                said, n = [], 0
            joined = bool(followup) and bool(said)
            query = " · ".join([*said, text])[-cap:] if joined else text
            said, n = [*said[-keep:], text], n + 1
            out.append((key[0], int(turn), query, joined, n, broken))
        state.update((said, n))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[by, "turn", "query", "concatenated", "turns", "forced_break"])

    return advance


def thread_state(turns: DataFrame, by: str = "conv_id", keep: int = 3, most: int = 5, cap: int = 750, idle_ms: int | None = None) -> DataFrame:
    """(by, turn, query, concatenated, turns, forced_break) of a stream of turns (by, turn, text, followup).

    Turns that are no allowed query are refused and leave the thread as it is; the others are trimmed. A
    follow-up is asked together with the turns before it, the last ``cap`` characters of them all; any other
    turn is asked alone, but stays in the thread. The thread holds the last ``keep`` turns before the latest
    and the latest. After ``most`` turns it is broken and starts anew. With ``idle_ms`` a thread without
    turns for so long is forgotten; the stream then needs a continuous trigger, as one that ends with its input
    (``availableNow``) waits for the timers again and again. Needs the state store that keeps its state on disk (RocksDB).
    """
    good = turns.where(allowed_query(F.col("text"))).select(by, F.col("turn").cast("long").alias("turn"), trimmed(F.col("text")).alias("text"), F.coalesce("followup", F.lit(False)).alias("followup"))
    kind = dict(turns.dtypes)[by]
    made = f"{by} {kind}, turn long, query string, concatenated boolean, turns int, forced_break boolean"
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return good.groupBy(by).applyInPandasWithState(_turns_of_a_thread(by, keep, most, cap, idle_ms), made, "said array<string>, n int", "append", timeout)


def facet_stream(stream: DataFrame, facets: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Facet counts (facet, value, n) of all rows so far, written anew as one version of the folder by each micro-batch.

    The counts are the stream's state, so an import makes the version before it stale and a restart
    reads nothing twice; the state holds a row for each distinct value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets)))
    counts = stream.select(pairs.alias("f")).select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))

    def refresh(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return counts.writeStream.outputMode("complete").foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
