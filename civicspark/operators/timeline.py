"""Dated events: gap grouping, chains, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import agenda_rank, allowed_query, trimmed


def gap_groups(events: DataFrame, by: list[str], when: str, tie: str, days: int = 30) -> DataFrame:
    """Adds group_no: a new group starts where more than ``days`` whole days lie to the event before."""
    w = Window.partitionBy(*by).orderBy(when, tie)
    seconds = F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(F.lag(when).over(w).cast("timestamp"))
    starts = F.coalesce((F.floor(seconds / 86_400_000_000) > days).cast("int"), F.lit(1))
    return events.withColumn("starts_group", starts).withColumn("group_no", F.sum("starts_group").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts_group")


def chain_links(pairs: DataFrame, by: str, when: str, key: str) -> DataFrame:
    """previous -> next of one owner by date, all but the last flagged as a stage before it."""
    w = Window.partitionBy(by).orderBy(when, key)
    out = pairs.withColumn("next_key", F.lead(key).over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return out.where("n > 1").withColumn("pre_stage", F.col("next_key").isNotNull()).drop("n")


def thread_queries(turns: DataFrame, by: str, order: str, text: str, before: int = 3, cap: int = 750) -> DataFrame:
    """Adds query: the last turns and the new one joined, of which the last ``cap`` characters stay."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-before, 0)
    return turns.withColumn("query", F.right(F.array_join(F.collect_list(text).over(w), " · "), F.lit(cap)))


def effective_queries(turns: DataFrame, by: str, order: str, text: str, before: int = 4, cap: int = 750) -> DataFrame:
    """The turns that are allowed queries, with the column query: each trimmed and joined to those before it in its thread.

    Other turns, empty ones too, are refused and leave the thread as it is. A thread keeps the latest
    turn and three before it; of the joined text the last ``cap`` characters stay.
    """
    good = turns.where(allowed_query(F.col(text)))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-before, 0)
    return good.withColumn("query", F.right(F.array_join(F.collect_list(trimmed(F.col(text))).over(w), " · "), F.lit(cap)))


def newest_first(items: DataFrame, by: str, when: str, key: str, cap: int) -> DataFrame:
    """The newest ``cap`` rows of each owner, with the number there are in all."""
    w = Window.partitionBy(by).orderBy(F.desc(when), key)
    return items.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(by))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def latest_until(events: DataFrame, by: str, when: str, cutoff, *columns: str) -> DataFrame:
    """As-of: each owner's latest event that is not after the cutoff."""
    held = events.where(F.col(when) <= F.lit(cutoff).cast("timestamp"))
    return held.groupBy(by).agg(F.max_by(F.struct(*columns, when), F.struct(when, *columns)).alias("x")).select(by, "x.*")


def dated(objects: DataFrame, by_type: dict[str, list[str]]) -> DataFrame:
    """Objects with a type to dated events: each type's first non-null date column; undated ones drop."""
    day = F.lit(None).cast("timestamp")
    for kind, columns in by_type.items():
        day = F.when(F.col("type") == kind, F.coalesce(*columns)).otherwise(day)
    return objects.withColumn("date", day).where("date is not null")


def agenda_places(items: DataFrame, owner: str, number: str, key: str) -> DataFrame:
    """Adds place: the order of an owner's items, numbers as numbers first, then those without, then texts."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*agenda_rank(F.col(number)), key)))


def answer_counts(files: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, measure, n) of answers: distinct files, events, and events of each type."""
    per = events.groupBy("query_id", "type").agg(F.count(F.lit(1)).alias("n"))
    distinct = files.groupBy("query_id").agg(F.count_distinct("file").alias("n")).select("query_id", F.lit("files").alias("measure"), "n")
    every = per.groupBy("query_id").agg(F.sum("n").alias("n")).select("query_id", F.lit("events").alias("measure"), "n")
    return distinct.unionByName(every).unionByName(per.select("query_id", F.concat(F.lit("events of "), F.coalesce("type", F.lit("(none)"))).alias("measure"), "n"))
