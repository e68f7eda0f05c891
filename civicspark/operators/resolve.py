"""What a question names: committees, slot vocabularies, similar items, and what an answer leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import normalise
from civicspark.operators.ranking import top_per, vector_recall


def similar_items(queries: DataFrame, items: DataFrame, k: int = 5, cutoff: float = 0.4) -> DataFrame:
    """(query_id, key, similarity, rank): the k most similar items whose similarity is over the cutoff."""
    return vector_recall(queries, items, round(1 - cutoff, 6), k).select("query_id", "key", F.col("score").alias("similarity"), "rank")


def top_then_threshold(queries: DataFrame, items: DataFrame, k: int = 10, most_distance: float = 0.5) -> DataFrame:
    """(query_id, key, distance): the k nearest items, and of those the ones within the distance."""
    distance = (F.round(1 - F.col("score"), 6) + 0.0).alias("distance")
    return vector_recall(queries, items, float("inf"), k).select("query_id", "key", distance).where(F.col("distance") <= most_distance)


def holding(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name): every name that holds a term.

    Names are cut into all their stretches of the lengths that terms have, and both sides meet on whole
    terms: a name costs its own length times the lengths in use, and only pairs that hold are made. The
    stretches are never gathered in one place, however small the table of names is.
    """
    a = terms.select("term").where("term <> ''").distinct()
    b = names.select("name").where("name is not null").distinct().withColumn("low", normalise(F.col("name")))
    lengths = a.select(F.length("term").alias("n")).distinct()
    upto = b.select(F.length("low").alias("of")).distinct().select("of", F.explode(F.sequence(F.lit(1), F.greatest("of", F.lit(1)))).alias("n"))
    fitting = upto.join(F.broadcast(lengths), "n").where("n <= of").groupBy("of").agg(F.collect_list("n").alias("sizes"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substring("low", i, n))
    stretches = F.array_distinct(F.flatten(F.transform("sizes", cut)))
    each = b.join(F.broadcast(fitting), F.length("low") == F.col("of")).select("name", F.explode(stretches).alias("term"))
    return a.join(each.hint("merge"), "term").select("term", "name")


def committees(queries: DataFrame, groups: DataFrame, organizations: DataFrame, now: Column, most: int = 10) -> DataFrame:
    """(query_id, name, tier) of queries (query_id, term): organizations that a term means.

    A term that a configured group (place, name) holds in one of its names means that group's members
    whose term has not ended (tier 0); else organizations of exactly that name (1); else the first
    ``most`` whose name holds it (2). A group without live members means nothing.
    """
    asked = queries.select("query_id", normalise(F.col("term")).alias("term")).where("term <> ''")
    grouped = holding(asked, groups).join(groups, "name").groupBy("term").agg(F.min("place").alias("place"))
    live = organizations.where(F.col("end_date").isNull() | (F.col("end_date") >= now)).select("name").distinct()
    zero = grouped.join(groups, "place").select("term", "name").join(live, "name", "left_semi").select("term", "name", F.lit(0).alias("tier"))
    left = asked.select("term").distinct().join(grouped, "term", "left_anti")
    known = organizations.select("name").distinct()
    one = left.join(known.withColumn("term", F.lower("name")), "term").select("term", "name", F.lit(1).alias("tier"))
    two = top_per(holding(left.join(one, "term", "left_anti"), known), ["term"], [F.col("name")], most).select("term", "name", F.lit(2).alias("tier"))
    return asked.join(zero.unionByName(one).unionByName(two).distinct(), "term").select("query_id", "name", "tier")


def slot_vocabulary(sources: list[DataFrame]) -> DataFrame:
    """(slot, value, place): normalised distinct values of slots in the order they are first seen.

    Sources (slot, value, at) come one after the other; ``at`` orders a source's own values.
    """
    out = None
    for number, source in enumerate(sources):
        part = source.select("slot", normalise(F.col("value").cast("string")).alias("value"), F.struct(F.lit(number).alias("source"), F.col("at").cast("string").alias("at")).alias("seen"))
        out = part if out is None else out.unionByName(part)
    first = out.where("value <> ''").groupBy("slot", "value").agg(F.min("seen").alias("seen"))
    return first.select("slot", "value", F.row_number().over(Window.partitionBy("slot").orderBy("seen", "value")).alias("place"))


def left_out(answer: DataFrame, excluded: DataFrame, by: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(answers without the excluded keys, (query, dropped) for those that lost some)."""
    gone = answer.join(excluded.select("key").distinct(), "key", "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("dropped"))
    return answer.join(excluded.select("key").distinct(), "key", "left_anti"), gone
