"""Recall signals for batches of queries, and their fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import strip_terms, trigrams
from civicspark.operators.blocks import best_items, best_label, best_parts


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def lexical_recall(queries: DataFrame, items: DataFrame, least: float = 0.3, n: int = 50, stop_terms: Sequence[str] = ()) -> DataFrame:
    """(query_id, key, score, rank): trigram similarity above ``least``, through an inverted trigram table.

    A pair that shares no trigram has similarity 0, so joining on trigrams loses nothing. Only the
    counts of shared trigrams are made; sizes give the Jaccard value. Queries: (query_id, query);
    items: (key, name), a row a key. Stop terms are taken out of both sides before they are compared.

    Distinct texts are compared once: of a name's keys only the first n can be among a query's n, and of
    a query's names only its first n by score and least key.
    """
    if stop_terms:
        queries = queries.withColumn("query", strip_terms(F.lower("query"), [t.lower() for t in stop_terms]))
        items = items.withColumn("name", strip_terms(F.lower("name"), [t.lower() for t in stop_terms]))
    named = items.where("name is not null").groupBy("name").agg(F.min("key").alias("least_key"))
    q = queries.select("query").distinct().withColumn("tri", trigrams(F.col("query"))).select("query", F.size("tri").alias("nq"), F.explode("tri").alias("t"))
    i = named.withColumn("tri", trigrams(F.col("name"))).select("name", "least_key", F.size("tri").alias("ni"), F.explode("tri").alias("t"))
    # exploded rows are many more than the file they come from lets the planner expect: never broadcast
    shared = q.join(i.hint("merge"), "t").groupBy("query", "name", "least_key", "nq", "ni").agg(F.count(F.lit(1)).alias("both"))
    scored = shared.select("query", "name", "least_key", F.round(F.col("both") / (F.col("nq") + F.col("ni") - F.col("both")), 6).alias("score")).where(F.col("score") > least)
    best = top_per(scored, ["query"], [F.desc("score"), F.col("least_key")], n, "place").select("query", "name", "score")
    keys = top_per(items.select("name", "key").where("name is not null"), ["name"], [F.col("key")], n, "place").select("name", "key")
    found = top_per(best.join(keys.hint("merge"), "name"), ["query"], [F.desc("score"), F.col("key")], n).select("query", "key", "score", "rank")
    return queries.select("query_id", "query").join(found, "query").select("query_id", "key", "score", "rank")


def vector_recall(queries: DataFrame, items: DataFrame, most_distance: float = 0.9, n: int = 50) -> DataFrame:
    """(query_id, key, score, rank): exact cosine of every item (key, vector) against a stated batch (query_id, query_vector).

    Items stay where they are and each task keeps its own best n, see ``blocks``; one exchange merges them.
    """
    return top_per(best_items(queries, items, n, most_distance), ["query_id"], [F.desc("score"), F.col("key")], n).select("query_id", "key", "score", "rank")


def best_chunk(queries: DataFrame, chunks: DataFrame, n: int | None = None) -> DataFrame:
    """(query_id, doc, score, chunk): each document's best chunk (doc, chunk, vector) for each query of a stated batch; of equal ones the smaller.

    For callers that take the first n documents of a query by score and doc, n keeps the others out of the shuffle.
    """
    top = F.min_by(F.struct("score", "chunk"), F.struct((-F.col("score")).alias("s"), F.col("chunk").alias("c")))
    best = best_parts(queries, chunks, n).groupBy("query_id", "doc").agg(top.alias("b")).select("query_id", "doc", "b.score", "b.chunk")
    return best if n is None else top_per(best, ["query_id"], [F.desc("score"), F.col("doc")], n).drop("rank")


def fuse(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (signal, query_id, key, rank): sum of 1 / (k + rank)."""
    return ranked.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


def fused_candidates(recalls: Sequence[tuple[str, str, DataFrame]], names: Mapping[str, DataFrame], required: Mapping[str, DataFrame] | None = None, per_signal: int = 50, k: int = 60) -> DataFrame:
    """(query_id, id, type, key, name, score, signals): candidates of several item types, each with what found it.

    recalls: (type, signal, ranked (query_id, key, rank and, where the signal has them, distance and chunk)), in
    the order of the signals lexical, name, content. Ranks of one type and key are fused reciprocally. signals
    is struct(lexical boolean, name double, content double, content_chunk int): whether names were alike, and
    the distances of the other signals to four places, null where a signal did not find the key; chunk 0 is
    the whole text and not told. ``required`` keeps the keys (key) of a type that filters left over, before
    anything is ranked. The name is told for the first two times ``per_signal`` keys of a type as the signals
    found them; only files stay without one.
    """
    order = ["lexical", "name", "content"]
    parts = []
    for kind, signal, ranked in recalls:
        own = {c: F.col(c) if c in ranked.columns else F.lit(None) for c in ("distance", "chunk")}
        part = ranked.select("query_id", F.col("key").cast("string").alias("key"), "rank", own["distance"].cast("double").alias("distance"), own["chunk"].cast("int").alias("chunk"))
        if required and kind in required:
            part = part.join(required[kind].select(F.col("key").cast("string").alias("key")).distinct().hint("merge"), "key", "left_semi")
        parts.append(part.select("query_id", F.lit(kind).alias("type"), "key", F.lit(order.index(signal)).alias("signal"), "rank", "distance", "chunk"))
    every = reduce(DataFrame.unionByName, parts)
    at = lambda signal, value: F.max(F.when(F.col("signal") == order.index(signal), value))
    fused = every.groupBy("query_id", "type", "key").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("total"),
        F.min(F.struct("signal", "rank")).alias("first"),
        at("lexical", F.lit(True)).alias("lexical"),
        F.round(at("name", F.col("distance")), 4).alias("by_name"),
        F.round(at("content", F.col("distance")), 4).alias("by_content"),
        F.nullif(at("content", F.col("chunk")), F.lit(0)).alias("content_chunk"),
    )
    known = reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("type"), F.col("key").cast("string").alias("key"), "name") for kind, df in names.items()))
    place = F.row_number().over(Window.partitionBy("query_id", "type").orderBy("first", "key"))
    told = fused.withColumn("place", place).join(known.hint("merge"), ["type", "key"], "left").withColumn("name", F.when(F.col("place") <= 2 * per_signal, F.col("name")))
    signals = F.struct("lexical", F.col("by_name").alias("name"), F.col("by_content").alias("content"), "content_chunk")
    kept = told.where(F.col("name").isNotNull() | (F.col("type") == "File"))
    return kept.select("query_id", F.concat_ws("_", "type", "key").alias("id"), "type", "key", "name", F.round("total", 5).alias("score"), signals.alias("signals"))


def boost(scored: DataFrame, tagged: DataFrame, factor: float = 1.2) -> DataFrame:
    """Scores of keys that carry the focus tag, raised."""
    marked = scored.join(tagged.select("key").distinct().withColumn("focus", F.lit(True)), "key", "left")
    return marked.withColumn("score", F.when(F.col("focus"), F.col("score") * factor).otherwise(F.col("score"))).drop("focus")


def rerank(scored: DataFrame, second: DataFrame, least: float = 0.8) -> DataFrame:
    """Second-stage scores: below ``least`` out, at or above it multiplied, none kept as it was."""
    joined = scored.join(second.select("query_id", "key", "rerank"), ["query_id", "key"], "left")
    return joined.where(F.col("rerank").isNull() | (F.col("rerank") >= least)).withColumn("score", F.col("score") * F.coalesce("rerank", F.lit(1.0))).drop("rerank")


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, by position."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "v"))
    mean = each.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def nearest_centroid(items: DataFrame, middle: DataFrame, label: str, least: float) -> DataFrame:
    """(key, label, score): the best label of each item (key, vector) if its cosine reaches ``least``; of equal ones the larger label.

    An item of several vectors, such as the documents of a pair, has as many rows of one key; the best of them counts.
    """
    each = best_label(middle.select(F.col(label).alias("query_id"), F.col("centroid").alias("query_vector")), items)
    return each.groupBy("key").agg(F.max_by("query_id", F.struct("score", "query_id")).alias(label), F.max("score").alias("score")).where(F.col("score") >= least)


def topic_focus(queries: DataFrame, topics: DataFrame, least: float = 0.30) -> DataFrame:
    """(query_id, topic, similarity): the topic (topic, place, vector) that a query (query_id, query_vector) is nearest to by cosine.

    Of equally near ones the first by place, which no two topics share. Under ``least`` there is no topic;
    nothing is nearer than 0, which is also told for queries without a usable vector. Similarities have
    six decimals, and each query id one row.
    """
    middle = topics.select((-F.col("place")).alias("query_id"), F.col("vector").alias("query_vector"))
    each = best_label(middle, queries.select(F.col("query_id").alias("key"), F.col("query_vector").alias("vector"))).where("score > 0")
    best = each.groupBy(F.col("key").alias("query_id")).agg((-F.max_by("query_id", F.struct("score", "query_id"))).alias("place"), F.max("score").alias("similarity"))
    named = best.join(topics.select("place", "topic"), "place")
    told = queries.select("query_id").distinct().join(named, "query_id", "left")
    return told.select("query_id", F.when(F.col("similarity") >= least, F.col("topic")).alias("topic"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def arg_max_or(scores: DataFrame, thresholds: DataFrame, fallback: str) -> DataFrame:
    """Per query the best-scored intent at or above its own threshold, else the fallback."""
    kept = scores.join(thresholds, "intent").where(F.col("score") >= F.col("threshold"))
    best = kept.groupBy("query_id").agg(F.max_by("intent", F.struct("score", "intent")).alias("intent"))
    return scores.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("intent", F.lit(fallback)).alias("intent"))
