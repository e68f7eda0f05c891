"""Tag assignments (item, tag, scheme, source, confidence) and what is counted over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("manual", "rule", "model")


def assign(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all assignments, rejected): one per item, tag and scheme; known ones stay, bad sources or confidences go."""
    ok = F.col("source").isin(*SOURCES) & (F.col("confidence").isNull() | F.col("confidence").between(0, 1))
    key = ["item", "tag", "scheme"]
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("confidence"), "source")
    fresh = incoming.where(ok).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return existing.unionByName(fresh.join(existing, key, "left_anti").select(*existing.columns)), incoming.where(~F.coalesce(ok, F.lit(False)))


def holding_all(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Items that hold every tag of the list; an unknown tag leaves none."""
    names = sorted(set(wanted))
    return tags.where(F.col("tag").isin(names)).groupBy("item").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(names)).select("item")


def holding_any(tags: DataFrame, wanted: list[str]) -> DataFrame:
    return tags.where(F.col("tag").isin(wanted)).select("item").distinct()


def of_items(tags: DataFrame) -> DataFrame:
    return tags.groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def details(tags: DataFrame, items: DataFrame | None = None, scheme: str | None = None) -> DataFrame:
    """(item, tag, scheme, source, confidence) of each assignment, by item and tag; of some items (item) and of one scheme where these are given.

    Assignments from before there were schemes have neither scheme nor source, and all without a
    confidence are sure: 1.0. An item that holds a tag under two schemes has a row for each.
    """
    told = tags.select("item", "tag", "scheme", "source", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    if scheme is not None:
        told = told.where(F.col("scheme") == scheme)
    if items is not None:
        told = told.join(items.select("item").distinct(), "item", "left_semi")
    return told.orderBy("item", "tag", "scheme", "source")


def related_by_tags(tags: DataFrame, seeds: DataFrame, scheme: str, shared: int = 2, n: int = 10) -> DataFrame:
    """Items sharing at least ``shared`` tags of one scheme with the seeds, the best n.

    The score adds up 1 + the seeds' best confidence (0.5 where none is known) over the item's own rows.
    """
    of_scheme = tags.where(F.col("scheme") == scheme)
    own = of_scheme.join(seeds.select("item"), "item", "left_semi").groupBy("tag").agg(F.coalesce(F.max("confidence"), F.lit(0.5)).alias("best"))
    other = of_scheme.join(seeds.select("item"), "item", "left_anti").join(own, "tag")
    found = other.groupBy("item").agg(F.count_distinct("tag").alias("shared"), F.round(F.sum(1 + F.col("best")), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return found.where(F.col("shared") >= shared).orderBy(F.desc("score"), "item").limit(n)


def drop_tag(catalog: DataFrame, tags: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame]:
    """A tag out of the catalog, and its assignments with it."""
    return catalog.where(~F.col("tag").isin(gone)), tags.where(~F.col("tag").isin(gone))


def by_precedence(tags: DataFrame, order: dict[str, float]) -> DataFrame:
    """One assignment per item and scheme: the source that stands first; its default fills a null confidence."""
    rank, fill = F.lit(len(order)), F.lit(None).cast("double")
    for place, (source, default) in enumerate(order.items()):
        rank = F.when(F.col("source") == source, place).otherwise(rank)
        fill = F.when(F.col("source") == source, F.lit(default)).otherwise(fill)
    best = F.min_by(F.struct("tag", "source", F.coalesce("confidence", fill).alias("confidence")), F.struct(rank.alias("r"), F.col("tag")))
    return tags.groupBy("item", "scheme").agg(best.alias("b")).select("item", "scheme", "b.*")


def cascade(items: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """Categories by stages (item, category): a later stage only decides what no earlier one did."""
    done = None
    for number, stage in enumerate(stages):
        open_ = items.select("item") if done is None else items.select("item").join(done, "item", "left_anti")
        found = stage.join(open_, "item", "left_semi").where("category is not null").withColumn("stage", F.lit(number))
        done = found if done is None else done.unionByName(found)
    return items.select("item").join(done, "item", "left").select("item", "category", "stage")


def grouped_by_pattern(names: DataFrame, column: str, rules: list[tuple[str, str]], least: int, skip: str = "^-") -> DataFrame:
    """Row counts by the first matching pattern; groups under ``least`` rows are put together as Other."""
    group = F.lit("Other")
    for pattern, value in reversed(rules):
        group = F.when(F.col(column).rlike(f"(?iU){pattern}"), F.lit(value)).otherwise(group)
    counted = names.where(~F.col(column).rlike(skip)).groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(F.when(F.col("n") >= least, F.col("grp")).otherwise("Other").alias("grp")).agg(F.sum("n").alias("n"))


def within_vocabulary(qualified: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) qualifiers by whether the vocabulary has the pair (tag, qualifier)."""
    pair = ["tag", "qualifier"]
    known = vocabulary.select(*pair).distinct()
    return qualified.join(known, pair, "left_semi"), qualified.join(known, pair, "left_anti")


def grounding_report(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """(tag, kept, rejected): how many qualifiers of each tag its vocabulary knows, and how many it does not."""
    both = kept.select("tag", F.lit(True).alias("known")).unionByName(rejected.select("tag", F.lit(False).alias("known")))
    return both.groupBy("tag").agg(F.count_if("known").alias("kept"), F.count_if(~F.col("known")).alias("rejected"))


def above_threshold(scores: DataFrame, thresholds: DataFrame, qualified_tags: list[str]) -> DataFrame:
    """Model scores to tags at or above each tag's threshold; only some tags keep their qualifier."""
    kept = scores.join(thresholds, "tag").where(F.col("score") >= F.col("threshold")).drop("threshold")
    return kept.withColumn("qualifier", F.when(F.col("tag").isin(qualified_tags), F.col("qualifier")))


def topic_clusters(tags: DataFrame, related: DataFrame, query_words: int, least: int = 3, n: int = 5) -> DataFrame:
    """(place, item, label): options to choose from after a short query whose related items fall into several clusters.

    A cluster is a tag that two related items (item, place) hold. With ``least`` clusters and a query of
    at most three words, the first n items each offer their first tag that no earlier one offered; items
    without one offer nothing, and fewer than two options are none.
    """
    held = related.join(tags.select("item", "tag").distinct(), "item")
    clusters = held.groupBy("tag").agg(F.count(F.lit(1)).alias("items")).where("items >= 2").agg(F.count(F.lit(1)).alias("clusters"))
    first = related.orderBy("place", "item").limit(n)  # n rows, so the fold below is over n entries
    rows = first.join(tags.select("item", "tag").distinct(), "item").groupBy("place", "item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    told = rows.agg(F.array_sort(F.collect_list(F.struct("place", "item", "tags"))).alias("rows"))
    item = dict(related.dtypes)
    none = F.array().cast(f"array<struct<place:{item['place']},item:{item['item']},label:string>>")

    def offer(acc, x):
        label = F.get(F.array_except(x["tags"], F.transform(acc, lambda o: o["label"])), 0)
        return F.when(label.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(x["place"].alias("place"), x["item"].alias("item"), label.alias("label")))))

    options = told.join(F.broadcast(clusters), F.lit(True)).where((F.col("clusters") >= least) & F.lit(query_words <= 3)).select(F.aggregate("rows", none, offer).alias("options"))
    return options.where(F.size("options") >= 2).select(F.explode("options").alias("o")).select("o.*")


def distribution(tables: list[DataFrame]) -> DataFrame:
    """(scheme, tag, items): distinct items of each tag, counted in every item table (item, tag, scheme) by itself and added up; no scheme is (none)."""
    numbered = reduce(DataFrame.unionByName, (t.select("item", "tag", F.coalesce("scheme", F.lit("(none)")).alias("scheme"), F.lit(i).alias("of")) for i, t in enumerate(tables)))
    each = numbered.groupBy("of", "scheme", "tag").agg(F.count_distinct("item").alias("items"))
    return each.groupBy("scheme", "tag").agg(F.sum("items").alias("items"))


def choice_totals(votes: DataFrame, choices: list[str]) -> DataFrame:
    """(party, a column of counts for each choice) of votes (party, choice), and a row without party with the totals of all, in one pass."""
    counts = [F.count_if(F.upper("choice") == c.upper()).alias(c) for c in choices]
    return votes.groupingSets([[F.col("party")], []], F.col("party")).agg(*counts, F.grouping_id().alias("level")).select(F.when(F.col("level") == 0, F.coalesce("party", F.lit("(none)"))).alias("party"), *choices)
