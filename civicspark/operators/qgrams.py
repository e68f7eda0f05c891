"""Similarity joins of short strings by edit distance, through prefixes of rare letter pairs.

A string of n letters has n + 1 pairs of neighbouring letters when a mark stands before and after it. With a
least ratio t, two strings of n and m letters differ by at most (1 - t) * max(n, m) edits, and a cheapest
edit script leaves untouched all but at most 2 * (1 - t) * n pairs of the one and 2 * (1 - t) * m pairs of
the other: a change or a removal spoils two pairs, an insertion one, and the longer string has m - n letters
that the shorter lacks. Untouched pairs stand in the same order on both sides, moved by no more than the
number of edits. So if both sides list their pairs from the rarest to the commonest, the rarest untouched
pair is among the first 2 * (1 - t) * n + 1 of the one list and the first 2 * (1 - t) * m + 1 of the other.
Only these prefixes are joined, within the bounds on length and position. As long as t is over 0.5 a prefix
is never longer than the list, so strings of any length, one letter too, meet in this way alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keeps rounded products of lengths and ratios on the right side of whole numbers.
SLACK = 1e-9


def letter_pairs(text: Column) -> Column:
    """Pairs of neighbouring letters in order, with a mark before the first and after the last letter."""
    marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(2)))


def pair_counts(strings: DataFrame, text: str) -> DataFrame:
    """(gram, count) over all strings; at most as many rows as there are pairs of letters in use."""
    return strings.select(F.explode(letter_pairs(F.col(text))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("count"))


def prefixes(strings: DataFrame, text: str, counts: DataFrame, least: float) -> DataFrame:
    """(text, length, gram, at): each string's rarest letter pairs, as many as its length asks for."""
    each = strings.select(text, F.posexplode(letter_pairs(F.col(text))).alias("at", "gram")).join(counts, "gram")
    listed = each.groupBy(text).agg(F.array_sort(F.collect_list(F.struct("count", "gram", "at"))).alias("rare"))
    first = F.slice("rare", F.lit(1), F.floor(2 * (1 - least) * F.length(text) + SLACK).cast("int") + 1)
    return listed.select(text, F.length(text).alias("length"), F.explode(first).alias("x")).select(text, "length", "x.gram", "x.at")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, other, longest): distinct pairs of distinct strings that may reach the ratio. Both sides have one row a string."""
    if least <= 0.5:
        raise ValueError("letter pairs decide nothing at a ratio of one half or less")
    counts = pair_counts(left.select(F.col("name").alias("s")).unionByName(right.select(F.col("other").alias("s"))), "s")
    a = prefixes(left, "name", counts, least).toDF("name", "n", "gram", "at")
    b = prefixes(right, "other", counts, least).toDF("other", "m", "gram", "by")
    longest = F.greatest("n", "m")
    edits = (1 - least) * longest + SLACK
    near = (F.abs(F.col("n") - F.col("m")) <= edits) & (F.abs(F.col("at") - F.col("by")) <= edits)
    return a.join(b, "gram").where(near).select("name", "other", longest.alias("longest")).distinct()


def similar_strings(left: DataFrame, right: DataFrame, least: float, once: bool = False) -> DataFrame:
    """(name, other, ratio) of all pairs whose edit ratio, 1 - distance / longer length, reaches ``least`` (over 0.5).

    ``left`` has a column name, ``right`` a column other; nulls and empty strings meet nothing, equal strings
    have ratio 1, and repeated rows count once. With ``once`` only pairs with name < other are made.
    """
    own = left.select("name").where("name <> ''").distinct()
    theirs = right.select("other").where("other <> ''").distinct()
    met = candidates(own, theirs, least)
    met = met.where("name < other") if once else met
    most = F.floor((1 - least) * F.col("longest") + SLACK).cast("int")
    # the comparison ends early where the distance is over the bound; the bound is a column, so it is compared here
    return met.withColumn("distance", F.levenshtein("name", "other")).where(F.col("distance") <= most).select("name", "other", (1 - F.col("distance") / F.col("longest")).alias("ratio"))
