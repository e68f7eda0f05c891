"""What clusters of named files hold: sizes, noise, and the words of their file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.functions.text import path_parts
from civicspark.operators.ranking import top_per

#: The cluster of what belongs to none.
NOISE = -1


def sizes(members: DataFrame) -> DataFrame:
    """(cluster, n) of members (name, cluster); noise is a row too, members without a cluster are none."""
    return members.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def summary(members: DataFrame) -> DataFrame:
    """One row (clusters, members, noise, noise_pct): clusters beside noise, and the share of noise in percent; no members give zeros and a null share."""
    noise = F.col("cluster") == NOISE
    told = sizes(members).agg(
        F.count_if(~noise).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("noise")
    )
    return told.withColumn("noise_pct", F.round(100 * F.try_divide(F.col("noise"), F.col("members")), 2))


def token_hints(members: DataFrame, largest: int = 15, k: int = 10, least: int = 3) -> DataFrame:
    """(cluster, n, place, token, times): the commonest words in the file names of the largest clusters.

    Words are runs of ASCII letters, digits and _ of at least ``least`` characters in a path's file name
    without its extension; case counts, and each time a word stands there. Noise counts among the
    ``largest`` but gets no words. Equal sizes go by cluster, equal counts by word.
    """
    told = sizes(members).orderBy(F.desc("n"), "cluster").limit(largest).where(F.col("cluster") != NOISE)
    stem = path_parts(F.col("name"))[3]
    words = members.join(F.broadcast(told), "cluster").select("cluster", "n", F.explode(F.regexp_extract_all(stem, F.lit(rf"[A-Za-z0-9_]{{{least},}}"), F.lit(0))).alias("token"))
    counted = words.groupBy("cluster", "n", "token").agg(F.count(F.lit(1)).alias("times"))
    return top_per(counted, ["cluster"], [F.desc("times"), F.col("token")], k, rank="place").select("cluster", "n", "place", "token", "times")
