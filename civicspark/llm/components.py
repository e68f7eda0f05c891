"""Connected components of a link table: bounded local contraction, then rounds of joins (large star, small star)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import cut

#: Links that one task contracts in memory; the number of tasks follows the number of links.
LINKS_PER_TASK = 500_000


def contract(links: DataFrame) -> DataFrame:
    """Each partition's links as stars around the smallest node that the partition's links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in parent if root(x) != x]
        for at in range(0, len(found), 10_000):
            u, v = zip(*found[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, most_rounds: int = 60, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(u, v) links to (node, component): the smallest node that can be reached, for every linked node.

    Links are dealt to tasks of a bounded number, whose stars take their place. Each round then hangs
    the larger neighbours of a node under its smallest neighbour, and does the same with the smaller
    ones, until nothing changes. Each round is cut with a checkpoint, and only a count and a checksum
    come to the driver.
    """
    given = cut(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v"))
    edges = cut(contract(given.repartition(max(1, -(-given.count() // links_per_task)))))
    before = _state(edges)
    for _ in range(most_rounds):
        both = _either_way(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(_either_way(large.join(low, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _either_way(df: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Two pairs of columns of each row as rows (u, v), which leaves the rows where they are."""
    pair = lambda p: F.struct(F.col(p[0]).alias("u"), F.col(p[1]).alias("v"))
    return df.select(F.explode(F.array(pair(one), pair(other))).alias("x")).select("x.u", "x.v")
