"""A stated batch of query vectors against all items, block by block.

Both sides become unit vectors once; a block of items times the matrix of queries gives all their cosines
together. Items stay where they are and each task keeps a bounded rest: its best n for each query, its best
chunk for each document, a count for each bucket. One exchange merges what the tasks kept.

The batch is counted first. Up to ``QUERIES_AT_ONCE`` rows it is sent to the tasks as one matrix; a larger one
is dealt into blocks of that many rows, and items meet each block in a co-group of (block, deal), so no task
holds more than one block of queries and one deal of items.

Cosines are in double precision and rounded to six decimals; where a norm is 0 the cosine is 0. Items and
queries with a null vector, a null entry, NaN or another length than the batch's commonest are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors that are sent to every task at once.
QUERIES_AT_ONCE = 2000
#: Items in a deal of a larger batch.
ITEMS_AT_ONCE = 100_000
#: Rows of items that are multiplied at once, and cosines that are made at once where the batch is large.
ROWS = 2048
CELLS = 1 << 18
#: Rows that a task keeps before it looks for the best of them.
HELD = 1 << 18

Blocks = Iterator[tuple[pa.RecordBatch, np.ndarray]]
Reduce = Callable[[pa.Array, Blocks], Iterator[pa.RecordBatch]]


def unit_rows(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable rows, their unit vectors); a zero vector stays zero."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if d is None:
        seen = lengths[lengths >= 0]
        d = int(np.bincount(seen).argmax()) if len(seen) else 0
    fits = np.flatnonzero(lengths == d)
    flat = column.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fits), d)
    whole = ~np.isnan(flat).any(axis=1)  # null entries are NaN here
    fits, flat = fits[whole], flat[whole]
    norms = np.sqrt((flat * flat).sum(axis=1))
    return fits, flat / np.where(norms == 0, 1.0, norms)[:, None]


def _blocks(batches: Iterator[pa.RecordBatch], queries: np.ndarray) -> Blocks:
    """(items, cosines by query and item), without the items' vectors."""
    rows = max(1, min(ROWS, CELLS // max(1, len(queries))))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            fits, units = unit_rows(piece.column("vector"), queries.shape[1])
            if len(fits):
                kept = piece.take(pa.array(fits)).drop_columns(["vector"])
                yield kept, np.round(queries @ units.T, 6) + 0.0


def _packed(queries: pa.Table) -> tuple[pa.Array, np.ndarray]:
    fits, units = unit_rows(queries.column("query_vector").combine_chunks())
    return queries.column("query_id").combine_chunks().take(pa.array(fits)), units


def against(queries: DataFrame, items: DataFrame, reduce: Reduce, schema: str) -> DataFrame:
    """What ``reduce`` makes of the cosines of a batch (query_id, query_vector) with all items (columns of which one is ``vector``).

    It runs once in each task or co-group, so its results still need a merge.
    """
    batch = queries.select("query_id", "query_vector")
    blocks = -(-batch.count() // QUERIES_AT_ONCE)
    if blocks <= 1:
        ids, matrix = _packed(batch.toArrow())  # at most QUERIES_AT_ONCE rows: counted above
        return items.mapInArrow(lambda batches: reduce(ids, _blocks(batches, matrix)) if len(ids) else iter(()), schema)
    deals = max(1, -(-items.count() // ITEMS_AT_ONCE))
    given = batch.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    named = [c for c in items.columns if c != "vector"]
    dealt = items.withColumn("deal", F.pmod(F.xxhash64(*named), F.lit(deals)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def grouped(asked: pa.Table, found: pa.Table) -> pa.Table:
        ids, matrix = _packed(asked)
        made = list(reduce(ids, _blocks(iter(found.drop_columns(["deal", "block"]).to_batches()), matrix))) if len(ids) and found.num_rows else []
        return pa.Table.from_batches(made) if made else empty

    empty = items.sparkSession.createDataFrame([], schema).toArrow()
    return given.groupBy("block", "deal").cogroup(dealt.groupBy("block", "deal")).applyInArrow(grouped, schema)


def _best(table: pa.Table, groups: list[str], n: int, tie: str = "key") -> pa.Table:
    """The best n rows of each group: largest score first, then the smallest key."""
    keys = [*((g, "ascending") for g in groups), ("score", "descending"), (tie, "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=keys))
    first = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        first[1:] = np.logical_or.reduce([pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False) for c in (table.column(g).combine_chunks() for g in groups)])
    starts = np.flatnonzero(first)
    place = np.arange(table.num_rows) - np.repeat(starts, np.diff([*starts, table.num_rows]))
    return table.filter(pa.array(place < n))


def _kept(ids: pa.Array, blocks: Blocks, n: int | None, least: float, group: str | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A task's best n of each query; scores that no longer count are dropped before they become rows.

    With a group these are the best one of each of the n best groups, or of all groups if n is None.
    """

    def best_of(table: pa.Table) -> pa.Table:
        if group:
            table = _best(table, ["q", group], 1)
        return table if n is None else _best(table, ["q"], n, group or "key")

    floor = np.full(len(ids), -np.inf)
    held: list[pa.Table] = []
    rows, limit = 0, HELD
    for items, cosines in blocks:
        which, at = np.nonzero((cosines >= floor[:, None]) & (np.round(1 - cosines, 6) < least))
        if not len(which):
            continue
        taken = items.take(pa.array(at))
        columns = {"q": pa.array(which), "score": pa.array(cosines[which, at])} | {c: taken.column(c) for c in names}
        held.append(pa.table(columns))
        rows += len(which)
        if rows > limit:
            best = best_of(pa.concat_tables(held))
            held, rows, limit = [best], best.num_rows, max(HELD, 2 * best.num_rows)
            if n is not None:  # the n-th score of a query bounds what can still count
                q, score = best.column("q").to_numpy(), best.column("score").to_numpy()
                last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
                full = np.bincount(q, minlength=len(ids))[q[last]] >= n
                floor[q[last[full]]] = score[last[full]]
    if held:
        best = best_of(pa.concat_tables(held)).combine_chunks()
        query = ids.take(best.column("q").combine_chunks())
        out = pa.table({"query_id": query} | {c: best.column(c) for c in names} | {"score": best.column("score")})
        yield from out.to_batches(max_chunksize=1 << 16)


def _types(df: DataFrame, *names: str) -> list[str]:
    return [dict(df.dtypes)[n] for n in names]


def best_items(queries: DataFrame, items: DataFrame, n: int, most_distance: float = float("inf")) -> DataFrame:
    """(query_id, key, score): for each query the best n items (key, vector) of every task; the caller merges and ranks."""
    kinds = _types(queries, "query_id") + _types(items, "key")
    schema = f"query_id {kinds[0]}, key {kinds[1]}, score double"
    return against(queries, items.select("key", "vector"), partial(_kept, n=n, least=most_distance, group=None, names=["key"]), schema)


def best_parts(queries: DataFrame, parts: DataFrame, n: int | None = None) -> DataFrame:
    """(query_id, doc, chunk, score): for each query and document the best part (doc, chunk, vector) of every task.

    With n only the best n documents of each query and task, the smaller of equal ones first. None of a query's
    first n is lost: where its best part is, only documents that come before it over all can come before it.
    """
    kinds = _types(queries, "query_id") + _types(parts, "doc", "chunk")
    schema = f"query_id {kinds[0]}, doc {kinds[1]}, key {kinds[2]}, score double"
    found = against(queries, parts.select("doc", F.col("chunk").alias("key"), "vector"), partial(_kept, n=n, least=float("inf"), group="doc", names=["doc", "key"]), schema)
    return found.withColumnRenamed("key", "chunk")


def _histogram(ids: pa.Array, blocks: Blocks, width: float, most: float) -> Iterator[pa.RecordBatch]:
    top = int(round(most / width)) + 1
    counts = np.zeros(top + 1, np.int64)
    for items, cosines in blocks:
        apart = np.round(1 - cosines, 6)[pc.not_equal(ids.take(pa.array(np.repeat(np.arange(len(ids)), items.num_rows))), items.column("key").take(pa.array(np.tile(np.arange(items.num_rows), len(ids))))).to_numpy(zero_copy_only=False).reshape(len(ids), -1)]
        bucket = np.where(apart < 0, 0, np.where(apart >= most, top, np.floor(apart / width) + 1)).astype(np.int64)
        counts += np.bincount(bucket, minlength=top + 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])


def distance_histogram(queries: DataFrame, items: DataFrame, width: float = 0.1, most: float = 2.0) -> DataFrame:
    """(bucket, n): distances of every item (key, vector) from every query of another key, counted by bucket.

    Bucket 0 is below 0, bucket k the k-th of ``width``, the last one ``most`` and over. Tasks count, one sum
    a bucket moves. Ids and keys are of one type and not null.
    """
    found = against(queries, items.select("key", "vector"), partial(_histogram, width=width, most=most), "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def _labelled(ids: pa.Array, blocks: Blocks) -> Iterator[pa.RecordBatch]:
    order = pc.sort_indices(ids).to_numpy()[::-1]  # of equal scores the largest label, which stands first here
    for items, cosines in blocks:
        best = cosines[order].argmax(axis=0)
        score = cosines[order][best, np.arange(items.num_rows)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(order[best])), items.column("key"), pa.array(score)], ["query_id", "key", "score"])


def best_label(middles: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, key, score): for each item (key, vector) the best of a batch (query_id, query_vector); a row for each block of the batch."""
    kinds = _types(middles, "query_id") + _types(items, "key")
    return against(middles, items.select("key", "vector"), _labelled, f"query_id {kinds[0]}, key {kinds[1]}, score double")
