"""Operator 6: near-duplicates by MinHash, with odd sketches to judge the candidates.

Documents are sets of word shingles. The stages:

1. a scan makes, for each document, its set's size and a 128-bit name of the set, ``BANDS`` band keys
   of ``ROWS`` MinHash values each, and an odd sketch: the MinHash samples folded into a bitmap of
   ``SKETCH_BITS`` parities. The XOR of two sketches holds the parities of the samples that differ,
   so its population count gives the similarity, most precisely where it is high;
2. equal sets are one representative from here on;
3. each band bucket is a star around one of its representatives. Star pairs whose sketches could be
   of linked sets are confirmed on full sets, and components of the confirmed links are formed;
4. in the buckets that still hold several components, the members outside the bucket's largest
   component are compared with all members by their sketches alone, in blocks of bounded size. That
   gives the components that may be linked, and the members that could be the link: often few. Only
   their texts move, and full sets are compared, again in blocks, read as streams. A block emits
   links that join components within it, so never all pairs; no pair of one component is looked at;
5. components again, then every row gets the smallest id of its component.

Rows are told apart by a key, not by id. A pair of similarity 0.85 shares no bucket with probability
(1 - 0.85**5)**32 = 7e-9; a linked pair's sketch estimate lies under the cut (threshold - 0.17) with
less than 1e-5. So no link is capped or dropped, and none is accepted without full sets.

Edge cases: null, empty and wordless texts have the empty set, stand alone and are kept; texts of
fewer words than a shingle have their whole word sequence as the one shingle. Each row has a row in
the result: rows that repeat an id are judged by their own texts and are kept if the id is their
component's smallest; rows without an id are compared too, come after all ids, and where a component
has no id, its ``component_id`` is null and one row of it is kept. ``first`` marks exactly one row of
each component, the one with the smallest id, and of several the first as read. A very long
text is read whole in one task, and where its links are confirmed its full set is in that task's
memory beside the block it meets, however many shingles it has. Extra columns are dropped; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import GOLDEN, LOWER, NOT_SPACE, U64, SubstringHash, cut, joined_bytes, map_arrow, mix, row_keyed, runs, slices, table, utf8
from civicspark.llm.components import connected_components

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: How far a linked pair's estimate may lie under the threshold and still be confirmed on full sets.
MARGIN = 0.17
#: Shingles that one block of compared representatives may hold in memory.
BLOCK_SHINGLES = 400_000
#: Sketches that one block of compared bucket members may hold in memory.
BLOCK_SKETCHES = 20_000
#: Rows that one stream of compared representatives may have.
STREAM_ROWS = 1_000

_draw = mix(np.arange(1, 2 * SAMPLES + 1, dtype=U64) * GOLDEN)
MULTIPLY = (_draw[:SAMPLES] | U64(1)).astype(np.uint32)[:, None]
ADD = (_draw[SAMPLES:] >> U64(32)).astype(np.uint32)[:, None]
SALT = mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0xA0761D6478BD642F))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted 64-bit shingle codes of each text: A-Z lowered, words are runs without white space."""
    low = LOWER[data]
    starts, ends = runs(NOT_SPACE[low], bounds)
    word = mix(SubstringHash(low).at(starts, ends) + (ends - starts).astype(U64)) if len(starts) else np.empty(0, U64)
    first = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        size = min(width, n)
        if not n:
            out.append(np.empty(0, U64))
            continue
        code = np.full(n - size + 1, size, U64)
        for k in range(size):
            code = mix(code * GOLDEN + word[a + k : a + k + n - size + 1])
        out.append(np.unique(code))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (MULTIPLY * x[None, at : at + 4096] + ADD).min(axis=1))
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each (place, value) flips one bit."""
    bit = (mix(least.astype(U64) + SALT) % U64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64) * GOLDEN
    for k in range(ROWS):
        key = mix(key ^ rows[:, k])
    return key.view(np.int64)


def estimate_from_bits(differing, samples: int = SAMPLES, bits: int = SKETCH_BITS):
    """Similarity that makes this many XORed bits likely: |XOR| bits <- 2 * samples * (1 - J) flips."""
    fill = np.minimum(2 * np.asarray(differing, np.float64) / bits, 1 - 1e-9)
    return 1 + bits / (4 * samples) * np.log1p(-fill)


def most_bits(threshold: float) -> int:
    """The largest XOR count whose estimate is within the margin of the threshold."""
    counts = np.arange(SKETCH_BITS + 1)
    return int(counts[estimate_from_bits(counts) >= threshold - MARGIN].max())


def features(docs: DataFrame, width: int) -> DataFrame:
    """key, n_shingles, set_hi, set_lo, bands, sketch of each row (key, doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, hi, lo, bands, sketch = [], [], [], [], []
        column = batch.column("text")
        for start, end in slices(column):
            for one in shingle_sets(*joined_bytes(column, start, end), width):
                size.append(len(one))
                spread = mix(one)
                hi.append(np.int64(np.bitwise_xor.reduce(spread).view(np.int64)) if len(one) else 0)
                lo.append(np.int64(np.add.reduce(mix(spread + GOLDEN)).view(np.int64)) if len(one) else 0)
                least = min_hashes(one)
                bands.append(band_keys(least) if len(one) else np.empty(0, np.int64))
                sketch.append(odd_sketch(least))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *(pa.array(v, k) for v, k in zip((size, hi, lo, bands, sketch), kinds, strict=True))], ["key", "doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sketch"])

    return map_arrow(docs, run, "key long, doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>")


def xor_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches, on the JVM."""
    total = F.lit(0)
    for k in range(SKETCH_WORDS):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 8)], np.uint8)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else POPCOUNT[x.view(np.uint8)].reshape(*x.shape, 8).sum(axis=-1)


def confirm(rows: DataFrame, width: int, part: int, whole: int, bits: int) -> DataFrame:
    """Confirmed links of each group: rows (grp, salt, side, doc, comp, sketch, text), side 0 held, side 1 streamed.

    Only links that join two components of the group are emitted, so a group of m documents gives at
    most about m of them; sets are compared only where the sketches allow a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, comps, sets, sketches, parent = None, [], [], [], None, {}
        held: list[np.ndarray] = []
        out_u, out_v = [], []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            column = batch.column("text")
            grp, salt, side, doc, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "salt", "side", "doc", "comp"))
            sketch = batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH_WORDS).view(np.uint64)
            for start, end in slices(column):
                for i, own in zip(range(start, end), shingle_sets(*joined_bytes(column, start, end), width), strict=True):
                    if key != (grp[i], salt[i]):
                        key, ids, comps, sets, held, sketches, parent = (grp[i], salt[i]), [], [], [], [], None, {}
                    if side[i] == 0:
                        ids.append(doc[i])
                        comps.append(comp[i])
                        sets.append(own)
                        held.append(sketch[i])
                        sketches = None
                        continue
                    if not ids:
                        continue
                    if sketches is None:
                        sketches = np.stack(held)
                    near = np.flatnonzero(_popcount(sketches ^ sketch[i]).sum(axis=1) <= bits)
                    mine = root(comp[i])
                    for j in near.tolist():
                        if root(comps[j]) == mine:
                            continue
                        both = len(np.intersect1d(own, sets[j], assume_unique=True)) if _sizes_allow(len(own), len(sets[j]), part, whole) else 0
                        if whole * both >= part * (len(own) + len(sets[j]) - both) and both:
                            out_u.append(doc[i])
                            out_v.append(ids[j])
                            parent[root(comps[j])] = mine = root(mine)
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])
            out_u, out_v = [], []

    dealt = rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "side")
    return dealt.select("grp", "salt", "side", "doc", "comp", "sketch", "text").mapInArrow(run, "u long, v long")


def _sizes_allow(a: int, b: int, part: int, whole: int) -> bool:
    return whole * min(a, b) >= part * max(a, b)


def screen(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (u, v) from rows (grp, salt, side, doc, comp, sketch), side 0 held, side 1 streamed.

    With v: two components that hold sketches close enough for a link, at most as many as join all of
    the block's. Without v: a document u that has such a sketch in another component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, comps, held, ready, near_to, parent, roots = None, [], [], [], None, None, {}, None
        out: list[tuple] = []

        def close() -> None:
            if near_to is not None:
                out.extend((int(d), None) for d in ready[0][near_to])

        for batch in batches:
            grp, salt, side, doc, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "salt", "side", "doc", "comp"))
            sketch = batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH_WORDS).view(np.uint64)
            for i in range(batch.num_rows):
                if key != (grp[i], salt[i]):
                    close()
                    key, docs, comps, held, ready, near_to, parent, roots = (grp[i], salt[i]), [], [], [], None, None, {}, None
                if side[i] == 0:
                    docs.append(doc[i])
                    comps.append(comp[i])
                    held.append(sketch[i])
                    continue
                if not docs:
                    continue
                if ready is None:
                    ready = np.array(docs), np.array(comps), np.stack(held)
                    near_to, roots = np.zeros(len(docs), bool), np.array(comps)
                near = (ready[1] != comp[i]) & (_popcount(ready[2] ^ sketch[i]).sum(axis=1) <= bits)
                if near.any():
                    near_to |= near
                    out.append((int(doc[i]), None))
                    mine = int(comp[i])
                    while mine in parent:
                        mine = parent[mine]
                    for other in np.unique(roots[near]).tolist():
                        if other != mine:
                            out.append((mine, other))
                            parent[other] = mine
                            roots[roots == other] = mine
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    dealt = rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "side")
    return dealt.select("grp", "salt", "side", "doc", "comp", "sketch").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100, key: str | None = None) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id, kept and first; linked if whole * intersection >= part * union.

    A key names a column with another long in each row; without one the table's own rows are numbered.
    """
    keyed, key = (docs, key) if key else row_keyed(docs)
    given = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    made = cut(features(given, width))
    bits = most_bits(part / whole)
    same = ["n_shingles", "set_hi", "set_lo"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"))
    reps = cut(made.where("n_shingles > 0").groupBy(*same).agg(F.min(order).alias("first")).withColumn("rep", F.col("first.key")))
    whole_sets = made.select("key", "n_shingles", "bands", "sketch").join(reps.select(F.col("rep").alias("key")), "key", "left_semi")
    banded = whole_sets.select(F.col("key").alias("rep"), F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(stars.select("bucket", "lead"), "bucket"))  # rows of shared buckets only
    pairs = members.where("rep <> lead").select("lead", "rep").distinct()
    shared = members.select(F.col("rep").alias("key")).distinct()
    sketched = cut(made.select("key", "n_shingles", "sketch").join(shared, "key", "left_semi"))
    a, b = sketched.select(F.col("key").alias("lead"), F.col("sketch").alias("lead_sketch")), sketched.select(F.col("key").alias("rep"), "sketch")
    close = cut(pairs.join(a, "lead").join(b, "rep").where(xor_bits("lead_sketch", "sketch") <= bits).select("lead", "rep"))

    # first the stars: the lead is held, its members pass by
    counted = close.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    passing = close.join(counted, "lead").select(F.col("lead").alias("grp"), F.col("rep").alias("doc"), spread_of("rep", "n").alias("salt"), F.lit(1).alias("side"))
    leads = counted.select(F.col("lead").alias("grp"), F.col("lead").alias("doc"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / STREAM_ROWS) - 1).cast("long"))).alias("salt"), F.lit(0).alias("side"))
    in_stars = cut(close.select(F.explode(F.array("lead", "rep")).alias("doc")).distinct())
    texts = cut(_texts(in_stars, given, sketched))  # of all texts only those that a sketch has brought up
    links = cut(confirm(leads.unionByName(passing).withColumn("comp", F.col("doc")).join(texts, "doc"), width, part, whole, bits))
    found = cut(connected_components(links))

    # then what shares a bucket across components
    more = _cross(members, found, given, sketched, in_stars, texts, width, part, whole, bits)
    if more is not None:
        found = cut(connected_components(links.unionByName(more)))
    linked = reps.join(found.withColumnRenamed("node", "rep"), "rep").select("component", "first", "rep")
    tops = linked.groupBy("component").agg(F.min("first").alias("top"))
    of_rep = linked.join(tops, "component").select("rep", "top")
    of_set = reps.join(of_rep, "rep", "left").select(*same, F.coalesce("top", "first").alias("top"))
    with_words = made.where("n_shingles > 0").select("key", "doc_id", *same).join(of_set, same).select("key", "doc_id", "n_shingles", "top")
    without = made.where("n_shingles = 0").select("key", "doc_id", "n_shingles", order.alias("top"))
    out = with_words.unionByName(without).select(F.col("key").alias("row_key"), "doc_id", "n_shingles", F.col("top.doc_id").alias("component_id"), (F.col("key") == F.col("top.key")).alias("first"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first")))


def spread_of(doc: str, n: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.greatest(F.lit(1), F.ceil(F.col(n) / STREAM_ROWS)).cast("long"))


def _texts(docs: DataFrame, given: DataFrame, sketched: DataFrame) -> DataFrame:
    """doc, sketch and text of the docs named."""
    body = given.select(F.col("key").alias("doc"), "text").join(docs, "doc", "left_semi")
    return body.join(sketched.select(F.col("key").alias("doc"), "sketch"), "doc")


def _blocks(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """(grp, salt, side, doc, comp) of (grp, doc, comp, n_shingles): all but a group's largest component against all of it.

    The held side is dealt into blocks by weight and the streamed side by rows, so neither is unbounded.
    """
    sizes = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("rows")).select("grp", F.col("top.comp").alias("top"), "rows")
    dealt = cut(members.join(largest, "grp"))
    outside = dealt.where("comp <> top")
    blocks = outside.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / limit)).cast("long").alias("blocks"))
    deals = F.greatest(F.lit(1), F.ceil(F.col("rows") / STREAM_ROWS)).cast("long")
    held = outside.join(blocks, "grp").select("grp", F.pmod(F.xxhash64("doc"), "blocks").alias("block"), "doc", "comp", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(0).alias("side"))
    passing = dealt.join(blocks, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc", "comp", spread_of("doc", "rows").alias("deal"), F.lit(1).alias("side"))
    return held.unionByName(passing).select("grp", (F.shiftleft("block", 32) + F.col("deal")).alias("salt"), "side", "doc", "comp")


def _cross(members: DataFrame, found: DataFrame, given: DataFrame, sketched: DataFrame, in_stars: DataFrame, texts: DataFrame, width: int, part: int, whole: int, bits: int) -> DataFrame | None:
    """Confirmed links across components that share a bucket; None if there can be none."""
    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    open_ = cut(labelled.join(mixed, "bucket", "left_semi"))
    if open_.isEmpty():
        return None
    rows = _blocks(open_.select(F.col("bucket").alias("grp"), F.col("rep").alias("doc"), "comp"), F.lit(1), BLOCK_SKETCHES)
    seen = cut(screen(rows.join(sketched.select(F.col("key").alias("doc"), "sketch"), "doc"), bits))
    near = seen.where("v is not null")
    if near.isEmpty():
        return None
    groups = connected_components(near).select(F.col("node").alias("comp"), F.col("component").alias("grp"))
    hot = seen.where("v is null").select(F.col("u").alias("doc")).distinct()
    comps = open_.select(F.col("rep").alias("doc"), "comp").distinct()
    placed = hot.join(comps, "doc").join(groups, "comp").join(sketched.select(F.col("key").alias("doc"), "n_shingles"), "doc")
    new = cut(placed.select("doc").join(in_stars, "doc", "left_anti"))
    if not new.isEmpty():
        texts = texts.unionByName(_texts(new, given, sketched))
    more = cut(confirm(_blocks(placed, F.col("n_shingles"), BLOCK_SHINGLES).join(texts, "doc"), width, part, whole, bits))
    return None if more.isEmpty() else more


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: 3-word shingles, 100 * intersection >= 85 * union."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, part=85, whole=100).select("doc_id", "n_shingles", "component_id", "kept")
