"""Operator 2: removal of long substrings that an earlier document holds, by names of strings at two lengths.

A 50-byte string of a document goes where it also starts in a document with a smaller id. This
is not prefix doubling over pairs of ranks: that would move some 14 times the input if it began with
every suffix, so two rounds name strings at sampled positions instead, and the sample is chosen so that nothing is lost: of the 27 strings of 24 bytes within a
50-byte window, the one with the smallest hash (the leftmost of equal ones) is the window's anchor.
Equal windows have equal anchors at equal places, so windows can only be equal where their anchors'
strings are. The rounds, at growing lengths:

1. rank 24 and beyond: each batch of documents names, for every anchor, its 24-byte string and the
   stretch of bytes that its windows cover (50 to 76 bytes). Spark deals the sorted names to ranges;
   a range ranks them together and answers with the smallest document of each stretch, and marks the
   24-byte strings that go on in more than one way. Names that are unique end here;
2. rank 50: for the marked ones the bytes around the 24-byte string are dealt once more, and ranges
   rank the windows themselves, all strings of 50 bytes at once, and answer with the smallest
   document of each;
3. each batch marks the bytes of its documents that hit windows cover.

Names are sorted arrays, one row for each pair of batch and range, so that equal names of a batch
travel once (a copy group, however large, sends one name a batch). A batch is bounded in bytes, a
range in names. Batches are made from the shuffled documents each time and hold no state, so a lost
executor costs only a repeated task. Names are 96 bits in round 1 and windows 64 bits beside the
64-bit name of their anchor.

All continuations of one 24-byte string are dealt to one range; a string with very many of them is
one group there, which is not split.

Edge cases: null and empty texts and texts under 50 bytes lose nothing; documents of one id do not
remove each other's bytes; a null id is never smaller than another and loses nothing; repeated rows
stay repeated; texts longer than a segment are ranked by overlapping segments; extra columns are
dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import GOLDEN, U64, SubstringHash, joined_bytes, mix, runs, table, utf8

LENGTH = 50
ANCHOR = 24
SPREAD = LENGTH - ANCHOR
BATCH_BYTES = 4 << 20
SEGMENT = 1 << 20
ENTRIES_AT_ONCE = 16_384
PLACE_BITS = U64(24)
PLACE_MASK = U64((1 << 24) - 1)
NAME_SHIFT = U64(24)
STRETCH_SHIFT = U64(8)


def pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(kind)


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first and last window of each anchor, its place, its string's and stretch's names."""
    parts = [_anchors_of_segment(data[at : at + SEGMENT + LENGTH - 1], at) for at in range(0, len(data) - LENGTH + 1, SEGMENT)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors_of_segment(data: np.ndarray, offset: int) -> tuple:
    hashed = SubstringHash(data)
    name = mix(hashed.every(ANCHOR))
    least = (name & ~PLACE_MASK) | np.arange(len(name), dtype=U64)
    size = 1
    while size * 2 <= SPREAD + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = SPREAD + 1 - size
    least = np.minimum(least[: len(least) - rest], least[rest:])  # of SPREAD + 1 places from each window's start
    place = (least & PLACE_MASK).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    shape = ((at - first) * 64 + (last - first)).astype(U64)
    stretch = mix(hashed.at(first, last + LENGTH) + mix(shape * GOLDEN))
    return first + offset, last + offset, at + offset, name[at], stretch


class Batch:
    """The documents of a batch in id order, and the distinct names of their anchors, sorted."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        texts = rows.column("text").take(pa.array(order)).combine_chunks()
        self.data, self.bounds = joined_bytes(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, 0, len(ids))
        found, owner = [], []
        for i, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            if b - a >= LENGTH:
                first, last, at, name, stretch = anchors(self.data[a:b])
                found.append((first + a, last + a, at + a, name, stretch))
                owner.append(np.full(len(first), i))
        if not found:
            found, owner = [tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, U64), np.empty(0, U64))], [np.empty(0, np.int64)]
        self.first, self.last, self.at, name, stretch = (np.concatenate(x) for x in zip(*found, strict=True))
        self.owner = np.concatenate(owner)
        by = np.lexsort((stretch, name))  # stable: of equal names the smallest id comes first
        n, s = name[by], stretch[by]
        fresh = np.append(True, (n[1:] != n[:-1]) | (s[1:] != s[:-1])) if len(n) else np.empty(0, bool)
        self.name, self.stretch, self.sample = n[fresh], s[fresh], by[fresh]
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(fresh) - 1
        self.least = self.ids[self.owner[self.sample]]

    def ranges(self, count: int) -> dict[int, tuple[int, int]]:
        """Where the names of each range stand among the entries, for the ranges that have some."""
        part = ((self.name >> U64(32)) * U64(count)) >> U64(32)
        if not len(part):
            return {}
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        return dict(zip(part[begin].tolist(), zip(begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True), strict=True))


ROW = "batch int, part int, round int, payload array<binary>"


def _rows(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({n: pa.array(list(v), k) for n, v, k in zip(("batch", "part", "round", "payload"), columns, kinds, strict=True)})


def send_names(rows: pa.Table, count: int) -> pa.Table:
    """Round 1 of a batch: sorted names with the smallest id of each."""
    number = rows.column("batch")[0].as_py()
    batch = Batch(rows)
    out = []
    for part, (a, b) in batch.ranges(count).items():
        out.append((number, part, 1, [pack(steps(batch.name[a:b] >> NAME_SHIFT)), pack(batch.stretch[a:b] >> STRETCH_SHIFT), pack(batch.least[a:b])]))
    return _rows(out)


def rank_names(rows: pa.Table) -> pa.Table:
    """A range of round 1: smallest id of each stretch, and which names go on in several ways."""
    batches, part = rows.column("batch").to_pylist(), rows.column("part")[0].as_py()
    got = [[unpack(p[0]), unpack(p[1]), unpack(p[2], np.int64)] for p in rows.column("payload").to_pylist()]
    name = np.concatenate([np.cumsum(x[0]) for x in got])
    stretch, least = (np.concatenate([x[k] for x in got]) for k in (1, 2))
    by = np.lexsort((stretch, name))
    n, s = name[by], stretch[by]
    new_name = np.append(True, n[1:] != n[:-1])
    fresh = new_name | np.append(True, s[1:] != s[:-1])
    smallest = np.empty(len(by), np.int64)
    smallest[by] = np.minimum.reduceat(least[by], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    ways = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(new_name))
    several = np.empty(len(by), bool)
    several[by] = (ways > 1)[np.cumsum(new_name) - 1]
    out, at = [], 0
    for number, x in zip(batches, got, strict=True):
        here = slice(at, at + len(x[0]))
        at += len(x[0])
        lower = np.flatnonzero(smallest[here] < least[here])
        open_ = np.flatnonzero(several[here])
        if len(lower) or len(open_):
            out.append((number, part, 1, [pack(steps(lower)), pack(smallest[here][lower]), pack(steps(open_))]))
    return _rows(out)


class Answers:
    """What the ranges said about a batch's entries."""

    def __init__(self, batch: Batch, count: int, replies: pa.Table):
        edges = batch.ranges(count)
        self.least, self.open = batch.least.copy(), np.zeros(len(batch.name), bool)
        second = {}
        for part, round_, payload in zip(*(replies.column(c).to_pylist() for c in ("part", "round", "payload")), strict=True):
            if round_ == 1:
                lower, smallest, open_ = np.cumsum(unpack(payload[0], np.int64)), unpack(payload[1], np.int64), np.cumsum(unpack(payload[2], np.int64))
                self.least[edges[part][0] + lower] = smallest
                self.open[edges[part][0] + open_] = True
            else:
                second[part] = unpack(payload[0], np.int64)
        chosen = np.flatnonzero(self.open)
        self.start = np.full(len(batch.name), -1, np.int64)  # where an open entry's windows begin in self.window
        size = batch.last[batch.sample] - batch.first[batch.sample] + 1
        own = np.repeat(batch.least[chosen], size[chosen])
        self.start[chosen] = np.append(0, np.cumsum(size[chosen])[:-1])[: len(chosen)]
        self.window = own
        for part, less in second.items():
            entries = chosen[slice(*np.searchsorted(chosen, edges[part]))]
            if len(entries):
                at = self.start[entries[0]]
                self.window[at : at + len(less)] -= less


def send_windows(key: tuple, rows: pa.Table, replies: pa.Table, count: int) -> pa.Table:
    """Round 2 of a batch: the bytes on both sides of the anchors that go on in several ways."""
    if not rows.num_rows or not replies.num_rows:
        return _rows([])
    number = key[0].as_py()
    batch = Batch(rows)
    answers = Answers(batch, count, replies)
    out = []
    for part, (a, b) in batch.ranges(count).items():
        entries = np.flatnonzero(answers.open[a:b]) + a
        if not len(entries):
            continue
        which = batch.sample[entries]
        first, last, at = batch.first[which], batch.last[which], batch.at[which]
        left, right = at - first, last + LENGTH - at - ANCHOR
        begin = np.stack([first, at + ANCHOR], axis=1).ravel()
        size = np.stack([left, right], axis=1).ravel()
        where = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        around = zstandard.ZstdCompressor(level=1).compress(batch.data[where].tobytes())
        out.append((number, part, 2, [pack(steps(batch.name[entries])), pack(left * 64 + right), around, pack(batch.least[entries])]))
    return _rows(out)


def rank_windows(rows: pa.Table) -> pa.Table:
    """A range of round 2: the smallest id of each window, as what it is below the asking batch's own."""
    batches, part = rows.column("batch").to_pylist(), rows.column("part")[0].as_py()
    names, lefts, rights, bodies, leasts = [], [], [], [], []
    for p in rows.column("payload").to_pylist():
        names.append(np.cumsum(unpack(p[0])))
        both = unpack(p[1], np.int64)
        lefts.append(both // 64)
        rights.append(both % 64)
        bodies.append(zstandard.ZstdDecompressor().decompress(p[2]))
        leasts.append(unpack(p[3], np.int64))
    name, left, right, least = (np.concatenate(x) for x in (names, lefts, rights, leasts))
    size = left + right - SPREAD + 1  # windows of an entry: each is SPREAD bytes around the anchor
    bytes_ = np.append(0, np.cumsum(left + right))
    body = np.frombuffer(b"".join(bodies), np.uint8)
    window = np.empty(size.sum(), U64)
    done = 0
    for a in range(0, len(name), ENTRIES_AT_ONCE):  # hashes need several times the bytes, so in bounded steps
        b = min(a + ENTRIES_AT_ONCE, len(name))
        k = size[a:b]
        nth = np.arange(k.sum()) - np.repeat(np.append(0, np.cumsum(k)[:-1]), k)
        start = np.repeat(bytes_[a:b] - bytes_[a], k) + nth
        ahead = np.repeat(left[a:b], k) - nth
        hashed = SubstringHash(body[bytes_[a] : bytes_[b]])
        window[done : done + len(nth)] = mix(mix(np.repeat(name[a:b], k) + ahead.astype(U64) * GOLDEN) ^ hashed.at(start, start + SPREAD))
        done += len(nth)
    own, of = np.repeat(least, size), np.repeat(name, size)
    by = np.lexsort((window, of))  # equal windows have equal anchors: 128 bits tell windows apart
    window, of = window[by], of[by]
    fresh = np.append(True, (window[1:] != window[:-1]) | (of[1:] != of[:-1]))
    del window, of
    smallest = np.empty(len(by), np.int64)
    smallest[by] = np.minimum.reduceat(own[by], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    out, at, edges = [], 0, np.append(0, np.cumsum(size))
    for number, x in zip(batches, names, strict=True):
        a, b = edges[at], edges[at + len(x)]
        at += len(x)
        less = own[a:b] - smallest[a:b]
        if less.any():
            out.append((number, part, 2, [pack(less)]))
    return _rows(out)


def removed_bytes(batch: Batch, answers: Answers) -> np.ndarray:
    """For each byte of the batch, whether a window covers it that starts in a smaller document."""
    entry = batch.entry
    doc = batch.ids[batch.owner]
    change = np.zeros(len(batch.data) + 1, np.int32)
    plain = ~answers.open[entry] & (answers.least[entry] < doc)
    np.add.at(change, batch.first[plain], 1)
    np.add.at(change, batch.last[plain] + LENGTH, -1)
    some = np.flatnonzero(answers.open[entry])
    size = (batch.last - batch.first + 1)[some]
    if len(some):
        nth = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
        hit = answers.window[np.repeat(answers.start[entry[some]], size) + nth] < np.repeat(doc[some], size)
        at = (np.repeat(batch.first[some], size) + nth)[hit]
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary"


def judge(rows: pa.Table, replies: pa.Table, count: int, texts: bool) -> pa.Table:
    """Round 3 of a batch: removed spans (starts and ends in turn) and, if asked for, the kept bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")
    out: list[list] = [[] for _ in names]
    if rows.num_rows:
        batch = Batch(rows)
        gone = removed_bytes(batch, Answers(batch, count, replies))
        starts, ends = runs(gone.astype(np.uint8), batch.bounds)
        at = np.searchsorted(starts, batch.bounds)
        for i, doc in enumerate(batch.ids):
            a, b = batch.bounds[i], batch.bounds[i + 1]
            s, e = starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
            own = batch.data[a:b]
            kept = (own[~gone[a:b]] if len(s) else own).tobytes()
            row = (int(doc), int(b - a), int((e - s).sum()), len(s), (np.stack([s, e], axis=1).ravel() - a).tolist(), kept if texts else b"", hashlib.sha256(kept).hexdigest())
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return pa.table({n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})


def substring_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (empty unless ``texts``) and kept_sha256."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BATCH_BYTES))
    # a null id would be read as a number; it stands in a batch of its own kind and is judged apart
    known = given.where(F.col("doc_id").isNotNull()).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int"))
    by_batch = known.groupBy("batch")
    named = by_batch.applyInArrow(lambda rows: send_names(rows, count), ROW)
    first = named.groupBy("part").applyInArrow(rank_names, ROW)
    around = by_batch.cogroup(first.groupBy("batch")).applyInArrow(lambda key, rows, replies: send_windows(key, rows, replies, count), ROW)
    second = around.groupBy("part").applyInArrow(rank_windows, ROW)
    replies = first.unionByName(second)
    schema = RESULT + ", kept_sha256 string"
    found = by_batch.cogroup(replies.groupBy("batch")).applyInArrow(lambda rows, back: judge(rows, back, count, texts), schema)
    none = F.array().cast("array<bigint>")
    alone = given.where(F.col("doc_id").isNull()).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), none.alias("spans"), (F.col("text") if texts else F.lit(b"")).alias("kept"), F.sha2("text", 256).alias("kept_sha256")
    )
    return found.unionByName(alone)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract in plain loops, for tests."""
    owner: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, t in raw:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if owner[t[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
