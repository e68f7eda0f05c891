"""Operator 5: benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is 13 consecutive item words (an item of fewer words is one window). Its set is its
shingles of ``SHINGLE`` words. The steps:

1. windows: the distinct windows of all items, a Spark table; they are dealt into blocks of a bounded
   number of windows, which are handled one after the other against all documents;
2. rarity: every document is scanned once for the shingles of the block, and Spark sums how often each
   occurs in the corpus;
3. prefix: a window must be contained whole, so the prefix it needs is one shingle, the rarest;
4. join: document shingles that are some window's prefix give candidates; the shingle's place in the
   window fixes where the window would start (positional bound), and only runs of window words that
   are long enough are looked at (length bound);
5. verify: the candidate's words are compared with the window's, word by word.

Words are compared as ids of the block's vocabulary, which are equal exactly where the words are. The
driver holds one block at a time; what a block hits is written before the next one comes. Rows are told
apart by a key that stays the same whenever the table is read.

Edge cases: a null or empty text has no words and is never contaminated; a null or wordless item has
no window; an item without an id hits words like any other and is not listed; equal items count apart;
repeated documents, and rows without an id, each have a row in the result; very long texts are scanned
whole, one at a time; extra columns are dropped; an empty benchmark hits nothing, an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import cut, map_arrow, row_keyed, table, utf8

WINDOW = 13
SHINGLE = 5
SHARE = 20  # contaminated if 20 * n_hit >= n_words
#: Windows a block may hold: at about 200 bytes a window, some 20 MB of index in each task.
WINDOWS_PER_BLOCK = 100_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words, for counting them in a text that is not lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered, then runs of digits, letters and all that is not ASCII."""
    return WORD.findall(text.lower())


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id (as text) and the words of each distinct window, newline-joined."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, windows = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            found = {b"\n".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))} if words else set()
            ids += [item] * len(found)
            windows += sorted(found)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary())], ["item_id", "words"])

    return map_arrow(benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text")), run, "item_id string, words binary")


class Index:
    """Windows of one block as arrays of word ids, with their shingles."""

    def __init__(self, windows: list[bytes]):
        lists = [w.split(b"\n") for w in windows]
        self.ids = {w: i for i, w in enumerate(sorted({w for x in lists for w in x}))}
        self.windows = [np.array([self.ids[w] for w in x], np.int64) for x in lists]
        self.least = min((len(w) for w in self.windows), default=WINDOW)
        self.lengths = sorted({len(w) for w in self.windows})

    @staticmethod
    def width(length: int) -> int:
        return min(SHINGLE, length)

    def codes(self, ids: np.ndarray, width: int) -> np.ndarray:
        """A code for each run of ``width`` word ids: a window's shingles and a document's alike."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        code = np.full(n, width, np.uint64)
        for k in range(width):
            code = (code ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code

    def widths(self) -> list[int]:
        return sorted({self.width(n) for n in self.lengths})

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def known_runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of vocabulary words that are long enough for the shortest window."""
        edge = np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = ends - starts >= self.least
        return zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)


def shingle_counts(docs: DataFrame, index: Index) -> dict[int, int]:
    """How often each shingle of the block's windows occurs in the corpus: at most as many as those."""
    wanted = {w: np.unique(np.concatenate([index.codes(x, w) for x in index.windows if len(x) >= w])) for w in index.widths()}
    every = np.unique(np.concatenate(list(wanted.values()))) if wanted else np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            seen = []
            for text in batch.column("text"):
                ids = index.word_ids(words_of(text.as_py()))
                for start, end in index.known_runs(ids):
                    for width in wanted:
                        codes = index.codes(ids[start:end], width)
                        at = np.searchsorted(every, codes)
                        ok = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == codes)
                        seen.append(at[ok])
            if seen:
                which, n = np.unique(np.concatenate(seen), return_counts=True)
                counts.update(dict(zip(which.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["shingle", "n"])

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {int(every[r["shingle"]]): r["n"] for r in found.collect()}


def matcher(index: Index, counts: dict[int, int]):
    """Prefix tables of the block: (width) -> sorted prefix codes, each with its (window, place) list."""
    tables: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for i, window in enumerate(index.windows):
        width = index.width(len(window))
        codes = index.codes(window, width)
        place = min(range(len(codes)), key=lambda k: (counts.get(int(codes[k]), 0), int(codes[k])))
        tables.setdefault(width, {}).setdefault(int(codes[place]), []).append((i, place))
    prefixes = {}
    for width, of in tables.items():
        # windows of one prefix by place and length, so that a candidate looks its words up once for each
        grouped = {c: {} for c in of}
        for code, found in of.items():
            for i, place in found:
                grouped[code].setdefault((place, len(index.windows[i])), {})[index.windows[i].tobytes()] = i
        prefixes[width] = (np.array(sorted(of), np.uint64), grouped)

    def match(text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit stretches of words, and windows that occur."""
        words = words_of(text)
        ids = index.word_ids(words)
        stretches, hit = [], set()
        for start, end in index.known_runs(ids):
            part = ids[start:end]
            for width, (keys, grouped) in prefixes.items():
                codes = index.codes(part, width)
                at = np.searchsorted(keys, codes)
                for k in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == codes)).tolist():
                    for (place, length), windows in grouped[int(codes[k])].items():
                        begin = k - place
                        if begin < 0 or begin + length > len(part):
                            continue
                        window = windows.get(part[begin : begin + length].tobytes())
                        if window is not None:
                            stretches.append((start + begin, start + begin + length))
                            hit.add(window)
        return len(words), stretches, hit

    return match


def union_length(stretches: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for start, end in sorted(stretches):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, windows_per_block: int = WINDOWS_PER_BLOCK, key: str | None = None) -> DataFrame:
    """row_key, doc_id, n_words, n_hit, item_ids (sorted as strings) and contaminated, a row for each document.

    A key names a column with another long in each row; without one the table's own rows are numbered.
    """
    keyed, key = (docs, key) if key else row_keyed(docs)
    given = keyed.select(F.col(key).alias("row_key"), utf8().alias("text"))
    windows = cut(item_windows(benchmark).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    blocks = max(1, -(-windows.count() // windows_per_block))
    hits = docs.sparkSession.createDataFrame([], HITS)
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).orderBy("words").collect()  # about windows_per_block rows
        if rows:
            hits = hits.unionByName(_block_hits(given, [bytes(r["words"]) for r in rows], [list(r["items"]) for r in rows]))
    every = keyed.select(F.col(key).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col("text"), F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    judged = every.join(_merge(hits), "row_key", "left").select("row_key", "doc_id", "n_words", n_hit.alias("n_hit"), items.alias("item_ids"))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


HITS = "row_key long, spans array<long>, item_ids array<string>"


def _block_hits(given: DataFrame, windows: list[bytes], items: list[list[str]]) -> DataFrame:
    """Of each document that some window of the block is in: the hit stretches of words, and the items."""
    index = Index(windows)
    match = matcher(index, shingle_counts(given, index))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, spans, found = [], [], []
        for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text"), strict=True):
            _, stretches, hit = match(text.as_py())
            if stretches:
                keys.append(key)
                spans.append([x for s in sorted(set(stretches)) for x in s])
                found.append(sorted({x for w in hit for x in items[w]}))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["row_key", "spans", "item_ids"])

    return cut(map_arrow(given, run, HITS))


def _merge(hits: DataFrame) -> DataFrame:
    """row_key, n_hit and item_ids: blocks of one document put together."""
    items = F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    grouped = hits.groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [union_length(list(zip(s[::2], s[1::2], strict=True))) for s in batch.column("spans").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(hit, pa.int64()), batch.column("item_ids")], ["row_key", "n_hit", "item_ids"])

    return map_arrow(grouped, run, "row_key long, n_hit long, item_ids array<string>")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple], benchmark: list[tuple]) -> list[tuple]:
    """The contract in plain loops, for tests."""
    out = []
    windows = [(item, words_of((text or "").encode())) for item, text in benchmark]
    for doc_id, text in docs:
        words, hit, items = words_of((text or "").encode()), set(), set()
        for item, own in windows:
            size = min(WINDOW, len(own))
            pieces = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if size and tuple(words[i : i + size]) in pieces:
                    hit.update(range(i, i + size))
                    items.add(str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(items), digest, bool(hit) and SHARE * len(hit) >= len(words)))
    return out
