"""Shared pieces of the training-data operators: table access, Arrow text batches, byte hashing.

Text columns travel to Python as UTF-8 bytes. A null text is an empty one unless an operator says
otherwise. All hashes are functions of the bytes alone, so a recomputed task gives the same values
on any executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd, so that it has an inverse modulo 2**64 and substring hashes can be shifted to a common power.
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def utf8(text_col: str = "text") -> Column:
    """Bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever it is kept."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a distinct long for each row, and that column's name.

    The key of a table as read is the number of the row's file and its place there, so it is the same
    whenever the table is read again; any other table is written once. The files' names are collected
    and broadcast: as many short strings as there are files.
    """
    key, name = "row_key", "row_file"
    while {key, name} & set(docs.columns):
        key, name = f"{key}_", f"{name}_"
    try:
        if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
            raise AnalysisException("not a table as read")
        located = docs.select("*", F.col("_metadata.file_path").alias(name), F.col("_metadata.row_index").alias(key))
    except AnalysisException:
        return cut(docs.withColumn(key, F.monotonically_increasing_id())), key
    paths = sorted(r[0] for r in located.select(name).distinct().collect())
    files = docs.sparkSession.createDataFrame(pa.table({name: pa.array(paths, pa.string()), "file_no": pa.array(range(len(paths)), pa.int64())}))
    numbered = located.join(F.broadcast(files.withColumnRenamed("file_no", f"{name}_no")), name)
    return numbered.withColumn(key, F.shiftleft(f"{name}_no", 40) + F.col(key)).drop(name, f"{name}_no"), key


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, at most one out; batches are cut so that long texts stay bounded in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def slices(column: pa.Array, at_most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column that hold about ``at_most`` bytes (a longer value stands alone)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + at_most, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


def joined_bytes(column: pa.Array, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows start..end in one array, and where each begins (one more entry than rows)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset + start : column.offset + end + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value over all its bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random-looking 64-bit value for each byte, made by a rule.
BYTE_VALUE = mix((np.arange(1, 257, dtype=U64)) * GOLDEN)

_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n, kept between calls."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())

        def upto(base: int) -> np.ndarray:
            out = np.ones(size, U64)
            out[1:] = U64(base)
            return np.multiply.accumulate(out)

        _powers = upto(BASE), upto(BASE_INVERSE)
    return _powers[0][:n], _powers[1][:n]


class SubstringHash:
    """64-bit hashes of any substrings of a byte array: equal bytes, equal hash, wherever they start."""

    def __init__(self, data: np.ndarray):
        ahead, self.back = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUE[data] * ahead[: len(data)], out=self.total[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of one length."""
        n = len(self.total) - length
        return (self.total[length:] - self.total[:n]) * self.back[:n]


#: 0 where a byte is ASCII white space (space and 9 to 13), 1 elsewhere.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = 0
#: A to Z become a to z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ones, which never cross one of the bounds."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(len(inside) + 1, np.int8)
    edge[0], edge[-1] = inside[0], -inside[-1].astype(np.int8)
    np.subtract(inside[1:], inside[:-1], out=edge[1:-1], dtype=np.int8, casting="unsafe")
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.unique(bounds[(bounds > 0) & (bounds < len(inside))])
    cut_at = inner[(inside[inner] == 1) & (inside[inner - 1] == 1)]
    if len(cut_at):
        starts, ends = np.sort(np.concatenate([starts, cut_at])), np.sort(np.concatenate([ends, cut_at]))
    return starts, ends


def label_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, mod: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: (id, label, text), balanced by class.

    Places go to ids that have a document, by a hash of the id, so the choice repeats. Where one id has
    several labels the largest holds; where it has several texts the smallest one does. Null labels and
    null ids are passed over.
    """
    here = docs.where(F.col(id_col).isNotNull())
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (crc32_of_id(id_col) % mod != held))
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("label"))
        .join(here.select(id_col), id_col, "left_semi")
    )
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows // 2) for k in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    # at most `rows` rows of two integers: the bound makes this broadcast safe
    return here.select(id_col, utf8().alias("text")).join(F.broadcast(ids), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))


def fit_in_one_task(sample: DataFrame, prepare: Callable[[bytes], bytes], fit: Callable[[list, list, list[bytes]], bytes], id_col: str, target: str) -> bytes:
    """Fit over a bounded number of rows in one task; returns the model's bytes, or none without rows.

    Texts are turned into packed features where they are, so the fit's task is sent features alone. It
    gets ids, targets and features in the order of the ids.
    """

    def ready(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([prepare(x.as_py()) for x in batch.column("text")], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(target), made], ["id", "target", "made"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, targets, made = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            targets += batch.column("target").to_pylist()
            made += batch.column("made").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], targets[i]))
        model = fit([ids[i] for i in order], [targets[i] for i in order], [made[i] for i in order]) if ids else b""
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    kinds = dict(sample.dtypes)
    features = map_arrow(sample.select(id_col, target, "text"), ready, f"id {kinds[id_col]}, target {kinds[target]}, made binary")
    rows = features.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else b""


def text_list(table_: pa.Table, name: str = "text") -> list[bytes]:
    return [x or b"" for x in table_.column(name).to_pylist()]
