"""Operator 9 [native]: mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The documents of a source stand
in one order (by size, then by a hash of the id, so that each stretch of the order holds like sizes);
their expected copies are prefix-summed, one offset per source is added, and a document is emitted
once for each integer its interval crosses. Since the expectation is the same within a source, the
prefix sum of a document is its rank times that expectation, and the rank comes from counts at three
levels (sizes of a source, hash ranges of one size, rows of one range), each a bounded window: no
task ever sorts a source.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; sources of
size 0 have target 0 and their documents are not taken; ids that repeat share a rank order by their
text's hash, so their intervals differ; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.llm.common import cut, row_keyed, table

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one size of one source that a single window may hold.
ROWS_PER_RANGE = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to targets: weights by rank, filled like water up to each source's cap.

    Sources whose cap lies lowest for their weight fill first. ``level`` is the common height per
    weight that the rest would share; the first source whose cap is not below it fixes it for all.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("cap_per_weight", "rank")
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_rank))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * MOST_REPEATS)
        .withColumn("cap_per_weight", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("filled", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.coalesce("filled", F.lit(0))).cast("double") / F.col("open_weight"))
        .withColumn("fixed", F.min(F.when(F.col("level") <= F.col("cap_per_weight"), F.struct("cap_per_weight", "rank", "level"))).over(Window.partitionBy()))
    )
    target = F.when(F.struct("cap_per_weight", "rank") < F.struct("fixed.cap_per_weight", "fixed.rank"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("fixed.level"))
    return ranked.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, from a hash of its name and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, seed: int = 0, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix emits the document).

    A key, a column with another value in each row, is handed on and orders rows that are alike.
    """
    own = [key] if key else []
    sized = docs.select(
        *own,
        "doc_id",
        "source",
        word_count().alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long").alias("draw"),
        F.xxhash64("text").alias("text_hash"),
    )
    sized = cut(sized)  # a few numbers a document, counted once for all that follows
    per_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("alike"))
    sizes = per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"))
    steps = (
        per_size.withColumn("before_size", F.coalesce(F.sum("alike").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("ranges", F.ceil(F.col("alike") / ROWS_PER_RANGE))
        .alias("s")
    )
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size"))
    placed = (
        sized.alias("d")
        .join(steps, same)
        .select(*own, "d.doc_id", "d.source", "d.size", "draw", "text_hash", "before_size", F.floor(F.col("draw") * F.col("ranges") / F.lit(4294967296.0)).alias("part"))
    )
    parts = placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    parts = parts.withColumn("before_part", F.coalesce(F.sum("in_part").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("p")
    here = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id", "text_hash", *own))
    numbered = placed.withColumn("in_range", here).alias("n")
    match = F.col("n.source").eqNullSafe(F.col("p.source")) & (F.col("n.size") == F.col("p.size")) & (F.col("n.part") == F.col("p.part"))
    ranked = numbered.join(parts, match).select(*own, "n.doc_id", "n.source", "n.size", (F.col("before_size") + F.col("before_part") + F.col("in_range")).alias("rank"))
    goals = source_targets(sizes).alias("g")
    expected = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    crossed = F.floor(F.col("rank") * expected + offset_of(F.col("r.source"), seed)) - F.floor((F.col("rank") - 1) * expected + offset_of(F.col("r.source"), seed))
    return (
        ranked.alias("r")
        .join(goals, F.col("r.source").eqNullSafe(F.col("g.source")))
        .select(*own, "doc_id", "r.source", "size", "source_size", "target", F.least(crossed, F.lit(MOST_REPEATS)).cast("int").alias("copies"))
    )


def emit_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed documents: each row once per copy, with its number from 1 in copy_no (mix_copy_no where that is taken)."""
    keyed, key = row_keyed(docs)
    copies = mix_sources(keyed, seed, key).where(F.col("copies") > 0).select(F.col(key).alias("mix_key"), F.col("copies").alias("mix_copies"))
    copy = "copy_no"
    while copy in docs.columns:
        copy = f"mix_{copy}"
    kept = keyed.alias("d").join(copies.alias("c"), F.col(f"d.{key}") == F.col("c.mix_key"))
    return kept.select("d.*", F.explode(F.sequence(F.lit(1), F.col("c.mix_copies"))).alias(copy)).drop(key)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixing_sql(docs: str = "documents", seed: int = 0) -> str:
    """DuckDB's form of the mix: a plain rank over each source, which the levels above add up to."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM sizes),
weighted AS (
  SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM ranked),
capped AS (SELECT *, cap::DOUBLE / weight AS cpw FROM weighted),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cpw, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(weight) OVER (ORDER BY cpw, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER () AS total
  FROM capped),
levels AS (SELECT *, (total - done)::DOUBLE / open_weight AS level FROM filled),
fixed AS (SELECT cpw AS f_cpw, rk AS f_rk, level AS f_level FROM levels WHERE level <= cpw ORDER BY cpw, rk LIMIT 1),
goals AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE
              WHEN cpw < f_cpw OR (cpw = f_cpw AND rk < f_rk) THEN cap::DOUBLE
              ELSE weight * f_level END AS target,
         ('0x' || substr(md5('{seed}:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM levels, fixed),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.u,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.draw, s.doc_id) AS rank,
         g.target / greatest(g.source_size, 1) AS expected
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (least(floor(rank * expected + u) - floor((rank - 1) * expected + u), 3)::BIGINT * size)::BIGINT AS taken
FROM placed"""
