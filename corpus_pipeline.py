"""The corpus pipeline: five filters and transforms over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; extra columns
of the input pass through. The last stage adds the number of each emitted copy.

Stages decide row by row, by a key of the row in the written table they are given: ids may be null or
repeat, also with other texts. Rows of the same text are near copies of one another, whatever their
ids; texts without a word stand alone, as in the operator. Null and empty texts pass every filter and
are taken by the mix as documents of size 0 of their source. Ties go to the smaller id, then to the
row that is read first. An empty table gives an empty table from every stage; extra columns pass
through unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import decontaminate, mixing, near_dedup, pii, toxicity
from civicspark.llm.common import ensure_checkpoint_dir, removed, row_keyed, table


def _without(docs: DataFrame, keyed: DataFrame, key: str, found: DataFrame, of: str = "row_key") -> DataFrame:
    return keyed.join(found.select(F.col(of).alias(key)), key, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents that are here, drop the rows that the classifier calls toxic."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    keyed, key = row_keyed(docs)
    given = keyed.select(F.col(key).alias("doc_id"), "text")  # scores say nothing of ids, so the key stands for one
    return _without(docs, keyed, key, toxicity.score_toxicity(given, model).where("predicted = 1"), "doc_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group the row with its smallest id stays (null ids are last).

    Rows of one text are copies whatever their ids; of several with the smallest id the first as read stays.
    """
    keyed, key = row_keyed(docs)
    found = near_dedup.near_duplicates(keyed, width=5, part=80, whole=100, key=key).where("first").select(F.col("row_key").alias(key))
    return keyed.join(found, key, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows of which benchmark windows cover a twentieth of the words or more; null texts stay."""
    keyed, key = row_keyed(docs)
    return _without(docs, keyed, key, decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), key=key).where("contaminated"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in brackets; ``n_chars``, where there is one, follows the new text. Every row stays."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times, numbered in ``copy_no`` (``mix_copy_no`` where that is taken)."""
    return mixing.emit_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_private),
    ("mixing", mix),
]

#: Trained stages and similarity joins can't be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's folder goes when the next one is written; the last stays for the result."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
