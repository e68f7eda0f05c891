"""Chunks of documents and word statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.qgrams import similar_strings
from civicspark.sources.tables import cut


LINE_ENDS = r"(?<=\n|\r(?!\n)|[\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def chunk(docs: DataFrame, target: int = 7000, hard: int = 8000, whole: int | None = None) -> DataFrame:
    """(doc, chunk_index, char_start, char_end, text): pieces that join up to the whole text.

    A text of at most ``whole`` (else ``hard``) characters is chunk 0. Longer ones fall into blocks at headings (lines
    that start with #). Blocks are put together while they stay within ``target``; a block over ``hard``
    closes what came before and is filled line by line up to ``hard``, and its last piece stays open for
    what follows. Only a line that is longer on its own makes a longer chunk. One document is one fold.
    """
    lines = F.filter(F.split("text", LINE_ENDS, -1), lambda x: x != "")
    lengths = F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), x.startswith("#").alias("head")))
    last = lambda a: F.element_at(a, -1)
    # blocks as arrays of line lengths
    grow = lambda acc, x: F.when(x["head"] & (F.size(acc) > 0) | (F.size(acc) == 0), F.concat(acc, F.array(F.array(x["n"])))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last(acc), F.array(x["n"])))))
    blocks = F.aggregate(lengths, F.array().cast("array<array<int>>"), grow)
    spans = F.array().cast("array<struct<s:int,e:int>>")
    span = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
    state = lambda done, s, e: F.struct(done.alias("done"), s.alias("s"), e.alias("e"))
    closed = lambda acc: F.when(acc["e"] > acc["s"], F.concat(acc["done"], span(acc["s"], acc["e"]))).otherwise(acc["done"])

    def line(acc, n):
        full = (acc["e"] > acc["s"]) & (acc["e"] - acc["s"] + n > hard)
        return state(F.when(full, closed(acc)).otherwise(acc["done"]), F.when(full, acc["e"]).otherwise(acc["s"]), acc["e"] + n)

    def block(acc, own):
        n = F.aggregate(own, F.lit(0), lambda a, x: a + x)
        over = n > hard
        flush = over | ((acc["e"] > acc["s"]) & (acc["e"] - acc["s"] + n > target))
        open_ = state(F.when(flush, closed(acc)).otherwise(acc["done"]), F.when(flush, acc["e"]).otherwise(acc["s"]), acc["e"])
        grown = F.when(over, F.aggregate(own, open_, line)).otherwise(state(open_["done"], open_["s"], open_["e"] + n))
        return F.element_at(F.transform(F.array(grown), lambda g: F.when(g["e"] - g["s"] >= F.when(over, hard).otherwise(target), state(closed(g), g["e"], g["e"])).otherwise(g)), 1)

    found = F.aggregate(blocks, state(spans, F.lit(0), F.lit(0)), block, closed)
    whole = hard if whole is None else whole
    small = docs.where(F.length("text") <= whole).select("doc", F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    large = docs.where(F.length("text") > whole).select("doc", "text", F.posexplode(found).alias("i", "x"))
    pieces = large.select("doc", (F.col("i") + 1).alias("chunk_index"), F.col("x.s").alias("char_start"), F.col("x.e").alias("char_end"), F.substring(F.col("text"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("text"))
    return small.unionByName(pieces)


def whole_texts(chunks: DataFrame, separator: str = "") -> DataFrame:
    """Chunks of a document put together in order."""
    return chunks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), separator).alias("text"))


def replace_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by document: a document that has fresh chunks loses its stored ones."""
    return stored.join(fresh.select("doc").distinct(), "doc", "left_anti").unionByName(fresh)


def store_chunks(fresh: DataFrame, path: str, buckets: int = 64) -> None:
    """Put fresh chunks into a table at ``path`` that is parted by a bucket of the document.

    Only the buckets of documents that have fresh chunks are read and written again (a dynamic partition
    overwrite, committed as one); the files of all others stay as they are. The first call makes the table.
    """
    spark = fresh.sparkSession
    dealt = fresh.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int"))
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        stored = spark.read.schema(dealt.schema).parquet(path)
        touched = [r[0] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
        dealt = cut(replace_chunks(stored.where(F.col("bucket").isin(touched)).select(*dealt.columns), dealt))
    dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def word_weights(docs: DataFrame, stopwords: list[str], least: int = 3) -> DataFrame:
    """(word, total, docs, tfidf): mean count in the documents that hold a word times ln(N / documents).

    docs has one row a document. A document gives all its words and then each of them once, so both numbers are
    counts by word: they are summed up where the text is read, and only words move, not words of documents.
    """
    listed = docs.select(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    both = F.array(F.struct(F.lit(False).alias("once"), "words"), F.struct(F.lit(True).alias("once"), F.array_distinct("words").alias("words")))
    words = listed.select(F.explode(both).alias("x")).select("x.once", F.explode("x.words").alias("word"))
    kept = words.where((F.length("word") >= least) & ~F.col("word").isin(stopwords))
    by_word = kept.groupBy("word").agg(F.count_if(~F.col("once")).alias("total"), F.count_if("once").alias("docs"))
    all_ = docs.agg(F.count(F.lit(1)).alias("all_docs"))
    return by_word.join(F.broadcast(all_), F.lit(True)).select("word", "total", "docs", F.round(F.col("total") / F.col("docs") * F.log(F.col("all_docs") / F.col("docs")), 6).alias("tfidf"))


def similar_words(words: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, ratio), a < b: words of three letters and more whose edit ratio, to six places, reaches ``least``; see ``qgrams``."""
    own = words.where(F.length("word") >= 3)
    met = similar_strings(own.select(F.col("word").alias("name")), own.select(F.col("word").alias("other")), least - 5e-7, once=True)
    return met.select(F.col("name").alias("a"), F.col("other").alias("b"), F.round("ratio", 6).alias("ratio")).where(F.col("ratio") >= least)


def word_clusters(weights: DataFrame, least: float = 0.8, order: Column | None = None) -> DataFrame:
    """(word, representative): each word goes to the heaviest similar word that is itself a representative.

    Greedy in order of weight, or of another ``order`` that has no ties. Round by round, words that no heavier undecided word touches become
    representatives, and their neighbours join them; the pair table shrinks each round.
    """
    weights = cut(weights)  # it is read again for each side of the pairs
    order = weights.select("word", (F.struct(-F.col("tfidf"), "word") if order is None else order).alias("o"))
    links = similar_words(weights.select("word"), least).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.join(order.toDF("a", "oa"), "a").join(order.toDF("b", "ob"), "b"))
    decided = None
    open_ = order
    while True:
        edge = both.join(open_.select(F.col("word").alias("a")), "a", "left_semi").join(open_.select(F.col("word").alias("b")), "b", "left_semi")
        beaten = edge.where("ob < oa").select(F.col("a").alias("word")).distinct()
        heads = open_.join(beaten, "word", "left_anti").select("word")
        joined = edge.join(heads.select(F.col("word").alias("b")), "b", "left_semi").groupBy("a").agg(F.min_by("b", "ob").alias("representative")).select(F.col("a").alias("word"), "representative")
        now = heads.select("word", F.col("word").alias("representative")).unionByName(joined.join(heads, "word", "left_anti"))
        decided = cut(now if decided is None else decided.unionByName(now))
        open_ = cut(open_.join(decided.select("word"), "word", "left_anti"))
        if open_.isEmpty():
            return decided


def kept_clusters(clusters: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(clusters of ``least`` words or more, words of smaller ones, which stay unclustered)."""
    large = clusters.groupBy("representative").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).select("representative")
    return clusters.join(large, "representative", "left_semi"), clusters.join(large, "representative", "left_anti").select("word")


def merged_clusters(clusters: DataFrame, weights: DataFrame, least: float = 0.8) -> DataFrame:
    """(word, representative): clusters whose representatives are similar become one, greedily: the largest first,
    of equally large ones that with the heavier representative."""
    sizes = clusters.groupBy(F.col("representative").alias("word")).agg(F.count(F.lit(1)).alias("size"))
    into = word_clusters(weights.join(sizes, "word"), least, F.struct(-F.col("size"), -F.col("tfidf"), "word")).toDF("representative", "merged")
    return clusters.join(into, "representative").select("word", F.col("merged").alias("representative"))


def backfill(docs: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Chunk 0 with the whole text for every document that has no chunk."""
    missing = docs.where("text is not null").join(chunks_.select("doc").distinct(), "doc", "left_anti")
    return missing.select("doc", F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
