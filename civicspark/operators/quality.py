"""Coverage, completeness and parity reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import trimmed, without_code_fence


def coverage(items: DataFrame, layers: dict[str, DataFrame], key: str) -> DataFrame:
    """(layer, n, pct): distinct items that each layer reaches, as a share of all, one decimal."""
    total = items.agg(F.count_distinct(key).alias("total"))
    out = None
    for name, layer in layers.items():
        part = items.select(key).distinct().join(layer.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n")
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(total), F.lit(True)).select("layer", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def preserved(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose non-empty count fell between two snapshots."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns))
        return wide.unpivot([], columns, "column", name)

    return counts(before, "n_before").join(counts(after, "n_after"), "column").where("n_after < n_before")


def count_gate(have: dict[str, DataFrame], baseline: DataFrame) -> DataFrame:
    """(table, n, least, ok): row counts against a baseline table (table, least)."""
    counted = None
    for name, df in have.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        counted = part if counted is None else counted.unionByName(part)
    return baseline.join(counted, "table", "left").select("table", F.coalesce("n", F.lit(0)).alias("n"), "least", (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("ok"))


def unresolved(links: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """(side, unresolved): link keys of each side that its table does not hold."""
    out = None
    for column, table in sides.items():
        part = links.where(F.col(column).isNotNull()).join(table.select(column).distinct(), column, "left_anti").agg(F.count(F.lit(1)).alias("unresolved")).select(F.lit(column).alias("side"), "unresolved")
        out = part if out is None else out.unionByName(part)
    return out


def parity(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """Differences between two result snapshots (query_id, key, score): missing keys or scores apart."""
    joined = old.select("query_id", "key", F.col("score").alias("old_score")).join(new.select("query_id", "key", F.col("score").alias("new_score")), ["query_id", "key"], "full")
    return joined.where(F.col("old_score").isNull() | F.col("new_score").isNull() | (F.abs(F.col("old_score") - F.col("new_score")) > tolerance))


def search_parity(old: DataFrame, new: DataFrame, tolerance: float = 0.02, tasks: int | None = None) -> DataFrame:
    """(query_id, key, finding, before, after): where two snapshots (query_id, key, distance, signals) of a batch of searches part.

    signals is a map from each signal that found a key to its distance. A query that the new snapshot
    lacks is one finding without a key; one whose keys differ has a finding for each missing and each extra
    key, and no others. In the rest a distance that is null on one side or apart by more than the tolerance,
    another set of signals, and a distance of a signal on both sides that is apart are findings; before and after
    are the distances in question. Queries that only the new snapshot has are passed over. A query is known by its
    rows, and (query_id, key) is unique in each snapshot.

    Rows of both snapshots are put together and dealt by query, into ``tasks`` parts or as many as Spark chooses;
    there the two of a key meet, and the state of a query is a window over its keys.
    """
    side = F.struct("distance", F.coalesce("signals", F.create_map().cast("map<string,double>")).alias("signals"))
    told = lambda df, name: df.select("query_id", "key", F.lit(name).alias("of"), side.alias("x"))
    rows = told(old, "a").unionByName(told(new, "b"))
    dealt = rows.repartition("query_id") if tasks is None else rows.repartition(tasks, "query_id")
    one = lambda name: F.first(F.when(F.col("of") == name, F.col("x")), ignorenulls=True).alias(name)
    both = dealt.groupBy("query_id", "key", F.when(F.col("key").isNull(), F.col("of")).alias("apart")).agg(one("a"), one("b"))  # no key is the same as another one that is null
    of_query = Window.partitionBy("query_id")
    state = {"n_old": F.count("a"), "n_new": F.count("b"), "differs": F.bool_or(F.col("a").isNull() != F.col("b").isNull()), "least": F.row_number()}
    known = both.withColumns({c: f.over(of_query.orderBy("key") if c == "least" else of_query) for c, f in state.items()}).where("n_old > 0")
    none = F.lit(None).cast("double")
    finding = lambda name, before=none, after=none: F.struct(F.lit(name).alias("finding") if isinstance(name, str) else name.alias("finding"), before.alias("before"), after.alias("after"))
    apart = lambda x, y: (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    before, after = F.col("a.distance"), F.col("b.distance")
    names = lambda side: F.array_sort(F.map_keys(f"{side}.signals"))
    shared = F.filter(F.map_keys("a.signals"), lambda s: F.map_contains_key(F.col("b.signals"), s) & apart(F.element_at("a.signals", s), F.element_at("b.signals", s)))
    in_both = F.concat(
        F.array_compact(F.array(F.when(apart(before, after), finding("distance", before, after)), F.when(names("a") != names("b"), finding("signals")))),
        F.transform(shared, lambda s: finding(F.concat(F.lit("signal "), s), F.element_at("a.signals", s), F.element_at("b.signals", s))),
    )
    one_side = F.array(F.when(F.col("a").isNull(), finding("extra key", none, after)).otherwise(finding("missing key", before, none)))
    lost = F.when(F.col("least") == 1, F.array(finding("missing query")))
    settled = F.when(F.col("n_new") == 0, lost).when(F.col("query_id").isNull(), None).when(~F.col("differs"), in_both).when(F.col("a").isNull() | F.col("b").isNull(), one_side)
    return known.select("query_id", F.when(F.col("n_new") > 0, F.col("key")).alias("key"), F.explode(settled).alias("f")).select("query_id", "key", "f.*")


def unreferenced(items: DataFrame, key: str, links: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Items that none of the link tables (table, its column) names.

    Keys of all tables are put together and made distinct before one anti join, so a key that very many
    links name is one row there; null keys name nothing, and items without a key are named by none.
    """
    named = reduce(DataFrame.unionByName, (df.select(F.col(column).alias(key)) for df, column in links)).where(F.col(key).isNotNull()).distinct()
    return items.join(named, key, "left_anti")


def chunk_report(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents without chunks, chunks without a vector, vectors without a chunk."""
    key = ["doc", "chunk_index"]
    parts = {"documents without chunks": docs.join(chunks, "doc", "left_anti"), "chunks without vector": chunks.join(vectors, key, "left_anti"), "vectors without chunk": vectors.join(chunks, key, "left_anti")}
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def reconcile(stored: DataFrame, fresh: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status): identical, fixed (texts differ) or missing on one side."""
    joined = stored.select(key, F.col(text).alias("a"), F.lit(True).alias("in_a")).join(fresh.select(key, F.col(text).alias("b"), F.lit(True).alias("in_b")), key, "full")
    return joined.select(key, F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("fixed").alias("status"))


def histogram(values: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    return values.groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fit_for_summary(docs: DataFrame, text: str, least_chars: int = 20, least_lines: int = 5, per_line: float = 10.0, top: float = 0.98) -> DataFrame:
    """Documents worth summarising: long enough, enough lines of enough characters, not among the longest."""
    sized = docs.withColumn("chars", F.length(text)).withColumn("lines", F.regexp_count(text, F.lit("\n")) + 1)
    good = sized.where((F.col("chars") >= least_chars) & (F.col("lines") >= least_lines) & (F.col("chars") / F.col("lines") >= per_line))
    limit = good.agg(F.percentile("chars", F.lit(top)).alias("most"))
    return good.join(F.broadcast(limit), F.lit(True)).where("chars <= most").drop("most")


def summary_texts(docs: DataFrame, summaries: DataFrame, done: DataFrame | None = None, cutoff: int = 8000) -> DataFrame:
    """(doc, summarised, text): what is kept of documents (doc, text) that are fit for it.

    A text of up to ``cutoff`` characters is kept as it is, trimmed. A longer one is replaced by its summary (doc,
    summary), without a code fence around it and cut to ``cutoff``; without a summary it has no row. Documents
    that are ``done`` (doc) have none either. Documents without a text have none; summaries are one a document.
    """
    open_ = docs if done is None else docs.join(done.select("doc").distinct(), "doc", "left_anti")
    long = F.length("text") > cutoff
    small = open_.where(~long).select("doc", F.lit(False).alias("summarised"), trimmed(F.col("text")).alias("text"))
    large = open_.where(long).select("doc").join(summaries.where("summary is not null"), "doc")
    return small.unionByName(large.select("doc", F.lit(True).alias("summarised"), F.left(without_code_fence(F.col("summary")), F.lit(cutoff)).alias("text")))


def resolution_report(links: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """(finding, n): for each side the links whose key its table (key column, deleted) lacks or has as deleted, and those that are fine on all sides."""
    fine, counts = F.lit(True), []
    for column, known in sides.items():
        found, gone = f"{column}_found", f"{column}_deleted"
        once = known.groupBy(F.col(column)).agg(F.lit(True).alias(found), F.coalesce(F.bool_or("deleted"), F.lit(False)).alias(gone))
        links = links.join(once, column, "left")
        counts += [F.count_if(F.col(found).isNull()).alias(f"{column} unresolved"), F.count_if(F.col(gone)).alias(f"{column} deleted")]
        fine = fine & F.col(found).isNotNull() & ~F.col(gone)
    wide = links.agg(*counts, F.count_if(fine).alias("resolved"))
    return wide.unpivot([], wide.columns, "finding", "n")


def content_integrity(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(finding, n) over files (doc, text), chunks (doc, chunk_index, text) and vectors (doc, chunk_index).

    Vectors of known files without their chunk, files with vectors but no chunk at all, files whose
    first chunk is another text than theirs (all files, not a sample), and how many were compared.
    """
    n = F.count(F.lit(1)).alias("n")
    known = vectors.join(files.select("doc"), "doc", "left_semi")
    both = files.where("text is not null").join(chunks.where("chunk_index = 0").select("doc", F.col("text").alias("first")), "doc")
    parts = {
        "vectors without chunk": known.join(chunks.select("doc", "chunk_index"), ["doc", "chunk_index"], "left_anti").agg(n),
        "files with vectors but no chunk": vectors.select("doc").distinct().join(chunks.select("doc"), "doc", "left_anti").agg(n),
        "texts differ": both.agg(F.count_if(F.col("text") != F.coalesce("first", F.lit(""))).alias("n")),
        "texts compared": both.agg(n),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("finding"), "n") for name, df in parts.items()))
