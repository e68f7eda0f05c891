"""The typed link graph as two tables: nodes (id, type, key, ...) and edges (source, target, relation)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.sources.tables import kept, tasks_for


@dataclass(frozen=True)
class Link:
    """One relation: a table that carries both keys. ``reverse`` swaps the stored direction."""

    relation: str
    source_type: str
    source: str
    target_type: str
    target: str
    reverse: bool = False


def node_id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}_"), F.col(column).cast("string"))


def edges(carriers: list[tuple[DataFrame, Link]]) -> DataFrame:
    """All relations as one edge table in canonical direction."""

    def one(df: DataFrame, link: Link) -> DataFrame:
        a, b = node_id(link.source_type, link.source), node_id(link.target_type, link.target)
        both = df.where(F.col(link.source).isNotNull() & F.col(link.target).isNotNull())
        return both.select((b if link.reverse else a).alias("source"), (a if link.reverse else b).alias("target"), F.lit(link.relation).alias("relation")).distinct()

    return reduce(DataFrame.unionByName, (one(df, link) for df, link in carriers))


def neighbourhood(seeds: DataFrame, graph: DataFrame, per_relation: int = 25, back: DataFrame | None = None) -> DataFrame:
    """(seed, node, relation, source, target): at most so many neighbours a relation, smallest first.

    ``back`` has the edges that may end at a seed where those that may begin at one were chosen before.

    Edges are kept by a semi join on the node they are seen from, which Spark takes below the distinct and the
    union of ``edges``: what no seed touches is never made distinct.
    """

    def seen_from(here: str, there: str, graph: DataFrame) -> DataFrame:
        near = graph.join(seeds.select(F.col("node").alias(here)), here, "left_semi")
        return near.select(F.col(here).alias("seed"), F.col(there).alias("node"), "relation", "source", "target")

    both = seen_from("source", "target", graph).unionByName(seen_from("target", "source", graph if back is None else back))
    w = Window.partitionBy("seed", "relation").orderBy("node")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_relation).drop("place")


def reach(seeds: DataFrame, graph: DataFrame, steps: list[tuple[str, bool]]) -> DataFrame:
    """Typed traversal for all seeds at once: each step follows one relation, forwards or backwards."""
    frontier = seeds.select(F.col("node").alias("seed"), "node")
    found = []
    for number, (relation, forwards) in enumerate(steps):
        a, b = ("source", "target") if forwards else ("target", "source")
        hop = graph.where(F.col("relation") == relation).select(F.col(a).alias("node"), F.col(b).alias("next"))
        frontier = frontier.join(hop, "node").select("seed", F.col("next").alias("node")).distinct()
        found.append(frontier.select("seed", "node", F.lit(number + 1).alias("step"), F.lit(relation).alias("relation")))
    return reduce(DataFrame.unionByName, found)


#: Nodes that are sent to all tasks, so that the edges stay where they are read; more meet the edges in a shuffle.
NODES_SENT = 500_000
#: Nodes that are sent to all tasks with their neighbours, so that seeds stay where they are.
NEAR_SENT = 100_000
#: Seeds in a task, each of which has all its edges there, and types that edges are chosen by before they are moved.
SEEDS_A_TASK, KINDS = 20_000, 100


def kind_of(node: Column) -> Column:
    return F.split(node, "_").getItem(0)


def _near(at: DataFrame, graph: DataFrame, skip: Sequence[str], per_relation: int) -> DataFrame:
    """(at, near): the neighbours of each distinct node (node) with their relation and whether the edge goes out to them."""
    kinds = [r[0] for r in at.select(kind_of(F.col("node"))).distinct().limit(KINDS + 1).collect()]
    if len(kinds) <= KINDS:
        here = {side: graph.where(kind_of(F.col(side)).isin(kinds)) for side in ("source", "target")}
    else:
        here = {side: graph for side in ("source", "target")}
    at = F.broadcast(at) if at.count() <= NODES_SENT else at
    near = neighbourhood(at, here["source"], per_relation, here["target"])
    near = near.where(~kind_of(F.col("node")).isin(*skip)) if skip else near
    return near.groupBy(F.col("seed").alias("at")).agg(F.collect_list(F.struct("relation", "node", (F.col("source") == F.col("seed")).alias("out"))).alias("near"))


def _expanded(seeds: DataFrame, graph: DataFrame, rounds: Sequence[str], skip: Sequence[str], per_relation: int) -> tuple[DataFrame, DataFrame]:
    """Distinct seeds (seed), and (seed, at, round, near): the nodes that a seed expands, each once, with their neighbours.

    A node's neighbours are the same for every seed, so they are looked for once, as a list for each distinct node.
    Seeds then take over the lists of the nodes that they found: only lists move, to the seed's task.
    """
    first = kept(seeds.select(F.col("node").alias("seed")).distinct())
    tasks = tasks_for(first, SEEDS_A_TASK)
    tables = [kept(_near(first.select(F.col("seed").alias("node")), graph, skip, per_relation))]
    listed = tables[0].schema["near"].dataType
    nothing = F.array().cast(listed)
    rows = first.join(tables[0].hint("merge"), F.col("seed") == F.col("at"), "left").select("seed", F.col("seed").alias("at"), F.lit(0).alias("round"), F.coalesce("near", nothing).alias("near"))
    for number, kind in enumerate(rounds, 1):
        of_kind = lambda df, c: df.where(kind_of(F.col(c)) == kind)  # noqa: B023, E731  used within this round
        met = reduce(DataFrame.unionByName, (of_kind(t.select(F.explode("near.node").alias("node")), "node") for t in tables)).distinct()
        before = [of_kind(t, "at") for t, looked_at in zip(tables, [None, *rounds]) if looked_at in (None, kind)]
        done = reduce(DataFrame.unionByName, before).select(F.col("at").alias("node"))
        tables.append(kept(_near(kept(met.join(done, "node", "left_anti")), graph, skip, per_relation)))
        near = reduce(DataFrame.unionByName, [*before, tables[-1]])
        sent = near.count() <= NEAR_SENT
        if number > 1 and not sent:
            rows = kept(rows)
        told = rows.groupBy("seed").agg(F.collect_list(F.struct("at", "round", "near")).alias("told"))
        found = F.filter(F.flatten("told.near")["node"], lambda n: kind_of(n) == kind)  # noqa: B023
        fresh = F.array_except(found, F.col("told.at"))  # of which each is there once
        if sent:
            every = F.concat("told", F.transform(fresh, lambda n: F.struct(n.alias("at"), F.lit(number).alias("round"), F.lit(None).cast(listed).alias("near"))))  # noqa: B023
            asked = told.select("seed", F.inline(every))
            rows = asked.join(F.broadcast(near.withColumnRenamed("near", "more")), "at", "left").select("seed", "at", "round", F.coalesce("near", "more", nothing).alias("near"))
        else:
            asked = told.select("seed", F.explode(fresh).alias("at"))
            more = asked.join(near.hint("merge"), "at", "left").select("seed", "at", F.lit(number).alias("round"), F.coalesce("near", nothing).alias("near"))
            rows = rows.unionByName(more).repartition(tasks, "seed")
    return first, rows


def expanded_in_rounds(seeds: DataFrame, graph: DataFrame, rounds: Sequence[str], skip: Sequence[str] = (), per_relation: int = 25) -> tuple[DataFrame, DataFrame]:
    """(nodes (seed, node, round), edges (seed, source, target, relation)) around each seed, breadth first.

    Round 0 looks at the neighbours of the seeds, round k at those of all nodes of the k-th type found so far,
    at most ``per_relation`` of a relation, smallest first. Nodes of the types to skip are not taken in. A node
    is expanded once for a seed however often it is found.
    """
    first, rows = _expanded(seeds, graph, rounds, skip, per_relation)
    each = rows.select("seed", "at", "round", F.inline("near"))
    nodes = first.select("seed", F.col("seed").alias("node"), F.lit(0).alias("round")).unionByName(each.select("seed", "node", "round"))
    edges_ = each.select("seed", F.when(F.col("out"), F.col("at")).otherwise(F.col("node")).alias("source"), F.when(F.col("out"), F.col("node")).otherwise(F.col("at")).alias("target"), "relation")
    return nodes.groupBy("seed", "node").agg(F.min("round").alias("round")), edges_.distinct()


def tallied_in_rounds(seeds: DataFrame, graph: DataFrame, rounds: Sequence[str], skip: Sequence[str] = (), per_relation: int = 25) -> DataFrame:
    """(seed, relation, edges, sources, targets, least): distinct edges of ``expanded_in_rounds`` and their ends by count, and the least source.

    A seed's edges are few, so they are counted as a list, where it lies; a row for each edge is never made.
    """
    _, rows = _expanded(seeds, graph, rounds, skip, per_relation)
    told = rows.groupBy("seed").agg(F.collect_list(F.struct("at", "near")).alias("told"))
    edge = lambda at, e: F.struct(e["relation"].alias("relation"), F.when(e["out"], at).otherwise(e["node"]).alias("source"), F.when(e["out"], e["node"]).otherwise(at).alias("target"))
    all_ = told.select("seed", F.flatten(F.transform("told", lambda t: F.transform(t["near"], lambda e: edge(t["at"], e)))).alias("all"))
    each = all_.select("seed", "all", F.explode(F.array_distinct("all.relation")).alias("relation"))
    ends = each.select("seed", "relation", F.filter("all", lambda e: e["relation"] == F.col("relation")).alias("ends"))
    size = lambda values: F.size(F.array_distinct(values)).cast("long")
    # strings are told apart by hash, structs one by one; the length keeps the two ends apart
    pair = F.transform("ends", lambda e: F.concat(F.length(e["source"]).cast("string"), F.lit(":"), e["source"], e["target"]))
    return ends.select("seed", "relation", size(pair).alias("edges"), size(F.col("ends.source")).alias("sources"), size(F.col("ends.target")).alias("targets"), F.array_min("ends.source").alias("least"))


def without_types(nodes: DataFrame, graph: DataFrame, skip: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types and every edge that touches them taken out."""
    gone = nodes.where(F.col("type").isin(skip)).select("id")
    left = graph.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.where(~F.col("type").isin(skip)), left


def merge_graphs(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of partial graphs: the first part's node wins, edges are distinct."""
    numbered = reduce(DataFrame.unionByName, (n.withColumn("part", F.lit(i)) for i, (n, _) in enumerate(parts)))
    first = numbered.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("part"))).where("place = 1").drop("place", "part")
    return first, reduce(DataFrame.unionByName, (e for _, e in parts)).dropDuplicates(["source", "target", "relation"])


def referencing(graph: DataFrame, targets: DataFrame) -> DataFrame:
    """Reverse lookup: every edge that points at one of the targets."""
    return graph.join(targets.select(F.col("node").alias("target")), "target", "left_semi")


def block_siblings(items: DataFrame, owner: str, number: str, key: str) -> DataFrame:
    """Items of one owner whose number has the same integer part (13 and 13.2 are one block)."""
    blocks = items.withColumn("block", F.regexp_extract(F.col(number).cast("string"), r"^(\d+)", 1)).where("block <> ''")
    a, b = blocks.select(owner, "block", F.col(key).alias("key")), blocks.select(owner, "block", F.col(key).alias("sibling"))
    return a.join(b, [owner, "block"]).where("key <> sibling")


def holds_all_terms(text: Column, terms: Column) -> Column:
    """Whether a text holds every term of an array column (terms of three characters and more)."""
    low = F.lower(text)
    return F.forall(F.filter(terms, lambda t: F.length(t) >= 3), lambda t: F.contains(low, F.lower(t)))


#: Terms that are looked for in one pass over the texts.
TERMS_AT_ONCE = 200_000
#: Rows that a task gives at once.
ROWS_OUT = 1 << 15
#: Words whose terms a task remembers at once; it begins anew where there are more.
WORDS_KEPT = 200_000
#: A word in lower case; a term that is one can only stand inside a word of the text.
RUN = re.compile(r"[^\W_]+")


def _terms_in(word: str, terms: frozenset[str], lengths: Sequence[int]) -> list[str]:
    """The terms that are part of a word; lengths are those that terms have, in order."""
    found = set()
    for n in lengths:
        if n > len(word):
            break
        found.update(p for i in range(len(word) - n + 1) if (p := word[i : i + n]) in terms)
    return list(found)


def _answered(texts: Iterator[tuple[object, str]], wanted: dict[object, list[str]]) -> Iterator[tuple[object, object]]:
    """(doc, question) of lower-cased texts that hold every term of a question: questions go by their longest term."""
    by_longest: dict[str, list[tuple[object, list[str]]]] = {}
    for question, asked in wanted.items():
        longest = max(asked, key=lambda t: (len(t), t))
        by_longest.setdefault(longest, []).append((question, [t for t in asked if t != longest]))
    terms = {t for asked in wanted.values() for t in asked}
    whole = frozenset(t for t in terms if RUN.fullmatch(t))
    others, lengths, known = sorted(terms - whole), sorted({len(t) for t in whole}), {}
    for doc, low in texts:
        held = {t for t in others if t in low}
        for word in set(RUN.findall(low)):
            inside = known.get(word)
            if inside is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                inside = known[word] = _terms_in(word, whole, lengths)
            held.update(inside)
        for term in held & by_longest.keys():
            yield from ((doc, question) for question, rest in by_longest[term] if held.issuperset(rest))


def holding_all_terms(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc, question) of texts (doc, text) that hold every term (question, term) of a question, as part of a word too.

    A text is read once for ``TERMS_AT_ONCE`` terms of questions: the distinct words of a text are looked up, a
    word's terms are found once in a task, and only questions whose longest term is held are looked at. Terms
    that are no words are looked for in the text one by one. Case does not count; terms of under three characters
    are passed over, and a question without any other holds nothing.
    """
    kinds = {"doc": dict(docs.dtypes)["doc"], "question": dict(questions.dtypes)["question"]}
    asked = questions.select("question", F.lower("term").alias("term")).where(F.length("term") >= 3)
    batch = asked.groupBy("question").agg(F.collect_set("term").alias("terms")).toArrow()  # a stated batch of questions
    kind = batch.schema.field("question").type
    passes: list[dict] = [{}]
    size = 0
    for question, terms in zip(batch.column("question").to_pylist(), batch.column("terms").to_pylist()):
        if passes[-1] and size + len(terms) > TERMS_AT_ONCE:
            passes.append({})
            size = 0
        passes[-1][question] = terms
        size += len(terms)

    def read(wanted: dict) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema: list[pa.Schema] = []

            def texts() -> Iterator[tuple[object, str]]:
                for given in batches:
                    schema[:] = [pa.schema([("doc", given.schema.field("doc").type), ("question", kind)])]
                    yield from zip(given.column("doc").to_pylist(), (t.as_py() for t in given.column("low")))

            answers = _answered(texts(), wanted)
            while rows := list(islice(answers, ROWS_OUT)):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), schema[0].types)], schema=schema[0])

        return low.mapInArrow(run, f"doc {kinds['doc']}, question {kinds['question']}")

    low = docs.select("doc", F.lower("text").alias("low")).where("low is not null")
    return reduce(DataFrame.unionByName, map(read, passes)).distinct()


def valid_triples(triples: DataFrame) -> DataFrame:
    """Triples whose object is a literal or a reference, not both and not neither."""
    return triples.where(F.col("object_literal").isNull() != F.col("object_ref").isNull())


def answer_scope(chosen: DataFrame | None, in_graph: DataFrame, refused: DataFrame, excluded: DataFrame) -> DataFrame:
    """Keys of an answer: the chosen ones, or all of the graph if none were, without refused and excluded ones."""
    base = in_graph if chosen is None else chosen
    return base.select("key").distinct().join(refused.select("key"), "key", "left_anti").join(excluded.select("key"), "key", "left_anti")


def related_objects(seeds: DataFrame, graph: DataFrame, steps: list[tuple[str, str, bool, str]]) -> tuple[DataFrame, DataFrame]:
    """Traversal from named sets to named sets for all seeds at once: (seed, kind, node) and the edge log.

    A step (from, relation, forwards, to) starts at all that the steps before it found of the set
    ``from`` ("seed" is the seeds' own) and adds to the set ``to``. The log (seed, relation, source,
    target, step) has each edge once, in its stored direction, with the first step that used it.
    """
    found = {"seed": seeds.select(F.col("node").alias("seed"), "node")}
    log = []
    for number, (start, relation, forwards, end) in enumerate(steps, 1):
        a, b = ("source", "target") if forwards else ("target", "source")
        hop = graph.where(F.col("relation") == relation).select("source", "target")
        used = found[start].join(hop, F.col("node") == F.col(a)).select("seed", F.lit(relation).alias("relation"), "source", "target", F.lit(number).alias("step"))
        nodes = used.select("seed", F.col(b).alias("node")).distinct()
        found[end] = found[end].unionByName(nodes).distinct() if end in found else nodes
        log.append(used)
    nodes = reduce(DataFrame.unionByName, (df.select("seed", F.lit(kind).alias("kind"), "node") for kind, df in found.items() if kind != "seed"))
    return nodes, reduce(DataFrame.unionByName, log).groupBy("seed", "relation", "source", "target").agg(F.min("step").alias("step"))


def expanded_answers(answers: DataFrame, items: DataFrame, owner: str, number: str, key: str, text: str) -> DataFrame:
    """(query_id, owner, key) that answers (query_id, owner, key, terms) gain: items of the same block whose text holds all terms."""
    near = block_siblings(items.select(owner, number, key).distinct(), owner, number, key).select(owner, "key", "sibling")
    asked = answers.select("query_id", owner, F.col(key).alias("key"), "terms").join(near, [owner, "key"]).select("query_id", owner, F.col("sibling").alias(key), "terms")
    held = asked.join(items.select(owner, key, text), [owner, key]).where(holds_all_terms(F.col(text), F.col("terms")))
    return held.select("query_id", owner, key).distinct().join(answers.select("query_id", owner, key), ["query_id", owner, key], "left_anti")
