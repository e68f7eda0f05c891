"""Names of a gazetteer in texts: a trie over tokens, walked once along each text.

Two ways to read: ``words`` compares runs of letters and digits only, so marks and blanks between them don't
count, and gives places in words. ``literal`` takes a name as it stands, marks and blanks too, and gives
places in characters: tokens are runs of letters, digits and underscores and any other single character, and
a match must not go on in a letter, digit or underscore on either side. Case never counts.

Two choices of non-overlapping matches: ``longest`` takes the longest names of the whole text first, of equal
ones the earlier; ``leftmost`` scans from the left, takes the longest name at each place and goes on after it.

Names are counted first: up to ``NAMES_AT_ONCE`` tokens of names are sent to the tasks as one trie. More are dealt
into groups by their first token, so that all names that can begin at one place are in one trie; every text
then meets each trie, its matches are brought together by document, and the choice is made there.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of names that are sent to every task at once: under 1 GB in a task's table.
NAMES_AT_ONCE = 4_000_000
#: Texts that meet one group of names together where these are dealt.
TEXTS_AT_ONCE = 20_000
ROWS_OUT = 1 << 15
#: By way of reading: what a token is, in Python and in Spark.
TOKENS = {"words": (re.compile(r"[^\W_]+"), r"[\p{L}\p{N}]+"), "literal": (re.compile(r"\w+|[^\w\s]"), r"(?U)\w+|[^\w\s]")}
#: Key of a node's names in its table of next tokens: no token is empty.
HERE = ""

Match = tuple[int, int, int, object, str]  # start, end, length that the choice goes by, id, name


def trie(names: Iterable[tuple[object, str]], way: str = "words") -> dict:
    """Nested tables by token; ``HERE`` has the (id, name) that end at a node, in order."""
    root: dict = {}
    several: list[dict] = []
    for name_id, name in names:
        node = root
        for token in TOKENS[way][0].findall(name.lower()):
            node = node.setdefault(sys.intern(token), {})
        if node is not root:
            row, held = (name if name_id == name else name_id, name), node.get(HERE)
            if held is None:
                node[HERE] = (row,)
            elif isinstance(held, list):
                held.append(row)
            else:
                node[HERE] = [*held, row]
                several.append(node)
    for node in several:
        node[HERE].sort(key=lambda x: (x[1], str(x[0])))
    return root


#: The last table of names that a Python worker built; its next tasks use it again.
_built: dict[str, dict] = {}


def _once(key: str, names: pa.Table, way: str) -> dict:
    if key not in _built:
        _built.clear()
        _built[key] = trie(_pairs(names), way)
    return _built[key]


def matches(text: str, root: dict, way: str = "words") -> Iterator[Match]:
    """Every place where a name stands, from the left."""
    spans = [m.span() for m in TOKENS[way][0].finditer(text)]
    found, literal = [text[s:e].lower() for s, e in spans], way == "literal"
    for at, token in enumerate(found):
        node, ahead = root.get(token), at
        while node is not None:
            for name_id, name in node.get(HERE, ()):
                if not literal:
                    yield at, ahead + 1, len(name), name_id, name
                    continue
                start, end = spans[at][0], spans[ahead][1]
                if text[start:end].lower() == name.strip().lower() and not _goes_on(text, start, end):
                    yield start, end, end - start, name_id, name
            ahead += 1
            node = node.get(found[ahead]) if ahead < len(found) else None


def _goes_on(text: str, start: int, end: int) -> bool:
    return any(c.isalnum() or c == "_" for c in (text[start - 1 : start] if start else "") + text[end : end + 1])


def _known(m: Match) -> tuple:
    return m[4].casefold(), m[4], m[3] is not None, m[3]


def longest_first(found: Iterable[Match]) -> list[Match]:
    """Matches that overlap none of those chosen before: longest first, then the earlier, then by name and id.

    The stretch that chosen matches cover is kept as marks, so a match costs its own length.
    """
    order = sorted(found, key=lambda m: (-m[2], m[0], m[1], *_known(m)))
    covered, kept = bytearray(max((m[1] for m in order), default=0)), []
    for m in order:
        if covered.find(1, m[0], m[1]) < 0:
            covered[m[0] : m[1]] = b"\x01" * (m[1] - m[0])
            kept.append(m)
    return sorted(kept, key=lambda m: (m[0], m[1], *_known(m)))


def from_the_left(found: Iterable[Match]) -> list[Match]:
    """The longest match at each place, left to right; the next one begins where the last ended or later."""
    kept, free = [], 0
    for m in sorted(found, key=lambda m: (m[0], -m[2], -m[1], *_known(m))):
        if m[0] >= free:
            kept.append(m)
            free = m[1]
    return kept


CHOICES: dict[str, Callable[[Iterable[Match]], Iterable[Match]]] = {"longest": longest_first, "leftmost": from_the_left, "all": list}


def _pairs(names: pa.Table) -> Iterator[tuple[object, str]]:
    """(id, name) of a table of names, a batch at a time."""
    for batch in names.to_batches(max_chunksize=10_000):
        yield from zip(batch.column("name_id").to_pylist(), batch.column("name").to_pylist())


def name_matches(docs: DataFrame, names: DataFrame, choice: str = "longest", way: str = "words") -> DataFrame:
    """(doc, name_id, name, start, end): chosen matches of names (name_id, name) in texts (doc, text).

    Null texts, and names that are null or have no token, match nothing; repeated names count once. Texts
    are chosen row by row, also where ``doc`` repeats, as long as the names are sent at once.
    """
    pick, kinds = CHOICES[choice], [dict(docs.dtypes)["doc"], dict(names.dtypes)["name_id"]]
    schema = f"doc {kinds[0]}, name_id {kinds[1]}, name string, start int, end int"
    wanted = names.select("name_id", "name").where("name is not null").distinct()
    texts = docs.select("doc", "text").where("text is not null")
    told = wanted.limit(NAMES_AT_ONCE + 1).toArrow()
    size = sum(len(TOKENS[way][0].findall(n)) for _, n in _pairs(told))
    few = told.num_rows <= NAMES_AT_ONCE and size <= NAMES_AT_ONCE

    def batch(rows: list[tuple[object, Match]], doc: pa.DataType, ident: pa.DataType) -> pa.RecordBatch:
        values = zip(*((d, m[3], m[4], m[0], m[1]) for d, m in rows))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (doc, ident, pa.string(), pa.int32(), pa.int32()))], ["doc", "name_id", "name", "start", "end"])

    def walk(batches: Iterable[pa.RecordBatch], root: dict, ident: pa.DataType, choose: Callable) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows, kind = [], given.schema.field("doc").type
            for doc, text in zip(given.column("doc"), given.column("text")):
                if found := choose(matches(text.as_py(), root, way)):
                    d = doc.as_py()
                    rows += ((d, m) for m in found)
                if len(rows) >= ROWS_OUT:
                    yield batch(rows, kind, ident)
                    rows = []
            if rows:
                yield batch(rows, kind, ident)

    if few:
        ident, key = told.schema.field("name_id").type, uuid.uuid4().hex
        return texts.mapInArrow(lambda batches: walk(batches, _once(key, told, way), ident, pick), schema)

    size = wanted.agg(F.sum(F.regexp_count("name", F.lit(TOKENS[way][1])))).first()[0]
    groups = max(2, -(-size // NAMES_AT_ONCE))
    first = F.regexp_extract(F.lower("name"), TOKENS[way][1], 0)
    dealt = wanted.withColumn("group", F.pmod(F.xxhash64(first), F.lit(groups)).cast("int"))
    slices = max(1, -(-texts.count() // TEXTS_AT_ONCE))
    spread = texts.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    every = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    empty = docs.sparkSession.createDataFrame([], schema).toArrow()

    def met(given: pa.Table, some: pa.Table) -> pa.Table:
        root = trie(_pairs(some), way)
        made = list(walk(given.to_batches(), root, some.schema.field("name_id").type, list))
        return pa.Table.from_batches(made) if made else empty

    found = spread.groupBy("slice", "group").cogroup(every.groupBy("slice", "group")).applyInArrow(met, schema)
    return found if choice == "all" else chosen(found, choice, way)


def chosen(found: DataFrame, choice: str = "longest", way: str = "words") -> DataFrame:
    """The chosen ones of matches (doc, name_id, name, start, end and any others); the matches of one document are one group."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("start", "end", "name", "name_id")]
        rows = [(s, e, len(n) if way == "words" else e - s, ((i is not None, i), k), n) for k, (s, e, n, i) in enumerate(zip(*columns))]
        return table.take(pa.array([m[3][1] for m in CHOICES[choice](rows)], pa.int64()))

    return found.groupBy("doc").applyInArrow(run, found.schema)
