"""Operator 12: conversation structure repair. Turns aligned to the alternating grammar, with audits.

A conversation's turns are aligned by Wagner and Fischer's recurrence to every feasible length of the
alternating string user, assistant, user, …: one table over the string's ends serves all lengths, because a
shorter string is an end of a longer one. Ukkonen's band keeps the table narrow: a path that leaves it would
cost more than the incumbent, the cost of a plain repair (``_incumbent``). Each length that costs least is
traced back by its ASCII-least letters, and the audits of all lengths are compared. Turns that must go stand
in no alignment; their D is written where they stand, which is the least letter.

Spark first finds each text's earliest turn (a repeated text is a duplicate), counting equal rows before they
travel, and then deals the rows out by ranges of (conversation, turn, role, text), so a conversation of any
size is spread over several tasks. A task walks through its sorted rows in pieces of up to ``PIECE`` turns.
A piece is summed up by its least (cost, audit) from each state of the grammar to each other: nothing yet (S),
after system (P), after user (U), after assistant (A). Conversations that lie inside a task are finished
there; those at its edges travel as pieces and are put together one piece after the other, of which only the
part is kept that the best paths of the four states don't share yet.

Audits: Keep K, Rerole R, Delete D, Insert I. A role's initial is its first character.

Edge cases: null role and text are one space, a null conversation or turn is one space in the damage key;
null conversations are one conversation, null turns come first; rows of one turn stand by role, then text, by
code point, repeated rows next to each other, so reruns agree. A conversation whose rows all go gives zeros,
an empty audit and the digest of an empty string. An empty role has no initial and is no legal neighbour.
Turns at the ends of the range of longs give their gaps modulo 2**64. Extra columns are dropped; an empty
table gives an empty table; long texts are hashed whole, one piece's texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import table

PIECE = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar (nothing yet, after system, after user, after assistant) and the symbol that may follow.
STATES = "SPUA"
FOLLOWS = {"S": "u", "P": "u", "U": "a", "A": "u"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
OTHER = {"u": "a", "a": "u"}
#: ASCII white space as the contract counts it.
SPACES = " \t\n\x0b\x0c\r"


class Turn(NamedTuple):
    initial: str
    fault: str  # "b" blank, "d" duplicate, "t" truncated, or nothing

    @property
    def goes(self) -> bool:
        return self.fault in ("b", "d")

    @property
    def extra(self) -> int:
        return TRUNCATED if self.fault == "t" else 0


Best = tuple[int, str]  # cost and audit; the smaller one is better, also between equal costs


def _incumbent(turns: list[Turn], first: str) -> int:
    """What a plain repair costs beyond what no repair avoids: missing turns are inserted, and the end is left as it is."""
    wanted, cost = first, 0
    for t in turns:
        if t.initial == wanted:
            wanted = OTHER[wanted]
        elif t.initial in OTHER:  # the turn between is missing
            cost += INSERT
        else:
            cost, wanted = cost + REROLE, OTHER[wanted]
    return min(cost, REROLE * sum(t.initial != s for t, s in zip(turns, (first + OTHER[first]) * len(turns))))


def _aligned(turns: list[Turn], first: str, last: str) -> Best | None:
    """The best alignment of turns to an alternating string that begins with ``first``, ends with ``last`` and is not empty.

    ``turns`` are those that need not go; costs and audits leave out the ones that must.
    """
    n, even = len(turns), first != last
    slack = _incumbent(turns, first) + INSERT * 2  # one more insertion or two turn any end into the asked one
    half = slack // 2 + 1
    # E[i][c]: turns i… against the last r = n - i + c - half symbols; an end of the string is cut off by the band
    width = 2 * half + 1
    far = 1 << 60
    rows: list[list[int]] = [[]] * (n + 1)
    rows[n] = [INSERT * (c - half) if c >= half else far for c in range(width)]
    for i in range(n - 1, -1, -1):
        t, below = turns[i], rows[i + 1]
        drop = DELETE
        match, miss = t.extra, t.extra + REROLE
        hit = t.initial == last  # at odd r the symbol is the last one
        row, left, r = [far] * width, far, n - i - half
        for c in range(width):
            if r >= 0:
                cost = left + INSERT
                if c + 1 < width and (x := below[c + 1] + drop) < cost:
                    cost = x
                if r > 0:
                    step = match if (hit if r & 1 else t.initial == OTHER[last]) else miss
                    if (x := below[c] + step) < cost:
                        cost = x
                row[c] = left = cost
            r += 1
        rows[i] = row
    best: Best | None = None
    for c in range(width):
        m = n + c - half
        if m < 1 or (m % 2 == 0) != even or rows[0][c] >= far or (best and rows[0][c] > best[0]):
            continue
        found = rows[0][c], _traced(turns, rows, half, c, last)
        best = found if best is None or found < best else best
    return best


def _traced(turns: list[Turn], rows: list[list[int]], half: int, c: int, last: str) -> str:
    """The ASCII-least letters along the table from the whole conversation on: D before I before K before R."""
    n, i, out, width = len(turns), 0, [], 2 * half + 1
    while True:
        here, r = rows[i][c], n - i + c - half
        if i < n and c + 1 < width and rows[i + 1][c + 1] + DELETE == here:
            out.append("D")
            i, c = i + 1, c + 1
        elif r > 0 and c > 0 and rows[i][c - 1] + INSERT == here:
            out.append("I")
            c -= 1
        elif i < n and r > 0:
            symbol = last if r & 1 else OTHER[last]
            out.append("K" if turns[i].initial == symbol else "R")
            i += 1
        else:
            return "".join(out)


def _with_forced(audit: str, goes: list[bool]) -> str:
    """Writes the D of each turn that must go where it stands, before any letter that could also stand there."""
    out, at, n = [], 0, len(goes)
    for letter in audit:
        while at < n and goes[at]:
            out.append("D")
            at += 1
        out.append(letter)
        at += letter != "I"
    return "".join(out) + "D" * (n - at)


def piece_paths(turns: list[Turn], starts: str = STATES) -> dict[tuple[str, str], Best]:
    """The best (cost, audit) of a run of turns from each of the ``starts`` to each state that can be reached."""
    goes = [t.goes for t in turns]
    free = [t for t in turns if not t.goes]
    forced = DELETE * sum(goes)
    out: dict[tuple[str, str], Best] = {}

    def offer(start: str, end: str, cost: int, audit: str) -> None:
        found = cost + forced, _with_forced(audit, goes)
        if (start, end) not in out or found < out[start, end]:
            out[start, end] = found

    known: dict[tuple[str, str], Best | None] = {}
    for start in starts:
        offer(start, start, DELETE * len(free), "D" * len(free))
        for end, last in (("U", "u"), ("A", "a")):
            first = FOLLOWS[start]
            if (first, last) not in known:
                known[first, last] = _aligned(free, first, last)
            if known[first, last]:
                offer(start, end, *known[first, last])
        if start == "S":  # a system turn may stand first: turns before it go
            kept = [i for i, t in enumerate(free) if t.initial == "s"]
            for k, i in enumerate(kept):
                lead = DELETE * i + free[i].extra
                if k and ("S", "A") in out and ("S", "U") in out and lead + forced > max(out["S", "A"][0], out["S", "U"][0], out["S", "P"][0]):
                    break  # later ones only cost more
                rest = free[i + 1 :]
                offer("S", "P", lead + DELETE * len(rest), "D" * i + "K" + "D" * len(rest))
                for end, last in (("U", "u"), ("A", "a")):
                    if found := _aligned(rest, "u", last):
                        offer("S", end, lead + found[0], "D" * i + "K" + found[1])
    return out


class Piece(NamedTuple):
    """A run of turns of one conversation, summed up: counts, edges, paths by pair of states, and the texts."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    distinct: int
    low: int | None
    high: int | None
    first_initial: str
    last_initial: str
    first_turn: int | None
    last_turn: int | None
    pairs: list[str]
    costs: list[int]
    audits: list[str]
    roles: list[str]
    texts: list[str]


PIECE_TYPES = {
    **dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "distinct", "low", "high"], "long"),
    **dict.fromkeys(["first_initial", "last_initial"], "string"),
    **dict.fromkeys(["first_turn", "last_turn"], "long"),
    "pairs": "array<string>",
    "costs": "array<long>",
    "audits": "array<string>",
    "roles": "array<string>",
    "texts": "array<string>",
}
RESULT_TYPES = {**dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "long"), "audit": "string", "repaired_sha256": "string"}
ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}

Row = tuple[int | None, str, str, str]  # turn, role, text, fault


def summed_up(rows: list[Row], whole: bool) -> Piece:
    """A piece of rows in order. A whole conversation only needs the paths from the beginning."""
    turns = [Turn(role[:1], fault) for _, role, _, fault in rows]
    paths = piece_paths(turns, "S" if whole else STATES)
    numbers = [r[0] for r in rows if r[0] is not None]
    count = {k: sum(t.fault == k for t in turns) for k in "bdt"}
    illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(turns, turns[1:]))
    pairs = [a + b for a, b in paths]
    return Piece(
        count["b"], count["d"], count["t"], illegal, len(set(numbers)), min(numbers, default=None), max(numbers, default=None), turns[0].initial, turns[-1].initial,
        rows[0][0], rows[-1][0], pairs, [c for c, _ in paths.values()], [a for _, a in paths.values()], [r[1] for r in rows], [r[2] for r in rows],
    )


class Repair:
    """One conversation put together from its pieces, in order."""

    def __init__(self) -> None:
        self.counts, self.distinct, self.low, self.high = [0, 0, 0, 0], 0, None, None
        self.before: tuple[str, int | None] | None = None
        self.best: dict[str, Best] = {"S": (0, "")}
        self.settled: list[str] = []
        self.rows: list[tuple[str, str]] = []  # those whose letters are not settled yet
        self.state, self.digest, self.lines = "S", hashlib.sha256(), 0

    def add(self, piece: Piece) -> None:
        for k in range(4):
            self.counts[k] += piece[k]
        self.distinct += piece.distinct
        if self.before is not None:
            self.counts[3] += self.before[0] + piece.first_initial not in LEGAL
            self.distinct -= piece.first_turn is not None and self.before[1] == piece.first_turn
        self.before = piece.last_initial, piece.last_turn
        if piece.low is not None:
            self.low = piece.low if self.low is None else min(self.low, piece.low)
            self.high = piece.high if self.high is None else max(self.high, piece.high)
        paths: dict[str, Best] = {}
        for pair, cost, audit in zip(piece.pairs, piece.costs, piece.audits):
            if pair[0] in self.best:
                so_far = self.best[pair[0]]
                found = so_far[0] + cost, so_far[1] + audit
                if pair[1] not in paths or found < paths[pair[1]]:
                    paths[pair[1]] = found
        self.best = paths
        self.rows += zip(piece.roles, piece.texts)
        shared = commonprefix([a for _, a in paths.values()])
        self._settle(shared)
        self.best = {s: (c, a[len(shared) :]) for s, (c, a) in paths.items()}

    def _settle(self, letters: str) -> None:
        """Hashes the turns of letters that no later piece can change."""
        at = 0
        for letter in letters:
            if letter == "D":
                at += 1
                continue
            role, text = ("", "") if letter == "I" else self.rows[at]
            at += letter != "I"
            if letter == "K" and self.state == "S" and role[:1] == "s":
                self.state = "P"
            else:
                symbol = FOLLOWS[self.state]
                role, self.state = role if letter == "K" else ROLE[symbol], symbol.upper()
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1
        self.rows = self.rows[at:]
        self.settled.append(letters)

    def result(self) -> tuple:
        cost, audit = min(self.best[s] for s in "SA" if s in self.best)
        self._settle(audit)
        gaps = 0 if self.low is None else (self.high - self.low + 1 - self.distinct + (1 << 63)) % (1 << 64) - (1 << 63)
        blank, duplicate, truncated, illegal = self.counts
        return gaps, blank, duplicate, truncated, illegal, cost, "".join(self.settled), self.digest.hexdigest()


def _crc_case(conv: Column, turn: Column) -> Column:
    told = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return (F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")) % 20).cast("int")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the contract's damage; a dropped row has no copies."""
    case = _crc_case(F.col("conv_id"), F.col("turn"))
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _faulted(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) once each, with ``own``: the fault of the text alone, and ``first``: its first copy is no duplicate."""
    parts = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text")]
    named = turns.where("copies > 0").withColumn("same", F.sha2(F.concat_ws(":", *parts), 256))
    earliest = named.groupBy("same").agg(F.min(F.struct("turn")).alias("earliest"))
    once = named.groupBy("same", "turn").agg(F.first("conv_id").alias("conv_id"), F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    shown = F.rtrim("text", F.lit(SPACES))
    own = F.when(shown == "", "b").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return once.join(earliest, "same").select("conv_id", "turn", "role", "text", "copies", own.alias("own"), F.col("turn").eqNullSafe(F.col("earliest.turn")).alias("first"))


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Row]]:
    """(conversation, row) for each copy, in order."""
    for batch in batches:
        for conv, turn, role, text, copies, own, first in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "copies", "own", "first"))):
            for copy in range(copies):
                yield conv, (turn, role, text, own if own == "b" or (first and not copy) else "d")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Row], bool]]:
    """(conversation, up to PIECE rows, whether the conversation ends with them)."""
    conv, rows, some = None, [], False
    for at, row in _expanded(batches):
        if some and at != conv:
            yield conv, rows, True
            rows = []
        elif len(rows) == PIECE:
            yield conv, rows, False
            rows = []
        conv, some = at, True
        rows.append(row)
    if some:
        yield conv, rows, True


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _emitted(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= 1 << 16:
            yield _batch(held, names, kinds)
            held, weight = [], 0
    if held:
        yield _batch(held, names, kinds)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation that has a row.

    ``conversations`` has conv_id, turn, role, text and ``copies``, as ``damaged`` gives them.
    """
    id_type = dict(conversations.dtypes)["conv_id"]
    piece_names, result_names = list(PIECE_TYPES), list(RESULT_TYPES)
    schema = ", ".join([f"conv_id {id_type}", "task int", "number int", *(f"r_{k} {v}" for k, v in RESULT_TYPES.items()), *(f"{k} {v}" for k, v in PIECE_TYPES.items())])

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, none = TaskContext.get().partitionId(), (None,) * len(PIECE_TYPES)
        id_kind: list[pa.DataType] = []

        def typed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in given:
                if not id_kind:
                    id_kind.append(b.schema.field("conv_id").type)
                yield b

        def rows() -> Iterator[tuple]:
            conversation, number, repair, held = 0, 0, None, []
            for conv, run, ends in _runs(typed(batches)):
                # the first conversation may have begun in the task before, so it leaves as pieces
                if conversation == 0:
                    yield conv, task, number, *(None,) * len(RESULT_TYPES), *summed_up(run, False)
                else:
                    held.append(run)
                    if ends:
                        finished.append((conv, held))
                        held = []
                        if len(finished) > 1:
                            yield whole(*finished.pop(0))
                number += 1
                if ends:
                    conversation += 1
            for conv, runs in finished:  # the last one may go on in the next task
                for run in runs:
                    yield conv, task, number, *(None,) * len(RESULT_TYPES), *summed_up(run, False)
                    number += 1

        def whole(conv: object, runs: list[list[Row]]) -> tuple:
            repair = Repair()
            for run in runs:
                repair.add(summed_up(run, len(runs) == 1))
            return conv, task, 0, *repair.result(), *none

        finished: list[tuple[object, list[list[Row]]]] = []
        made = rows()
        first = next(made, None)
        if first is None:
            return
        kinds = [id_kind[0], pa.int32(), pa.int32(), *(ARROW[v] for v in RESULT_TYPES.values()), *(ARROW[v] for v in PIECE_TYPES.values())]
        names = ["conv_id", "task", "number", *(f"r_{k}" for k in result_names), *piece_names]

        def chained() -> Iterator[tuple]:
            yield first
            yield from made

        yield from _emitted(chained(), names, kinds, lambda r: 64 if r[-1] is None else 64 + sum(map(len, r[-1])))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            conv, repair = None, None
            for b in batches:
                if not id_kind:
                    id_kind.append(b.schema.field("conv_id").type)
                for at, done, piece in _pieces(b):
                    if repair is not None and (done is not None or at != conv):
                        yield conv, *repair.result()
                        repair = None
                    if done is not None:
                        yield at, *done
                        continue
                    conv, repair = at, repair or Repair()
                    repair.add(piece)
            if repair is not None:
                yield conv, *repair.result()

        made = rows()
        first = next(made, None)
        if first is None:
            return

        def chained() -> Iterator[tuple]:
            yield first
            yield from made

        yield from _emitted(chained(), ["conv_id", *result_names], [id_kind[0], *(ARROW[v] for v in RESULT_TYPES.values())], lambda r: 64 + len(r[-2]))

    def _pieces(b: pa.RecordBatch) -> Iterator[tuple[object, tuple | None, Piece | None]]:
        for at in range(b.num_rows):
            row = b.slice(at, 1).to_pylist()[0]
            if row["r_cost"] is not None:
                yield row["conv_id"], tuple(row[f"r_{k}"] for k in result_names), None
            else:
                yield row["conv_id"], None, Piece(*(row[k] for k in piece_names))

    order = ["conv_id", "turn", "role"]
    dealt = _faulted(conversations).repartitionByRange(*order, F.left("text", F.lit(256))).sortWithinPartitions(*order, "text")
    pieces = dealt.mapInArrow(in_task, schema)
    joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "task", "number")
    return joined.mapInArrow(together, ", ".join([f"conv_id {id_type}", *(f"{k} {v}" for k, v in RESULT_TYPES.items())]))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's damage, counts, least cost, audit and digest of every conversation."""
    turns = damaged(table(spark, sf_dir, "conversations"))
    found = repaired(turns)
    every = turns.groupBy(F.col("conv_id").alias("of")).agg(F.lit(1).alias("here"))
    zero = lambda k: F.coalesce(k, F.lit(0).cast("long")).alias(k)
    numbers = [zero(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    joined = every.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
