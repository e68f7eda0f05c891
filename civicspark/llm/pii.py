"""Operator 7 [native]: personal data by candidate generation and gradient-boosted trees.

1. Base finders: the contract's four patterns, leftmost and non-overlapping, with their checks.
2. Generators with high recall propose further, overlapping spans: groups of four digits, grouped
   numbers without a plus sign, numbers with a trunk zero, long runs of letters and digits, and long
   runs that ``_ - / + .`` join into one key with its prefix and its ``=`` padding.
3. Each proposal gets small integer features, and a weak label that they do not hold. A card or phone
   proposal is labelled by its format (a base span, with its checks, covers it) and described by its
   context: cue words before it, what stands at both ends, how its groups are set apart. A run of
   letters and digits is labelled by its context (it is assigned to a name such as ``token``) or by the
   first letters of a known kind of key, and described by its format: length, digits, case, hexadecimal,
   and what joins its parts.
4. Spark counts the proposals of the corpus by feature combination and label, a table whose size the
   features bound. Logistic boosting of depth-two trees over it gives the probability of a label.
   Proposals without one are unlabelled, not negative: on a fold kept aside, the mean probability of
   labelled proposals estimates how many of a kind's private ones have the label at all, and a
   probability divided by that share is the calibrated one. The threshold is ``ACCEPT`` on that scale.
5. Scores are CASE expressions over the features; proposals at or above their threshold become spans
   unless a base span covers them.

Positions come from splitting a text at a pattern and adding up piece lengths, so everything runs as
column expressions on one row at a time: no shuffle except the table of counts. Patterns use
possessive repeats and a look-behind that skips inner starts, so a long run costs linear time and no
deep recursion; they match exactly what the contract's patterns match. Lists are built in pieces of
``PIECE``, so a text with very many matches does not copy its list for each of them.

Edge cases: a null text is empty and has no spans (``redact`` leaves it null); repeated rows are
repeated; ids may be null; extra columns are dropped by the query and kept by ``redact``, whatever
their names; an empty table (or one without proposals) adds nothing; where spans overlap, the one
that starts first (then the longer, then the kind listed first) names the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import crc32_of_id, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: The contract's patterns, in the form that matches the same without backtracking into runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text that must be there before a pattern is tried.
NEEDS = {"email": "@", "phone": "+"}
#: Generators: pattern, the kind their spans get, and whether the text must hold a digit.
GENERATORS = (
    (r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?:[0-9]{1,3})?(?![0-9])", "card", True),
    (r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", "phone", True),
    (r"(?<![0-9A-Za-z+])\(?0[0-9]{1,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{2,5}(?![0-9A-Za-z])", "phone", True),
    (r"(?<![A-Za-z0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}+", "secret", False),
    (r"(?<![A-Za-z0-9_/+.-])(?=[A-Za-z0-9_/+.-]{20})(?=[A-Za-z_/+.-]*+[0-9])(?=[0-9_/+.-]*+[A-Za-z])[A-Za-z0-9]++(?:[_/+.-]++[A-Za-z0-9]++)++={0,2}+", "secret", True),
)
#: Words before a number that say what it is.
CUES = (r"card|visa|iban|account|payment", r"tel|phone|call|fax|mobile|dial|ring|whatsapp", r"order|invoice|ticket|item|isbn|article|part|serial|version|page|ref|no\.|nr\.|#")
ASSIGNED = r"(?i)(?:token|key|secret|password|passwd|pwd)[\x20]*[=:][\x20]*[\"']?$"
#: How access keys of well-known services begin.
PREFIXES = r"^(?:AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|xox[abeoprs]-|[prs]k_(?:live|test)_|sk-|npm_|hf_)"
FEATURES = ("k", "cue", "before", "after", "gaps", "size", "digits", "letters", "hex")
TREES = 30
RATE = 0.3
#: Calibrated probability from which a proposal becomes a span.
ACCEPT = 0.8
KEPT_ASIDE = (5, 0)
#: Entries that a list grows by at a time.
PIECE = 64


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the table's own."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def scan(rows: Column, state: Column, step, kind: str) -> Column:
    """The items that ``step`` makes going through an array with a running state, as an array.

    step: (state, entry) to (state, item, whether the item counts). Items are gathered in pieces.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(state.alias("st"), none.alias("out"))

    def inner(acc: Column, x: Column) -> Column:
        after, item, counts = step(acc["st"], x)
        return F.struct(after.alias("st"), F.when(counts, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, c: Column) -> Column:
        piece = F.aggregate(F.slice(rows, c * PIECE + 1, PIECE), F.struct(F.element_at(acc, -1)["st"].alias("st"), none.alias("out")), inner)
        return F.concat(acc, F.array(piece))

    numbers = F.sequence(F.lit(0), F.floor(F.size(rows) / PIECE).cast("int"))
    return F.flatten(F.transform(F.aggregate(numbers, F.array(start), outer), lambda p: p["out"]))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<s, e, m, before>> of the non-overlapping matches, leftmost first; before: up to 24 characters."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("n"), F.right(p, F.lit(24)).alias("before"), m.alias("m")))
    kind = "struct<s:int,e:int,m:string,before:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        s = at + x["n"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return e, F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["before"].alias("before")), x["m"].isNotNull()

    # a one-element array holds the rows, so that they are made once for all their uses
    spans = F.flatten(F.transform(F.array(rows), lambda r: scan(r, F.lit(0), step, kind)))
    return F.when(possible, spans).otherwise(F.array().cast(f"array<{kind}>"))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    points = F.transform(each, lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits_of(m)).between(16, 19) & luhn(digits_of(m))
    if kind == "phone":
        return F.length(digits_of(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, figures: Column) -> Column:
    """array<struct<k, s, e>> of the base finders, by kind as listed, then start."""
    parts = []
    for k, kind in enumerate(BASE):
        parts.append(_checked(k, kind, matches(text, BASE[kind], text.contains(NEEDS[kind]) if kind in NEEDS else figures)))
    return F.concat(*parts)


def _checked(k: int, kind: str, found: Column) -> Column:
    return F.transform(F.filter(found, lambda x: valid(kind, x["m"])), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def char_class(c: Column) -> Column:
    return F.when((c == "") | c.isNull() | c.rlike(r"^\s$"), 0).when(c.rlike("^[A-Za-z0-9]$"), 1).when(c.isin('"', "'", "=", ":"), 2).when(c.isin(".", ",", ";", "!", "?"), 3).otherwise(4)


def cue_class(before: Column) -> Column:
    """0, or 1 more than the place of the group whose word stands last before a number."""
    out = F.lit(0)
    for k, words in reversed(list(enumerate(CUES))):
        out = F.when(before.rlike(rf"(?i)(?:{words})[^A-Za-z0-9]*$"), k + 1).otherwise(out)
    return out


def proposals(text: Column, figures: Column) -> Column:
    """array<struct<k, s, e, features..., assigned>> of the generators."""
    return F.concat(*(_proposed(text, figures if needs else F.lit(True), pattern, KINDS.index(kind)) for pattern, kind, needs in GENERATORS))


def _proposed(text: Column, possible: Column, pattern: str, k: int) -> Column:
    secret = KINDS[k] == "secret"
    none = F.lit(0)

    def row(x: Column) -> Column:
        digits, length = F.length(digits_of(x["m"])), F.length(x["m"])
        lower, upper = x["m"].rlike("[a-z]"), x["m"].rlike("[A-Z]")
        # what makes a number a base span (its plus sign, its country code) is not among what stands before it
        before = F.regexp_replace(x["before"], r"[\x20()+0-9-]*$", "")
        context = {"cue": cue_class(before), "before": char_class(F.right(before, F.lit(1))), "after": char_class(F.substring(text, x["e"] + 1, F.lit(1))), "gaps": F.when(x["m"].rlike("[./()]"), 3).when(x["m"].contains("-"), 2).when(x["m"].contains(" "), 1).otherwise(0)}
        form = {"size": F.when(length < 20, 0).when(length < 32, 1).when(length < 48, 2).otherwise(3), "digits": F.when(digits == 0, 0).when(digits * 8 < length, 1).when(digits * 2 < length, 2).otherwise(3), "letters": F.when(lower & upper, 2).when(upper, 1).otherwise(0), "hex": x["m"].rlike("^[0-9A-Fa-f]+$").cast("int")}
        form_gaps = F.when(x["m"].contains("."), 3).when(x["m"].rlike("[/+]"), 2).when(x["m"].rlike("[_-]"), 1).otherwise(0)
        features = {**dict.fromkeys(context, none), **form, "gaps": form_gaps} if secret else {**context, **dict.fromkeys(form, none)}
        return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *(v.cast("int").alias(f) for f, v in features.items()), (x["before"].rlike(ASSIGNED) | x["m"].rlike(PREFIXES) if secret else F.lit(False)).alias("assigned"))

    return F.transform(matches(text, pattern, possible), row)


def with_spans(docs: DataFrame, base: str = "base", offered: str = "offered") -> DataFrame:
    """The input with base spans and proposals, each proposal with what its label says."""
    text = text_of()
    (figures,) = free_names(docs, "any_digit_in_text")  # a column of its own, so that each text is searched for a digit once
    both = docs.withColumn(figures, text.rlike("[0-9]")).withColumns({base: base_spans(text, F.col(figures)), offered: proposals(text, F.col(figures))}).drop(figures)
    inside = lambda x: F.exists(base, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))
    return both.withColumn(offered, F.transform(offered, lambda x: x.withField("covered", inside(x))))


def combination_counts(spans: DataFrame) -> list[dict]:
    """Weak labels counted by feature combination and fold: at most as many rows as combinations."""
    aside = F.coalesce(crc32_of_id() % KEPT_ASIDE[0] == KEPT_ASIDE[1], F.lit(False))
    # the outer form, as the plain one would have the lists made once more to filter by their sizes
    each = spans.select(aside.alias("aside"), F.explode_outer("offered").alias("x")).where(F.col("x").isNotNull())
    # a covered run of letters is part of an address, not a secret: it says nothing
    each = each.where(~((F.col("x.k") == KINDS.index("secret")) & F.col("x.covered")))
    counted = each.groupBy("aside", *(F.col(f"x.{f}").alias(f) for f in FEATURES)).agg(F.count_if(F.col("x.covered") | F.col("x.assigned")).alias("yes"), F.count(F.lit(1)).alias("n"))
    return sorted((r.asDict() for r in counted.collect()), key=lambda c: [c["aside"], *(c[f] for f in FEATURES)])


class Boosted:
    """Depth-two trees boosted on the logistic loss over a table of counted feature combinations."""

    def __init__(self, counts: list[dict], trees: int = TREES, rate: float = RATE):
        rows = [c for c in counts if not c["aside"]]
        self.trees: list[tuple] = []
        yes, n = sum(c["yes"] for c in rows), sum(c["n"] for c in rows)
        self.bias = math.log((yes + 1) / (n - yes + 1))
        score = [self.bias] * len(rows)
        for _ in range(trees if n else 0):
            p = [1 / (1 + math.exp(-max(-30, min(30, z)))) for z in score]
            grad = [c["yes"] - c["n"] * q for c, q in zip(rows, p, strict=True)]
            hess = [c["n"] * q * (1 - q) for c, q in zip(rows, p, strict=True)]
            everyone = list(range(len(rows)))
            root = self._split(rows, grad, hess, everyone)
            if root is None:
                break
            sides = ([i for i in everyone if rows[i][root[0]] <= root[1]], [i for i in everyone if rows[i][root[0]] > root[1]])
            leaves = []
            for side in sides:
                cut = self._split(rows, grad, hess, side)
                groups = [side] if cut is None else [[i for i in side if rows[i][cut[0]] <= cut[1]], [i for i in side if rows[i][cut[0]] > cut[1]]]
                leaves.append((cut, [rate * sum(grad[i] for i in g) / (sum(hess[i] for i in g) + 1.0) for g in groups]))
            tree = (root, leaves)
            self.trees.append(tree)
            score = [z + self._value(tree, c) for z, c in zip(score, rows, strict=True)]
        self.thresholds = self._calibrate([c for c in counts if c["aside"]] or rows)

    @staticmethod
    def _split(rows: list[dict], grad: list[float], hess: list[float], among: list[int]) -> tuple | None:
        best, cut = 1e-6, None
        g, h = sum(grad[i] for i in among), sum(hess[i] for i in among)
        for f in FEATURES:
            sums: dict[int, list[float]] = {}
            for i in among:
                at = sums.setdefault(rows[i][f], [0.0, 0.0])
                at[0] += grad[i]
                at[1] += hess[i]
            left = [0.0, 0.0]
            for v in sorted(sums)[:-1]:
                left[0] += sums[v][0]
                left[1] += sums[v][1]
                gain = left[0] ** 2 / (left[1] + 1) + (g - left[0]) ** 2 / (h - left[1] + 1) - g * g / (h + 1)
                if gain > best:
                    best, cut = gain, (f, v)
        return cut

    @staticmethod
    def _value(tree: tuple, c: dict) -> float:
        (f, v), leaves = tree
        cut, values = leaves[0 if c[f] <= v else 1]
        return values[0] if cut is None or c[cut[0]] <= cut[1] else values[1]

    def score(self, c: dict) -> float:
        return self.bias + sum(self._value(t, c) for t in self.trees)

    def _calibrate(self, counts: list[dict]) -> dict[int, float]:
        """For each kind the score of the calibrated probability ACCEPT; infinite where nothing is labelled."""
        out = {}
        for k in sorted({KINDS.index(kind) for _, kind, _ in GENERATORS}):
            rows = [(1 / (1 + math.exp(-max(-30, min(30, self.score(c))))), c["yes"]) for c in counts if c["k"] == k]
            labelled = sum(y for _, y in rows)
            share = sum(p * y for p, y in rows) / labelled if labelled else 0.0
            least = ACCEPT * share
            out[k] = math.log(least / (1 - least)) if 0 < least < 1 else math.inf
        return out

    def expression(self, x: Column) -> Column:
        """The score as CASE expressions over a proposal's fields."""

        def leaf(cut: tuple | None, values: list[float]) -> Column:
            return F.lit(values[0]) if cut is None else F.when(x[cut[0]] <= cut[1], F.lit(values[0])).otherwise(F.lit(values[1]))

        total = F.lit(self.bias)
        for (f, v), leaves in self.trees:
            total = total + F.when(x[f] <= v, leaf(*leaves[0])).otherwise(leaf(*leaves[1]))
        return total

    def accepted(self, x: Column) -> Column:
        test = F.lit(False)
        for k, least in self.thresholds.items():
            if least < math.inf:
                test = test | ((x["k"] == k) & (self.expression(x) >= least))
        return test


def find_private(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """The input with two columns array<struct<k, s, e>>, k an index into KINDS: base spans, and all spans."""
    model = Boosted(combination_counts(with_spans(docs.select("doc_id", "text"))))
    (offered,) = free_names(docs, "offered")
    added = F.transform(F.filter(offered, lambda x: ~x["covered"] & model.accepted(x)), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return with_spans(docs, base, offered).withColumn(spans, F.array_sort(F.array_distinct(F.concat(base, added)))).drop(offered)


def joined(spans: str) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are one."""
    base, spans = free_names(docs, "base", "spans")
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))

    def step(reach: Column, x: Column) -> tuple[Column, Column, Column]:
        # what a span adds: the text since the last one's end, and its tag; a span that begins inside another adds nothing
        item = F.struct(reach.alias("since"), x["s"].alias("s"), x["k"].alias("k"))
        return F.greatest(reach, -x["e"]), item, x["s"] >= reach

    def cut_out(x: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)), F.lit("]"))
        return F.concat(F.substring(F.col("text"), x["since"] + 1, x["s"] - x["since"]), tag)

    marks = scan(by_start, F.lit(0), step, "struct<since:int,s:int,k:int>")
    end = F.array_max(F.transform(spans, lambda x: x["e"]))
    whole = F.concat(F.array_join(F.transform(marks, cut_out), ""), F.substring(F.col("text"), end + 1, F.length("text")))
    return find_private(docs, base, spans).withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(F.col("text"))).select(*docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *(of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def brute_force(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """Base spans of one text with the contract's own patterns, for tests."""
    text = text or ""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind: str, m: str) -> bool:
        d = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    found = [(kind, m.start(), m.end()) for kind, p in patterns.items() for m in re.finditer(p, text) if ok(kind, m[0])]
    return found, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
