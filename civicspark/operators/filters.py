"""Structured filter specs as predicates and semi joins, applied before any ranking."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names that a filter spec may use.
FACETS = ("paperType", "year", "result", "role", "authoritative", "tag", "district", "organization")
OPS = ("in", "eq", "range")
BASES = ("paper", "meeting", "file")


class FilterError(ValueError):
    pass


def _checked(spec: dict) -> dict:
    if not isinstance(spec, dict) or spec.get("facet") not in FACETS:
        raise FilterError(f"no known facet in {spec!r}")
    facet, op = spec["facet"], spec.get("op", "in")
    out = {"facet": facet, "op": op}
    if op == "in" and isinstance(spec.get("values"), (list, tuple)) and spec["values"]:
        out["values"] = [str(v) for v in spec["values"]]
    elif op == "eq" and "value" in spec and facet != "organization":
        out["value"] = spec["value"]
    elif op == "range" and facet == "year" and (spec.get("from") is not None or spec.get("to") is not None):
        out |= {"from": spec.get("from"), "to": spec.get("to"), "basis": spec.get("basis", "paper")}
        if out["basis"] not in BASES:
            raise FilterError(f"unknown basis {out['basis']!r}")
    else:
        raise FilterError(f"{facet} can't use {op!r} as it stands in {spec!r}")
    if facet == "tag":
        if not spec.get("scheme"):
            raise FilterError("a tag filter names its scheme")
        out["scheme"] = str(spec["scheme"])
    return out


def validate(specs: list[dict] | None) -> list[dict]:
    """Normalised copies of the specs: op ``in`` where none is named, values as strings; others are an error.

    Years may be numbers or strings. A tag filter needs its scheme, organizations are listed by name.
    """
    return [_checked(x) for x in specs or []]


def year_of(value) -> int:
    """The year that a bound of a range begins with."""
    return int(str(value)[:4])


def predicate(specs: list[dict] | None, columns: dict[str, str]) -> Column:
    """One column condition for the facets that live on the row; columns: facet or basis to column."""

    def one(spec: dict) -> Column:
        if spec["op"] == "in":
            return F.col(columns[spec["facet"]]).cast("string").isin(spec["values"])
        if spec["op"] == "eq":
            return F.col(columns[spec["facet"]]) == F.lit(spec["value"])
        day = F.col(columns[spec["basis"]])
        low = day >= F.lit(f"{year_of(spec['from'])}-01-01").cast("timestamp") if spec["from"] is not None else F.lit(True)
        high = day < F.lit(f"{year_of(spec['to']) + 1}-01-01").cast("timestamp") if spec["to"] is not None else F.lit(True)
        return low & high

    return reduce(lambda a, b: a & b, map(one, validate(specs)), F.lit(True))


def tagged(items: DataFrame, assignments: DataFrame, spec: dict, key: str) -> DataFrame:
    """Items that hold one of the tags of a tag filter within its scheme: a semi join."""
    (checked,) = validate([spec])
    held = assignments.where((F.col("scheme") == checked["scheme"]) & F.col("tag").isin(checked["values"]))
    return having(items, held, key)


def having(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Items with a link (facets that live in another table): a semi join."""
    return items.join(links.select(key).distinct(), key, "left_semi")


def not_deleted(deleted: Column) -> Column:
    return ~F.coalesce(deleted, F.lit(False))


def not_boilerplate(status: Column) -> Column:
    """Gate verdicts hide only what is known to be boilerplate."""
    return status.isNull() | (status != "boilerplate")


def named_items(items: DataFrame, moments: DataFrame, links: Mapping[str, DataFrame], contains: str, year_start: int | None = None, year_end: int | None = None) -> DataFrame:
    """Items (key, name, owner, ...) whose name holds a text, with the columns date and files, by date (none last) and key.

    ``%`` and ``_`` in the text stand for any characters and any one, as in LIKE. The date is the day of the owner's
    moment (owner, moment); years, both included, leave out dated items alone. files lists what the link
    tables (key, file) name for an item, each once: by the name of the first table that has it, then by file.
    Owners are unique in ``moments``; an item without a link has an empty list.
    """
    day = moments.select("owner", F.to_date("moment").alias("date"))
    found = items.where(F.col("name").like(f"%{contains}%")).join(day, "owner", "left")
    for bound, kept in ((year_start, lambda y: F.year("date") >= y), (year_end, lambda y: F.year("date") <= y)):
        if bound is not None:
            found = found.where(F.col("date").isNull() | kept(bound))
    every = reduce(DataFrame.unionByName, (df.select("key", "file", F.lit(place).alias("place")) for place, (_, df) in enumerate(sorted(links.items())))).where("file is not null")
    own = every.join(found.select("key").distinct(), "key", "left_semi").groupBy("key", "file").agg(F.min("place").alias("place"))
    listed = own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "file"))).alias("ordered")).select("key", F.col("ordered.file").alias("files"))
    kind = dict(listed.dtypes)["files"]
    return found.join(listed, "key", "left").withColumn("files", F.coalesce("files", F.array().cast(kind))).orderBy(F.asc_nulls_last("date"), "key")
