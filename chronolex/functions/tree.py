"""Nested article trees: flattening, chunking, diffs. Maps are built by one rule: the last of equal paths wins, in the place of the first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import thresholds


def _entry(path: Column, text: Column) -> Column:
    return F.struct(path.alias("key"), text.alias("value"))


def paths(clauses: Column) -> Column:
    """array<struct(key, value)> of every clause, sub-clause and item, in document order."""

    def clause(c: Column) -> Column:
        top = F.when(c["no"] != "", F.concat(F.lit("제"), c["no"], F.lit("항"))).otherwise("본문")

        def sub(s: Column) -> Column:
            here = F.concat(top, F.lit("제"), s["no"], F.lit("호"))
            return F.concat(F.array(_entry(here, s["text"])), F.transform(s["items"], lambda i: _entry(F.concat(here, i["no"], F.lit("목")), i["text"])))

        return F.concat(F.array(_entry(top, c["text"])), F.flatten(F.transform(c["sub_clauses"], sub)))

    return F.flatten(F.transform(clauses, clause))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once. A column that a lambda repeats is worked out anew for each element it goes over."""
    return F.transform(F.array(value), body)[0]


def as_map(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last value counts, at the first place."""

    def merged(e: Column) -> Column:
        # By key and place: equal keys are neighbours, the first says where, the last what.
        def of(s: Column) -> Column:
            first = F.filter(s, lambda x, i: ~F.get(s, i - 1)["key"].eqNullSafe(x["key"]))
            last = F.filter(s, lambda x, i: ~F.get(s, i + 1)["key"].eqNullSafe(x["key"]))
            places = F.sort_array(F.zip_with(first, last, lambda f, l: F.struct(f["place"].alias("first"), l["place"].alias("last"))))
            return F.map_from_entries(F.transform(places, lambda p: F.get(e, p["last"])))

        return bound(F.sort_array(F.transform(e, lambda x, i: F.struct(x["key"].alias("key"), i.alias("place")))), of)

    return bound(entries, lambda e: F.when(F.size(F.array_distinct(F.transform(e, lambda x: x["key"]))) == F.size(e), F.map_from_entries(e)).otherwise(merged(e)))


def flatten_tree(clauses: Column) -> Column:
    return as_map(paths(clauses))


def chunks(clauses: Column) -> Column:
    """array<struct(chunk_path, text)>, one per clause, with all that is nested in it."""

    def chunk(c: Column) -> Column:
        below = F.flatten(F.transform(c["sub_clauses"], lambda s: F.concat(F.array(s["text"]), F.transform(s["items"], lambda i: i["text"]))))
        path = F.when(c["no"] != "", F.concat(F.lit("제"), c["no"], F.lit("항"))).otherwise("")
        return F.struct(path.alias("chunk_path"), F.array_join(F.concat(F.array(c["text"]), below), "\n").alias("text"))

    return F.transform(clauses, chunk)


def full_text(clauses: Column) -> Column:
    return F.array_join(F.transform(chunks(clauses), lambda c: c["text"]), "\n")


def encoded(value: Column) -> Column:
    """A tree, diff or list of thresholds as JSON."""
    return F.to_json(value)


def decoded(text: Column, schema: str) -> Column:
    """The value back; schema: one of TREE, DIFF and array<THRESHOLD> of `schemas`. Text that is no JSON gives null."""
    return F.from_json(text, schema)


def diff(before: Column, after: Column) -> Column:
    """struct(added, removed, changed) of two path maps, whose paths are brought together by hashing."""
    there = lambda m: F.transform_values(m, lambda k, v: F.struct(v.alias("value")))  # noqa: E731 # a null is a text, too

    def of(both: Column) -> Column:
        added = F.transform_values(F.map_filter(both, lambda k, v: v["old"].isNull()), lambda k, v: v["new"]["value"])
        removed = F.transform_values(F.map_filter(both, lambda k, v: v["new"].isNull()), lambda k, v: v["old"]["value"])
        other = F.map_filter(both, lambda k, v: v["old"].isNotNull() & v["new"].isNotNull() & ~v["new"].eqNullSafe(v["old"]))
        changed = F.transform_values(other, lambda k, v: F.struct(v["old"]["value"].alias("from"), v["new"]["value"].alias("to")))
        return F.struct(added.alias("added"), removed.alias("removed"), changed.alias("changed"))

    return bound(F.map_zip_with(there(after), there(before), lambda k, new, old: F.struct(new.alias("new"), old.alias("old"))), of)


def added_thresholds(change: Column, **kw) -> Column:
    """Thresholds of added texts, and those of changed texts that the old text lacks; by path, repeats kept."""
    new = F.flatten(F.transform(F.map_values(change["added"]), lambda t: thresholds(t, **kw)))
    entries = F.array_sort(F.map_entries(change["changed"]))
    of_changed = F.flatten(F.transform(entries, lambda e: F.filter(thresholds(e["value"]["to"], **kw), lambda t: ~F.array_contains(thresholds(e["value"]["from"], **kw), t))))
    return F.concat(new, of_changed)
