"""Citations by an automaton over a vocabulary of names: all names are looked for at once, whatever their number.

A citation is a name, before it perhaps the mark of a former law, after it perhaps a detail in parentheses, and an article. The first one of a
text is that which begins first; of names that begin at one place the longest counts whose article follows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of one automaton, some 100 bytes each in every worker; more names take turns, and the earliest citation counts.
NAMES = 200_000
FORMER = "구"
DETAIL = r"(?:\s*\(([^)]*)\))?\s*"
FOUND = "start int, named int, rest int, law string, detail string, art_no string, branch_no string"

_automata: dict[str, "NameAutomaton"] = {}


class NameAutomaton:
    def __init__(self, names: list[str], article: str):
        import ahocorasick

        self.names = ahocorasick.Automaton()
        for name in names:
            self.names.add_word(name, len(name))
        self.names.make_automaton()
        self.tail = re.compile(DETAIL + article)

    def first(self, text: str) -> tuple | None:
        """(start, 0 behind a mark of a former law or else 1, minus the name's length, name, detail, article, branch)."""
        best = None
        for last, size in self.names.iter(text):
            tail = self.tail.match(text, last + 1)
            if tail:
                start = last + 1 - size
                before = start
                while before and text[before - 1].isspace():
                    before -= 1
                former = before > 0 and text[before - 1] == FORMER
                found = (before - 1 if former else start, 0 if former else 1, -size, text[start : last + 1], *tail.group(1, 2, 3))
                best = found if best is None or found[:3] < best[:3] else best
        return best


def name_list(names: list[str] | DataFrame) -> list[str]:
    """The names, from a list or from the first column of a table, which is a dimension: there are few against the texts."""
    given = (r[0] for r in names.select(names.columns[0]).distinct().toLocalIterator()) if isinstance(names, DataFrame) else names
    return sorted({n for n in given if n})


def first_citation(text: Column, names: list[str] | DataFrame, article: str) -> Column:
    """struct(start, named, rest, law, detail, art_no, branch_no) of the first citation; law is null where there is none."""
    def by(part: list[str]) -> Column:
        shared, label = SparkSession.active().sparkContext.broadcast(part), uuid.uuid4().hex

        @F.pandas_udf(FOUND)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            if label not in _automata:
                _automata.clear()
                _automata[label] = NameAutomaton(shared.value, article)
            automaton, nothing = _automata[label], (None,) * 7
            for texts in batches:
                rows = [(automaton.first(t) if isinstance(t, str) else None) or nothing for t in texts]
                yield pd.DataFrame(rows, columns=["start", "named", "rest", "law", "detail", "art_no", "branch_no"], dtype=object)

        return found(text)

    known = name_list(names)
    parts = [by(known[i : i + NAMES]) for i in range(0, len(known), NAMES)]
    if len(parts) == 1:
        return parts[0]
    hits = F.filter(F.array(*parts), lambda p: p["law"].isNotNull())
    return F.array_min(hits)
