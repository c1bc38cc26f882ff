"""Packet predicates: any-of matching and two-valued logic over Spark columns.

``field(name)`` looks a field up and its operators build ordinary columns::

    packets.where((field("udp.port") == 53) | field("tcp.flags.syn").exists())

A field has no value, one, or several.  A comparison is true if any value satisfies it; a
missing field makes it false, never NULL, so negation behaves.  ``!=`` wants the field to be
present and no value to be equal.  Inside ``where`` a top-level comparison of a scalar field
stays a plain ``column = literal``, which Parquet can push down; :func:`both`, :func:`either`
and :func:`negate` make the two-valued forms where they matter.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.ip import key_of, key_range


@dataclass(frozen=True)
class Entry:
    """One field: its kind, the SQL expression of its value and whether that is an array."""

    name: str
    kind: str
    sql: str
    many: bool = False
    text_sql: str = ""


def total(condition: Column) -> Column:
    """The condition with NULL as false."""
    return F.coalesce(condition, F.lit(False))


def negate(condition: Column) -> Column:
    return ~total(condition)


def both(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & total(c)
    return out


def either(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | total(c)
    return out


class Field:
    def __init__(self, entry: Entry) -> None:
        self.entry = entry

    @property
    def column(self) -> Column:
        return F.expr(self.entry.sql)

    def _any(self, test) -> Column:
        return F.exists(self.column, lambda x: total(test(x))) if self.entry.many else test(self.column)

    def exists(self) -> Column:
        """True flags; for other kinds, at least one value (an empty text or 0 is one)."""
        if self.entry.many:
            return total(F.size(self.column) > 0)
        return total(self.column) if self.entry.kind == "bool" else self.column.isNotNull()

    def _equal(self, x: Column, value) -> Column:
        if self.entry.kind == "ip":
            if "/" in str(value):
                low, high = key_range(str(value))
                return x.between(low, high)
            return x == key_of(str(value))
        if self.entry.kind == "bytes":
            return x == F.lit(bytes(value))
        if self.entry.kind == "string" and isinstance(value, str) and _is_mac(value):
            return x == _mac(value)
        return x == F.lit(value)

    def __eq__(self, value) -> Column:  # type: ignore[override]
        return self._any(lambda x: self._equal(x, value))

    def __ne__(self, value) -> Column:  # type: ignore[override]
        """Present, and no value is equal."""
        if self.entry.many:
            return total(F.size(self.column) > 0) & ~total(self == value)
        return self.column.isNotNull() & ~total(self == value)

    __hash__ = None  # type: ignore[assignment]

    def _ordered(self, compare) -> Column:
        return F.lit(False) if self.entry.kind == "ip" else self._any(compare)

    def __lt__(self, value) -> Column:
        return self._ordered(lambda x: x < F.lit(value))

    def __le__(self, value) -> Column:
        return self._ordered(lambda x: x <= F.lit(value))

    def __gt__(self, value) -> Column:
        return self._ordered(lambda x: x > F.lit(value))

    def __ge__(self, value) -> Column:
        return self._ordered(lambda x: x >= F.lit(value))

    def isin(self, *values) -> Column:
        """Any value equals any of these; none given is false."""
        out = F.lit(False)
        for v in values:
            out = out | total(self == v)
        return out

    def _text(self) -> Field:
        """Numbers, flags and addresses as their text."""
        e = self.entry
        if e.kind == "string":
            return self
        sql = e.text_sql or (f"transform({e.sql}, x -> cast(x as string))" if e.many else f"cast({e.sql} as string)")
        return Field(Entry(e.name, "string", sql, e.many))

    def contains(self, part: str | bytes) -> Column:
        if self.entry.kind == "bytes":
            raw = part.encode() if isinstance(part, str) else part
            return F.contains(self.column, F.lit(raw))
        return self._text()._any(lambda x: F.contains(x, F.lit(part)))

    def matches(self, pattern: str) -> Column:
        """A regular expression found anywhere; one that is no expression is an error here and now."""
        re.compile(pattern)
        if self.entry.kind == "bytes":
            return F.decode(self.column, "ISO-8859-1").rlike(pattern)
        return self._text()._any(lambda x: x.rlike(pattern))


def _is_mac(text: str) -> bool:
    return bool(re.fullmatch(r"(?i)[0-9a-f]{2}([:-][0-9a-f]{2}){5}", text))


def _mac(text: str) -> str:
    return text.lower().replace("-", ":")


def is_address(text: str) -> bool:
    try:
        ipaddress.ip_network(text, strict=False)
    except ValueError:
        return False
    return True


class Registry:
    """Fields by name, case-insensitive, with suggestions for names that are not there."""

    def __init__(self, entries: list[Entry]) -> None:
        self.entries = {e.name: e for e in entries}

    def __call__(self, name: str) -> Field:
        entry = self.entries.get(name.lower())
        if entry is None:
            raise KeyError(f"no field {name!r}; near: {', '.join(self.suggestions(name)) or 'none'}")
        return Field(entry)

    def suggestions(self, name: str, limit: int = 5) -> list[str]:
        wanted = name.lower()

        def rank(known: str) -> tuple[int, str]:
            return (0 if known.startswith(wanted) else 1 if wanted in known else 2 if known in wanted else 3 if known.split(".")[-1] == wanted.split(".")[-1] else 9), known

        return [k for r, k in sorted(map(rank, self.entries)) if r < 9][:limit]

    def rows(self, search: str = "") -> list[tuple[str, str, str]]:
        return [(e.name, e.kind, e.sql) for e in self.entries.values() if search.lower() in e.name]
