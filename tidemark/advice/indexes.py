"""Composite index candidates: equality columns first, then a sort, a range or a grouping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..sql.lexer import lower
from ..sql.writer import quote
from .catalog import Catalog, Index
from .facts import SYSTEM_SCHEMAS, Facts, Predicate, TableUse, Use, same

#: Most equality columns, most columns after them, most bytes of an index name.
MOST_EQUALITY, MOST_TAIL, NAME_BYTES = 4, 3, 64


@dataclass
class Candidate:
    table: str
    equality: list[str]
    tail: list[str]
    tail_kind: str
    checked: bool = False
    partial: str = ""
    redundant: list[Index] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.equality + self.tail

    @property
    def ddl(self) -> str:
        return f"ALTER TABLE {quote(self.table)} ADD INDEX {index_name(self.table, self.columns)} ({', '.join(map(quote, self.columns))});"


def index_name(table: str, columns: list[str]) -> str:
    clean = [re.sub(rb"[^A-Za-z0-9_]", b"_", c.encode("utf-8", "surrogateescape")).lower().decode() for c in columns]
    name = "_".join(["idx", lower(table), *clean])
    return name.encode("utf-8", "surrogateescape")[:NAME_BYTES].decode("utf-8", "ignore")


def _distinct(columns) -> list[str]:
    return list({lower(c): c for c in reversed(list(columns))}.values())[::-1]


def _usable(p: Predicate, catalog: Catalog | None) -> bool:
    """Whether an index can serve a condition: bare column, not under OR, no text compared with a number."""
    column = catalog.column(p.column.table, p.column.column) if catalog else None
    return p.sargable and not p.under_or and not (p.value == "number" and column is not None and column.textual)


def _all_on(uses: list[Use], table: TableUse) -> list[str]:
    return _distinct(u.column for u in uses) if all(same(u.ref, table.ref) for u in uses) else []


def _for_table(facts: Facts, table: TableUse, catalog: Catalog | None) -> Candidate | None:
    filters, joins, ranges = [], [], []
    for p in facts.predicates:
        if p.other is not None:
            if p.kind == "equality" and p.sargable and not p.under_or:
                joins += [u.column for u in (p.column, p.other) if same(u.ref, table.ref)]
        elif same(p.column.ref, table.ref) and _usable(p, catalog):
            if p.kind in ("equality", "is_null", "in"):
                filters.append(p.column.column)
            elif p.kind == "range" or (p.kind == "like" and p.pattern and p.pattern[0] not in "%_"):
                ranges.append(p.column.column)
    filters = _distinct(filters)
    ranges = [r for r in ranges[:1] if not any(same(r, c) for c in filters)]
    equality = (filters or _distinct(joins))[:MOST_EQUALITY]
    rest = lambda columns: [c for c in columns if not any(same(c, e) for e in equality)]
    first = same(facts.tables[0].ref, table.ref)
    plain = not (facts.by_rand or facts.by_expression or facts.mixed_directions)
    sort = rest(_all_on(facts.order_by, table)) if first and plain else []
    group = rest(_all_on(facts.group_by, table)) if first and not facts.order_by else []
    if sort and (not ranges or same(ranges[0], sort[0])):
        tail, kind = sort, "sort"
    elif ranges:
        tail, kind = ranges, "range"
    else:
        tail, kind = group, "group" if group else ""
    out = Candidate(table.name, equality, tail[:MOST_TAIL], kind)
    return out if out.columns else None


def _against_schema(c: Candidate, catalog: Catalog | None) -> bool:
    """Completes a candidate from the schema; False if the schema makes it pointless."""
    known = catalog.table(c.table) if catalog else None
    if known is None:
        return not (not c.tail and len(c.equality) == 1 and same(c.equality[0], "id"))
    c.checked = True
    if not all(known.column(x) for x in c.columns) or known.serving(c.equality, c.tail):
        return False
    if c.tail and c.equality and (found := known.serving(c.equality, [])):
        c.partial = found.name
    c.redundant = known.made_redundant(c.equality, c.tail)
    return True


def suggest(facts: Facts, catalog: Catalog | None = None) -> list[Candidate]:
    """Candidates in table order, each set of columns of a table once."""
    out: dict[tuple, Candidate] = {}
    if facts.kind in ("SELECT", "UPDATE", "DELETE"):
        for table in facts.base_tables:
            if lower(table.schema) in SYSTEM_SCHEMAS:
                continue
            c = _for_table(facts, table, catalog)
            if c is not None and _against_schema(c, catalog):
                out.setdefault((lower(c.table), tuple(c.columns)), c)
    return list(out.values())
