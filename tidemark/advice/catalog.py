"""The analysed database's schema, replayed from its DDL."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..sql.lexer import lower
from ..sql.parser import parse_script
from ..sql.tree import Node

#: Type categories by the type's first word; any other is "other".
CATEGORIES = {
    "integer": "tinyint smallint mediumint int integer bigint bit bool boolean serial year",
    "decimal": "decimal numeric dec fixed",
    "float": "float double real",
    "string": "char varchar tinytext text mediumtext longtext enum set nchar nvarchar",
    "binary": "binary varbinary tinyblob blob mediumblob longblob",
    "temporal": "date datetime timestamp time",
    "json": "json",
}
_CATEGORY_OF = {t: c for c, ts in CATEGORIES.items() for t in ts.split()}
NUMERIC = frozenset(("integer", "decimal", "float"))
BTREE = frozenset(("primary", "unique", "regular"))


def category_of(kind: str) -> str:
    words = lower(kind).replace("(", " ").split()
    return _CATEGORY_OF.get(words[0] if words else "", "other")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True

    @property
    def category(self) -> str:
        return category_of(self.type)

    @property
    def textual(self) -> bool:
        return self.category == "string"

    @property
    def numeric(self) -> bool:
        return self.category in NUMERIC


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    columns: tuple[str, ...]

    @property
    def btree(self) -> bool:
        return self.kind in BTREE

    def _agrees(self, equality: list[str], tail: list[str], length: int) -> bool:
        """Whether the first columns are equality columns in any order, then the tail in order."""
        own, wanted = [lower(c) for c in self.columns[:length]], {lower(c) for c in equality}
        split = len(equality)
        return all(c in wanted for c in own[:split]) and own[split:] == [lower(c) for c in tail][: max(0, length - split)]

    def serves(self, equality: list[str], tail: list[str]) -> bool:
        length = len(equality) + len(tail)
        return self.btree and 0 < length <= len(self.columns) and self._agrees(equality, tail, length)

    def is_prefix_of(self, equality: list[str], tail: list[str]) -> bool:
        return self.btree and 0 < len(self.columns) < len(equality) + len(tail) and self._agrees(equality, tail, len(self.columns))


@dataclass
class Table:
    name: str
    schema: str = ""
    columns: dict[str, Column] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def column(self, name: str) -> Column | None:
        return self.columns.get(lower(name))

    def serving(self, equality: list[str], tail: list[str]) -> Index | None:
        return next((i for i in self.indexes.values() if i.serves(equality, tail)), None)

    def made_redundant(self, equality: list[str], tail: list[str]) -> list[Index]:
        return [i for i in self.indexes.values() if i.kind == "regular" and i.is_prefix_of(equality, tail)]

    def leads(self, column: str) -> bool:
        return any(i.btree and i.columns and lower(i.columns[0]) == lower(column) for i in self.indexes.values())


class Catalog:
    """Tables by name without regard to case or schema; the last definition wins."""

    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.warnings: list[str] = []

    @classmethod
    def from_ddl(cls, ddl: str) -> Catalog:
        """Replays CREATE TABLE, ALTER TABLE and CREATE INDEX; what does not parse becomes a warning."""
        out = cls()
        statements, errors = parse_script(ddl)
        for s in statements:
            out.apply(s)
        out.warnings = [f"skipped a statement: {e}" for e in errors]
        return out

    def apply(self, s: Node) -> None:
        if s.kind not in ("create_table", "alter_table"):
            return
        known = self.tables.get(lower(s.table.name)) if s.kind == "alter_table" else None
        table = known or Table(s.table.name, s.table.schema)
        for c in s.columns:
            table.columns[lower(c.name)] = Column(c.name, c.type, c.nullable)
        for name in getattr(s, "dropped", ()):
            table.indexes.pop(lower(name), None)
        for i in s.indexes:
            name = i.name or (i.columns[0] if i.columns else "")
            table.indexes[lower(name)] = Index(name, i.type, tuple(i.columns))
        self.tables[lower(s.table.name)] = table

    def table(self, name: str) -> Table | None:
        return self.tables.get(lower(name))

    def column(self, table: str, column: str) -> Column | None:
        found = self.table(table) if table else None
        return found.column(column) if found else None

    def tables_with_column(self, column: str) -> list[Table]:
        return [t for _, t in sorted(self.tables.items()) if t.column(column)]

    def rows(self) -> list[tuple]:
        """(table, column, type, category, nullable) of every column, in order."""
        return [(t.name, c.name, c.type, c.category, c.nullable) for _, t in sorted(self.tables.items()) for c in t.columns.values()]
