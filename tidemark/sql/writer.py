"""Syntax trees back to SQL, with no more parentheses than precedence needs."""

from __future__ import annotations

import re

from .lexer import lower
from .parser import NOT, POWERS, PREDICATE, UNARY, VALUE
from .tree import Node
from .words import RESERVED

_PLAIN = re.compile(r"(?=.*[^0-9])[A-Za-z0-9_$\u0080-\U0010ffff\udc80-\udcff]+\Z", re.S)
_POWER = {"OR": 2, "XOR": 3, "AND": 4, "LIKE": 6, "NOT LIKE": 6, "REGEXP": 6, "NOT REGEXP": 6, "DIV": 11}


def quote(name: str) -> str:
    """A name as it must be written: bare if it can be, else in backticks."""
    if _PLAIN.match(name) and lower(name) not in RESERVED:
        return name
    return "`" + name.replace("`", "``") + "`"


def power_of(e: Node) -> int:
    if e.kind == "binary":
        return _POWER.get(e.op) or POWERS[e.op]
    if e.kind in ("in", "between", "is"):
        return PREDICATE
    return {"NOT": NOT}.get(e.op, UNARY) if e.kind == "unary" else 100


def _at_least(e: Node, power: int) -> str:
    return f"({to_sql(e)})" if power_of(e) < power else to_sql(e)


def _list(items) -> str:
    return ", ".join(map(to_sql, items))


def to_sql(n: Node) -> str:
    """SQL of an expression, a table or a query."""
    return _WRITERS[n.kind](n)


def _unary(e: Node) -> str:
    return e.op + (" " if e.op.isalpha() else "") + _at_least(e.operand, NOT if e.op == "NOT" else UNARY)


def _binary(e: Node) -> str:
    power = power_of(e)
    gap = "" if e.op in ("->", "->>") else " "
    return _at_least(e.left, power) + gap + e.op + gap + _at_least(e.right, power + 1)


def _in(e: Node) -> str:
    return f"{_at_least(e.operand, VALUE)}{' NOT' if e.negated else ''} IN ({to_sql(e.query) if e.query else _list(e.values)})"


def _between(e: Node) -> str:
    return f"{_at_least(e.operand, VALUE)}{' NOT' if e.negated else ''} BETWEEN {_at_least(e.low, VALUE)} AND {_at_least(e.high, VALUE)}"


def _call(e: Node) -> str:
    if e.name == "match" and e.args:
        return f"MATCH({_list(e.args[:-1])}) AGAINST({to_sql(e.args[-1])})"
    if e.name in ("extract", "position") and len(e.args) == 2:
        first = to_sql(e.args[0]) + " FROM " if e.name == "extract" else _at_least(e.args[0], VALUE) + " IN "
        return f"{e.name.upper()}({first}{to_sql(e.args[1])})"
    name = lower(e.name).upper() if e.name.isascii() else e.name
    if not e.args and not e.star and e.name.startswith("current_"):
        return name
    return f"{name}({'*' if e.star else ('DISTINCT ' if e.distinct else '') + _list(e.args)}){' OVER ()' if e.windowed else ''}"


def _case(e: Node) -> str:
    out = "CASE" + (f" {to_sql(e.operand)}" if e.operand else "")
    out += "".join(f" WHEN {to_sql(c)} THEN {to_sql(r)}" for c, r in e.branches)
    return out + (f" ELSE {to_sql(e.other)}" if e.other else "") + " END"


def _cast(e: Node) -> str:
    if e.type.startswith("using "):
        return f"CONVERT({to_sql(e.operand)} USING {e.type[6:]})"
    return f"CAST({to_sql(e.operand)} AS {e.type.upper()})"


def _table(t: Node) -> str:
    name = f"({to_sql(t.query)})" if t.query else (quote(t.schema) + "." if t.schema else "") + quote(t.name)
    return name + (f" AS {quote(t.alias)}" if t.alias else "")


def _item(i: Node) -> str:
    if i.star:
        return f"{i.qualifier}.*" if i.qualifier else "*"
    return to_sql(i.expr) + (f" AS {quote(i.alias)}" if i.alias else "")


def _join(j: Node) -> str:
    how = f"{'NATURAL ' if j.natural else ''}{j.how} {to_sql(j.table)}"
    return how + (f" ON {to_sql(j.on)}" if j.on else f" USING ({', '.join(j.using)})" if j.using else "")


def _select(s: Node) -> str:
    out = []
    if s.ctes:
        out.append("WITH " + ", ".join(f"{quote(c.name)}{' (' + ', '.join(c.columns) + ')' if c.columns else ''} AS ({to_sql(c.query)})" for c in s.ctes))
    out.append(f"SELECT {'DISTINCT ' if s.distinct else ''}{_list(s.items)}")
    if s.tables:
        out.append(f"FROM {_list(s.tables)}")
    out += map(to_sql, s.joins)
    if s.where:
        out.append(f"WHERE {to_sql(s.where)}")
    if s.group_by:
        out.append(f"GROUP BY {_list(s.group_by)}{' WITH ROLLUP' if s.rollup else ''}")
    if s.having:
        out.append(f"HAVING {to_sql(s.having)}")
    out += [f"{b.op} {to_sql(b.query)}" for b in s.branches]
    if s.order_by:
        out.append("ORDER BY " + ", ".join(to_sql(o.expr) + (" DESC" if o.descending else "") for o in s.order_by))
    if s.limit:
        out.append("LIMIT " + (to_sql(s.limit.offset) + ", " if s.limit.offset else "") + to_sql(s.limit.count))
    return " ".join(out + ([s.lock] if s.lock else []))


_WRITERS = {
    "literal": lambda e: e.text,
    "column": lambda e: ".".join(quote(x) for x in (e.schema, e.table, e.name) if x),
    "unary": _unary,
    "binary": _binary,
    "in": _in,
    "between": _between,
    "is": lambda e: f"{_at_least(e.operand, VALUE)} IS {'NOT ' if e.negated else ''}{e.test}",
    "call": _call,
    "case": _case,
    "cast": _cast,
    "interval": lambda e: f"INTERVAL {_at_least(e.value, UNARY)} {e.unit}",
    "subquery": lambda e: f"{e.how + ' ' if e.how else ''}({to_sql(e.query)})",
    "row": lambda e: f"({_list(e.items)})",
    "table": _table,
    "item": _item,
    "join": _join,
    "select": _select,
}
