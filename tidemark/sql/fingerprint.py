"""Statement kinds, fingerprints and class ids."""

from __future__ import annotations

import re
from typing import NamedTuple

from .lexer import CLOSE, COMMA, DOT, END, LITERALS, OP, OPEN, PARAM, QUOTED, SEMICOLON, VARIABLE, WORD, Token, lower, tokenize, unquote_name
from .words import DML, KIND_OF, OPERATOR_WORDS


class Fingerprint(NamedTuple):
    text: str
    class_id: str
    kind: str


def fnv1a_64(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def class_id(text: str) -> str:
    """Sixteen upper-case hex digits."""
    return f"{fnv1a_64(text.encode('utf-8', 'surrogateescape')):016X}"


def statement_kind(tokens: list[Token]) -> str:
    """Kind by the first word; after WITH, by the first word outside parentheses that begins a DML statement."""
    words = iter(tokens)
    first = next((t for t in words if t.kind != OPEN), None)
    if first is None or first.kind != WORD:
        return "UNKNOWN"
    if not first.is_word("with"):
        return KIND_OF.get(lower(first.text), "UNKNOWN")
    depth = 0
    for t in words:
        depth += (t.kind == OPEN) - (t.kind == CLOSE)
        if depth == 0 and t.kind == WORD and KIND_OF.get(lower(t.text)) in DML:
            return KIND_OF[lower(t.text)]
    return "UNKNOWN"


def _constant_list(tokens: list[Token], at: int) -> int | None:
    """Where a parenthesised list of constants that opens at ``at`` closes."""
    at += 1
    while True:
        if tokens[at].is_op("-", "+") and tokens[at + 1].kind in LITERALS:
            at += 1
        elif not (tokens[at].kind in LITERALS or tokens[at].kind == PARAM or tokens[at].is_word("null", "true", "false")):
            return None
        at += 1
        if tokens[at].kind == CLOSE:
            return at
        if tokens[at].kind != COMMA:
            return None
        at += 1


def _closing(tokens: list[Token], at: int) -> int:
    """The parenthesis that closes the one at ``at``, or the last token."""
    depth = 0
    for k in range(at, len(tokens) - 1):
        depth += (tokens[k].kind == OPEN) - (tokens[k].kind == CLOSE)
        if depth == 0:
            return k
    return len(tokens) - 2


#: What may be written without a blank before it.
_TIGHT = frozenset((COMMA, CLOSE, DOT, SEMICOLON))


def _normal(t: Token) -> str:
    if t.kind in (WORD, VARIABLE):
        return lower(t.text)
    if t.kind == QUOTED:
        return lower(unquote_name(t.text))
    return "?" if t.kind in LITERALS or t.kind == PARAM else t.text


def fingerprint(sql: str) -> Fingerprint:
    """Text with constants as ``?``, lists of constants and inserted rows folded to ``(?+)``, in canonical spacing."""
    tokens = tokenize(sql)
    kind = statement_kind(tokens)
    last = len(tokens) - 1
    while last > 0 and tokens[last - 1].kind == SEMICOLON:
        last -= 1
    out: list[str] = []
    before, before_word = END, ""
    folding = kind in ("INSERT", "REPLACE")
    at = 0

    def glued(what: str) -> bool:
        if not out or what in _TIGHT or before in (OPEN, DOT):
            return True
        return what == OPEN and (before == QUOTED or (before == WORD and before_word not in OPERATOR_WORDS))

    while at < last:
        t, after = tokens[at], tokens[at + 1]
        if t.is_op("-", "+") and after.kind in LITERALS:
            left = tokens[at - 1] if at else None
            if left is None or left.kind in (OP, OPEN, COMMA) or (left.kind == WORD and lower(left.text) in OPERATOR_WORDS):
                at += 1
                continue
        if folding and after.kind == OPEN and t.is_word("values", "value"):
            at = _closing(tokens, at + 1)
            while at + 2 < len(tokens) - 1 and tokens[at + 1].kind == COMMA and tokens[at + 2].kind == OPEN:
                at = _closing(tokens, at + 2)
            out += ["" if glued(WORD) else " ", "values(?+)"]
            before, folding = CLOSE, False
            at += 1
            continue
        out += ["" if glued(t.kind) else " ", _normal(t)]
        before, before_word = t.kind, lower(t.text) if t.kind == WORD else ""
        at += 1
        if after.kind == OPEN and t.is_word("in") and (end := _constant_list(tokens, at)) is not None:
            out.append("(?+)")
            before, at = CLOSE, end + 1
    text = "".join(out)
    return Fingerprint(text, class_id(text), kind)


_QUOTED_TEXT = re.compile(r"'(?:[^']|'')*+'")
_WHOLE_NUMBER = re.compile(r"(?<![A-Za-z0-9_$.@\u0080-\U0010ffff])[0-9]+(?![A-Za-z0-9_$.\u0080-\U0010ffff])")
_UNSURE = re.compile(r"[#\"`\\]|--|/\*|@'")


#: Quoted texts and names, comments and whole numbers, each read to its end before the next begins.
_PARTS = re.compile(
    r"'(?:[^'\\]|''|\\.)*+'|\"(?:[^\"\\]|\"\"|\\.)*+\"|`(?:[^`]|``)*+`|/\*.*?\*/|--(?=[ \t\n\r\f\v]|\Z)[^\n]*|#[^\n]*|" + _WHOLE_NUMBER.pattern, re.S
)
_LEFT = re.compile(r"[#\"`'\\]|--|/\*")
_RISKY = re.compile(r"/\*[!+]|@['\"`]")


def _emptied(part: re.Match) -> str:
    first = part[0][0]
    return "''" if first == "'" else '""' if first == '"' else part[0] if first == "`" else "0" if first.isdigit() else " "


def skeleton(sql: str) -> str:
    """A text with the same fingerprint that statements of one shape share: texts emptied, whole numbers zeroed.

    Where quotes, escapes or comments do not end, or a comment may be executed, the statement itself is returned.
    """
    if not _UNSURE.search(sql):
        return _WHOLE_NUMBER.sub("0", _QUOTED_TEXT.sub("''", sql))
    if _RISKY.search(sql) or _LEFT.search(_PARTS.sub("", sql)):
        return sql
    return _PARTS.sub(_emptied, sql)
