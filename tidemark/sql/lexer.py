"""Tokens of MySQL statements.  Any text gives tokens; nothing raises."""

from __future__ import annotations

import re
from typing import NamedTuple

WORD, QUOTED, VARIABLE, STRING, NUMBER, HEX, PARAM, OP, END = "word", "quoted", "variable", "string", "number", "hex", "param", "op", "end"
OPEN, CLOSE, COMMA, DOT, SEMICOLON = "(", ")", ",", ".", ";"
LITERALS = frozenset((STRING, NUMBER, HEX))
_FOLD = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """ASCII capitals to small letters; everything else stays."""
    return text.translate(_FOLD)


class Token(NamedTuple):
    kind: str
    text: str
    offset: int

    def is_word(self, *words: str) -> bool:
        return self.kind == WORD and lower(self.text) in words

    def is_op(self, *ops: str) -> bool:
        return self.kind == OP and self.text in ops

    @property
    def is_name(self) -> bool:
        return self.kind in (WORD, QUOTED)


_W = r"A-Za-z0-9_$\u0080-\U0010ffff"
_START = r"A-Za-z_$\u0080-\U0010ffff"
_SINGLE, _DOUBLE, _BACK = r"'(?:[^'\\]|\\.|'')*+(?:'|\\?\Z)", r'"(?:[^"\\]|\\.|"")*+(?:"|\\?\Z)', r"`(?:[^`]|``)*+(?:`|\Z)"
_SCAN = re.compile(
    rf"""(?P<blank>[ \t\n\r\f\v]+|\#[^\n]*|--(?=[\x00-\x20]|\Z)[^\n]*|/\*(?!!)(?:.*?\*/|.*))
    |(?P<opening>/\*![0-9]*)
    |(?P<hex>[xXbB]{_SINGLE}|0[xX][0-9A-Fa-f]+(?![{_W}])|0[bB][01]+(?![{_W}]))
    |(?P<string>[nN]{_SINGLE}|_[{_W}]*+{_SINGLE}|{_SINGLE}|{_DOUBLE})
    |(?P<word>[{_START}][{_W}]*|0[xX][0-9A-Fa-f]+[{_W}]+|0[bB][01]+[{_W}]+|[0-9]+(?![0-9.]|[eE](?:[0-9]|[+-][0-9]))[{_W}]+)
    |(?P<number>[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)
    |(?P<fraction>\.[0-9]+(?:[eE][+-]?[0-9]+)?)
    |(?P<quoted>{_BACK})
    |(?P<variable>@@?(?:{_SINGLE}|{_DOUBLE}|{_BACK}|[{_W}.]*))
    |(?P<param>\?)
    |(?P<mark>[(),.;])
    |(?P<op><=>|->>|<=|>=|<>|!=|\|\||&&|:=|->|<<|>>|.)""",
    re.X | re.S,
)


def tokenize(sql: str) -> list[Token]:
    """All tokens, with one of kind ``end`` at the end."""
    out: list[Token] = []
    at, executable, size = 0, 0, len(sql)
    before = None
    while at < size:
        if executable and sql.startswith("*/", at):
            at, executable = at + 2, executable - 1
            continue
        found = _SCAN.match(sql, at)
        kind = found.lastgroup
        if kind == "blank":
            at = found.end()
            continue
        if kind == "opening":
            at, executable = found.end(), executable + 1
            continue
        text = found[0]
        if kind == "fraction":
            # after a name or a closing parenthesis a point belongs to a qualified name
            kind, text = (DOT, ".") if before in (WORD, QUOTED, CLOSE) else (NUMBER, text)
        elif kind == "mark":
            kind = text
        out.append(Token(kind, text, at))
        before = kind
        at += len(text)
    out.append(Token(END, "", size))
    return out


def unquote_name(text: str) -> str:
    """A name without its backticks."""
    if not text.startswith("`"):
        return text
    body = text[1:-1] if len(text) > 1 and text.endswith("`") else text[1:]
    return body.replace("``", "`")


#: The characters that a backslash makes in MySQL strings; other characters stand for themselves.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def unquote_string(text: str) -> str:
    """The value of a string token; a prefix such as ``N`` or ``_utf8`` is dropped, ``\\%`` and ``\\_`` keep their backslash."""
    start = min((k for k in (text.find("'"), text.find('"')) if k >= 0), default=-1)
    if start < 0:
        return text
    quote = text[start]
    body = text[start + 1 :]
    if body.endswith(quote):
        body = body[:-1]
    return re.sub(rf"\\(.)|{quote}{quote}", lambda m: quote if m[1] is None else m[0] if m[1] in "%_" else ESCAPES.get(m[1], m[1]), body, flags=re.S)
