"""Numbers and texts for people."""

from __future__ import annotations

import math
import re


def format_duration(seconds: float) -> str:
    if not math.isfinite(seconds) or seconds < 0:
        return "-"
    for below, scale, spec in ((1e-3, 1e6, "{:.0f} µs"), (0.1, 1e3, "{:.1f} ms"), (1.0, 1e3, "{:.0f} ms"), (10.0, 1, "{:.2f} s"), (60.0, 1, "{:.1f} s")):
        if seconds < below:
            return spec.format(seconds * scale)
    whole = math.floor(seconds + 0.5)
    for below, big, small, names in ((3600, 60, 1, "ms"), (86400, 3600, 60, "hm"), (math.inf, 86400, 3600, "dh")):
        if whole < below:
            return f"{whole // big}{names[0]} {whole % big // small:02d}{names[1]}"
    raise AssertionError


def format_count(n: int) -> str:
    return f"{n:,}"


def format_compact(n: float) -> str:
    if not math.isfinite(n):
        return "-"
    if n < 1000:
        return f"{n:.1f}" if n < 10 and n != math.floor(n) else f"{n:.0f}"
    for suffix in "kMBT":
        n /= 1000
        if n < 1000 or suffix == "T":
            return f"{n:.1f}{suffix}" if n < 100 else f"{n:.0f}{suffix}"
    raise AssertionError


def format_bytes(n: int) -> str:
    value, unit = float(n), 0
    while value >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    return f"{n} B" if unit == 0 else f"{value:.1f} {('KB', 'MB', 'GB', 'TB')[unit - 1]}"


def abbreviate(text: str, limit: int = 0) -> str:
    """On one line, and cut to ``limit`` characters with an ellipsis if that is not 0."""
    text = re.sub(r"[ \t\n\r\f\v]+", " ", text.strip(" \t\n\r\f\v"))
    return text if limit == 0 or len(text) <= limit else text[: limit - 1].rstrip(" ") + "…"


#: Clauses that begin a line in laid-out SQL.
_CLAUSES = r"(?i)\s+(?=(?:from|where|group by|having|order by|limit|union(?: all)?|(?:left |right |inner |cross )?join|set|values|on duplicate key)\b)"


def pretty_sql(sql: str) -> str:
    """One clause a line; texts in quotes are left alone."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*'|`[^`]*`|\"(?:[^\"\\]|\\.)*\")", sql.strip())
    return "".join(p if k % 2 else re.sub(_CLAUSES, "\n", p) for k, p in enumerate(parts))


def fix_parts(suggestion: str) -> list[tuple[str, str]]:
    """A suggestion's lines as ("sql" or "text", line)."""
    starts = ("ALTER TABLE", "SELECT ", "NOT EXISTS", "... WHERE", "CREATE ")
    return [("sql" if line.startswith(starts) else "text", line) for line in suggestion.split("\n") if line]
