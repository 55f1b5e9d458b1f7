"""Whole-text extraction as SQL expressions (no Python per row)."""

from __future__ import annotations

import re

#: Separates captured groups while they travel as one string.
GROUP_SEPARATOR = "\u0001"

_POSIX_CLASSES = {
    "[:digit:]": "0-9",
    "[:blank:]": r" \t",
    "[:space:]": r"\s",
    "[:alpha:]": "a-zA-Z",
    "[:alnum:]": "a-zA-Z0-9",
    "[:upper:]": "A-Z",
    "[:lower:]": "a-z",
    "[:xdigit:]": "0-9A-Fa-f",
}


def from_posix(pattern: str) -> str:
    """A POSIX extended pattern as Java accepts it (classes are rewritten)."""
    for posix, java in _POSIX_CLASSES.items():
        pattern = pattern.replace(posix, java)
    return pattern


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The functions below take and give SQL expression text.  A catalog has hundreds
# of layouts; written as text, each becomes one expression in one call.


def all_groups(pattern: str) -> str:
    """Replacement that leaves the groups of a match, with a separator between them."""
    return GROUP_SEPARATOR.join(f"${i}" for i in range(1, group_count(pattern) + 1))


def captured(text: str, pattern: str, groups: str) -> str:
    """All groups of one match, read in a single pass over the text; ``groups`` comes from ``all_groups``.

    The text must match as a whole; group ``i`` is element ``i - 1``.
    """
    return f"split(regexp_replace({text}, {pattern}, {groups}), {literal(GROUP_SEPARATOR)})"


def records(text: str, pattern: str) -> str:
    """Every match of a record or line pattern, in order of appearance."""
    return f"regexp_extract_all({text}, {pattern}, 0)"


# Patterns of parts of a text.


def between(start: str, end: str, occurrence: int = 1) -> str:
    """Text after the n-th literal ``start`` up to ``end`` (or to the end), as group 1."""
    skip = f"(?:{quoted(start)}.*?){{{occurrence - 1}}}" if occurrence > 1 else ""
    body = r"(.*?)" if end else "(.*)"
    stop = rf"(?:{quoted(end)}|\z)" if end else ""
    return f"(?s){skip}{quoted(start)}{body}{stop}"


def section(header: str) -> str:
    """A header line and the lines below it up to the first blank line."""
    return rf"(?ms)^{header}[^\n]*\n.*?(?=\n\n|\z)"


def run_of_lines(header: str, line: str) -> str:
    """A header line and the lines right below it that start with ``line``."""
    return rf"(?ms)^{header}[^\n]*\n.*?(?=^(?!{line})|\z)"


def number(text: str) -> str:
    """Integer part of an unsigned number as a double; 20 digits, so counters stay whole.

    Text that starts with anything but a digit, such as a sign, is no number.
    """
    return f"CAST(try_cast(regexp_extract(trim({text}), '^[0-9]+', 0) AS decimal(20,0)) AS double)"


def quoted(literal: str) -> str:
    """The literal with every character that is special in a regex escaped."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)
