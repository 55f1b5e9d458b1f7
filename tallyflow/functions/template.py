"""``${kind:name}`` templates compiled to one SQL string expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from tallyflow.functions.text import literal

_VARIABLE = re.compile(r"\$\{([a-z_]+):([A-Za-z0-9_]+)\}")

#: kind -> (name -> SQL expression)
Environment = Mapping[str, Callable[[str], str]]

NO_TAGS = "CAST(map() AS map<string,string>)"


def variables(template: str) -> list[tuple[str, str]]:
    return _VARIABLE.findall(template)


def render(template: str, env: Environment) -> str:
    """Concatenate the literal pieces and the columns a template names."""
    pieces: list[str] = []
    at = 0
    for match in _VARIABLE.finditer(template):
        if match.start() > at:
            pieces.append(literal(template[at : match.start()]))
        kind, name = match.groups()
        if kind not in env:
            raise ValueError(f"unknown variable ${{{kind}:{name}}}")
        pieces.append(f"coalesce({env[kind](name)}, '')")
        at = match.end()
    if at < len(template):
        pieces.append(literal(template[at:]))
    if not pieces:
        return "''"
    return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"


def render_tags(template: str, env: Environment, *, optional: bool = False) -> str:
    """A ``k=v k=v`` template as a map; keys are fixed when the plan is made.

    With ``optional`` a tag whose value is empty is left out.
    """
    pairs = [] if template.strip() in ("", "NA") else template.split()
    if not pairs:
        return NO_TAGS
    entries: list[str] = []
    for pair in pairs:
        key, value = pair.split("=", 1)
        entries += [literal(key), render(value, env)]
    made = f"map({', '.join(entries)})"
    return f"map_filter({made}, (k, v) -> v != '')" if optional else made
