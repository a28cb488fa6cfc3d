"""SQL texts with named places: filled in or refused, cut into statements, tables to be made told apart."""

from __future__ import annotations

import re

_PLACE = re.compile(r"\$(\w+|\{\w+\})")
_MAKES = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?temp(?:orary)?\s+(?:table|view)\s+(\w+)\s+as\s+(.*)$", re.IGNORECASE | re.DOTALL)
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|;|[^'\"\-/;]+|.", re.DOTALL)


def render(text: str, values: dict[str, str]) -> str:
    """`text` with every $name replaced; a name without a value, or a value without a place, is an error."""
    names = {m.strip("{}") for m in _PLACE.findall(text)}
    if names != set(values):
        raise KeyError(f"without value: {sorted(names - set(values))}, without place: {sorted(set(values) - names)}")
    return _PLACE.sub(lambda m: values[m[1].strip("{}")], text)


def statements(text: str) -> list[str]:
    """The statements of a script, without comments; a semicolon in quotes or comments ends none."""
    found, now = [], ""
    for token in _TOKEN.findall(text):
        if token == ";":
            found.append(now.strip())
            now = ""
        elif not token.startswith(("--", "/*")):
            now += token
    return [s for s in [*found, now.strip()] if s]


def split_create(statement: str) -> tuple[str | None, str]:
    """(name, query) of a statement that makes a temporary table, (None, statement) of any other."""
    made = _MAKES.match(statement)
    return (made[1], made[2].strip()) if made else (None, statement)


def run_script(spark, text: str, values: dict[str, str]):
    """Run a script: tables to be made become lazy temporary views; the frame of the last query is returned."""
    last = None
    for statement in statements(render(text, values)):
        name, query = split_create(statement)
        last = spark.sql(query)
        if name:
            last.createOrReplaceTempView(name)
    return last
