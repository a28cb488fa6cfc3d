"""Declared rules compiled to Spark expressions: clauses, predicates, exclusions, impacts, messages.

A rule is data. Compiling it gives Column expressions that Catalyst optimises with the rest
of the plan; nothing is executed row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarraf.functions.periods import month_index, period_of_index
from sarraf.operators.windows import collapse_runs

_CLAUSE = re.compile(r"^\s*(\w+(?:\.\w+)*)\s*(==|!=|>=|<=|>|<|not\s+in|in)\s*(.+?)\s*$")
_FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def clause(text: str, columns: list[str] = ()) -> Column:
    """`<field> <op> <literal>` as a Column that is false, never null, where the field is null.

    A dotted field is the column of that name where `columns` has one, else a field of a
    struct. No field equals the literal `null`, every field that has a value differs from it,
    and nothing can be ordered against it. `in` and `not in` need a list.
    """
    found = _CLAUSE.match(text)
    if not found:
        raise ValueError(f"not a clause: {text!r}")
    name, op, literal = found.groups()
    c = F.col(f"`{name}`" if name in columns else name)
    if op.endswith("in"):
        if literal[0] not in "[(" or literal[-1] not in "])":
            raise ValueError(f"{op} needs a list: {text!r}")
        hit = c.isin(*[_literal(x.strip()) for x in literal.strip("[]() ").split(",") if x.strip()])
        test = ~hit if op.startswith("not") else hit
    elif literal == "null":
        if op not in ("==", "!="):
            raise ValueError(f"null has no order: {text!r}")
        test = c.isNotNull() & F.lit(op == "!=")
    else:
        value = _literal(literal)
        test = {"==": c == value, "!=": c != value, ">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value}[op]
    return F.coalesce(test, F.lit(False))


def _literal(text: str):
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def all_of(clauses: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [clause(c) for c in clauses], F.lit(True))


def failing(clauses: list[str]) -> Column:
    """The clauses a row does not satisfy, as an array of their texts."""
    return F.filter(F.array(*[F.when(~clause(c), c) for c in clauses]), lambda c: c.isNotNull())


def message(template: str) -> Column:
    """A template with {field} and {field:,.0f} as a Column; null reads `not recorded`."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        name, shape = m.groups()
        decimals = re.fullmatch(r",\.(\d)f", shape or "")
        text = F.format_number(F.col(name).cast("double"), int(decimals[1])) if decimals else F.col(name).cast("string")
        parts.append(F.coalesce(text, F.lit("not recorded")))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


@dataclass
class Rule:
    """One rule: SQL texts of a predicate, an exclusion, an impact and a severity."""

    code: str
    predicate: str
    impact: str = "0"
    severity: str = "'MEDIUM'"
    exclusion: str | None = None
    template: str = ""
    evidence: list[str] = field(default_factory=list)

    def validate(self, rows: DataFrame) -> None:
        """Bind every text against the columns; runs no job, raises on the first that does not resolve."""
        if not re.fullmatch(r"[A-Z]\w*", self.code):
            raise ValueError(f"bad code {self.code!r}")
        tests = [F.expr(x) for x in (self.predicate, self.impact, self.severity, self.exclusion) if x]
        _ = rows.select(*tests, *[F.col(e) for e in self.evidence]).schema

    def holds(self) -> Column:
        """Whether a row satisfies the predicate and is not excluded; unknown excludes nothing."""
        kept = F.expr(self.predicate)
        return kept & ~F.coalesce(F.expr(self.exclusion), F.lit(False)) if self.exclusion else kept

    def hits(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.holds())


def run_rules(rules: list[Rule], rows: DataFrame, key: str, period: str) -> DataFrame:
    """Windows of consecutive months in which each rule holds, with impact and the last month's severity and message.

    Every row is tagged with all the rules it meets in one pass; months and windows of all
    rules are then found together, in one aggregation and one window over (key, code).
    """
    for rule in rules:
        rule.validate(rows)
    text = lambda r: message(r.template) if r.template else F.lit(None).cast("string")
    tags = [F.when(r.holds(), F.struct(F.lit(r.code).alias("code"), F.expr(r.impact).cast("double").alias("impact"), F.expr(r.severity).cast("string").alias("severity"), text(r).alias("description"))) for r in rules]
    found = rows.select(F.col(key), month_index(period).alias("_m"), F.inline(F.array_compact(F.array(*tags))))
    one = found.groupBy(key, "code", "_m").agg(F.sum("impact").alias("impact"), F.max(F.struct("severity", "description")).alias("_e"))
    one = one.select(key, "code", "_m", "impact", F.col("impact").alias("monthly"), "_e.*")
    runs = collapse_runs(one, [key, "code"], "_m", ["impact"], ["monthly", "severity", "description"])
    shaped = runs.withColumns({"period_from": period_of_index("first_step"), "period_to": period_of_index("last_step")})
    return shaped.select(key, "code", "severity", "period_from", "period_to", F.col("steps").alias("months"), "monthly", F.col("impact").alias("cumulative"), "description")


def what_if(rows: DataFrame, key: str, value, overrides: dict[str, object]) -> DataFrame:
    """The rows of one key with some columns set to literals, in the types of those columns.

    Overrides are values, never expressions, so nothing given by a user is parsed as SQL.
    """
    unknown = set(overrides) - set(rows.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    one = rows.where(F.col(key) == F.lit(value))
    return one.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in overrides.items()}) if overrides else one
