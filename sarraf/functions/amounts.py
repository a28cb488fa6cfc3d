"""Amounts by declared kind as Column expressions: fixed, share of a base, by a table of levels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONEY = "decimal(14,2)"


def _money(value) -> Column:
    return F.lit(Decimal(str(value))).cast(_MONEY)


def expected_amount(kind: str, *, amount=None, share=None, base: Column | None = None, level: Column | None = None, table: dict | None = None, count: Column | None = None, most=None) -> Column:
    """The amount that a declaration gives a row, in cents rounded half up; null where its input is null, 0 for a level without entry.

    `fixed`: `amount`, times `count` (at most `most` of them) if there is one. `share_of_base`:
    `share` of `base`, at most `most`. `by_level`: the entry of `table` for `level`.
    """
    if kind == "fixed":
        if count is None:
            return _money(amount)
        heads = F.least(count.cast("int"), F.lit(2**31 - 1 if most is None else most))
        return F.when(count.isNotNull(), (_money(amount) * heads).cast(_MONEY))
    if kind == "share_of_base":
        part = F.round(base.cast(_MONEY) * F.lit(Decimal(str(share))), 2).cast(_MONEY)
        return part if most is None else F.when(part.isNotNull(), F.least(part, _money(most)))
    if kind == "by_level":
        entry = F.lit(None).cast(_MONEY)
        for key, value in (table or {}).items():
            entry = F.when(level == key, _money(value)).otherwise(entry)
        return F.when(level.isNotNull(), F.coalesce(entry, _money(0)))
    raise ValueError(f"no such kind of amount: {kind}")
