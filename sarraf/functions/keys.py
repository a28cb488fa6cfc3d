"""Normal forms of identifiers and their check digits, all as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic-Indic and Eastern Arabic-Indic digits and the ASCII digits they stand for.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

_EDGES = r"^[\s ]+|[\s ]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without blanks (any white space) at either end."""
    return F.regexp_replace(_col(c), _EDGES, "")


def norm_id(c: Column | str) -> Column:
    """Upper case without surrounding blanks; an empty id is null."""
    value = F.upper(trimmed(c))
    return F.when(value != "", value)


def norm_word(c: Column | str) -> Column:
    """Lower case without surrounding blanks; an empty word is null."""
    value = F.lower(trimmed(c))
    return F.when(value != "", value)


def bare_code(c: Column | str) -> Column:
    """Without blanks and hyphens, upper case, digits in ASCII script; empty is null."""
    value = F.upper(F.translate(_col(c), OTHER_DIGITS, ASCII_DIGITS))
    value = F.regexp_replace(value, r"[\s \-‐-―]+", "")
    return F.when(value != "", value)


def _digit(c: Column, at: int) -> Column:
    return F.ascii(F.substring(c, at, 1)) - F.lit(48)


def national_id_ok(bare: Column | str) -> Column:
    """Ten ASCII digits starting with 1 whose last digit is the check digit.

    The check digit complements, to a multiple of ten, the sum of the nine digits
    before it, of which those in odd places count double with their own digits added.
    """
    c = _col(bare)
    total = F.lit(0)
    for at in range(1, 10):
        digit = _digit(c, at)
        if at % 2:
            digit = digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0))
        total = total + digit
    check = (F.lit(10) - total % 10) % 10
    return F.coalesce(F.when(c.rlike("^1[0-9]{9}$"), check == _digit(c, 10)), F.lit(False))


def iban_ok(bare: Column | str) -> Column:
    """The MOD-97 check of ISO 13616 over an upper-case IBAN without blanks."""
    c = _col(bare)
    moved = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char).cast("long")
        digit = (rest * 10 + code - 48) % 97
        letter = (rest * 100 + code - 55) % 97
        return F.when(char == "", rest).when(code < 58, digit).otherwise(letter)

    shape = c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}$")
    return F.coalesce(F.when(shape, F.aggregate(F.split(moved, ""), F.lit(0).cast("long"), step) == 1), F.lit(False))
