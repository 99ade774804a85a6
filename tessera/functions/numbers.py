"""Numbers as people write them in sheets, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, col, rest_after, trimmed, without_end


def to_number(c: Column | str) -> Column:
    """'$1,200' and '(12.50)' as numbers; a percent sign is dropped; anything else is null.

    The signs are taken off one by one, from both ends inwards; what is left
    must be digits with at most one point.  Each step is bound once, so that
    the expression grows with the number of steps.
    """

    def inside(cell: Column) -> Column:
        opened = F.startswith(cell, F.lit("("))
        return bound(without_end(rest_after(cell, "("), "%"), lambda x: in_brackets(x, opened))

    def in_brackets(x: Column, opened: Column) -> Column:
        closed = F.endswith(x, F.lit(")"))
        return bound(trimmed(without_end(x, ")")), lambda bare: signed(bare, opened, closed))

    def signed(bare: Column, opened: Column, closed: Column) -> Column:
        value = bound(trimmed(rest_after(rest_after(bare, "-"), "$")), lambda x: F.when(closed | ~opened, plain(x)))
        return bound(value, lambda v: F.when(opened | F.startswith(bare, F.lit("-")), -v).otherwise(v))

    def plain(digits: Column) -> Column:
        ends_well = F.translate(F.right(digits, F.lit(1)), "0123456789", "") == ""
        whole_behind = ~F.contains(digits, F.lit(".")) | ~F.contains(F.substring_index(digits, ".", -1), F.lit(","))
        good = (F.translate(digits, "0123456789,.", "") == "") & ends_well & whole_behind
        return F.when(good, F.nullif(F.replace(digits, F.lit(","), F.lit("")), F.lit("")).try_cast("double"))

    return bound(trimmed(col(c).cast("string")), inside)


def round_half_up(c: Column | str, places: int = 2) -> Column:
    """Halves go towards plus infinity, unlike SQL's round."""
    scale = float(10**places)
    return F.floor(col(c) * scale + 0.5) / scale
