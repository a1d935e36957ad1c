"""Counts, exact sums, rates and rounding."""

from __future__ import annotations

_SPLIT_BITS = 20
_LOW_MASK = (1 << _SPLIT_BITS) - 1


def tally(condition: str) -> str:
    """Rows for which the condition holds (NULL for no rows at all, as in SQL)."""
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def whole_div(a: str, b: str) -> str:
    return f"(({a}) div nullif({b}, 0))"


def ratio(part: str, whole: str, digits: int) -> str:
    """part / whole rounded to ``digits``, halves away from zero; NULL if whole is 0.

    Done in whole numbers, so the last digit does not depend on floating point.
    """
    scale = 10**digits
    size = f"((abs({part}) * {2 * scale} + {whole}) div nullif(({whole}) * 2, 0)) / {scale}.0D"
    return f"(CASE WHEN ({part}) < 0 THEN -1 ELSE 1 END * ({size}))"


def pct(part: str, whole: str) -> str:
    """100 * part / whole with two decimals."""
    return ratio(f"(({part}) * 100)", whole, 2)


def split_sum(value: str, name: str, digits: int) -> dict[str, str]:
    """Two BIGINT sums of the value in whole units, and a double sum of what is left.

    A decimal sum costs about twelve times as much as a double sum and a single
    BIGINT sum overflows at this scale; a double sum depends on row order. The
    rest is exactly 0 for values of at most ``digits`` decimals, so their sum is
    exact and free of order; smaller parts and values beyond the BIGINT range, NaN
    and infinities included, go into the rest as a whole. ``joined`` adds the three.
    """
    scaled = f"({value} * {10**digits}.0D)"
    units = f"(CASE WHEN abs({scaled}) >= 9.0E18D THEN 0L ELSE CAST(rint({scaled}) AS BIGINT) END)"
    return {
        f"{name}_hi": f"sum(shiftright({units}, {_SPLIT_BITS}))",
        f"{name}_lo": f"sum({units} & {_LOW_MASK}L)",
        f"{name}_rest": f"sum({value} - CAST({units} AS DOUBLE) / {10**digits}.0D)",
    }


def joined(name: str, digits: int) -> str:
    return (f"((CAST({name}_hi AS DOUBLE) * {1 << _SPLIT_BITS}.0D"
            f" + CAST({name}_lo AS DOUBLE)) / {10**digits}.0D + {name}_rest)")


def joined_mean(name: str, digits: int, count: str, places: int) -> str:
    """Sum held in parts divided by a count; rounded in whole numbers unless there is a rest."""
    units = (f"CAST(CAST({name}_hi AS DECIMAL(38, 0)) * {1 << _SPLIT_BITS} + {name}_lo"
             " AS DECIMAL(38, 0))")
    whole = ratio(units, f"CAST({count} * {10**digits}L AS DECIMAL(38, 0))", places)
    return (f"(CASE WHEN {name}_rest = 0 THEN {whole}"
            f" ELSE {rounded(mean(joined(name, digits), count), places)} END)")


def mean(total: str, count: str) -> str:
    return f"({total} / nullif({count}, 0))"


def rounded(value: str, places: int = 2) -> str:
    return f"round({value}, {places})"
