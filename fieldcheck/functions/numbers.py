"""Number parsing, rounding and digit expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from fieldcheck.constants import INTEGER_TOLERANCE

# Order bins per e-fold of magnitude, see order_bin.
_BINS_PER_EFOLD = 16384
_BIN_OFFSET = _BINS_PER_EFOLD * 800


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def parse_strip(x: Column | str) -> Column:
    """Keep digits, comma, dot and minus; read comma as dot; NULL when that is no number."""
    kept = F.regexp_replace(as_col(x).cast("string"), r"[^0-9,.\-]", "")
    return F.translate(kept, ",", ".").try_cast("double")


def parse_first_number(x: Column | str, comma_decimal: bool = True) -> Column:
    """First number in the text; commas inside it are grouping marks.

    With ``comma_decimal`` a comma counts as decimal sign when the text holds no dot.
    """
    text = as_col(x).cast("string")
    if comma_decimal:
        text = F.when(F.contains(text, F.lit(".")), text).otherwise(F.translate(text, ",", "."))
    number = F.regexp_substr(text, F.lit(r"-?(\d[\d,]*\.?\d*|\.\d+)"))
    return F.translate(number, ",", "").try_cast("double")


def number_of(x: Column | str, dtype: T.DataType, parser=parse_strip) -> Column:
    """The value as double: a cast for numeric columns, ``parser`` for all others."""
    return as_col(x).cast("double") if is_numeric_type(dtype) else parser(x)


def is_finite(x: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    x = as_col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def r_round(x: Column | str, digits: int) -> Column:
    """Round to the nearer of the two neighbours with ``digits`` decimals, ties to even.

    Unlike ``round`` this is plain double arithmetic, so every engine gets the same bits.
    """
    x = as_col(x).cast("double")
    p = F.lit(float(10**digits))
    down = F.floor(x * p).cast("double")
    lo, hi = down / p, F.ceil(x * p).cast("double") / p
    even = (down % F.lit(2.0)) == 0.0
    down_is_nearer = ((x - lo) < (hi - x)) | (((x - lo) == (hi - x)) & even)
    # Beyond 1e15 a double holds no such decimals.
    return (
        F.when(F.abs(x * p) >= F.lit(1e15), x).when(down_is_nearer, lo).otherwise(hi)
    )


def bind(x: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often ``use`` names it.

    For result tables: it keeps nested formulas from multiplying in the plan. In the scan of
    raw rows generated code is faster, which lambdas are not part of.
    """
    return F.transform(F.array(as_col(x)), use)[0]


def round2(x: Column | str) -> Column:
    """Two-step rounding for quantiles: 6 digits remove the last-bit noise, then 2."""
    return bind(bind(x, lambda v: r_round(v, 6)), lambda v: r_round(v, 2))


def is_integerish(x: Column | str, tol: float = INTEGER_TOLERANCE) -> Column:
    """Finite and within ``tol`` of an integer (NaN and infinities compare false)."""
    x = as_col(x)
    return F.abs(x - F.rint(x)) < F.lit(tol)


def last_digit(x: Column | str) -> Column:
    """Last digit before the decimal sign of an integer-like value, else NULL."""
    x = as_col(x)
    return F.when(is_integerish(x), F.floor(F.abs(x) % F.lit(10.0)).cast("bigint"))


def last_tenth(x: Column | str) -> Column:
    """First decimal of a non-integer value, rounded: 0.0 to 1.0; else NULL."""
    x = as_col(x)
    frac = x - F.floor(x).cast("double")
    return F.when(is_finite(x) & ~is_integerish(x), r_round(frac, 1))


def fmt_pct(share: Column | str) -> Column:
    """``0.1234`` → ``12.3%``."""
    return fmt_pct_value(as_col(share) * F.lit(100.0))


def fmt_pct_value(pct: Column | str) -> Column:
    """``12.34`` → ``12.3%``."""
    return bind(pct, lambda v: F.format_string("%.1f%%", r_round(v, 1)))


def fmt_share_label(pct: Column | str, num: Column | str, den: Column | str) -> Column:
    """``53.33% (8/15)`` from an already rounded percent; ``-`` without one."""
    text = F.format_string("%.2f%% (%d/%d)", as_col(pct), as_col(num), as_col(den))
    return F.when(as_col(pct).isNull(), F.lit("-")).otherwise(text)


def order_bin(x: Column | str) -> Column:
    """A bigint that never decreases with the (finite) value.

    Logarithmic in magnitude, so no look at the data is needed to place a value, and a bin
    spans about 0.006 % of the value whatever the range of the data is.
    """
    x = as_col(x)
    size = F.floor(F.ln(F.abs(x)) * F.lit(float(_BINS_PER_EFOLD))) + F.lit(_BIN_OFFSET)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("bigint")
