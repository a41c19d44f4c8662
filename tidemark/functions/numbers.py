"""Number handling: rounding, canonical text, parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as K


def half_up(c: Column | str, digits: int) -> Column:
    """Round half up at ``digits``, after dropping binary noise below 1e-10.

    Doubles of 1e27 and more have no such digits and stay as they are;
    non-finite values are null.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = c.cast("double")
    large = (F.abs(plain) >= 1e27) & (F.abs(plain) < float("inf"))
    return F.when(large, plain).otherwise(F.round(c.try_cast("decimal(38,10)"), digits).cast("double"))


def exact(c: Column | str, scale: int = 8, whole: int = 14) -> Column:
    """Exact decimal with ``whole`` digits before the point; values beyond are null.

    The product of two stays exact while their digits add up to 37 at most.
    A caller must say so where a value is there and its exact form is not:
    see ``out_of_range``.
    """
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast(f"decimal({whole + scale},{scale})")


def out_of_range(result: Column, *inputs: Column | str) -> Column:
    """True where every input has a value and the result computed from them has none."""
    return result.isNull() & all_of(*[(F.col(c) if isinstance(c, str) else c).isNotNull() for c in inputs])


def parse_number(c: Column, kind: str = "double") -> Column:
    """Number from a landed cell: separators dropped, placeholders become null."""
    text = F.trim(F.translate(c, ",", ""))
    return F.when(~text.isin(*K.MISSING_NUMBERS), text).try_cast(kind)


def canonical_decimal(c: Column | str) -> Column:
    """Exponent-free text of all digits without trailing zeros; zero is ``0``.

    Doubles are written with the digits of their text form in Spark;
    non-finite ones by their names.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")

    def trimmed(t: Column) -> Column:
        bare = F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0*$", "")).otherwise(t)
        return F.when(bare.rlike("^-?0?$"), F.lit("0")).otherwise(bare)

    def spread(t: Column) -> Column:
        """The digits of 1.25E-7 with zeros on the side to which the point moves, and the point in its place."""
        parts = F.struct(
            F.regexp_extract(t, r"^(-?)", 1).alias("sign"),
            F.regexp_extract(t, r"^-?(\d+)", 1).alias("whole"),
            F.regexp_extract(t, r"\.(\d*)", 1).alias("rest"),
            F.regexp_extract(t, r"E(-?\d+)$", 1).cast("int").alias("shift"),
        )

        def placed(p: Column) -> Column:
            front, back = F.greatest(-p.shift, F.lit(0)), F.greatest(p.shift - F.length(p.rest), F.lit(0))
            digits = F.concat(F.repeat(F.lit("0"), front), p.whole, p.rest, F.repeat(F.lit("0"), back))
            point = F.length(p.whole) + front + p.shift
            return F.concat(p.sign, F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))

        return trimmed(F.regexp_replace(F.transform(F.array(parts), placed)[0], r"^(-?)0+(?=\d)", "$1"))

    return F.when(text.rlike(r"E-?\d+$"), spread(text)).when(text.rlike(r"\d$"), trimmed(text)).otherwise(text)


def yield_to_ratio(value: Column, unit: Column) -> Column:
    """Percent is divided by 100, ratio kept; any other unit gives null."""
    return F.when(unit == "percent", value / 100.0).when(unit == "ratio", value)


def normalize_twd(value: Column, unit: Column) -> Column:
    """Positive finite amount in TWD; unknown units and bad values give null."""
    factors = F.create_map(*[F.lit(x) for pair in K.TWD_UNITS.items() for x in pair])
    ok = (value > 0) & ~F.isnan(value) & (value < float("inf"))
    return F.when(ok, value * F.try_element_at(factors, unit))


def point_to_range(low: Column, high: Column, tolerance: str, scale: int = 4) -> tuple[Column, Column]:
    """Widen a point to a range by the tolerance; both ends rounded half up."""
    tol = F.lit(tolerance).cast("decimal(9,6)")
    one = F.lit("1").cast("decimal(9,6)")
    point = low == high
    return (
        F.round(F.when(point, low * (one - tol)).otherwise(low), scale),
        F.round(F.when(point, high * (one + tol)).otherwise(high), scale),
    )


def first_reason(*cases: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in cases])


def all_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a & b, flags)
