"""Values at and beyond the limits of exact decimals: nothing becomes null in silence."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions import numbers as nb
from tidemark.operators import valuation as val


def one(spark, values, fn, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows(df.select("i", fn(F.col("v")).alias("o")), "i")]


def plain(x):
    d = Decimal(repr(x))
    return format(d.normalize(), "f") if d else "0"


def test_canonical_decimal_keeps_all_digits(spark):
    values = [3e-11, 1.5, -0.0, 0.0, 100.0, -2.5e-7, 1e28, 123456789.125, 1.7976931348623157e308, 0.1 + 0.2, -1e16, 12345678901234567.0, 1e21, 9.5e-5]
    assert one(spark, values, nb.canonical_decimal, "double") == [plain(v) for v in values]
    assert one(spark, [float("nan"), float("inf"), None], nb.canonical_decimal, "double") == ["NaN", "Infinity", None]
    assert one(spark, [Decimal("0.0000000000001"), Decimal("-1.50"), Decimal("0E-13")], nb.canonical_decimal, "decimal(38,13)") == ["0.0000000000001", "-1.5", "0"]
    assert one(spark, [7, -10, 0], nb.canonical_decimal, "long") == ["7", "-10", "0"]


def test_half_up_of_large_values(spark):
    assert one(spark, [1e28, -3e300, 1e27, float("inf"), float("nan"), None], lambda c: nb.half_up(c, 2), "double") == [1e28, -3e300, 1e27, None, None, None]


def test_matrix_has_no_available_cell_without_a_price(spark):
    eps = spark.createDataFrame([("A", 1, 2020, 2e14, 1.0, -1.0)], "symbol string, id long, fiscal_year int, eps_low double, eps_base double, eps_high double")
    pe = spark.createDataFrame([("A", "p", "base", 10.0), ("A", "q", "none", None)], "symbol string, pe_id string, label string, pe_value double")
    got = {(r.eps_scenario, r.pe_id): (r.status, r.target_price) for r in val.eps_pe_matrix(eps, pe).collect()}
    assert got == {
        ("low", "p"): ("value_out_of_range", None),
        ("base", "p"): ("available", 10.0),
        ("high", "p"): ("not_applicable", None),
        ("low", "q"): ("insufficient_data", None),
        ("base", "q"): ("insufficient_data", None),
        ("high", "q"): ("not_applicable", None),
    }


def test_eva_floor_to_two_digits(spark):
    cases = [(7e9, 5e9, 3.0, 0.08), (100.0, 2000.0, 7.0, 0.07), (-50.0, 10.0, 3.0, 0.05), (1e300, 1.0, 1.0, 0.07), (1.0, None, 1.0, 0.07), (1.0, 1.0, 0.0, 0.07), (1.0, 1.0, 2.0, 0.0), (0.25, 0.5, 1.5, 0.333333)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, nopat double, invested_capital double, shares double, wacc double")
    got = {r.id: r for r in val.eva_floor(df).collect()}
    for i, (nopat, capital, shares, wacc) in enumerate(cases):
        if i == 3:
            assert (got[i].status, got[i].eva_floor_price) == ("value_out_of_range", None)
        elif i == 4:
            assert (got[i].status, got[i].eva_floor_price) == ("insufficient_data", None)
        elif not (shares > 0 and wacc > 0):
            assert (got[i].status, got[i].eva, got[i].eva_floor_price) == ("not_applicable", None, None)
        else:
            a, b, s, w = (Decimal(repr(x)) for x in (nopat, capital, shares, wacc))
            eva = (a - b * w).quantize(Decimal("0.01"), ROUND_HALF_UP)
            price = ((b + eva / w) / s).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert (got[i].status, got[i].eva, got[i].eva_floor_price) == ("available", float(eva), float(price))
