"""Normalisation of landed text: symbols, dates, clocks, lists, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as K


def normalize_symbol(c: Column) -> Column:
    """Upper-case, index aliases to the benchmark, market suffix where none is given."""
    s = F.upper(F.trim(c))
    return (
        F.when(s.isin("0000", "TAIEX"), F.lit(K.BENCHMARK_SYMBOL))
        .when(s.startswith("^") | s.endswith(".TW") | s.endswith(".TWO"), s)
        .otherwise(F.concat(s, F.lit(".TW")))
    )


def cost_model(c: Column) -> Column:
    """Sales tax, lot size and instrument type of a symbol, with the common rates."""
    s = normalize_symbol(c)
    index, fund = s.startswith("^"), s.startswith("00")
    return F.struct(
        F.when(index | fund, F.lit(K.FUND_TAX_RATE)).otherwise(F.lit(K.STOCK_TAX_RATE)).alias("sales_tax_rate"),
        F.when(index, F.lit(1)).otherwise(F.lit(K.BOARD_LOT)).alias("lot_size"),
        F.when(index, "index_etf_proxy").when(fund, "equity_etf").otherwise("stock").alias("instrument_type"),
        F.lit(K.COMMISSION_RATE).alias("commission_rate"),
        F.lit(K.SLIPPAGE_RATE).alias("slippage_rate"),
    )


def parse_minguo_date(c: Column) -> Column:
    """Dates in republic years (with slashes, dots, CJK marks, or seven digits) and ISO dates.

    Years of at most three digits count from 1911.  Unreadable text gives null.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(c), "[年月./-]", "/"), "日", "")
    text = F.when(text.rlike("^\\d{7}$"), F.regexp_replace(text, "^(\\d{3})(\\d{2})(\\d{2})$", "$1/$2/$3")).otherwise(text)
    shape = "^(\\d{1,4})/(\\d{1,2})/(\\d{1,2})$"
    ok = text.rlike(shape)
    part = [F.regexp_extract(text, shape, i).try_cast("int") for i in (1, 2, 3)]
    year = F.when(part[0] < 1911, part[0] + 1911).otherwise(part[0])
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part[1].cast("string"), 2, "0"), F.lpad(part[2].cast("string"), 2, "0"))
    return F.when(ok, iso.try_cast("date"))


def parse_month_period(c: Column) -> Column:
    """Month end of a ``2026M05`` period."""
    shape = "^(\\d{4})M(\\d{1,2})$"
    text = F.trim(c)
    iso = F.concat(F.regexp_extract(text, shape, 1), F.lit("-"), F.lpad(F.regexp_extract(text, shape, 2), 2, "0"), F.lit("-01"))
    return F.last_day(F.when(text.rlike(shape), iso).try_cast("date"))


def normalize_utc(c: Column) -> Column:
    """Timestamp from text that states its offset; text without one gives null."""
    return F.when(F.trim(c).rlike("(Z|[+-]\\d{2}:?\\d{2})$"), F.trim(c)).try_cast("timestamp")


def resolve_cutoff(explicit: Column, local_date: Column) -> Column:
    """Explicit instant, else local midnight in the market's zone (the day itself excluded)."""
    return F.coalesce(explicit, F.to_utc_timestamp(local_date.cast("timestamp"), K.MARKET_TIME_ZONE))


def parse_list_cell(c: Column) -> Column:
    """List from a cell holding JSON or single-quoted list text; anything else is empty."""
    parsed = F.from_json(F.translate(c, "'", '"'), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def session_status(name: Column, description: Column) -> Column:
    """Session kind by the first keyword found; null when no keyword says it."""
    text = F.concat_ws(" ", name, description)
    (first, kind), *rest = K.SESSION_KEYWORDS
    out = F.when(text.contains(first), kind)
    for word, k in rest:
        out = out.when(text.contains(word), k)
    return out


def action_type(label: Column) -> Column:
    """Event type of an ex-right label."""
    kinds = F.create_map(*[F.lit(x) for pair in K.ACTION_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.trim(label)), F.lit(K.OTHER_ACTION))


def years_before(c: Column, years: int) -> Column:
    """Same day some years earlier; 29 February becomes 28."""
    return F.add_months(c, -12 * years)
