"""Landed provider files to typed tables.

Readers only attach a schema; the parsing functions take the read DataFrame, so
they work the same on files, on text columns and in a stream.  Rows that cannot
be read are null or go to a rejects table; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.normalize import action_type, parse_minguo_date, parse_month_period, session_status
from tidemark.functions.numbers import parse_number, yield_to_ratio

ENVELOPE = "stat string, data array<array<string>>"
TABLE_ENVELOPE = "stkDate string, aaData array<array<string>>"
TURNOVER_A = "Date string, TradeValue string"
TURNOVER_B = "Date string, TradeAmount string"
MONEY = "data struct<dataSets: array<array<string>>, structure: struct<Table1: array<struct<data: string>>>>"
MONEY_ANY = f"{MONEY}, result struct<structure: struct<tables: array<struct<name: string, items: array<string>>>>, data: array<array<string>>>"
SESSIONS = "Name string, Date string, Weekday string, Description string"
STATEMENTS = "stock_id string, date string, origin_date string, type string, value double"
CORRUPT = "corrupt"
PER_ROWS = "stock_id string, date string, PER string, PBR string, dividend_yield string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file (or a list of objects), under a fixed schema.

    A document that cannot be read keeps its text in ``corrupt`` with all else
    null; ``unreadable`` turns such rows into rejects.  No broken file ends the job.
    """
    return spark.read.schema(f"{schema}, {CORRUPT} string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def unreadable(documents: DataFrame) -> DataFrame:
    """Documents that are no JSON of the expected shape, with the reason."""
    return documents.where(F.col(CORRUPT).isNotNull()).withColumn("reason", F.lit("document_unreadable"))


def _cell(i: int) -> Column:
    return F.get("row", F.lit(i))


def _whole(i: int) -> Column:
    return parse_number(_cell(i), "bigint")


def _number(i: int) -> Column:
    return parse_number(_cell(i))


def envelope_rows(envelopes: DataFrame) -> DataFrame:
    """Data rows of accepted envelopes; other columns of the envelope are kept."""
    rest = [c for c in envelopes.columns if c not in ("stat", "data", CORRUPT)]
    # A filter on stat, or one that Spark infers for a plain explode, would sink below the parsing and repeat it.
    data = F.when(F.col("stat") == "OK", F.col("data"))
    return envelopes.select(*rest, F.posexplode_outer(data).alias("_place", "row")).where("_place is not null").drop("_place")


def envelope_rejects(envelopes: DataFrame) -> DataFrame:
    """Envelopes that give no rows: unreadable, refused, or accepted without data."""
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in envelopes.columns else F.lit(False)
    refused = ~F.col("stat").eqNullSafe("OK")
    reason = (
        F.when(broken, "document_unreadable")
        .when(refused, F.concat(F.lit("response_not_ok:"), F.coalesce("stat", F.lit("missing"))))
        .when(F.col("data").isNull(), "accepted_without_data")
    )
    return envelopes.withColumn("reason", reason).where(F.col("reason").isNotNull())


def market_month(envelopes: DataFrame) -> DataFrame:
    """Market calendar rows of a month."""
    return envelope_rows(envelopes).select(
        parse_minguo_date(_cell(0)).alias("trade_date"),
        _whole(1).alias("traded_shares"),
        _whole(2).alias("traded_value_twd"),
        _whole(3).alias("transaction_count"),
        _number(4).alias("taiex"),
        _number(5).alias("taiex_change"),
    )


def stock_day(envelopes: DataFrame) -> DataFrame:
    """Official daily rows; ``envelopes`` carry the symbol.  The note column may be absent."""
    return envelope_rows(envelopes).select(
        "symbol",
        parse_minguo_date(_cell(0)).alias("trade_date"),
        _whole(1).alias("volume"),
        _whole(2).alias("traded_value_twd"),
        _number(3).alias("open"),
        _number(4).alias("high"),
        _number(5).alias("low"),
        _number(6).alias("close"),
        F.trim(_cell(7)).alias("change_text"),
        _whole(8).alias("transaction_count"),
        F.coalesce(F.trim(_cell(9)), F.lit("")).alias("note"),
    )


def exright(envelopes: DataFrame) -> DataFrame:
    """Ex-right and ex-dividend actions."""
    return envelope_rows(envelopes).select(
        F.trim(_cell(1)).alias("symbol"),
        parse_minguo_date(_cell(0)).alias("event_date"),
        action_type(_cell(6)).alias("event_type"),
        _number(3).alias("previous_close"),
        _number(4).alias("reference_price"),
        _number(9).alias("opening_reference"),
        _number(5).alias("action_value"),
        F.trim(_cell(6)).alias("action_reason"),
        F.col("row").alias("raw_row"),
    )


def reduction(envelopes: DataFrame) -> DataFrame:
    """Capital reductions."""
    return envelope_rows(envelopes).select(
        F.trim(_cell(1)).alias("symbol"),
        parse_minguo_date(_cell(0)).alias("event_date"),
        F.lit(K.CAPITAL_REDUCTION).alias("event_type"),
        _number(3).alias("previous_close"),
        _number(4).alias("reference_price"),
        _number(7).alias("opening_reference"),
        F.lit(None).cast("double").alias("action_value"),
        F.trim(_cell(9)).alias("action_reason"),
        F.col("row").alias("raw_row"),
    )


def turnover(a: DataFrame, b: DataFrame) -> DataFrame:
    """Daily turnover of both markets in long form."""
    one = a.select(parse_minguo_date(F.col("Date")).alias("trade_date"), F.lit("A").alias("market"), parse_number(F.col("TradeValue")).alias("value"))
    two = b.select(parse_minguo_date(F.col("Date")).alias("trade_date"), F.lit("B").alias("market"), parse_number(F.col("TradeAmount")).alias("value"))
    return one.unionByName(two)


def turnover_positional(a: DataFrame, b: DataFrame) -> DataFrame:
    """The older layouts: value in the third column of one, the second of the other."""
    one = envelope_rows(a).select(parse_minguo_date(_cell(0)).alias("trade_date"), F.lit("A").alias("market"), _number(2).alias("value"))
    rows = b.select(F.explode("aaData").alias("row"))
    two = rows.select(parse_minguo_date(_cell(0)).alias("trade_date"), F.lit("B").alias("market"), _number(1).alias("value"))
    return one.unionByName(two)


def _plain_name(c: Column) -> Column:
    """Upper case, no spaces, full-width letters and digits made narrow."""
    wide = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26))
    narrow = "".join(chr(0x30 + i) for i in range(10)) + "".join(chr(0x41 + i) for i in range(26))
    return F.translate(F.regexp_replace(F.upper(c), "[\\s　]", ""), wide, narrow)


def _category_place(category: str) -> Column:
    """Number of the first column group that names the category; null if none does."""
    names = F.transform("data.structure.Table1", lambda x: _plain_name(x["data"]))
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(names) - 1, F.lit(0))), lambda i: F.contains(F.get(names, i), F.lit(category)))
    return F.get(hits, F.lit(0))


def one_money_layout(documents: DataFrame) -> DataFrame:
    """Documents read with ``MONEY_ANY``: the compact layout (``result``) brought into the full one (``data``)."""
    compact = F.col("result")
    table = F.get(F.filter(compact["structure"]["tables"], lambda t: t["name"] == "Table1"), F.lit(0))
    named = F.transform(table["items"], lambda x: F.struct(x.alias("data")))
    built = F.struct(compact["data"].alias("dataSets"), F.struct(named.alias("Table1")).alias("structure"))
    return documents.withColumn("data", F.when(F.col("data.dataSets").isNotNull(), F.col("data")).otherwise(built)).drop("result")


def released_money_supply(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """Monthly values with the time they were published; none is invented.

    ``releases(period, available_at)``: the earliest time of a period counts.
    Rows without one, or without a value, keep the reason why they cannot enter the ledger.
    """
    known = releases.where(F.col("available_at").isNotNull()).groupBy("period").agg(F.min("available_at").alias("available_at"))
    reason = F.when(F.col("value_raw").isNull(), "value_missing").when(F.col("available_at").isNull(), "official_release_timestamp_required")
    return rows.join(known, "period", "left").withColumn("reason", reason)


def release_status(released: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: all rows usable, some, or none, with the periods that wait."""
    usable, waits = F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())
    status = F.when(usable == 0, "needs_human_input").when(waits > 0, "partial").otherwise("available")
    pending = F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.col("period"))))
    return released.groupBy(*keys).agg(status.alias("status"), usable.alias("usable"), pending.alias("waiting_periods"))


def money_supply_rejects(documents: DataFrame, category: str = "M1B") -> DataFrame:
    """Documents that hold no values of the category, with the reason."""
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in documents.columns else F.lit(False)
    reason = F.when(broken, "document_unreadable").when(_category_place(category).isNull(), "category_missing").when(F.col("data.dataSets").isNull(), "no_data")
    return documents.withColumn("reason", reason).where(F.col("reason").isNotNull())


def money_supply(documents: DataFrame, category: str = "M1B") -> DataFrame:
    """Monthly values of one category: each category owns a value and a growth column."""
    located = documents.select(_category_place(category).alias("at"), F.explode("data.dataSets").alias("row"))
    period = parse_month_period(_cell(0))
    return located.where(F.col("at").isNotNull()).select(
        F.date_format(period, "yyyy-MM").alias("period"),
        period.alias("data_date"),
        parse_number(F.get("row", 1 + 2 * F.col("at"))).alias("value_raw"),
        F.lit("TWD_million").alias("raw_unit"),
    )


def sessions(rows: DataFrame) -> DataFrame:
    """Calendar rows with their session kind; rows without a kind or date carry a reason."""
    day = parse_minguo_date(F.col("Date"))
    kind = session_status(F.coalesce("Name", F.lit("")), F.coalesce("Description", F.lit("")))
    return rows.select(
        day.alias("trade_date"),
        kind.alias("session_status"),
        F.coalesce(F.nullif("Description", F.lit("")), "Name").alias("note"),
        F.when(day.isNull(), "date_unreadable").when(kind.isNull(), "session_meaning_missing").alias("reason"),
    )


def statements(rows: DataFrame) -> DataFrame:
    """EPS filings from financial statements."""
    is_eps = F.upper("type").rlike("EPS|EARNINGSPERSHARE")
    return rows.where(is_eps).select(
        "stock_id",
        F.col("date").try_cast("date").alias("period_end"),
        F.coalesce(F.col("origin_date").try_cast("date"), F.col("date").try_cast("date")).alias("origin_date"),
        "value",
    )


def per_rows(rows: DataFrame, unit: str) -> DataFrame:
    """Daily PE, PB and yield; an unknown yield unit leaves the yield null with a reason."""
    u = F.lit(unit)
    ratio = yield_to_ratio(parse_number(F.col("dividend_yield")), u)
    return rows.select(
        F.col("stock_id").alias("symbol"),
        F.col("date").try_cast("date").alias("metric_date"),
        parse_number(F.col("PER")).alias("pe"),
        parse_number(F.col("PBR")).alias("pb"),
        ratio.alias("dividend_yield_ratio"),
        F.when(~u.isin("percent", "ratio"), "unknown_yield_unit").alias("reason"),
    )
