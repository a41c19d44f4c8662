import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions import canonical, normalize as nz, numbers as nb


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows(df.select("i", fn(F.col("v")).alias("o")), "i")]


def test_numbers_dates_symbols(spark):
    assert one(spark, ["1,234.5", "--", "", " 7 ", "N/A", "x", None], nb.parse_number) == [1234.5, None, None, 7.0, None, None, None]
    d = dt.date(2014, 1, 2)
    assert one(spark, ["103/01/02", "103年01月02日", "1030102", "2014-01-02", "103.1.2", "103/13/40", "soon"], nz.parse_minguo_date) == [d] * 5 + [None, None]
    assert one(spark, ["2024M02", "2023M2", "2024-02"], nz.parse_month_period) == [dt.date(2024, 2, 29), dt.date(2023, 2, 28), None]
    assert one(spark, ["0000", " taiex ", "2330", "6488.two", "^gspc", "0050.TW"], nz.normalize_symbol) == ["^TWII", "^TWII", "2330.TW", "6488.TWO", "^GSPC", "0050.TW"]
    cost = one(spark, ["TAIEX", "0050", "2330"], lambda c: F.concat_ws("|", *[nz.cost_model(c)[x].cast("string") for x in ("sales_tax_rate", "lot_size", "instrument_type")]))
    assert cost == ["0.001|1|index_etf_proxy", "0.001|1000|equity_etf", "0.003|1000|stock"]


def test_clocks_lists_labels(spark):
    assert one(spark, ["2024-01-01T08:00:00+08:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00"], nz.normalize_utc) == [dt.datetime(2024, 1, 1)] * 2 + [None]
    assert one(spark, ["['a', 'b']", '["c"]', "junk", None], nz.parse_list_cell) == [["a", "b"], ["c"], [], []]
    assert one(spark, ["權", "息", "權息", "?"], nz.action_type) == ["ex_right", "ex_dividend", "ex_right_dividend", "other_exright"]
    assert one(spark, ["市場無交易", "放假", "最後交易日", "開始交易", "?"], lambda c: nz.session_status(c, F.lit(""))) == ["no_trading", "holiday", "special", "trading", None]
    cut = spark.sql("select cast(null as timestamp) e, date'2024-01-02' d").select(nz.resolve_cutoff(F.col("e"), F.col("d"))).first()[0]
    assert cut == dt.datetime(2024, 1, 1, 16)


def test_canonical_forms(spark):
    assert one(spark, ["1.500", "0.00", "-0.0", "100", "-2.50", "0.0001"], nb.canonical_decimal) == ["1.5", "0", "0", "100", "-2.5", "0.0001"]
    doc = spark.createDataFrame([('{"a":{"b":null,"c":1}}',)], "d string")
    r = doc.select(canonical.path_get("d", "a.b").alias("x"), canonical.path_get("d", "a.z").alias("y"), canonical.path_get("d", "a.c").alias("z"), canonical.path_get("d", "q.r").alias("w")).first()
    assert (r.x.present, r.x.value) == (True, None) and (r.y.present, r.w.present) == (False, False) and r.z.value == "1"
    m = spark.sql("select map('b','2','a','1') m").select(F.to_json(canonical.canonical_map("m"))).first()[0]
    assert m == '{"a":"1","b":"2"}'
    assert one(spark, [2.675, 0.125, -2.675, 1.0049999], lambda c: nb.half_up(c, 2), "double") == [2.68, 0.13, -2.68, 1.0]
    assert one(spark, ["percent", "ratio", "bps"], lambda c: nb.yield_to_ratio(F.lit(4.0), c)) == [0.04, 4.0, None]
    assert one(spark, [5.0, -1.0, float("nan"), float("inf")], lambda c: nb.normalize_twd(c, F.lit("TWD_million")), "double") == [5e6, None, None, None]
