import datetime as dt


def day(n, start=dt.date(2020, 1, 1)):
    return start + dt.timedelta(days=n)


def panel(spark, closes, symbol="A", volumes=None, highs=None, lows=None):
    rows = [
        (
            symbol,
            day(i),
            float(c),
            float(highs[i] if highs else c + 1),
            float(lows[i] if lows else c - 1),
            float(c),
            float(volumes[i] if volumes else 1000 + i),
        )
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
