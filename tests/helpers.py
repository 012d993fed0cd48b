from datetime import datetime, timedelta


def candles(spark, rows, instrument="X", timeframe="H1", start="2024-01-01", hours=1):
    """A series of (open, high, low, close[, volume]) bars."""
    begin = datetime.fromisoformat(start)
    data = [(instrument, timeframe, begin + timedelta(hours=hours * i), *map(float, (*r, 100)[:5])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "instrument string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double")


def walk(rng, n, tick=1.0):
    """Bars of a random walk on whole ticks, with many ties."""
    out, close = [], 100
    for _ in range(n):
        open_ = close
        close = open_ + rng.randint(-3, 3)
        out.append((open_ * tick, (max(open_, close) + rng.randint(0, 2)) * tick, (min(open_, close) - rng.randint(0, 2)) * tick, close * tick, rng.randint(0, 50)))
    return out


def column(df, *names):
    rows = df.orderBy("instrument", "timestamp").collect()
    return [r[names[0]] for r in rows] if len(names) == 1 else [tuple(r[n] for n in names) for r in rows]
