"""Analytics over candle series (open, high, low, close, volume) as DataFrame transforms on Spark."""
