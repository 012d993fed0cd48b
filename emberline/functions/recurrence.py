"""Steps for `scan`: exponential and Wilder averages, Wilder sums and ADX out of them, and ranks in a rolling window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable

Number = float | None


def ema(period: int) -> Callable[[Number], Number]:
    """Exponential average with weight 2 / (period + 1); the first value is the seed, so there is no warm-up."""
    weight, last = 2.0 / (period + 1), None

    def step(x: Number) -> Number:
        nonlocal last
        if x is not None:
            last = x if last is None else weight * x + (1 - weight) * last
        return last

    return step


def _seeded(period: int, seed: Callable[[list[float]], float], go_on: Callable[[float, float], float]) -> Callable[[Number], Number]:
    """NULL until the period-th value; then the seed over the last `period` rows; then go_on. A missing value repeats the last result."""
    recent: list[Number] = []
    seen, last = 0, None

    def step(x: Number) -> Number:
        nonlocal seen, last, recent
        if last is not None:
            if x is not None:
                last = go_on(last, x)
            return last
        recent = [*recent, x][-period:]
        seen += x is not None
        if seen == period:
            last = seed([v for v in recent if v is not None])
        return last

    return step


def rma(period: int) -> Callable[[Number], Number]:
    """Wilder's average."""
    return _seeded(period, lambda v: sum(v) / len(v), lambda last, x: (1 - 1 / period) * last + x / period)


def wilder_sum(period: int) -> Callable[[Number], Number]:
    return _seeded(period, sum, lambda last, x: last - last / period + x)


def expanding_rma(period: int) -> Callable[[Number], Number]:
    """Wilder's average whose warm-up is the mean of all values so far instead of NULL."""
    n, total, last = 0, 0.0, None

    def step(x: Number) -> Number:
        nonlocal n, total, last
        if x is None:
            return last
        n += 1
        if n <= period:
            total += x
            last = total / n
        else:
            last = (last * (period - 1) + x) / period
        return last

    return step


def adx(period: int) -> Callable[[Number, float, float], tuple[Number, float, float]]:
    """(true range, +DM, -DM) -> (ADX, +DI, -DI). During the indicators' warm-up DX is 0 and counts in ADX's seed."""
    sums, smooth = [wilder_sum(period) for _ in range(3)], rma(period)

    def step(tr: Number, plus: float, minus: float) -> tuple[Number, float, float]:
        t, p, m = (s(x) for s, x in zip(sums, (tr, plus, minus), strict=True))
        up, down = (100 * p / t, 100 * m / t) if t and t > 0 else (0.0, 0.0)
        return smooth(abs(up - down) / (up + down) * 100 if up + down > 0 else 0.0), up, down

    return step


def rsi(period: int) -> Callable[[Number], Number]:
    """Change of close -> RSI; 100 without losses, NULL without any change."""
    up, down = rma(period), rma(period)

    def step(change: Number) -> Number:
        if change is None:
            return None
        gain, loss = up(max(change, 0.0)), down(max(-change, 0.0))
        if gain is None or (gain == 0 and loss == 0):
            return None
        return 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)

    return step


def macd(fast: int, slow: int, signal: int) -> Callable[[Number], tuple[Number, Number, Number]]:
    """Close -> line, signal, histogram."""
    quick, steady, smooth = ema(fast), ema(slow), ema(signal)

    def step(x: Number) -> tuple[Number, Number, Number]:
        a, b = quick(x), steady(x)
        line = None if a is None else a - b
        avg = smooth(line)
        return line, avg, None if line is None else line - avg

    return step


def rolling_rank(n: int) -> Callable[[Number], tuple[Number, Number]]:
    """Percentile rank (0-100) of a value among the last n, by the average and by the highest rank of its ties; NULL unless there are n.

    The window is kept sorted, so a step costs a search instead of n comparisons. Values that agree in ten significant digits are ties,
    so rounding noise of sums does not decide ranks, whatever the scale of a series' prices.
    """
    window: deque[Number] = deque()
    in_order: list[float] = []

    def step(x: Number) -> tuple[Number, Number]:
        if len(window) == n and (old := window.popleft()) is not None:
            del in_order[bisect_left(in_order, old)]
        x = None if x is None else float(f"{x:.10g}")
        window.append(x)
        if x is not None:
            insort(in_order, x)
        if x is None or len(in_order) < n:
            return None, None
        below, up_to = bisect_left(in_order, x), bisect_right(in_order, x)
        return (below + (up_to - below + 1) / 2) / n * 100, up_to / n * 100

    return step
