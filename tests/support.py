"""Fixtures shared by the tests."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import random

START = dt.datetime(2025, 1, 1, 10, tzinfo=None)
#: Six bars that rise and fall: open, high, low, close, volume.
UNEVEN = [
    (19.5, 21.0, 19.0, 20.0, 300),
    (20.5, 23.0, 20.5, 22.0, 150),
    (22.0, 22.5, 20.0, 21.0, 420),
    (21.5, 25.0, 21.5, 24.0, 90),
    (24.0, 24.5, 22.0, 23.0, 260),
    (23.5, 28.0, 23.5, 27.0, 510),
]
SIX = [(START + dt.timedelta(minutes=i), *bar) for i, bar in enumerate(UNEVEN)]


def random_bars(symbols: dict[str, int], seed: int = 7, step: float = 60.0):
    """Bars with uneven gaps: symbol, timestamp, open, high, low, close, volume."""
    rng = random.Random(seed)
    rows = []
    for symbol, count in symbols.items():
        at, price = START, 100.0
        for _ in range(count):
            at += dt.timedelta(seconds=round(step * rng.choice([1, 1, 1, 1, 5, 200]), 3))
            price = max(1.0, price + rng.choice([-1.5, -0.5, 0.0, 0.5, 1.5]))
            high, low = price + rng.random(), price - rng.random()
            rows.append((symbol, at, price, high, low, price, rng.randrange(0, 1000)))
    rng.shuffle(rows)
    return rows


BARS = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume bigint"


def plan_of(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def near(a, b, tolerance=1e-9) -> bool:
    if a is None or b is None:
        return a is b
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
