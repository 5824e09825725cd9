"""Exponential moving average as built-in windows.

EMA_t = m*x_t + (1-m)*EMA_{t-1}, seeded with x_0, equals the weighted sum of all
earlier rows with weights that fall like q^age, q = 1-m. Values must be finite: a
null, NaN or infinite one fails the job, since the recurrence would carry it on for
ever. For finite values the sum is that of the recurrence to a double's precision. Within a run of ``run``
rows this is a running sum of x*q^-j scaled back by q^j; the run before
contributes its last value times q^(j+1). Rows further back than ``reach`` weigh
less than e^-60 together, far below double precision, so a block only needs that
many rows before it and no state has to travel between blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tsquant.functions.series import POS, Frames

# e^-60 is negligible next to 1; e^300 still fits a double with room for prices.
NEGLIGIBLE = 60.0
LARGEST = 300.0


@dataclass(frozen=True)
class Decay:
    """Weights of one exponential average."""

    period: float
    smoothing: float = 2.0

    def __post_init__(self):
        if not 0 < self.weight <= 1:
            raise ValueError("smoothing / (1 + period) must lie in (0, 1]")

    @property
    def weight(self) -> float:
        return self.smoothing / (1.0 + self.period)

    @property
    def kept(self) -> float:
        return 1.0 - self.weight

    @property
    def rate(self) -> float:
        return -math.log(self.kept) if self.kept > 0 else math.inf

    @property
    def reach(self) -> int:
        """Rows back that still matter."""
        return 0 if self.kept == 0 else math.ceil(NEGLIGIBLE / self.rate)

    @property
    def longest_run(self) -> int:
        """Rows over which q^-j stays a sound double."""
        return 1 if self.kept == 0 else max(1, math.floor(LARGEST / self.rate))


def common_run(decays: list[Decay]) -> int | None:
    """A run length that suits all averages, so that they share one sort order."""
    moving = [d for d in decays if d.kept > 0]
    if not moving:
        return None
    shortest = min(d.longest_run for d in moving)
    return shortest if shortest >= max(d.reach for d in moving) else None


def run_name(run: int) -> str:
    return f"_run_{run}"


def run_column(run: int) -> Column:
    return F.expr(f"`{POS}` div {run}")


def finite(source: str) -> Column:
    """The value of a column; one that is null or not finite fails the job."""
    x = F.col(source).cast("double")
    refused = F.raise_error(F.lit(f"{source} must be finite for an exponential average")).cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(refused)


def ema_levels(
    frames: Frames, source: str, decay: Decay, run: int, out: str
) -> list[dict[str, Column]]:
    """Two levels: the sum within a run, then the value with the run before."""
    x = finite(source)
    if decay.kept == 0:
        return [{out: x * 1.0}, {}]
    q = F.lit(decay.kept)
    j = F.col(POS) - F.col(run_name(run)) * run
    local = f"_local_{out}"
    seen = F.when(frames.first_row, F.lit(1.0)).otherwise(F.lit(decay.weight)) * x
    running = frames.window(run_name(run)).rowsBetween(Window.unboundedPreceding, 0)
    run_end = F.when(j == run - 1, F.col(local))
    before = F.last(run_end, ignorenulls=True).over(frames.earlier())
    return [
        {local: F.pow(q, j) * F.sum(seen * F.pow(q, -j)).over(running)},
        {out: F.col(local) + F.coalesce(before * F.pow(q, j + 1), F.lit(0.0))},
    ]
