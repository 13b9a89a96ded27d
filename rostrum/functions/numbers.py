"""Number expressions: display rounding, guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed1(x: Column) -> Column:
    """One decimal as text: the exact binary value rounded, exact ties away from zero (76.25 gives 76.3, 78.35 gives 78.3)."""
    tie = F.abs(x * 4) % 2 == 1
    away = F.signum(x) * F.floor(F.abs(x) * 10 + 0.5) / 10
    return F.regexp_replace(F.format_number(F.when(tie, away).otherwise(x), 1), ",", "")


def signed1(x: Column) -> Column:
    """fixed1 with a plus sign for positive values; what rounds to zero has no sign."""
    text = F.regexp_replace(fixed1(x), "^-0\\.0$", "0.0")
    return F.when(text.cast("double") > 0, F.concat(F.lit("+"), text)).otherwise(text)


def stdev(x: Column) -> Column:
    """Population deviation of two values or more."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope over three pairs or more, null if x does not vary."""
    both = F.when(y.isNotNull() & x.isNotNull(), F.lit(1))
    return F.when(F.count(both) >= 3, F.regr_slope(y, x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def credited_mean(value: str) -> Column:
    """The mean of known values, each counted ``credits`` times."""
    return ratio(F.sum(F.col(value) * F.col("credits")), F.sum(F.when(F.col(value).isNotNull(), F.col("credits"))))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def parse_number(text: Column) -> Column:
    """A plain decimal number; commas and white space are dropped, anything else gives null."""
    bare = F.regexp_replace(text, r"[,\s]", "")
    return F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare.try_cast("double"))


def r6(x: Column) -> Column:
    """Six decimals: what results are compared at."""
    return F.round(x.cast("double"), 6)


# Rounds under which a split is thin, and deltas that stand out (points of win rate, speaker points).
THIN_ROUNDS, RATE_STANDS_OUT, SCORE_STANDS_OUT = 4, 5.0, 0.3


def thin(rounds: Column) -> Column:
    """Whether a split rests on too few rounds."""
    return rounds < THIN_ROUNDS


def stands_out(delta: Column, least: float) -> Column:
    """Whether a delta is large enough to be marked, and which way: 1, -1, or 0."""
    return F.when(delta >= least, 1).when(delta <= -least, -1).otherwise(0)
