"""Score statistics of every person at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.functions.numbers import fixed1, ratio, slope, stdev
from rostrum.operators import spread

QUANTILES = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}


def quantiles(x: Column, at: dict[str, float] = QUANTILES) -> Column:
    """Interpolated quantiles as one array: one sort for all of them."""
    return F.percentile(x, F.array(*[F.lit(q) for q in at.values()]))


def score_profile(speech: DataFrame, by: str = "person_id") -> DataFrame:
    """Count, mean, deviation, range and quantiles of published scores; persons without one keep a row with n 0."""
    s = F.col("score")
    plain = [F.count(s).alias("n"), F.avg(s).alias("mean"), stdev(s).alias("stdev"), F.min(s).alias("low"), F.max(s).alias("high")]
    large = spread.large_groups(speech, [by])
    if large is None:
        agg = speech.groupBy(by).agg(*plain, quantiles(s).alias("q"))
    else:
        agg = speech.groupBy(by).agg(*plain).join(spread.quantiles(speech, [by], "score", list(QUANTILES.values()), large), by, "left")
    out = agg.select(by, "n", "mean", "stdev", "low", "high", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(QUANTILES)])
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def extremes(speech: DataFrame, order: list[str], by: str = "person_id") -> DataFrame:
    """Best and worst speech; of equal ones, the first in the given order."""
    first = [F.col(c).asc_nulls_last() for c in order]
    scored = speech.filter("score is not null")
    w = lambda c: Window.partitionBy(by).orderBy(c, *first)
    ranked = scored.withColumn("b", F.row_number().over(w(F.desc("score")))).withColumn("w", F.row_number().over(w(F.asc("score")))).filter("b = 1 or w = 1")
    pick = lambda mark, c: F.max(F.when(F.col(mark) == 1, F.col(c)))
    return ranked.groupBy(by).agg(*[pick(m, c).alias(f"{name}_{c}") for m, name in (("b", "best"), ("w", "worst")) for c in ("tid", "round", "score")])


def _bin_width(span: Column) -> Column:
    return F.when(span <= 20, 1).when(span <= 40, 2).otherwise(F.ceil(span / 20)).cast("bigint")


def histogram(speech: DataFrame, by: str = "person_id") -> DataFrame:
    """Counts in bins from the floor of the least score, at most 21 of them, empty ones included."""
    s = speech.filter("score is not null")
    span = s.groupBy(by).agg(F.floor(F.min("score")).alias("low"), F.floor(F.max("score")).alias("high"))
    span = span.withColumn("width", _bin_width(F.col("high") - F.col("low")))
    counts = s.join(span, by).withColumn("bin", F.floor((F.col("score") - F.col("low")) / F.col("width"))).groupBy(by, "bin").agg(F.count("*").alias("n"))
    bins = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("high") - F.col("low")) / F.col("width")))))
    return bins.join(counts, [by, "bin"], "left").select(by, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_bin(speech: DataFrame, by: str = "person_id") -> DataFrame:
    """The histogram bin that holds the mean, else the last."""
    s = speech.filter("score is not null").groupBy(by).agg(F.floor(F.min("score")).alias("low"), F.floor(F.max("score")).alias("high"), F.avg("score").alias("mean"))
    width = _bin_width(F.col("high") - F.col("low"))
    last = F.floor((F.col("high") - F.col("low")) / width)
    return s.select(by, F.least(F.floor((F.col("mean") - F.col("low")) / width), last).alias("mean_bin"))


def round_profile(speech: DataFrame, by: str = "person_id") -> DataFrame:
    """Mean by round number, and whether it is the person's best or worst of rounds met twice or more (the earlier round on ties). Scores are
    summed in the order of tournaments, so rounds of the same scores have the same mean to the bit."""
    scored = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("tid", F.col("score").cast("double").alias("x")))))
    r = speech.groupBy(by, "round").agg(F.count("score").alias("n"), scored.alias("list")).filter("n > 0")
    r = r.select(by, "round", "n", ratio(F.aggregate("list", F.lit(0.0), lambda a, s: a + s["x"]), F.col("n")).alias("mean"))
    often = F.when(F.col("n") >= 2, F.col("mean"))
    w = lambda c: Window.partitionBy(by).orderBy(c, "round")
    best = (F.col("n") >= 2) & (F.row_number().over(w(often.desc_nulls_last())) == 1)
    worst = (F.col("n") >= 2) & (F.row_number().over(w(often.asc_nulls_last())) == 1)
    return r.select(by, "round", "n", "mean", best.alias("is_best"), worst.alias("is_worst"))


def momentum(speech: DataFrame, least: int = 6, ends: int = 3, by: str = "person_id") -> DataFrame:
    """Means of the first and last speeches of tournaments with enough scored ones, pooled, and what lies between."""
    s = speech.filter("score is not null")
    w = Window.partitionBy(by, "tid")
    s = s.withColumn("first", F.row_number().over(w.orderBy("round", "event_id"))).withColumn("n", F.count("*").over(w)).withColumn("last", F.col("n") - F.col("first") + 1)
    agg = s.filter(F.col("n") >= least).groupBy(by).agg(
        F.avg(F.when(F.col("first") <= ends, F.col("score"))).alias("opening"), F.avg(F.when(F.col("last") <= ends, F.col("score"))).alias("closing"), F.count_distinct("tid").alias("samples")
    )
    return agg.withColumn("momentum", F.col("closing") - F.col("opening"))


def trends(speech: DataFrame, by: str = "person_id") -> DataFrame:
    """Means over tournaments of the slope of score on round, and of the deviation within."""
    one = speech.filter("score is not null").groupBy(by, "tid").agg(slope(F.col("score"), F.col("round")).alias("slope"), stdev(F.col("score")).alias("stdev"))
    return one.groupBy(by).agg(F.avg("slope").alias("slope"), F.avg("stdev").alias("stdev_within"), F.count("slope").alias("slopes"))


def speaker_average(average_cell: Column, total: Column, spoken: Column, cell_mean: Column, prelims: Column) -> Column:
    """As published: the average cell, else total over rounds spoken, else the mean of cells, else total over prelims; one decimal, as text."""
    per = lambda n: F.when(n > 0, ratio(total, n))
    return fixed1(F.coalesce(average_cell, per(spoken), cell_mean, per(prelims)))


def prelim_count(stored: Column, team_rounds: Column, speaker_rounds: Column) -> Column:
    """The first positive count."""
    return F.coalesce(*[F.when(c > 0, c) for c in (stored, team_rounds, speaker_rounds)])
