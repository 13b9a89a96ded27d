"""Places, quantiles and streaks of groups of any size: a group that is too large for one task is spread over many.

Groups are counted first. Small ones are worked on as they are, by a window or an aggregate; the few with more than
``GROUP_ROWS`` rows, and more than a 65,536th of all, take another way to the same result:

- places: rows are partitioned by range over (group, order), numbered within their partition, and shifted by the counts of the
  partitions before; equal values that go on across an edge share the place of their first.
- quantiles: bins of values are counted and narrowed, pass by pass, around the ranks that are asked for, until a bin has one value.
- streaks: stretches of consecutive rows are summed up as (beginning, end, best of each kind), and these are folded in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.sources.store import stored

GROUP_ROWS = 1_000_000
#: Rows of a large group that one task numbers, about; bins of a pass; rows of a stretch of a streak.
TASK_ROWS, BINS, STRETCH = 250_000, 1024, 10_000
#: Rows of one key that a task of a join meets with what they are joined with.
CROWD = 8192
#: Rows of either side that meet at a stretch where a result has a row for each pair.
TILE = 4096
#: There are at most so many large groups, so what is known of each goes to every task.
MOST_GROUPS = 65_536


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__k_{k}" for k in keys})


def _matches(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys))


def _with(df: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with a few rows, by keys that may be null."""
    out = df.join(F.broadcast(_renamed(few, keys)), _matches(keys), how)
    return out.drop(*[f"__k_{k}" for k in keys])


def large_groups(df: DataFrame, group: list[str], most: int | None = None) -> DataFrame | None:
    """(group, __rows) of the groups that are too large for one task, or None."""
    most = GROUP_ROWS if most is None else most
    counts = df.groupBy(*group).agg(F.count("*").alias("__rows"))
    rows, n = counts.agg(F.sum("__rows"), F.count_if(F.col("__rows") > most)).first()
    return counts.filter(F.col("__rows") > max(most, rows // MOST_GROUPS)) if n else None


def join_crowded(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """left joined with right (inner or left) by keys of which a few have very many rows in left: those are dealt by the hash ``by``, some
    ``CROWD`` rows to a task, and their rows of right are copied to each. Keys have no nulls. There are few such keys, so their list
    is sent to every task."""
    crowds = left.groupBy(*keys).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > CROWD)
    deals = F.broadcast(crowds.select(*keys, F.ceil(F.col("__rows") / CROWD).cast("int").alias("__deals")))
    dealt = lambda df: df.join(deals, keys, "left").withColumn("__deals", F.coalesce("__deals", F.lit(1)))
    one = dealt(left).withColumn("__deal", F.pmod(by, F.col("__deals")).cast("int")).drop("__deals")
    other = dealt(right).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
    return one.join(other, [*keys, "__deal"], how).drop("__deal")


def pairs(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right (inner or left) by keys of which a few have very many rows on both sides, so that the result has far more rows
    than either. Rows of such a key are dealt by their hash: those of right into tiles of some ``TILE``, each an array in one row,
    those of left into as many at a time; every part of left meets every tile in a place of its own, where a row of left is laid
    out over the tile. What moves is each row once for some ``TILE`` rows of the other side, and a task holds one tile and
    what one row of left makes of it. Rows of right that share a key are not all alike. Keys have no nulls."""
    spark, place = left.sparkSession, [*keys, "__deal", "__tile"]
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def counted(df: DataFrame, name: str) -> DataFrame:
        # only keys of more than a tile, so there are few
        crowds = df.groupBy(*keys).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > TILE)
        return F.broadcast(crowds.select(*keys, F.ceil(F.col("__rows") / TILE).cast("int").alias(name)))

    deals, tiles = counted(left, "__deals"), counted(right, "__tiles")
    known = lambda df: df.join(deals, keys, "left").join(tiles, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__deals", "__tiles")})
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [c for c in right.columns if c not in keys]
    one = known(left).select(*left.columns, "__tiles", dealt(left, "__deals").alias("__deal"), copies("__tiles").alias("__tile"))
    other = known(right).select(*keys, "__deals", dealt(right, "__tiles").alias("__tile"), F.struct(*own).alias("__row")).groupBy(*keys, "__deals", "__tile").agg(F.collect_list("__row").alias("__of_tile"))
    other = other.select(*keys, "__tile", "__of_tile", copies("__deals").alias("__deal"))
    met = one.repartition(parts, *place).join(other.repartition(parts, *place).hint("merge"), place, how)
    if how == "inner":
        return met.select(*left.columns, F.inline("__of_tile"))
    # a key with several tiles has rows in right, so a tile that got none of them is no miss
    return met.filter(F.col("__of_tile").isNotNull() | (F.col("__tiles") == 1)).select(*left.columns, F.inline_outer("__of_tile"))


def _orders(by: dict[str, str]) -> list[Column]:
    return [getattr(F.col(c), how)() for c, how in by.items()]


def _numbered(rows: DataFrame, keys: list[str], ties: dict[str, str], rest: dict[str, str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumn("index", F.row_number().over(w.orderBy(*_orders(ties | rest))).cast("bigint")).withColumn("rank", F.rank().over(w.orderBy(*_orders(ties))).cast("bigint"))


def places(df: DataFrame, group: list[str], ties: dict[str, str], rest: dict[str, str], large: DataFrame | None) -> DataFrame:
    """df with ``index``, the place of each row in its group by ``ties`` and then ``rest``, and ``rank``, the place of the first row that is
    equal by ``ties``: columns and how they are ordered (desc, asc_nulls_last and the like). large: :func:`large_groups`."""
    if large is None:
        return _numbered(df, group, ties, rest)
    some, others = _with(df, large.select(*group), group, "left_semi"), _with(df, large.select(*group), group, "left_anti")
    rows, least = large.agg(F.sum("__rows"), F.min("__rows")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // min(TASK_ROWS, least)))
    ranged = stored(some.repartitionByRange(parts, *group, *_orders(ties | rest)).withColumn("__part", F.spark_partition_id()))
    here = ["__part", *group]
    # partitions follow each other: what comes before one is all rows of its group in earlier ones
    counts = ranged.groupBy(*here).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = _with(_numbered(ranged, here, ties, rest), counts.select(*here, before.alias("__before")), here)
    shifted = shifted.withColumns({c: F.col(c) + F.col("__before") for c in ("index", "rank")}).drop("__before")
    # values with which a partition begins may have begun before it
    equal = [*group, *ties]
    edges = shifted.groupBy(*here).agg(F.min_by(F.struct(*ties), "index").alias("__v")).select(*group, "__v.*").distinct()
    begun = _with(shifted, edges, equal, "left_semi").groupBy(*equal).agg(F.min("rank").alias("__first"))
    out = _with(shifted, begun, equal, "left").withColumn("rank", F.coalesce("__first", "rank"))
    columns = [*df.columns, "index", "rank"]
    return out.select(columns).unionByName(_numbered(others, group, ties, rest).select(columns))


def _interpolated(low: Column, high: Column, position: Column) -> Column:
    """As ``percentile`` does it."""
    floor, ceil = F.floor(position), F.ceil(position)
    return F.when((floor == ceil) | (low == high), low).otherwise((ceil - position) * low + (position - floor) * high)


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float], large: DataFrame | None) -> DataFrame:
    """(group, q): interpolated quantiles of each group's known values, as an array; the same as ``percentile`` gives."""
    asked = F.array(*[F.lit(float(a)) for a in at])
    whole = lambda rows: rows.groupBy(*group).agg(F.percentile(F.col(value), asked).alias("q"))
    if large is None:
        return whole(df)
    some = _with(df, large.select(*group), group, "left_semi").filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__x"))
    spark, ends = df.sparkSession, some.groupBy(*group).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    position = (F.col("n") - 1) * F.col("__at")
    sought = ends.withColumn("__at", F.explode(asked)).withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
    # (group, rank, low, high, below): the value of this rank lies in low..high, with so many values below it
    open_ = sought.select(*group, "__rank", "low", "high", F.lit(0).cast("bigint").alias("below")).distinct().toArrow()
    schema, found = spark.createDataFrame(open_).schema, []
    keys = [*group, "__rank"]
    while open_.num_rows:
        left = spark.createDataFrame(open_)
        found.append(left.filter("low = high").select(*keys, F.col("low").alias("__value")))
        left = left.filter("low < high")
        target = F.broadcast(_renamed(left.withColumnsRenamed({c: f"__t_{c}" for c in ("low", "high", "below")}), group))
        met = some.join(target, _matches(group) & F.col("__x").between(F.col("__t_low"), F.col("__t_high")))
        place = F.least(F.floor((F.col("__x") / 2 - F.col("__t_low") / 2) / (F.col("__t_high") / 2 - F.col("__t_low") / 2) * BINS), F.lit(BINS - 1))
        bins = met.groupBy(*keys, "__t_below", place.alias("bin")).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        until = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) + F.col("__t_below")
        hit = bins.withColumn("until", until).withColumn("below", F.col("until") - F.col("n")).filter((F.col("below") <= F.col("__rank")) & (F.col("until") > F.col("__rank")))
        open_ = hit.select(*[f.name for f in schema.fields]).toArrow()
    small = whole(_with(df, large.select(*group), group, "left_anti"))
    if not found:
        return small  # no large group has a known value
    values = reduce(DataFrame.unionByName, found)
    per = ends.select(*group, "n").withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1)))).withColumn("__p", (F.col("n") - 1) * F.get(asked, F.col("__i")))
    for name, rank in (("__lo", F.floor("__p")), ("__hi", F.ceil("__p"))):
        known = _renamed(values.withColumnsRenamed({"__rank": "__r", "__value": name}), group)
        per = per.join(F.broadcast(known), _matches(group) & (F.col("__r") == rank)).drop("__r", *[f"__k_{g}" for g in group])
    each = per.withColumn("x", _interpolated(F.col("__lo"), F.col("__hi"), F.col("__p")))
    done = each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "x"))), lambda s: s["x"]).alias("q"))
    return done.unionByName(small)


def _islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, start) of the runs of equal values, in order of ``index``."""
    w = Window.partitionBy(*keys).orderBy("index")
    marked = rows.withColumn("__new", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int"))
    counted = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.groupBy(*keys, "__run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min("index").alias("start"))


def longest_streaks(df: DataFrame, group: list[str], order: dict[str, str], value: str, large: DataFrame | None) -> DataFrame:
    """(group, won, lost): the longest runs of true and of false values of each group, in its order. value has no nulls."""
    best = lambda on: F.coalesce(F.max(F.when(on, F.col("n"))), F.lit(0))
    runs = lambda rows: _islands(_numbered(rows, group, order, {}), group, value).groupBy(*group).agg(best(F.col(value)).alias("won"), best(~F.col(value)).alias("lost"))
    if large is None:
        return runs(df)
    some, others = _with(df, large.select(*group), group, "left_semi"), _with(df, large.select(*group), group, "left_anti")
    keys = [*group, "__stretch"]
    placed = places(some, group, order, {}, large).withColumn("__stretch", F.floor((F.col("index") - 1) / STRETCH))
    run = F.struct(value, "n")
    each = _islands(placed, keys, value).groupBy(*keys).agg(
        F.count("*").alias("runs"), F.min_by(run, "start").alias("head"), F.max_by(run, "start").alias("tail"), best(F.col(value)).alias("won"), best(~F.col(value)).alias("lost")
    )
    listed = each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__stretch", "runs", "head", "tail", "won", "lost"))).alias("s"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(False).alias("on"), zero.alias("n"), zero.alias("won"), zero.alias("lost"))

    def join(a: Column, s: Column) -> Column:
        """What is known of all stretches so far, and the next: its beginning goes on from the run at the end."""
        grown = s["head"]["n"] + F.when(a["on"] == s["head"][value], a["n"]).otherwise(0)
        at_end = F.when(s["runs"] == 1, grown).otherwise(s["tail"]["n"])
        on = s["head"][value]
        return F.struct(s["tail"][value].alias("on"), at_end.alias("n"), F.greatest(a["won"], s["won"], F.when(on, grown)).alias("won"), F.greatest(a["lost"], s["lost"], F.when(~on, grown)).alias("lost"))

    whole = listed.select(*group, F.aggregate("s", start, join).alias("a")).select(*group, "a.won", "a.lost")
    return whole.unionByName(runs(others))
