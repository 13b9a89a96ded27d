"""Ranks, breaks and judging records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.functions.numbers import credited_mean, ratio
from rostrum.functions.stages import category_of, category_priority, outround_stage, round_class, stage_rank
from rostrum.operators.spread import large_groups, places


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the given order. The filter on the row number lets every task pass on one row of a key only
    (a window group limit before the shuffle), so a key with very many rows is no hot one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")


def competition_ranks(standings: DataFrame) -> DataFrame:
    """(tid, team, place): explicit ranks stay; other rows with wins or points are placed by wins, then points, then name,
    and share a place with the first derived row that equals them. A tournament needs two rows with wins or points for derived places."""
    own = F.col("wins").isNotNull() | F.col("points").isNotNull()
    large = large_groups(standings, ["tid"])
    s = standings.withColumnRenamed("rank", "given")
    placed = places(s, ["tid"], {"wins": "desc_nulls_last", "points": "desc_nulls_last"}, {"team": "asc"}, large).drop("rank").withColumnRenamed("given", "rank")
    signals = placed.withColumn("signals", F.count_if(own).over(Window.partitionBy("tid"))) if large is None else placed.join(s.groupBy("tid").agg(F.count_if(own).alias("signals")), "tid")
    ranked = signals.withColumn("derived", F.col("rank").isNull())
    place = F.min("index").over(Window.partitionBy("tid", "derived", "wins", "points"))
    return ranked.select("tid", "team", F.coalesce(F.col("rank"), F.when(own & (F.col("signals") >= 2), place)).cast("bigint").alias("place"))


def team_breaks(breaks: DataFrame) -> DataFrame:
    """(tid, team, category, rank, categories): the break of the category that counts most, the first row on ties, and all categories."""
    order = [F.desc(category_priority(F.col("category"))), F.col("seq").asc()]
    top = first_by(breaks, ["tid", "team"], *order).select("tid", "team", "category", "rank")
    names = breaks.groupBy("tid", "team").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return top.join(names, ["tid", "team"])


def deepest_by_category(reached: DataFrame) -> DataFrame:
    """(person_id, category, stage, rank): the deepest stage reached in each category; stages of unknown depth are left out."""
    r = reached.withColumn("category", category_of(F.col("stage"))).withColumn("rank", stage_rank(F.col("stage"))).filter("rank > 0")
    return first_by(r, ["person_id", "category"], F.desc("rank"), F.asc("tid")).select("person_id", "category", "stage", "rank")


def speaker_signals(entry: DataFrame) -> DataFrame:
    """(tid, elimination, break_rank, broke): over all names of one speaker at a tournament. Unknown stages count as depth 0."""
    deepest = first_by(entry.filter("elimination is not null"), ["tid"], F.desc(stage_rank(F.col("elimination"), strict=False)), F.asc("person_id")).select("tid", "elimination")
    rest = entry.groupBy("tid").agg(F.min("break_rank").alias("break_rank"))
    out = rest.join(deepest, "tid", "left")
    return out.select("tid", "elimination", "break_rank", (F.col("elimination").isNotNull() | F.col("break_rank").isNotNull()).alias("broke"))


def primary_team(speech: DataFrame) -> DataFrame:
    """(person_id, team): the team with most scored rounds; of equal ones, the first to appear."""
    t = speech.groupBy("person_id", "team").agg(F.count("score").alias("scored"), F.min("seq").alias("seen"))
    return first_by(t, ["person_id"], F.desc("scored"), F.asc("seen")).select("person_id", "team", "scored")


def richest_participation(entry: DataFrame) -> DataFrame:
    """(person_id, tid): the entry with most known: 4 for a total, 2 for a team, 1 for an elimination; the first on ties."""
    known = lambda c, n: F.when(F.col(c).isNotNull(), n).otherwise(0)
    return first_by(entry.withColumn("score", known("total", 4) + known("team", 2) + known("elimination", 1)), ["person_id"], F.desc("score"), F.asc("tid")).select("person_id", "tid", "score")


def inrounds_judged(judging: DataFrame, at: str = "slot") -> DataFrame:
    """Distinct (stage, round) of preliminary rounds judged; null without any."""
    inround = round_class(F.col("stage")) == "inround"
    key = F.when(inround, F.struct("stage", "round"))
    return judging.groupBy("person_id", at).agg(F.nullif(F.count_distinct(key), F.lit(0)).alias("inrounds"))


def judge_record(judging: DataFrame, at: str = "slot") -> DataFrame:
    """By person and tournament (the column ``at``): preliminary rounds chaired (not distinct), and the deepest elimination stages chaired and sat on; the first assignment on ties."""
    j = judging.withColumn("kind", round_class(F.col("stage"))).withColumn("rank", stage_rank(F.col("stage")))
    chairs = j.groupBy("person_id", at).agg(F.count_if((F.col("kind") == "inround") & (F.lower(F.trim("panel_role")) == "chair")).alias("chaired"))
    out = j.filter("kind = 'outround'")
    deepest = lambda rows, name: first_by(rows, ["person_id", at], F.desc("rank"), F.asc("assignment_id")).select("person_id", at, F.col("stage").alias(name))
    top = deepest(out.filter("panel_role = 'chair'"), "chaired_stage")
    panel = deepest(out.filter("panel_role <> 'chair'"), "panel_stage")
    return chairs.join(top, ["person_id", at], "left").join(panel, ["person_id", at], "left")


def best_judge_row(rows: DataFrame) -> DataFrame:
    """One judging record of each person: a tag counts 1, chaired rounds 1 each, a chaired elimination 5, a panel 3; the first on ties."""
    score = F.coalesce("chaired", F.lit(0)) + F.when(F.col("chaired_stage").isNotNull(), 5).otherwise(0) + F.when(F.col("panel_stage").isNotNull(), 3).otherwise(0) + F.when(F.col("tag").isNotNull(), 1).otherwise(0)
    return first_by(rows.withColumn("score", score), ["person_id"], F.desc("score"), F.asc("slot")).select("person_id", "slot", "score")


def judging_seasons(records: DataFrame) -> DataFrame:
    """By year: tournaments judged, rounds chaired, tournaments with an elimination stage."""
    out = F.col("chaired_stage").isNotNull() | F.col("panel_stage").isNotNull()
    return records.filter("year is not null").groupBy("person_id", "year").agg(F.count("*").alias("tournaments"), F.coalesce(F.sum("chaired"), F.lit(0)).alias("chaired"), F.count_if(out).alias("with_outround"))


def top_break_limit(teams: Column) -> Column:
    return F.ceil(teams.cast("double") * F.lit(0.1).cast("double")).cast("bigint")


# Names of major events.
MAJORS = r"(?i)\b(?:wudc|world(?: university)? debating|eudc|european debating|australs|asian debating|naudc|north american debating)\b"


def highlights(entry: DataFrame, averages: DataFrame, records: DataFrame, tournament: DataFrame, majors: str = MAJORS, most: int = 5) -> DataFrame:
    """By person, over speaking and judging: tournaments won (the first ``most`` of them), top breaks, best open rank and best average with
    where they were, elimination rounds chaired, times in the adjudication core, majors by distinct name and year, first and last year.
    Rows come by year (latest first, undated last), then name; of equal bests the first counts. Averages are as published: text that is no
    number counts for nothing. records: judging, one row for each person and tid, with ``tag``."""
    t = tournament.select("tid", "name", "year", "teams").withColumn("at", F.struct((-F.col("year")).isNull(), -F.col("year"), F.collate("name", "UNICODE"), "tid"))
    s = entry.join(averages, ["person_id", "tid"], "left").join(t, "tid").withColumn("score", F.nullif(F.col("average").try_cast("double"), F.lit(float("nan"))))
    titled = F.array_sort(F.collect_list(F.when(F.col("champion"), F.struct("at", F.concat_ws(" ", "name", "year").alias("title")))))
    best = lambda value, by: F.min(F.when(F.col(value).isNotNull(), F.struct(by.alias("by"), "at", F.col(value).alias("value"), "name")))
    spoken = s.groupBy("person_id").agg(
        F.array_join(F.transform(F.slice(titled, 1, most), lambda x: x["title"]), "; ").alias("titles"),
        F.count_if(F.col("broke") & (F.col("teams") > 0) & (F.col("open_rank") <= top_break_limit(F.col("teams")))).alias("top_breaks"),
        best("open_rank", F.col("open_rank").cast("double")).alias("r"), best("score", -F.col("score")).alias("a"),
    )
    judged = records.groupBy("person_id").agg(F.count("chaired_stage").alias("outrounds_chaired"), F.count_if(F.col("tag") == "core").alias("core"))
    there = entry.select("person_id", "tid").unionByName(records.select("person_id", "tid")).join(t, "tid")
    both = there.groupBy("person_id").agg(
        F.count_distinct(F.when(F.col("name").rlike(majors), F.struct("name", F.coalesce("year", F.lit(0))))).alias("majors"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.join(spoken, "person_id", "left").join(judged, "person_id", "left").select(
        "person_id", F.coalesce("titles", F.lit("")).alias("titles"), zero("top_breaks"), F.col("r.value").alias("best_rank"), F.col("r.name").alias("best_rank_at"), F.col("a.value").alias("best_average"),
        F.col("a.name").alias("best_average_at"), zero("outrounds_chaired"), zero("core"), "majors", "first_year", "last_year",
    )


def top_breaks(entry: DataFrame, tournament: DataFrame, most: int = 5) -> DataFrame:
    """The best-ranked top breaks of each person."""
    j = entry.join(tournament, "tid").filter(F.col("broke") & (F.col("teams") > 0) & (F.col("open_rank") <= top_break_limit(F.col("teams"))))
    w = Window.partitionBy("person_id").orderBy("open_rank", "tid")
    return j.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= most).select("person_id", "place", "tid", "open_rank", "teams")


def upper_median(values: Column) -> Column:
    """The middle value of a list, the upper of two; null below three."""
    s = F.array_sort(values)
    return F.when(F.size(s) >= 3, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


# Words of a tournament's name that tell its format, in order.
FORMAT_NAMES = [
    (r"(?i)british parliamentary|\bbp\b", "British Parliamentary"),
    (r"(?i)asian parliamentary", "Asian Parliamentary"),
    (r"(?i)worlds schools|\bwsdc\b", "World Schools"),
    (r"(?i)^(?!.*public\s*policy).*\bpolicy\b", "Policy"),
    (r"(?i)lincoln[-\s]?douglas|\bld\b", "Lincoln-Douglas"),
    (r"(?i)public forum|\bpf\b", "Public Forum"),
    (r"(?i)\bwudc\b|\beudc\b|\baudc\b|\bnaudc\b|\babp\b|\bbpp\b", "British Parliamentary"),
]
TEAM_SIZES = {2: "British Parliamentary", 3: "Asian Parliamentary"}


def format_of(name: Column, *sizes: Column) -> Column:
    """Format by the name, else by the first team size (or upper median of sizes) that tells one."""
    out = F.lit(None).cast("string")
    for size in reversed(sizes):
        by_size = F.lit(None).cast("string")
        for n, value in TEAM_SIZES.items():
            by_size = F.when(size == n, F.lit(value)).otherwise(by_size)
        out = F.coalesce(by_size, out)
    for pattern, value in reversed(FORMAT_NAMES):
        out = F.when(name.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def cv_totals(entry: DataFrame, records: DataFrame) -> DataFrame:
    """By person: tournaments, breaks and chaired rounds over speaking and judging."""
    s = entry.select("person_id", F.when(F.col("broke"), 1).otherwise(0).alias("broke"), F.lit(0).cast("bigint").alias("chaired"))
    j = records.select("person_id", F.when(F.col("chaired_stage").isNotNull(), 1).otherwise(0).alias("broke"), F.coalesce("chaired", F.lit(0)).alias("chaired"))
    return s.unionByName(j).groupBy("person_id").agg(F.count("*").alias("entries"), F.sum("broke").alias("breaks"), F.sum("chaired").alias("chaired"))


def motion_totals(rounds: DataFrame, motion: DataFrame) -> DataFrame:
    """By person, over rounds with each of their motions: debated, tagged, mean of scored, decided, wins, tournaments. Motions are counted
    by round first."""
    counts = motion.groupBy("tid", "round").agg(F.count("*").alias("credits"), F.count_if(F.col("type").isNotNull() | F.col("topic").isNotNull()).alias("tagged"))
    sums = lambda when: F.coalesce(F.sum(F.when(when, F.col("credits"))), F.lit(0).cast("bigint"))
    out = rounds.join(counts, ["tid", "round"]).groupBy("person_id").agg(
        F.sum("credits").alias("debated"), F.sum("tagged").alias("tagged"), credited_mean("score").alias("avg_score"),
        sums(F.col("won").isNotNull()).alias("decided"), sums(F.col("won")).alias("wins"), F.count_distinct("tid").alias("tournaments"),
    )
    return out.withColumn("win_rate", ratio(F.col("wins"), F.col("decided")))
