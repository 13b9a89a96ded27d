"""Win records: splits by dimension, streaks, partners, seasons, volume, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.numbers import credited_mean, ratio
from rostrum.functions.stages import canonical_position, field_size, outround_stage
from rostrum.operators.spread import join_crowded, large_groups, longest_streaks, pairs


def merged_rounds(speech: DataFrame, team_round: DataFrame) -> DataFrame:
    """Published scores and results of each person's rounds, rounds of either side only included; of repeated rounds, the last row of a
    side counts. The seat is the result's: a round that was scored only has none."""
    keys = ["person_id", "tid", "round"]
    s = speech.filter("score is not null").groupBy(*keys).agg(F.max_by("score", "event_id").alias("score"))
    t = team_round.groupBy(*keys).agg(F.max_by(F.struct("won", "points", "position"), "event_id").alias("r"))
    return s.join(t, keys, "full").select(*keys, "score", "r.won", "r.points", "r.position")


def with_motions(rounds: DataFrame, motion: DataFrame) -> DataFrame:
    """Every round with each of its motions: a round with two motions credits both. Rounds of a tournament that many persons debated are
    dealt over tasks, and each is laid out over many of its motions at a time."""
    m = motion.select("tid", "round", "motion_id", "type", "topic")
    return pairs(rounds, m, ["tid", "round"], "left").select(*rounds.columns, "motion_id", "type", "topic")


PLAIN, OF_MOTIONS = ("position", "format", "region", "season", "field_size"), {"motion_type": "type", "topic": "topic"}
#: Counts of motions by round and key that are sent to every task; if there are more, rounds are joined with them by shuffles.
SENT_KEYS = 1_000_000


def split_credits(rounds: DataFrame, tournament: DataFrame, motion: DataFrame, dims: Sequence[str] = (*PLAIN, *OF_MOTIONS)) -> DataFrame:
    """:func:`split_rows` of some dimensions with equal rows as one: ``credits`` tells how many. A round has one row for all its motions of
    a type or topic, and motions are not read unless their dimensions are wanted."""
    base, of_motions = ["person_id", "tid", "score", "won", "points"], [d for d in dims if d in OF_MOTIONS]
    parts = []
    if plain := [d for d in dims if d in PLAIN]:
        keys = {"position": canonical_position(F.col("position")), "format": F.coalesce("format", F.lit("Unknown")), "region": F.col("region"), "season": F.col("year").cast("string"), "field_size": field_size(F.col("teams"))}
        t = tournament.select("tid", "year", "format", "region", "teams")
        known = rounds if plain == ["position"] else rounds.join(t, "tid", "left")
        each = known.select(*base, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), keys[d].alias("key")) for d in plain])).alias("s"))
        parts.append(each.select(*base, "s.dim", "s.key", F.lit(1).cast("bigint").alias("credits")).filter("key is not null and key <> ''"))
    if of_motions:
        named = motion.select("tid", "round", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(OF_MOTIONS[d]).alias("key")) for d in of_motions])).alias("s"))
        counts = named.select("tid", "round", "s.dim", "s.key").filter("key is not null and key <> ''").groupBy("tid", "round", "dim", "key").agg(F.count("*").alias("credits"))
        if counts.count() <= SENT_KEYS:
            # a person's rounds are in one task, so what they are credited with is summed up where it arises
            fan = rounds.repartition("person_id").join(F.broadcast(counts), ["tid", "round"])
        else:
            fan = join_crowded(rounds, counts, ["tid", "round"], F.xxhash64("person_id"))
        parts.append(fan.select(*base, "dim", "key", "credits"))
    return reduce(DataFrame.unionByName, parts)


def split_rows(rounds: DataFrame, tournament: DataFrame, motion: DataFrame) -> DataFrame:
    """(person_id, dim, key, tid, score, won, points): each round under the keys of seven dimensions; empty keys are left out."""
    t = tournament.select("tid", "year", "format", "region", "teams")
    plain = rounds.join(t, "tid", "left")
    dims = {"position": canonical_position(F.col("position")), "format": F.coalesce("format", F.lit("Unknown")), "region": F.col("region"), "season": F.col("year").cast("string"), "field_size": field_size(F.col("teams"))}
    base = ["person_id", "tid", "score", "won", "points"]
    one = plain.select(*base, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), k.alias("key")) for d, k in dims.items()])).alias("s"))
    # motions come at their own grain: other dimensions are settled before this fan-out
    fan = with_motions(rounds, motion)
    two = fan.select(*base, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("key")) for d, c in (("motion_type", "type"), ("topic", "topic"))])).alias("s"))
    return one.unionByName(two).select(*base, "s.dim", "s.key").filter("key is not null and key <> ''")


def tally() -> list[Column]:
    """Over rows that count ``credits`` times."""
    won, n = F.col("won"), F.col("credits")
    counted = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0).cast("bigint"))
    return [
        F.sum(n).alias("rounds"), F.count_distinct("tid").alias("tournaments"), counted(won.isNotNull()).alias("decided"), counted(won).alias("wins"),
        credited_mean("score").alias("avg_score"), credited_mean("points").alias("avg_points"),
    ]


def baseline(speech: DataFrame, rounds: DataFrame) -> DataFrame:
    """Mean score and win rate of each person, to hold splits against."""
    s = speech.groupBy("person_id").agg(F.avg("score").alias("base_score"))
    r = rounds.groupBy("person_id").agg(ratio(F.count_if("won"), F.count("won")).alias("base_rate"))
    return s.join(r, "person_id", "full")


def splits(credits: DataFrame, base: DataFrame) -> DataFrame:
    """One groupBy for all dimensions of :func:`split_credits`; deltas against the person's own baseline, win rates in percentage points."""
    agg = credits.groupBy("person_id", "dim", "key").agg(*tally()).withColumn("win_rate", ratio(F.col("wins"), F.col("decided")))
    out = agg.join(base, "person_id", "left")
    return out.select("person_id", "dim", "key", "rounds", "tournaments", "decided", "wins", "win_rate", "avg_score", "avg_points", (F.col("avg_score") - F.col("base_score")).alias("score_delta"), ((F.col("win_rate") - F.col("base_rate")) * 100).alias("win_rate_delta"))


def record(rounds: DataFrame) -> DataFrame:
    """Decided rounds, wins, win rate, mean points of each person."""
    return rounds.groupBy("person_id").agg(F.count("won").alias("decided"), F.count_if("won").alias("wins"), ratio(F.count_if("won"), F.count("won")).alias("win_rate"), F.avg("points").alias("avg_points"))


def points_distribution(rounds: DataFrame) -> DataFrame:
    return rounds.filter("points is not null").groupBy("person_id", "points").agg(F.count("*").alias("rounds"))


def streaks(rounds: DataFrame, tournament: DataFrame) -> DataFrame:
    """Longest runs of wins and of losses over decided rounds, in order of year (undated last), tournament name, round."""
    d = rounds.filter("won is not null").join(tournament.select("tid", "name", "year"), "tid")
    rows = d.select("person_id", "year", F.collate("name", "UNICODE").alias("name"), "round", "won")
    order = {"year": "asc_nulls_last", "name": "asc", "round": "asc"}
    return longest_streaks(rows, ["person_id"], order, "won", large_groups(rows, ["person_id"])).withColumnsRenamed({"won": "win_streak", "lost": "loss_streak"})


def teammates(entry: DataFrame) -> DataFrame:
    """(person_id, tid, mate): the others of one's team at a tournament."""
    mate = entry.select("tid", "team", F.col("person_id").alias("mate"))
    return entry.select("person_id", "tid", "team").join(mate, ["tid", "team"]).filter("person_id <> mate").select("person_id", "tid", "mate")


def partners(mates: DataFrame, entry: DataFrame, rounds: DataFrame, base: DataFrame) -> DataFrame:
    """By teammate: tournaments and breaks together, pooled scores and decisions, delta of the win rate."""
    per = rounds.groupBy("person_id", "tid").agg(F.sum("score").alias("s"), F.count("score").alias("n"), F.count("won").alias("decided"), F.count_if("won").alias("wins"))
    joined = mates.join(entry.select("person_id", "tid", "broke"), ["person_id", "tid"]).join(per, ["person_id", "tid"], "left")
    agg = joined.groupBy("person_id", "mate").agg(F.count("*").alias("tournaments"), F.count_if("broke").alias("breaks"), ratio(F.sum("s"), F.sum("n")).alias("avg_score"), F.coalesce(F.sum("decided"), F.lit(0)).alias("decided"), F.coalesce(F.sum("wins"), F.lit(0)).alias("wins"))
    rate = ratio(F.col("wins"), F.col("decided"))
    return agg.withColumn("win_rate", rate).join(base, "person_id", "left").select("person_id", "mate", "tournaments", "breaks", "avg_score", "decided", "win_rate", ((rate - F.col("base_rate")) * 100).alias("win_rate_delta"))


def seasons(entry: DataFrame, averages: DataFrame, tournament: DataFrame) -> DataFrame:
    """By year: tournaments, mean of their averages (as published), breaks, break rate, best open rank. Undated tournaments are left out."""
    joined = entry.join(averages, ["person_id", "tid"], "left").join(tournament.select("tid", "year"), "tid").filter("year is not null")
    value = F.col("average").try_cast("double")
    return joined.groupBy("person_id", "year").agg(F.count("*").alias("tournaments"), F.avg(value).alias("avg"), F.count_if("broke").alias("breaks"), ratio(F.count_if("broke"), F.count("*")).alias("break_rate"), F.min("open_rank").alias("best_rank"))


def volume(rounds: DataFrame, entry: DataFrame, tournament: DataFrame, mates: DataFrame, records: DataFrame) -> DataFrame:
    """Tournaments spoken at and judged, rounds, speeches, elimination rounds, chaired rounds, years over both roles, formats and partners
    of each person. records: judging, one row for each person and tid."""
    r = rounds.groupBy("person_id", "tid").agg(F.count_distinct("round").alias("rounds"), F.count("score").alias("speeches")).groupBy("person_id").agg(F.sum("rounds").alias("rounds"), F.sum("speeches").alias("speeches"))
    none = F.lit(None)
    spoken = entry.select("person_id", "tid", F.lit(True).alias("spoke"), F.col("elimination").isNotNull().alias("out"), none.cast("bigint").alias("chaired"))
    judged = records.select("person_id", "tid", F.lit(False).alias("spoke"), F.lit(False).alias("out"), "chaired")
    both = spoken.unionByName(judged).join(tournament.select("tid", "year", "format"), "tid", "left")
    e = both.groupBy("person_id").agg(
        F.count_if("spoke").alias("tournaments"), F.count_if(~F.col("spoke")).alias("judged"), F.count_if("out").alias("outrounds"), F.coalesce(F.sum("chaired"), F.lit(0)).alias("rounds_chaired"),
        (F.max("year") - F.min("year") + 1).alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct(F.when(F.col("spoke"), F.col("format"))).alias("formats"),
    )
    m = mates.groupBy("person_id").agg(F.count_distinct("mate").alias("partners"))
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rounds", "speeches", "partners")]
    return e.join(r, "person_id", "left").join(m, "person_id", "left").select(*e.columns, *counted)


def coverage(entry: DataFrame, tournament: DataFrame) -> DataFrame:
    """For how many of a person's tournaments each kind of data is there."""
    j = entry.join(tournament, "tid")
    return j.groupBy("person_id").agg(F.count("*").alias("tournaments"), F.count("total").alias("with_total"), F.count_if(F.col("team_rank").isNotNull() | F.col("open_rank").isNotNull()).alias("with_rank"), F.count("year").alias("with_year"), F.count("region").alias("with_region"))


def rates(entry: DataFrame) -> DataFrame:
    """Break, final and champion rates over tournaments."""
    final = outround_stage(F.col("elimination")).isin("grand_final", "final")
    n = F.count("*")
    return entry.groupBy("person_id").agg(n.alias("tournaments"), F.count_if("broke").alias("breaks"), ratio(F.count_if("broke"), n).alias("break_rate"), ratio(F.count_if(final), n).alias("final_rate"))
