"""Domain facts over the driver's tables, for queries and their oracles.

Each fact is a DataFrame here and a common table expression of the same name in
:data:`FACTS_SQL` (DuckDB). Facts are in exploded form: one row per speech, per
team and round, per motion, and so on, for all persons at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week(ts: Column) -> Column:
    """Weeks since Monday 1970-01-05."""
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-05").cast("date")) / 7).cast("bigint")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every round of a person at a tournament: a week of the person's events, in order."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), "ts", "event_type", F.col("value").alias("raw"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"))
    e = e.withColumn("tid", week(F.col("ts")))
    seat = F.when(F.col("event_type") == "view", "OG").when(F.col("event_type") == "click", "OO").when(F.col("event_type") == "purchase", "CG").when(F.col("event_type") == "signup", "CO")
    order = Window.partitionBy("person_id", "tid").orderBy("ts", "event_id")
    k = F.col("k")
    return e.withColumn("round", F.row_number().over(order).cast("bigint")).select(
        "event_id", "person_id", "tid", "round", "ts", "k", seat.alias("position"), "raw", F.when(k % 5 != 0, k % 2 == 1).alias("won"), F.when(k % 9 != 0, k % 4).alias("points")
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored speeches; a score may be unpublished (null)."""
    r = rounds(spark, sf_dir).filter("k % 13 <> 0")
    return r.select("event_id", "person_id", "tid", "round", "position", F.when(F.col("k") % 11 != 0, F.col("raw")).alias("score"))


def team_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a person's team by round; won is null while undecided."""
    return rounds(spark, sf_dir).filter("k % 17 <> 0").select("event_id", "person_id", "tid", "round", "position", "won", "points")


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(week(F.col("ts")).alias("tid")).distinct()
    i = F.col("tid") % 5
    return t.select(
        "tid",
        F.concat(F.lit("Cup "), F.col("tid").cast("string")).alias("name"),
        F.when(i != 4, 2019 + i).alias("year"),
        F.when(F.col("tid") % 4 == 0, "British Parliamentary").when(F.col("tid") % 4 == 1, "Asian Parliamentary").when(F.col("tid") % 4 == 2, "World Schools").alias("format"),
        F.when(F.col("tid") % 3 == 0, "Europe").when(F.col("tid") % 3 == 1, "South Asia").alias("region"),
        F.when(i == 0, 12).when(i == 1, 40).when(i == 2, 64).when(i == 3, 120).cast("bigint").alias("teams"),
        F.when(i < 3, 5 + i).alias("prelims"),
    )


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's participation in a tournament as a speaker."""
    e = rounds(spark, sf_dir).groupBy("person_id", "tid").agg(F.count("*").alias("rounds"), F.round(F.sum("raw"), 2).alias("total"), F.count_if(F.col("won")).alias("wins"), F.sum("points").alias("points"))
    x = F.col("person_id") + F.col("tid")
    return e.select(
        "person_id", "tid", "rounds", F.when(x % 7 != 0, F.col("total")).alias("total"), "wins", F.coalesce("points", F.lit(0)).alias("points"),
        F.concat(F.lit("Team "), F.floor(F.col("person_id") / 2).cast("string")).alias("team"),
        F.when(x % 6 != 0, (F.col("person_id") * 7 + F.col("tid") * 3) % 40 + 1).alias("team_rank"),
        F.when(x % 4 == 0, F.col("person_id") % 16 + 1).alias("break_rank"),
        (x % 4 == 0).alias("broke"),
        F.when(x % 12 == 0, "Grand Final").when(x % 12 == 4, "ESL Semifinals").when(x % 12 == 8, "QF").alias("elimination"),
        F.when(x % 5 != 0, F.col("person_id") % 30 + 1).alias("open_rank"), F.when(x % 8 == 1, F.col("person_id") % 9 + 1).alias("esl_rank"), F.when(x % 16 == 1, F.col("person_id") % 5 + 1).alias("efl_rank"),
        ((x % 12 == 0) & (F.floor(F.col("person_id") / 2) % 2 == 0)).alias("champion"),
    )


def _span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first, tids), one row: the first tournament, and how many follow each other."""
    return table(spark, sf_dir, "events").agg(F.min(week(F.col("ts"))).alias("first"), (F.max(week(F.col("ts"))) - F.min(week(F.col("ts"))) + 1).alias("tids"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motions: every part in one round of one tournament; some rounds have several, and some are those of rounds that nobody debated."""
    p, n = table(spark, sf_dir, "part").join(F.broadcast(_span(spark, sf_dir))), F.floor(F.col("p_partkey") / F.col("tids"))
    return p.select(
        F.col("p_partkey").alias("motion_id"), (F.col("first") + F.col("p_partkey") % F.col("tids")).alias("tid"), (1 + n % 97).cast("bigint").alias("round"), (F.col("p_partkey") % 3).alias("seq"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("type"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_brand")).alias("topic"), F.col("p_name").alias("text"),
    )


def judging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels that a person judged on, at one of the first five tournaments (slot 0 to 4)."""
    o = table(spark, sf_dir, "orders").join(F.broadcast(_span(spark, sf_dir)))
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "Grand Final").when(F.col("o_orderpriority") == "2-HIGH", "SF").when(F.col("o_orderpriority") == "5-LOW", "Octofinals")
    n = (F.col("o_orderkey") % 6 + 1).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("assignment_id"), (F.col("o_custkey") % 150).alias("person_id"), (F.col("o_orderkey") % 5).alias("slot"), (F.col("first") + F.col("o_orderkey") % 5).alias("tid"),
        F.coalesce(stage, F.concat(F.lit("R"), n.cast("string"))).alias("stage"), F.when(stage.isNull(), n).alias("round"),
        F.when(F.col("o_orderstatus") == "O", "chair").when(F.col("o_orderstatus") == "F", "panellist").otherwise("trainee").alias("panel_role"),
    )


def job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest queue."""
    o = table(spark, sf_dir, "orders")
    host = F.concat(F.lower(F.regexp_replace("o_orderpriority", r"[^A-Za-z]", "")), F.lit(".example.org"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 4 == 0, "running").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("https://"), host, F.lit("/t"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/privateurls/x"), F.col("o_custkey").cast("string")).alias("url"),
        status.alias("status"), (F.col("o_orderkey") % 5).alias("attempts"),
        F.when(status == "failed", F.when(F.col("o_orderkey") % 3 == 0, "fetch landing: HTTP 404 for page").when(F.col("o_orderkey") % 3 == 1, "deadlock detected").otherwise("parse: no table")).alias("last_error"),
        F.col("o_orderdate").alias("scheduled_at"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate") + F.expr("INTERVAL 10 MINUTES")).alias("started_at"),
        F.when(status.isin("done", "failed"), F.col("o_orderdate") + F.expr("INTERVAL 10 MINUTES") + F.make_dt_interval(secs=F.col("o_orderkey") % 700)).alias("finished_at"),
    )


FACTS_SQL = r"""
WITH RECURSIVE rounds AS (
  SELECT event_id, user_id AS person_id, tid, row_number() OVER (PARTITION BY user_id, tid ORDER BY ts, event_id) AS round, ts, k,
         CASE event_type WHEN 'view' THEN 'OG' WHEN 'click' THEN 'OO' WHEN 'purchase' THEN 'CG' WHEN 'signup' THEN 'CO' END AS position,
         value AS raw, CASE WHEN k % 5 <> 0 THEN k % 2 = 1 END AS won, CASE WHEN k % 9 <> 0 THEN k % 4 END AS points
  FROM (SELECT *, floor(date_diff('day', DATE '1970-01-05', ts::DATE) / 7)::BIGINT AS tid, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events)
), speech AS (
  SELECT event_id, person_id, tid, round, position, CASE WHEN k % 11 <> 0 THEN raw END AS score FROM rounds WHERE k % 13 <> 0
), team_round AS (
  SELECT event_id, person_id, tid, round, position, won, points FROM rounds WHERE k % 17 <> 0
), tournament AS (
  SELECT tid, 'Cup ' || tid AS name, CASE WHEN tid % 5 <> 4 THEN 2019 + tid % 5 END AS year,
         CASE tid % 4 WHEN 0 THEN 'British Parliamentary' WHEN 1 THEN 'Asian Parliamentary' WHEN 2 THEN 'World Schools' END AS format,
         CASE tid % 3 WHEN 0 THEN 'Europe' WHEN 1 THEN 'South Asia' END AS region,
         CASE tid % 5 WHEN 0 THEN 12 WHEN 1 THEN 40 WHEN 2 THEN 64 WHEN 3 THEN 120 END::BIGINT AS teams,
         CASE WHEN tid % 5 < 3 THEN 5 + tid % 5 END AS prelims
  FROM (SELECT DISTINCT tid FROM rounds)
), entry AS (
  SELECT person_id, tid, rounds, CASE WHEN x % 7 <> 0 THEN total END AS total, wins, coalesce(points, 0) AS points, 'Team ' || (person_id // 2) AS team,
         CASE WHEN x % 6 <> 0 THEN (person_id * 7 + tid * 3) % 40 + 1 END AS team_rank, CASE WHEN x % 4 = 0 THEN person_id % 16 + 1 END AS break_rank, x % 4 = 0 AS broke,
         CASE x % 12 WHEN 0 THEN 'Grand Final' WHEN 4 THEN 'ESL Semifinals' WHEN 8 THEN 'QF' END AS elimination, CASE WHEN x % 5 <> 0 THEN person_id % 30 + 1 END AS open_rank,
         CASE WHEN x % 8 = 1 THEN person_id % 9 + 1 END AS esl_rank, CASE WHEN x % 16 = 1 THEN person_id % 5 + 1 END AS efl_rank, x % 12 = 0 AND person_id // 2 % 2 = 0 AS champion
  FROM (SELECT person_id, tid, person_id + tid AS x, count(*) AS rounds, round(sum(raw), 2) AS total, count(*) FILTER (WHERE won) AS wins, sum(points)::BIGINT AS points FROM rounds GROUP BY ALL)
), weeks AS (
  SELECT min(tid) AS first, max(tid) - min(tid) + 1 AS tids FROM rounds
), motion AS (
  SELECT p_partkey AS motion_id, first + p_partkey % tids AS tid, (1 + p_partkey // tids % 97)::BIGINT AS round, p_partkey % 3 AS seq,
         CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS type, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS topic, p_name AS text
  FROM part, weeks
), judging AS (
  SELECT o_orderkey AS assignment_id, o_custkey % 150 AS person_id, o_orderkey % 5 AS slot, first + o_orderkey % 5 AS tid, coalesce(st, 'R' || (o_orderkey % 6 + 1)) AS stage,
         CASE WHEN st IS NULL THEN o_orderkey % 6 + 1 END AS round, CASE o_orderstatus WHEN 'O' THEN 'chair' WHEN 'F' THEN 'panellist' ELSE 'trainee' END AS panel_role
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'Grand Final' WHEN '2-HIGH' THEN 'SF' WHEN '5-LOW' THEN 'Octofinals' END AS st FROM orders, weeks)
), job AS (
  SELECT o_orderkey AS job_id, o_custkey AS user_id,
         'https://' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) || '.example.org/t' || (o_orderkey % 50) || '/privateurls/x' || o_custkey AS url,
         status, o_orderkey % 5 AS attempts,
         CASE WHEN status = 'failed' THEN CASE o_orderkey % 3 WHEN 0 THEN 'fetch landing: HTTP 404 for page' WHEN 1 THEN 'deadlock detected' ELSE 'parse: no table' END END AS last_error,
         o_orderdate AS scheduled_at, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL 10 MINUTE END AS started_at,
         CASE WHEN status IN ('done', 'failed') THEN o_orderdate + INTERVAL 10 MINUTE + to_seconds(o_orderkey % 700) END AS finished_at
  FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'failed' END AS status FROM orders)
)
"""


class Catalog:
    """Queries with their oracle SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function (spark, sf_dir) -> DataFrame under its name; sql continues :data:`FACTS_SQL`."""

        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = FACTS_SQL + sql
            return f

        return add
