"""Queries over scores: profiles, histograms, dynamics, field context."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.numbers import r6
from rostrum.operators import field, scores
from rostrum.plans import facts
from rostrum.plans.facts import Catalog

CATALOG = Catalog()
query = CATALOG.query

_SD = "CASE WHEN count(score) >= 2 THEN stddev_pop(score) END"


@query(f"""
SELECT person_id, count(score) AS n, round(avg(score), 6) AS mean, round({_SD}, 6) AS stdev, min(score) AS low, max(score) AS high,
  round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median,
  round(quantile_cont(score, 0.75), 6) AS q3, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr
FROM speech GROUP BY person_id""")
def agg_06_score_profile(spark, sf_dir):
    out = scores.score_profile(facts.speech(spark, sf_dir))
    return out.select("person_id", "n", "low", "high", *[r6(F.col(c)).alias(c) for c in ("mean", "stdev", "p10", "q1", "median", "q3", "p90", "iqr")])


@query("""
, s AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, tid, round) AS b, row_number() OVER (PARTITION BY person_id ORDER BY score, tid, round) AS w FROM speech WHERE score IS NOT NULL)
SELECT person_id, max(tid) FILTER (WHERE b = 1) AS best_tid, max(round) FILTER (WHERE b = 1) AS best_round, max(score) FILTER (WHERE b = 1) AS best_score,
  max(tid) FILTER (WHERE w = 1) AS worst_tid, max(round) FILTER (WHERE w = 1) AS worst_round, max(score) FILTER (WHERE w = 1) AS worst_score
FROM s GROUP BY person_id""")
def agg_06_extremes(spark, sf_dir):
    return scores.extremes(facts.speech(spark, sf_dir), ["tid", "round"])


_SPAN = """
, span AS (SELECT person_id, low, high, mean, (CASE WHEN high - low <= 20 THEN 1 WHEN high - low <= 40 THEN 2 ELSE ceil((high - low) / 20) END)::BIGINT AS width
  FROM (SELECT person_id, floor(min(score))::BIGINT AS low, floor(max(score))::BIGINT AS high, avg(score) AS mean FROM speech WHERE score IS NOT NULL GROUP BY person_id))"""


@query(_SPAN + """
, bins AS (SELECT person_id, low, width, unnest(range(0, (high - low) // width + 1)) AS bin FROM span)
, counts AS (SELECT person_id, floor((score - low) / width)::BIGINT AS bin, count(*) AS n FROM speech JOIN span USING (person_id) WHERE score IS NOT NULL GROUP BY ALL)
SELECT person_id, bin, low + bin * width AS "from", low + (bin + 1) * width AS "to", coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING (person_id, bin)""")
def agg_07_histogram(spark, sf_dir):
    return scores.histogram(facts.speech(spark, sf_dir))


@query(_SPAN + " SELECT person_id, least(floor((mean - low) / width)::BIGINT, (high - low) // width) AS mean_bin FROM span")
def agg_08_mean_bin(spark, sf_dir):
    return scores.mean_bin(facts.speech(spark, sf_dir))


@query("""
, r AS (SELECT person_id, round, count(score) AS n, avg(score) AS mean FROM speech GROUP BY ALL HAVING count(score) > 0)
, x AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY CASE WHEN n >= 2 THEN mean END DESC NULLS LAST, round) AS b,
  row_number() OVER (PARTITION BY person_id ORDER BY CASE WHEN n >= 2 THEN mean END ASC NULLS LAST, round) AS w FROM r)
SELECT person_id, round, n, round(mean, 6) AS mean, n >= 2 AND b = 1 AS is_best, n >= 2 AND w = 1 AS is_worst FROM x""")
def agg_10_round_profile(spark, sf_dir):
    return scores.round_profile(facts.speech(spark, sf_dir)).withColumn("mean", r6(F.col("mean")))


@query("""
, s AS (SELECT *, row_number() OVER (PARTITION BY person_id, tid ORDER BY round, event_id) AS i, count(*) OVER (PARTITION BY person_id, tid) AS n FROM speech WHERE score IS NOT NULL)
SELECT person_id, round(avg(score) FILTER (WHERE i <= 3), 6) AS opening, round(avg(score) FILTER (WHERE n - i < 3), 6) AS closing, count(DISTINCT tid) AS samples,
  round(avg(score) FILTER (WHERE n - i < 3) - avg(score) FILTER (WHERE i <= 3), 6) AS momentum
FROM s WHERE n >= 6 GROUP BY person_id""")
def agg_11_momentum(spark, sf_dir):
    out = scores.momentum(facts.speech(spark, sf_dir))
    return out.select("person_id", "samples", *[r6(F.col(c)).alias(c) for c in ("opening", "closing", "momentum")])


@query(f"""
, t AS (SELECT person_id, tid, CASE WHEN count(*) >= 3 THEN regr_slope(score, round) END AS slope, {_SD} AS sd FROM speech WHERE score IS NOT NULL GROUP BY ALL)
SELECT person_id, round(avg(slope), 6) AS slope, round(avg(sd), 6) AS stdev_within, count(slope) AS slopes FROM t GROUP BY person_id""")
def agg_12_ols_slope(spark, sf_dir):
    out = scores.trends(facts.speech(spark, sf_dir))
    return out.select("person_id", "slopes", r6(F.col("slope")).alias("slope"), r6(F.col("stdev_within")).alias("stdev_within"))


@query(f"""
, t AS (SELECT person_id, tid, {_SD} AS sd FROM speech WHERE score IS NOT NULL GROUP BY ALL)
SELECT person_id, round(avg(sd), 6) AS stdev_within FROM t GROUP BY person_id""")
def agg_13_stdev_within(spark, sf_dir):
    return scores.trends(facts.speech(spark, sf_dir)).select("person_id", r6(F.col("stdev_within")).alias("stdev_within"))


_SLICES = """
, s AS (SELECT *, row_number() OVER (PARTITION BY person_id, tid ORDER BY round, event_id) AS i, count(*) OVER (PARTITION BY person_id, tid) AS n FROM speech WHERE score IS NOT NULL)"""


@query(_SLICES + " SELECT person_id, tid, round, i <= 3 AS opens, n - i < 3 AS closes FROM s WHERE i <= 3 OR n - i < 3")
def win_07_first_last_slices(spark, sf_dir):
    return field.end_slices(facts.speech(spark, sf_dir), 3)


_AVERAGE = """
, p AS (SELECT s.person_id, s.tid, total, spoken, cell_mean, CASE WHEN prelims > 0 THEN prelims WHEN team_rounds > 0 THEN team_rounds WHEN speaker_rounds > 0 THEN speaker_rounds END AS prelims, own_rounds
  FROM (SELECT person_id, tid, total FROM entry) s
  LEFT JOIN tournament USING (tid)
  LEFT JOIN (SELECT tid, max(round) AS team_rounds FROM team_round WHERE round > 0 GROUP BY tid) USING (tid)
  LEFT JOIN (SELECT tid, max(round) AS speaker_rounds FROM speech WHERE round > 0 AND coalesce(position, '') <> 'average' GROUP BY tid) USING (tid)
  LEFT JOIN (SELECT person_id, tid, count(score) AS spoken, avg(score) AS cell_mean, count(score) AS own_rounds FROM speech GROUP BY ALL) c USING (person_id, tid))"""


@query(_AVERAGE + " SELECT DISTINCT tid, prelims FROM p")
def proj_08_prelim_count(spark, sf_dir):
    return field.prelims(facts.tournament(spark, sf_dir), facts.team_round(spark, sf_dir), facts.speech(spark, sf_dir))


_FIXED = "CASE WHEN abs({x} * 4) % 2 = 1 THEN printf('%.1f', sign({x}) * floor(abs({x}) * 10 + 0.5) / 10) ELSE printf('%.1f', {x}) END"


@query(_AVERAGE + ", v AS (SELECT person_id, tid, coalesce(CASE WHEN spoken > 0 THEN total / spoken END, cell_mean, CASE WHEN prelims > 0 THEN total / prelims END) AS x FROM p) SELECT person_id, tid, " + _FIXED.format(x="x") + " AS average FROM v")
def proj_09_speaker_average(spark, sf_dir):
    return field.averages(facts.entry(spark, sf_dir), facts.speech(spark, sf_dir), field.prelims(facts.tournament(spark, sf_dir), facts.team_round(spark, sf_dir), facts.speech(spark, sf_dir)))


_FIELD = _AVERAGE + """
, cell AS (SELECT person_id, tid, total / nullif(prelims, 0) AS x, own_rounds, prelims FROM p)
, ctx AS (SELECT m.person_id, m.tid, f.n, f.mean, f.sd, f.median, f.p90, m.x AS mine, m.own_rounds, m.prelims,
    (SELECT count(*) FROM cell o WHERE o.tid = m.tid AND o.x > m.x) AS better
  FROM cell m JOIN (SELECT tid, count(x) AS n, avg(x) AS mean, CASE WHEN count(x) >= 2 THEN stddev_pop(x) END AS sd, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.9) AS p90 FROM cell GROUP BY tid) f USING (tid)
  WHERE m.x IS NOT NULL)"""


@query(_FIELD + " SELECT DISTINCT tid, n, round(mean, 6) AS mean, round(sd, 6) AS stdev, round(median, 6) AS median, round(p90, 6) AS p90 FROM ctx")
def agg_05_field_summary(spark, sf_dir):
    out = field.summary(_cells(spark, sf_dir)).filter("n > 0")
    return out.select("tid", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "stdev", "median", "p90")])


def _cells(spark, sf_dir):
    speech = facts.speech(spark, sf_dir)
    return field.cells(facts.entry(spark, sf_dir), speech, field.prelims(facts.tournament(spark, sf_dir), facts.team_round(spark, sf_dir), speech))


@query(_FIELD + """
SELECT person_id, tid, round(mine - mean, 6) AS delta, round(CASE WHEN sd > 0 THEN (mine - mean) / sd END, 6) AS z, better + 1 AS placement, n AS field,
  round((1 - better / n) * 100, 6) AS percentile, coalesce(own_rounds < prelims, false) AS incomplete FROM ctx""")
def agg_09_field_context(spark, sf_dir):
    out = field.context(_cells(spark, sf_dir))
    return out.select("person_id", "tid", "placement", "field", "incomplete", *[r6(F.col(c)).alias(c) for c in ("delta", "z", "percentile")])


@query(_FIELD + """
, c AS (SELECT *, coalesce(own_rounds < prelims, false) AS incomplete FROM ctx)
SELECT person_id, count(*) AS placements, count(*) FILTER (WHERE NOT incomplete) AS complete, round(avg(mine - mean) FILTER (WHERE NOT incomplete), 6) AS mean_delta,
  round(avg(CASE WHEN sd > 0 THEN (mine - mean) / sd END) FILTER (WHERE NOT incomplete), 6) AS mean_z, round(avg((1 - better / n) * 100) FILTER (WHERE NOT incomplete), 6) AS mean_percentile
FROM c GROUP BY person_id""")
def agg_09_career_field(spark, sf_dir):
    out = field.career(field.context(_cells(spark, sf_dir)))
    return out.select("person_id", "placements", "complete", *[r6(F.col(c)).alias(c) for c in ("mean_delta", "mean_z", "mean_percentile")])


@query(_FIELD + " SELECT m.person_id, m.tid, round(m.mine, 6) AS mine, round(m.mean, 6) AS mean FROM ctx m")
def join_10_field_join(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    out = field.with_summary(cells, field.summary(cells)).filter("x is not null")
    return out.select("person_id", "tid", r6(F.col("x")).alias("mine"), r6(F.col("mean")).alias("mean"))


@query("SELECT person_id, tid, row_number() OVER (PARTITION BY tid ORDER BY total DESC, person_id) AS derived_rank FROM entry WHERE total IS NOT NULL")
def win_01_derived_rank(spark, sf_dir):
    return field.derived_ranks(facts.entry(spark, sf_dir).filter("total is not null"), "total", "person_id")


@query(", d AS (SELECT person_id, tid, row_number() OVER (PARTITION BY tid ORDER BY total DESC, person_id) AS r FROM entry WHERE total IS NOT NULL) SELECT person_id, tid, coalesce(open_rank, r) AS rank FROM entry LEFT JOIN d USING (person_id, tid)")
def proj_10_rank_fallback(spark, sf_dir):
    e = facts.entry(spark, sf_dir)
    d = field.derived_ranks(e.filter("total is not null"), "total", "person_id")
    return e.join(d, ["person_id", "tid"], "left").select("person_id", "tid", F.coalesce("open_rank", "derived_rank").alias("rank"))
