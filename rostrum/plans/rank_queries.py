"""Queries over ranks, breaks and judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.numbers import r6
from rostrum.functions.stages import category_of, category_priority, display_stage, motion_type, normalize_stage, outround_stage, round_class, stage_rank
from rostrum.operators import field, ranks, results
from rostrum.plans import facts
from rostrum.plans.facts import Catalog, table
from rostrum.plans.result_queries import _FAN, r9
from rostrum.plans.score_queries import _AVERAGE, _FIXED

CATALOG = Catalog()
query = CATALOG.query

_STAND = """
, standing AS (SELECT n_nationkey AS tid, s_name AS team, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE wins END AS wins, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE points END AS points, CASE WHEN n_nationkey % 4 = 0 THEN s_suppkey % 20 + 1 END AS rank
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') % 5 AS wins, sum(l_quantity)::BIGINT % 3 AS points FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey)"""


def _standings(spark, d):
    agg = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "A") % 5).alias("wins"), (F.sum("l_quantity").cast("bigint") % 3).alias("points"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(agg, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    known = lambda c: F.when(F.col("s_suppkey") % 9 != 0, F.col(c)).alias(c)
    return s.select(F.col("n_nationkey").alias("tid"), F.col("s_name").alias("team"), known("wins"), known("points"), F.when(F.col("n_nationkey") % 4 == 0, F.col("s_suppkey") % 20 + 1).alias("rank"))


@query(_STAND + """
, i AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY wins DESC NULLS LAST, points DESC NULLS LAST, team) AS i, count(*) FILTER (WHERE wins IS NOT NULL OR points IS NOT NULL) OVER (PARTITION BY tid) AS signals FROM standing)
SELECT tid, team, coalesce(rank, CASE WHEN (wins IS NOT NULL OR points IS NOT NULL) AND signals >= 2 THEN min(i) OVER (PARTITION BY tid, rank IS NULL, wins, points) END) AS place FROM i""")
def win_02_competition_rank(spark, sf_dir):
    return ranks.competition_ranks(_standings(spark, sf_dir))


_BREAKS = """
, brk AS (SELECT l_orderkey % 40 AS tid, 'Team ' || (l_partkey % 30) AS team, CASE substr(l_shipdate::DATE::VARCHAR, 10, 1) WHEN '1' THEN 'Open' WHEN '2' THEN 'ESL' WHEN '3' THEN 'EFL' WHEN '4' THEN 'Novice' WHEN '5' THEN 'Pro-Am' END AS category,
  l_linenumber AS rank, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""


def _breaks(spark, d):
    digit = F.substring(F.date_format("l_shipdate", "yyyy-MM-dd"), 10, 1)
    c = F.when(digit == "1", "Open").when(digit == "2", "ESL").when(digit == "3", "EFL").when(digit == "4", "Novice").when(digit == "5", "Pro-Am")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("tid"), F.concat(F.lit("Team "), (F.col("l_partkey") % 30).cast("string")).alias("team"), c.alias("category"), F.col("l_linenumber").alias("rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


_PRIORITY = "CASE WHEN category IS NULL OR category = '' THEN 0 WHEN category = 'Open' THEN 100 WHEN category = 'ESL' THEN 80 WHEN category = 'EFL' THEN 60 WHEN category = 'Novice' THEN 50 ELSE 40 END"


@query(_BREAKS + f"""
, top AS (SELECT tid, team, category, rank FROM brk QUALIFY row_number() OVER (PARTITION BY tid, team ORDER BY {_PRIORITY} DESC, seq, rank) = 1)
SELECT tid, team, category, rank, coalesce(categories, '') AS categories FROM top JOIN (SELECT tid, team, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM brk GROUP BY ALL) USING (tid, team)""")
def agg_24_team_breaks(spark, sf_dir):
    return ranks.team_breaks(_breaks(spark, sf_dir))


_RANK = "CASE WHEN {x} ILIKE '%grand final%' THEN 100 WHEN {x} ILIKE '%semifinal%' OR lower({x}) = 'sf' THEN 90 WHEN lower({x}) = 'qf' THEN 80 WHEN {x} ILIKE '%octofinal%' THEN 70 END"


@query(f"""
, r AS (SELECT person_id, tid, elimination AS stage, CASE WHEN elimination LIKE 'ESL %' THEN 'ESL' ELSE 'Open' END AS category, {_RANK.format(x='elimination')} AS rank FROM entry)
SELECT person_id, category, stage, rank FROM r WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY person_id, category ORDER BY rank DESC, tid) = 1""")
def agg_25_deepest_by_category(spark, sf_dir):
    return ranks.deepest_by_category(facts.entry(spark, sf_dir).select("person_id", "tid", F.col("elimination").alias("stage")))


@query(f"""
, d AS (SELECT tid, elimination FROM entry WHERE elimination IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY coalesce({_RANK.format(x='elimination')}, 0) DESC, person_id) = 1)
SELECT tid, elimination, break_rank, elimination IS NOT NULL OR break_rank IS NOT NULL AS broke FROM (SELECT tid, min(break_rank) AS break_rank FROM entry GROUP BY tid) LEFT JOIN d USING (tid)""")
def agg_26_speaker_signals(spark, sf_dir):
    return ranks.speaker_signals(facts.entry(spark, sf_dir))


@query("""
, t AS (SELECT person_id, 'Squad ' || coalesce(position, '-') AS team, count(score) AS scored, min(event_id) AS seen FROM speech GROUP BY ALL)
SELECT person_id, team, scored FROM t QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY scored DESC, seen) = 1""")
def agg_27_primary_team(spark, sf_dir):
    s = facts.speech(spark, sf_dir).select("person_id", F.concat(F.lit("Squad "), F.coalesce("position", F.lit("-"))).alias("team"), "score", F.col("event_id").alias("seq"))
    return ranks.primary_team(s)


@query("""
, s AS (SELECT person_id, tid, CASE WHEN total IS NOT NULL THEN 4 ELSE 0 END + 2 + CASE WHEN elimination IS NOT NULL THEN 1 ELSE 0 END AS score FROM entry)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY score DESC, tid) = 1""")
def agg_28_richest_participation(spark, sf_dir):
    return ranks.richest_participation(facts.entry(spark, sf_dir))


@query(" SELECT person_id, slot, nullif(count(DISTINCT (stage, round)) FILTER (WHERE regexp_matches(stage, '^R\\d+$')), 0) AS inrounds FROM judging GROUP BY ALL")
def agg_22_judge_inrounds(spark, sf_dir):
    return ranks.inrounds_judged(facts.judging(spark, sf_dir))


_JUDGE = f"""
, k AS (SELECT *, regexp_matches(stage, '^R\\d+$') AS inround, {_RANK.format(x='stage')} AS rank FROM judging)
, top AS (SELECT person_id, slot, stage AS chaired_stage FROM k WHERE NOT inround AND panel_role = 'chair' QUALIFY row_number() OVER (PARTITION BY person_id, slot ORDER BY rank DESC, assignment_id) = 1)
, panel AS (SELECT person_id, slot, stage AS panel_stage FROM k WHERE NOT inround AND panel_role <> 'chair' QUALIFY row_number() OVER (PARTITION BY person_id, slot ORDER BY rank DESC, assignment_id) = 1)
, rec AS (SELECT person_id, slot, chaired, chaired_stage, panel_stage FROM (SELECT person_id, slot, count(*) FILTER (WHERE inround AND panel_role = 'chair') AS chaired FROM k GROUP BY ALL) LEFT JOIN top USING (person_id, slot) LEFT JOIN panel USING (person_id, slot))"""


@query(_JUDGE + " SELECT * FROM rec")
def agg_23_judge_aggregates(spark, sf_dir):
    return ranks.judge_record(facts.judging(spark, sf_dir))


@query(_JUDGE + """
, s AS (SELECT person_id, slot, chaired + CASE WHEN chaired_stage IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN panel_stage IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN slot % 2 = 0 THEN 1 ELSE 0 END AS score FROM rec)
SELECT person_id, slot, score FROM s QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY score DESC, slot) = 1""")
def agg_29_best_judge_row(spark, sf_dir):
    rec = ranks.judge_record(facts.judging(spark, sf_dir)).withColumn("tag", F.when(F.col("slot") % 2 == 0, "core"))
    return ranks.best_judge_row(rec)


@query(_JUDGE + " SELECT person_id, 2019 + slot AS year, count(*) AS tournaments, sum(chaired)::BIGINT AS chaired, count(*) FILTER (WHERE chaired_stage IS NOT NULL OR panel_stage IS NOT NULL) AS with_outround FROM rec WHERE slot <> 4 GROUP BY ALL")
def agg_18_judging_seasons(spark, sf_dir):
    rec = ranks.judge_record(facts.judging(spark, sf_dir)).withColumn("year", F.when(F.col("slot") != 4, 2019 + F.col("slot")))
    return ranks.judging_seasons(rec)


@query(_JUDGE + """
, u AS (SELECT person_id, broke::INT AS broke, 0 AS chaired FROM entry UNION ALL SELECT person_id, (chaired_stage IS NOT NULL)::INT, chaired FROM rec)
SELECT person_id, count(*) AS entries, sum(broke)::BIGINT AS breaks, sum(chaired)::BIGINT AS chaired FROM u GROUP BY person_id""")
def agg_38_cv_totals(spark, sf_dir):
    return ranks.cv_totals(facts.entry(spark, sf_dir), ranks.judge_record(facts.judging(spark, sf_dir)))


@query(_JUDGE + " SELECT person_id, 'speaker' AS role, tid AS at FROM entry UNION ALL SELECT person_id, 'judge', slot FROM rec")
def set_02_speaker_judge_union(spark, sf_dir):
    s = facts.entry(spark, sf_dir).select("person_id", F.lit("speaker").alias("role"), F.col("tid").alias("at"))
    return s.unionByName(ranks.judge_record(facts.judging(spark, sf_dir)).select("person_id", F.lit("judge").alias("role"), F.col("slot").alias("at")))


@query(_AVERAGE + _JUDGE + """
, avgs AS (SELECT person_id, tid, """ + _FIXED.format(x="x") + """::DOUBLE AS score FROM (SELECT person_id, tid, coalesce(CASE WHEN spoken > 0 THEN total / spoken END, cell_mean, CASE WHEN prelims > 0 THEN total / prelims END) AS x FROM p))
, s AS (SELECT e.*, name, year, teams, score, row_number() OVER (PARTITION BY e.person_id ORDER BY year DESC NULLS LAST, name, tid) AS i FROM entry e JOIN tournament USING (tid) LEFT JOIN avgs USING (person_id, tid))
, won AS (SELECT person_id, string_agg(concat_ws(' ', name, year), '; ' ORDER BY i) AS titles FROM (SELECT * FROM s WHERE champion QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY i) <= 5) GROUP BY person_id)
, best AS (SELECT person_id, name AS best_rank_at, open_rank AS best_rank FROM s WHERE open_rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY open_rank, i) = 1)
, av AS (SELECT person_id, name AS best_average_at, score AS best_average FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY score DESC, i) = 1)
, tb AS (SELECT person_id, count(*) FILTER (WHERE broke AND teams > 0 AND open_rank <= ceil(teams / 10)) AS top_breaks FROM s GROUP BY person_id)
, jr AS (SELECT person_id, count(chaired_stage) AS outrounds_chaired, count(*) FILTER (WHERE slot % 2 = 0) AS core FROM rec GROUP BY person_id)
, b AS (SELECT person_id, count(DISTINCT (name, coalesce(year, 0))) FILTER (WHERE regexp_matches(name, '(?i)\\bcup\\b')) AS majors, min(year) AS first_year, max(year) AS last_year
  FROM (SELECT person_id, tid FROM entry UNION ALL SELECT person_id, slot + first FROM rec, weeks) JOIN tournament USING (tid) GROUP BY person_id)
SELECT person_id, coalesce(titles, '') AS titles, coalesce(top_breaks, 0) AS top_breaks, best_rank, best_rank_at, best_average, best_average_at, coalesce(outrounds_chaired, 0) AS outrounds_chaired, coalesce(core, 0) AS core, majors, first_year, last_year
FROM b LEFT JOIN won USING (person_id) LEFT JOIN best USING (person_id) LEFT JOIN av USING (person_id) LEFT JOIN tb USING (person_id) LEFT JOIN jr USING (person_id)""")
def agg_30_highlights(spark, sf_dir):
    e, t, speech = facts.entry(spark, sf_dir), facts.tournament(spark, sf_dir), facts.speech(spark, sf_dir)
    averages = field.averages(e, speech, field.prelims(t, facts.team_round(spark, sf_dir), speech))
    records = ranks.judge_record(facts.judging(spark, sf_dir).withColumn("at", F.struct("tid", "slot")), "at").select("person_id", "at.tid", "chaired_stage", F.when(F.col("at.slot") % 2 == 0, "core").alias("tag"))
    return ranks.highlights(e, averages, records, t, majors=r"(?i)\bcup\b")


@query("""
SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY open_rank, tid) AS place, tid, open_rank, teams FROM entry JOIN tournament USING (tid) WHERE broke AND teams > 0 AND open_rank <= ceil(teams / 10) QUALIFY place <= 5""")
def agg_30_top_breaks(spark, sf_dir):
    return ranks.top_breaks(facts.entry(spark, sf_dir), facts.tournament(spark, sf_dir))


@query("""
, g AS (SELECT o_custkey AS tid, list_sort(list(o_orderkey % 4 + 1)) AS sizes FROM orders GROUP BY o_custkey)
SELECT tid, CASE sizes[len(sizes) // 2 + 1] WHEN 2 THEN 'British Parliamentary' WHEN 3 THEN 'Asian Parliamentary' END AS format FROM g WHERE len(sizes) >= 3""")
def agg_31_format_inference(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tid")).agg(F.collect_list(F.col("o_orderkey") % 4 + 1).alias("sizes")).filter("size(sizes) >= 3")
    return g.select("tid", ranks.format_of(F.lit("Open"), ranks.upper_median(F.col("sizes"))).alias("format"))


@query(_FAN + """
SELECT person_id, count(*) AS debated, count(*) FILTER (WHERE type IS NOT NULL OR topic IS NOT NULL) AS tagged, round(avg(score) + 1e-12, 9) AS avg_score, count(won) AS decided, count(*) FILTER (WHERE won) AS wins,
  round(count(*) FILTER (WHERE won) / nullif(count(won), 0) + 1e-12, 9) AS win_rate, count(DISTINCT tid) AS tournaments FROM fan WHERE motion_id IS NOT NULL GROUP BY person_id""")
def agg_37_motion_totals(spark, sf_dir):
    rounds = results.merged_rounds(facts.speech(spark, sf_dir), facts.team_round(spark, sf_dir))
    out = ranks.motion_totals(rounds, facts.motion(spark, sf_dir))
    return out.withColumns({c: r9(c) for c in ("avg_score", "win_rate")})


# -- vocabularies over labels that the tables hold or spell ------------------

_LABELS = """
, label AS (SELECT DISTINCT CASE o_orderkey % 12 WHEN 0 THEN 'GF' WHEN 1 THEN 'ESL Semifinals' WHEN 2 THEN 'R' || (o_orderkey % 9) WHEN 3 THEN 'Quarterfinals' WHEN 4 THEN 'Triple Octofinals' WHEN 5 THEN 'Partial Double Octofinals'
  WHEN 6 THEN 'Round of 16' WHEN 7 THEN 'Novice Final' WHEN 8 THEN 'semis' WHEN 9 THEN 'Round ' || (o_orderkey % 9) WHEN 10 THEN 'Grand Final' ELSE o_orderpriority END AS label FROM orders)"""


def _labels(spark, d):
    n = F.col("o_orderkey") % 12
    digit = (F.col("o_orderkey") % 9).cast("string")
    names = {0: "GF", 1: "ESL Semifinals", 3: "Quarterfinals", 4: "Triple Octofinals", 5: "Partial Double Octofinals", 6: "Round of 16", 7: "Novice Final", 8: "semis", 10: "Grand Final"}
    label = F.when(n == 2, F.concat(F.lit("R"), digit)).when(n == 9, F.concat(F.lit("Round "), digit))
    for k, v in names.items():
        label = label.when(n == k, F.lit(v))
    return table(spark, d, "orders").select(label.otherwise(F.col("o_orderpriority")).alias("label")).distinct()


_NORM = "CASE WHEN regexp_matches(label, '^R\\d+$') THEN 'Round ' || label[2:] WHEN label = 'GF' THEN 'Grand Final' WHEN label = 'semis' THEN 'Semifinals' ELSE label END"
_CLASS = """CASE WHEN regexp_matches(lower(label), 'grand\\s*final|\\bgf\\b') THEN 'grand_final' WHEN regexp_matches(lower(label), 'semi[-\\s]?final|\\bsf\\b|\\bsemis?\\b') THEN 'semifinal' WHEN lower(label) LIKE '%quarterfinal%' THEN 'quarterfinal'
  WHEN lower(label) LIKE '%triple octo%' THEN 'triple_octofinal' WHEN lower(label) LIKE '%partial%' THEN 'double_octofinal' WHEN regexp_matches(lower(label), 'octo[-\\s]?final|round\\s*of\\s*16') THEN 'octofinal' WHEN regexp_matches(lower(label), '\\bfinals?\\b') THEN 'final' END"""
_DEPTH = f"CASE {_CLASS} WHEN 'grand_final' THEN 100 WHEN 'final' THEN 95 WHEN 'semifinal' THEN 90 WHEN 'quarterfinal' THEN 80 WHEN 'octofinal' THEN 70 WHEN 'double_octofinal' THEN 60 WHEN 'triple_octofinal' THEN 50 END"


@query(_LABELS + f" SELECT label, {_NORM} AS stage FROM label")
def fn_06_normalize_stage(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", normalize_stage(F.col("label")).alias("stage"))


@query(_LABELS + " SELECT label, CASE WHEN regexp_matches(label, '^(R|Round )\\d+$') THEN 'inround' WHEN label IN ('GF', 'Quarterfinals', 'Triple Octofinals', 'Partial Double Octofinals', 'Round of 16', 'semis', 'Grand Final') THEN 'outround' ELSE 'unknown' END AS kind FROM label")
def fn_07_round_class(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", round_class(F.col("label")).alias("kind"))


@query(_LABELS + f" SELECT label, {_CLASS} AS stage FROM label")
def fn_08_outround_stage(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", outround_stage(F.col("label")).alias("stage"))


@query(_LABELS + f" SELECT label, {_DEPTH} AS strict, coalesce({_DEPTH}, 0) AS loose FROM label")
def fn_09_stage_rank(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", stage_rank(F.col("label")).alias("strict"), stage_rank(F.col("label"), strict=False).alias("loose"))


@query(_LABELS + f""" SELECT label, CASE {_CLASS} WHEN 'grand_final' THEN 'Final' WHEN 'final' THEN 'Final' WHEN 'semifinal' THEN 'Semifinals' WHEN 'quarterfinal' THEN 'Quarterfinals' WHEN 'octofinal' THEN 'Octofinals'
  WHEN 'double_octofinal' THEN 'Double Octofinals' WHEN 'triple_octofinal' THEN 'Triple Octofinals' ELSE {_NORM} END AS shown FROM label""")
def fn_10_display_stage(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", display_stage(F.col("label")).alias("shown"))


@query(_LABELS + " SELECT label, CASE WHEN label LIKE 'ESL %' THEN 'ESL' WHEN label LIKE 'Novice %' THEN 'Novice' ELSE 'Open' END AS category, CASE WHEN label LIKE 'ESL %' THEN 80 WHEN label LIKE 'Novice %' THEN 50 ELSE 100 END AS priority FROM label")
def fn_25_break_category(spark, sf_dir):
    c = category_of(F.col("label"))
    return _labels(spark, sf_dir).select("label", c.alias("category"), category_priority(c).alias("priority"))


@query("""
, m AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'This House would ban ' WHEN 1 THEN 'THBT ' WHEN 2 THEN 'THS ' WHEN 3 THEN 'This house regrets ' WHEN 4 THEN 'This House, as a parent, ' WHEN 5 THEN 'THP ' WHEN 6 THEN 'tho. ' ELSE 'Motion: ' END || p_name AS text FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'THW' WHEN 1 THEN 'THBT' WHEN 2 THEN 'THS' WHEN 3 THEN 'THR' WHEN 4 THEN 'Other' WHEN 5 THEN 'THP' WHEN 6 THEN 'THO' END AS type FROM m""")
def fn_13_motion_type(spark, sf_dir):
    starts = ["This House would ban ", "THBT ", "THS ", "This house regrets ", "This House, as a parent, ", "THP ", "tho. ", "Motion: "]
    text = F.concat(F.get(F.array(*[F.lit(x) for x in starts]), (F.col("p_partkey") % 8).cast("int")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", motion_type(text).alias("type"))


@query(_STAND + " SELECT tid, round(avg(wins), 6) AS wins, round(avg(points), 6) AS points FROM standing GROUP BY tid")
def join_05_team_standings(spark, sf_dir):
    return _standings(spark, sf_dir).groupBy("tid").agg(r6(F.avg("wins")).alias("wins"), r6(F.avg("points")).alias("points"))
