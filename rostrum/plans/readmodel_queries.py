"""Queries of the read model, functions, sorts, sets and exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.functions import names, numbers, stages, urls
from rostrum.functions.similarity import blended, jaro_udf, jaro_winkler_column, token_containment
from rostrum.operators import exports, field, merging, ranks, readmodel, resolve, results, scores
from rostrum.operators.jobs import is_permanent
from rostrum.plans import facts
from rostrum.plans.facts import Catalog, table
from rostrum.plans.rank_queries import _JUDGE
from rostrum.plans.result_queries import _MERGED, _ROWS
from rostrum.plans.score_queries import _FIELD
from rostrum.sources import csv_sink
from rostrum.sources.catalog import column_lists
from rostrum.sources.html_tables import team_matches
from rostrum.sources.store import shared_folder

CATALOG = Catalog()
query = CATALOG.query


# -- scans, filters ----------------------------------------------------------


@query(" SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def src_01_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_orderdate")


@query(" SELECT * FROM customer WHERE c_custkey = 42")
def src_02_point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey = 42").limit(1)


@query(" SELECT job_id FROM job WHERE user_id = 7 AND started_at IS NOT NULL AND finished_at IS NOT NULL")
def proj_01_complete_filter(spark, sf_dir):
    return facts.job(spark, sf_dir).filter("user_id = 7 and started_at is not null and finished_at is not null").select("job_id")


@query(" SELECT job_id, user_id FROM job WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def proj_02_in_list(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return facts.job(spark, sf_dir).join(keys, "user_id", "left_semi").select("job_id", "user_id")


@query(" SELECT person_id, tid, team FROM entry WHERE (tid, team) IN (SELECT tid, team FROM entry WHERE broke)")
def proj_03_pair_list(spark, sf_dir):
    e = facts.entry(spark, sf_dir)
    return e.join(e.filter("broke").select("tid", "team"), ["tid", "team"], "left_semi").select("person_id", "tid", "team")


_RUNS = ", run AS (SELECT event_id AS run_id, ts AS created_at, CASE WHEN event_type = 'error' THEN ['fetch: page ' || (event_id % 7) || ' — failed', 'parse: ' || props] ELSE []::VARCHAR[] END AS warnings FROM events)"


def _runs(spark, d):
    e = table(spark, d, "events")
    some = F.array(F.concat(F.lit("fetch: page "), (F.col("event_id") % 7).cast("string"), F.lit(" — failed")), F.concat(F.lit("parse: "), "props"))
    return e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", some).otherwise(F.array().cast("array<string>")).alias("warnings"))


@query(_RUNS + " SELECT run_id FROM run WHERE len(warnings) > 0")
def proj_04_array_not_empty(spark, sf_dir):
    return _runs(spark, sf_dir).filter("size(warnings) > 0").select("run_id")


@query(_RUNS + """, l AS (SELECT * FROM run WHERE len(warnings) > 0 ORDER BY created_at DESC, run_id DESC LIMIT 200), w AS (SELECT created_at, unnest(warnings) AS w FROM l)
SELECT substr(split_part(w, ' — ', 1), 1, 200) AS headline, count(*) AS n, max(created_at) AS latest FROM w GROUP BY 1 ORDER BY n DESC, headline LIMIT 20""")
def agg_33_warning_headlines(spark, sf_dir):
    return readmodel.warning_headlines(_runs(spark, sf_dir))


@query(" SELECT job_id FROM job WHERE last_error LIKE '%HTTP 404%'")
def proj_05_like(spark, sf_dir):
    return facts.job(spark, sf_dir).filter(F.col("last_error").like("%HTTP 404%")).select("job_id")


@query(r" SELECT job_id, coalesce(regexp_matches(last_error, 'fetch landing\b.*HTTP 404\b'), false) AS permanent FROM job")
def proj_06_regex(spark, sf_dir):
    return facts.job(spark, sf_dir).select("job_id", F.coalesce(is_permanent(F.col("last_error")), F.lit(False)).alias("permanent"))


_REG = """
, reg AS (SELECT o_custkey AS user_id, o_orderkey % 40 AS tid, 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 4 <> 0 THEN 'Ann-' || (o_orderkey % 5) || ' Lee' END AS name FROM orders)
, claimed AS (SELECT c_custkey AS user_id, 'ann ' || (c_custkey % 5) || ' lee' AS key FROM customer)"""


def _registrations(spark, d):
    o = table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Ann-"), (F.col("o_orderkey") % 5).cast("string"), F.lit(" Lee")))
    return o.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 40).alias("tid"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), name.alias("name"), F.col("o_orderkey").alias("seq")).withColumn("key", names.normalize_name(F.col("name")))


def _claimed(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("ann "), (F.col("c_custkey") % 5).cast("string"), F.lit(" lee")).alias("key"), F.col("c_name").alias("display"))


@query(_REG + """
, a AS (SELECT r.user_id, tid, name AS alias FROM reg r JOIN claimed c ON c.user_id = r.user_id AND c.key = lower(replace(r.name, '-', ' ')) QUALIFY row_number() OVER (PARTITION BY r.user_id, tid ORDER BY url) = 1)
SELECT DISTINCT r.user_id, r.tid, coalesce(alias, c_name) AS my_name FROM reg r LEFT JOIN a USING (user_id, tid) JOIN customer ON c_custkey = r.user_id""")
def proj_07_name_fallback(spark, sf_dir):
    r, c = _registrations(spark, sf_dir), _claimed(spark, sf_dir)
    a = readmodel.alias_of(r, c)
    return r.select("user_id", "tid").distinct().join(a, ["user_id", "tid"], "left").join(c.select("user_id", "display"), "user_id").select("user_id", "tid", F.coalesce("alias", "display").alias("my_name"))


@query(_REG + ", n AS (SELECT lower(replace(name, '-', ' ')) AS key, name, row_number() OVER (PARTITION BY lower(replace(name, '-', ' ')) ORDER BY url[2:]::BIGINT) AS i FROM reg WHERE name IS NOT NULL) SELECT key, max(name) FILTER (WHERE i = 1) AS name, count(*) AS n FROM n GROUP BY key")
def agg_32_registration_names(spark, sf_dir):
    return resolve.registration_names(_registrations(spark, sf_dir).filter("name is not null"))


@query(" SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '[name withdrawn]' ELSE c_name END AS name FROM customer")
def proj_11_name_masking(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", names.mask_name(F.col("c_name"), F.when(F.col("c_custkey") % 10 == 0, F.lit(1))).alias("name"))


_FIX = "CASE WHEN abs({x} * 4) % 2 = 1 THEN printf('%.1f', sign({x}) * floor(abs({x}) * 10 + 0.5) / 10) ELSE printf('%.1f', {x}) END"


@query(" , e AS (SELECT event_id, value - 50.25 AS x FROM events), t AS (SELECT event_id, CASE WHEN s = '-0.0' THEN '0.0' ELSE s END AS s FROM (SELECT event_id, " + _FIX.format(x="x") + " AS s FROM e)) SELECT event_id, CASE WHEN s::DOUBLE > 0 THEN '+' || s ELSE s END AS shown FROM t")
def fn_28_signed_display(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.signed1(F.col("value") - 50.25).alias("shown"))


@query(" SELECT person_id, tid, concat_ws(' | ', '#' || open_rank || ' Open', '#' || esl_rank || ' ESL', '#' || efl_rank || ' EFL') AS ranks, points::VARCHAR AS points FROM entry")
def proj_12_export_format(spark, sf_dir):
    f = {x.id: x for x in exports.registry()}
    e = facts.entry(spark, sf_dir)
    return e.select("person_id", "tid", F.coalesce(f["speaker_rank"].speaker, F.lit("")).alias("ranks"), f["team_points"].speaker.alias("points"))


@query(_JUDGE + """
, j AS (SELECT person_id, count(*) AS judged, sum(chaired) AS chaired FROM rec GROUP BY person_id), s AS (SELECT person_id, count(*) AS n, count(*) FILTER (WHERE broke) AS breaks, min(open_rank) AS best FROM entry GROUP BY person_id)
, x AS (SELECT person_id, list_filter(CASE WHEN coalesce(judged, 0) = 0 OR n >= 3 * coalesce(judged, 0) THEN ['tournaments=' || n, 'breaks=' || breaks, 'best_rank=' || coalesce(best, 0), 'judged=' || coalesce(judged, 0), 'chaired=' || coalesce(chaired, 0)]
  ELSE ['judged=' || coalesce(judged, 0), 'chaired=' || coalesce(chaired, 0), 'tournaments=' || n, 'breaks=' || breaks, 'best_rank=' || coalesce(best, 0)] END, lambda t: NOT regexp_matches(t, '=0$')) AS t FROM s LEFT JOIN j USING (person_id))
SELECT person_id, array_to_string(t[1:4], ',') AS tiles FROM x""")
def proj_13_header_metrics(spark, sf_dir):
    j = ranks.judge_record(facts.judging(spark, sf_dir)).groupBy("person_id").agg(F.count("*").alias("judged"), F.sum("chaired").alias("chaired"))
    s = facts.entry(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("n"), F.count_if("broke").alias("breaks"), F.min("open_rank").alias("best"))
    tiles = readmodel.header_tiles(F.col("n"), F.coalesce("judged", F.lit(0)), F.col("breaks"), F.col("best"), F.col("chaired"))
    text = F.array_join(F.transform(tiles, lambda t: F.concat(t["name"], F.lit("="), t["value"].cast("string"))), ",")
    return s.join(j, "person_id", "left").select("person_id", text.alias("tiles"))


@query(" SELECT motion_id, (SELECT count(*) FROM motion WHERE type IS NULL OR topic IS NULL) AS untagged FROM motion WHERE type IS NULL OR topic IS NULL ORDER BY motion_id LIMIT 40")
def proj_14_untagged_motions(spark, sf_dir):
    m = facts.motion(spark, sf_dir).filter("type is null or topic is null")
    total = m.agg(F.count("*").alias("untagged"))
    return m.orderBy("motion_id").limit(40).select("motion_id").join(F.broadcast(total))


@query(" SELECT job_id, CASE WHEN status IN ('abandoned', 'failed') THEN status WHEN finished_at IS NOT NULL AND NOT (user_id % 3 = 0) THEN 'unmatched' WHEN status = 'done' THEN 'done' ELSE 'pending' END AS shown FROM job")
def proj_15_effective_status(spark, sf_dir):
    return facts.job(spark, sf_dir).select("job_id", readmodel.effective_status(F.col("status"), F.col("finished_at").isNotNull(), F.col("user_id") % 3 == 0).alias("shown"))


@query(" , s AS (SELECT CASE WHEN status IN ('abandoned', 'failed') THEN status WHEN finished_at IS NOT NULL AND NOT (user_id % 3 = 0) THEN 'unmatched' WHEN status = 'done' THEN 'done' ELSE 'pending' END AS shown FROM job) SELECT shown, count(*) AS n FROM s GROUP BY shown")
def agg_36_status_tiles(spark, sf_dir):
    return proj_15_effective_status(spark, sf_dir).groupBy("shown").agg(F.count("*").alias("n"))


@query(" , rep AS (SELECT user_id AS person_id, tid FROM (SELECT DISTINCT person_id AS user_id, tid FROM entry WHERE person_id % 3 = 0 AND tid % 2 = 0)) SELECT e.person_id, e.tid, r.tid IS NOT NULL AS reported FROM entry e LEFT JOIN rep r ON r.person_id = e.person_id AND r.tid = e.tid")
def proj_16_report_mark(spark, sf_dir):
    e = facts.entry(spark, sf_dir).select("person_id", "tid")
    reports = e.filter("person_id % 3 = 0 and tid % 2 = 0").groupBy("person_id").agg(F.collect_list("tid").alias("tids")).withColumn("status", F.lit("open"))
    return readmodel.report_marks(reports, e)


# -- joins ---------------------------------------------------------------------


@query(" SELECT job_id, c_name AS name FROM job LEFT JOIN customer ON c_custkey = user_id AND c_nationkey < 10")
def join_01_left(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return facts.job(spark, sf_dir).join(c, "user_id", "left").select("job_id", "name")


@query(" SELECT person_id, tid FROM entry WHERE person_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join_02_claimed_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("person_id"))
    return facts.entry(spark, sf_dir).join(c, "person_id", "left_semi").select("person_id", "tid")


@query(" SELECT person_id, tid FROM entry e WHERE EXISTS (SELECT 1 FROM judging j WHERE j.person_id = e.person_id AND j.slot = e.tid % 5 AND panel_role = 'chair')")
def join_03_role_semi(spark, sf_dir):
    j = facts.judging(spark, sf_dir).filter("panel_role = 'chair'").select("person_id", "slot")
    return facts.entry(spark, sf_dir).withColumn("slot", F.col("tid") % 5).join(j, ["person_id", "slot"], "left_semi").select("person_id", "tid")


@query(" SELECT e.person_id, e.tid, string_agg(coalesce(t.points::VARCHAR, '-'), ',' ORDER BY t.round) AS points FROM entry e LEFT JOIN team_round t ON t.person_id = e.person_id AND t.tid = e.tid AND t.round > 0 GROUP BY ALL")
def join_06_round_lists(spark, sf_dir):
    t = facts.team_round(spark, sf_dir).filter("round > 0").groupBy("person_id", "tid").agg(F.array_sort(F.collect_list(F.struct("round", "points"))).alias("list"))
    text = F.array_join(F.transform("list", lambda x: F.coalesce(x["points"].cast("string"), F.lit("-"))), ",")
    return facts.entry(spark, sf_dir).join(t, ["person_id", "tid"], "left").select("person_id", "tid", F.coalesce(text, F.lit("-")).alias("points"))


@query("""
, sib AS (SELECT *, count(*) OVER (PARTITION BY tid, round) - 1 AS siblings FROM motion), e AS (SELECT DISTINCT person_id, tid FROM entry), j AS (SELECT DISTINCT person_id, tid FROM judging)
SELECT w.person_id, motion_id, siblings, w.debated, NOT w.debated AS judged_only FROM sib JOIN (SELECT coalesce(e.person_id, j.person_id) AS person_id, coalesce(e.tid, j.tid) AS tid, e.person_id IS NOT NULL AS debated FROM e FULL JOIN j USING (person_id, tid)) w USING (tid)""")
def join_09_motion_entries(spark, sf_dir):
    return readmodel.motion_entries(facts.motion(spark, sf_dir), facts.entry(spark, sf_dir), facts.judging(spark, sf_dir))


@query(" SELECT motion_id, count(*) OVER (PARTITION BY tid, round) - 1 AS siblings FROM motion")
def win_06_siblings(spark, sf_dir):
    return facts.motion(spark, sf_dir).select("motion_id", (F.count("*").over(Window.partitionBy("tid", "round")) - 1).alias("siblings"))


@query(" SELECT e.person_id, e.tid, e.elimination, b.break_rank FROM entry e LEFT JOIN (SELECT tid, team, elimination, min(break_rank) AS break_rank FROM entry WHERE elimination IS NOT NULL GROUP BY ALL) b ON b.tid = e.tid AND b.team = e.team AND b.elimination = e.elimination")
def join_11_outround_lookup(spark, sf_dir):
    e = facts.entry(spark, sf_dir).select("person_id", "tid", "team", "elimination", "break_rank")
    b = e.filter("elimination is not null").groupBy("tid", "team", "elimination").agg(F.min("break_rank").alias("break_rank"))
    return e.drop("break_rank").join(b, ["tid", "team", "elimination"], "left").select("person_id", "tid", "elimination", "break_rank")


@query(" SELECT s.event_id, e.team, s.score FROM speech s JOIN entry e USING (person_id, tid)")
def join_12_score_participant(spark, sf_dir):
    return facts.speech(spark, sf_dir).join(facts.entry(spark, sf_dir), ["person_id", "tid"]).select("event_id", "team", "score")


@query(" SELECT tid, max(round) AS last_round FROM speech s JOIN entry USING (person_id, tid) WHERE round > 0 AND coalesce(position, '') <> 'average' GROUP BY tid")
def agg_03_max_with_join(spark, sf_dir):
    s = facts.speech(spark, sf_dir).filter("round > 0 and coalesce(position, '') <> 'average'")
    return s.join(facts.entry(spark, sf_dir).select("person_id", "tid"), ["person_id", "tid"], "left_semi").groupBy("tid").agg(F.max("round").alias("last_round"))


@query(" SELECT DISTINCT tid, position FROM speech")
def agg_04_distinct(spark, sf_dir):
    return facts.speech(spark, sf_dir).select("tid", "position").distinct()


@query(" SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT person_id FROM entry)")
def join_16_unmatched(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return o.join(facts.entry(spark, sf_dir).select(F.col("person_id").alias("user_id")), "user_id", "left_anti")


@query(" SELECT tid, team FROM (SELECT tid, team, count(*) FILTER (WHERE total IS NULL) AS unmatched, bool_or(open_rank IS NULL) AS owned FROM entry GROUP BY ALL) WHERE unmatched = 1 AND NOT owned")
def join_20_redacted_owner(spark, sf_dir):
    e = facts.entry(spark, sf_dir).select("tid", "team", F.col("total").isNotNull().alias("matched"), F.col("open_rank").isNull().alias("is_owner"))
    return resolve.redacted_owner(e)


@query(" SELECT job_id, user_id FROM job WHERE (user_id, job_id % 5) IN (SELECT person_id, tid % 5 FROM entry)")
def join_21_ownership_guard(spark, sf_dir):
    own = facts.entry(spark, sf_dir).select(F.col("person_id").alias("user_id"), (F.col("tid") % 5).alias("slot"))
    return facts.job(spark, sf_dir).withColumn("slot", F.col("job_id") % 5).join(own, ["user_id", "slot"], "left_semi").select("job_id", "user_id")


@query(_RUNS + """, l AS (SELECT *, run_id % 50 AS tid, run_id % 3 AS parser FROM run QUALIFY row_number() OVER (PARTITION BY run_id % 50, run_id % 3 ORDER BY created_at DESC, run_id) = 1)
SELECT tid, coalesce(sum(len(warnings)), 0)::BIGINT AS warnings FROM l GROUP BY tid""")
def join_22_latest_warnings(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumn("tid", F.col("run_id") % 50).withColumn("parser", F.col("run_id") % 3)
    latest = ranks.first_by(r, ["tid", "parser"], F.desc("created_at"), F.asc("run_id"))
    return latest.groupBy("tid").agg(F.flatten(F.collect_list("warnings")).alias("w")).select("tid", F.size("w").cast("bigint").alias("warnings"))


@query("""
, p AS (SELECT o_orderkey AS proposal_id, o_custkey AS user_id, o_orderkey % 5 + 2815 AS tid, o_orderkey % 700 * 7 AS motion_id, CASE o_orderkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'motion_type' ELSE 'motion_topic' END AS kind, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'O')
SELECT proposal_id, c_name AS user_name, t.name AS tournament_name, kind, value, CASE kind WHEN 'region' THEN region WHEN 'motion_type' THEN m.type ELSE m.topic END AS current
FROM p LEFT JOIN customer ON c_custkey = user_id LEFT JOIN tournament t ON t.tid = p.tid LEFT JOIN motion m ON m.motion_id = p.motion_id""")
def join_23_proposal_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "region").when(F.col("o_orderkey") % 3 == 1, "motion_type").otherwise("motion_topic")
    p = o.select(F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 5 + 2815).alias("tid"), (F.col("o_orderkey") % 700 * 7).alias("motion_id"), kind.alias("kind"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    t = facts.tournament(spark, sf_dir).select("tid", F.col("name").alias("tournament_name"), "region")
    return readmodel.proposal_queue(p, users, t, facts.motion(spark, sf_dir).select("motion_id", "type", "topic"))


# -- names, similarity -----------------------------------------------------------


@query(" SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('José-' || c_name || '_x. ' || c_mktsegment), '[-_./\\\\]+', ' ', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM customer")
def fn_01_normalize_name(spark, sf_dir):
    raw = F.concat(F.lit("José-"), "c_name", F.lit("_x. "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", names.normalize_name(raw).alias("key"))


_PAIR = ", pair AS (SELECT a.p_partkey AS x, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 3) % (SELECT count(*) FROM part))"


def _pairs(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    b = p.select(F.col("p_partkey").alias("y"), F.col("p_name").alias("b"))
    return p.select(F.col("p_partkey").alias("x"), F.col("p_name").alias("a"), ((F.col("p_partkey") * 7 + 3) % n).alias("y")).join(b, "y")


@query(_PAIR + " SELECT x, a = b OR contains(a, b) OR contains(b, a) OR len(list_filter(string_split(a, ' '), lambda t: NOT list_contains(string_split(b, ' '), t))) = 0 AS matches FROM pair")
def fn_02_names_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", names.names_match(F.col("a"), F.col("b")).alias("matches"))


# letters are matched one by one, in order, with the first free equal one within reach
_JARO = """
, jr AS (
  SELECT id, a, b, 1::BIGINT AS i, []::BIGINT[] AS taken, '' AS l, greatest(0, greatest(len(a), len(b)) // 2 - 1) AS reach FROM jpair
  UNION ALL SELECT id, a, b, i + 1, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, CASE WHEN j IS NULL THEN l ELSE l || a[i] END, reach
  FROM (SELECT *, list_filter(range(greatest(1, i - reach), least(len(b), i + reach) + 1), lambda j: b[j] = a[i] AND NOT list_contains(taken, j))[1] AS j FROM jr WHERE i <= len(a)))
, jm AS (SELECT *, len(taken) AS m, len(list_filter(range(1, len(taken) + 1), lambda k: l[k] <> b[list_sort(taken)[k]])) / 2 AS moved FROM jr WHERE i = len(a) + 1)
, jaro AS (SELECT id, a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN m = 0 THEN 0.0 ELSE (m / len(a) + m / len(b) + (m - moved) / m) / 3 END AS j FROM jm)
, winkler AS (SELECT *, j + (CASE WHEN len(a) >= 4 AND a[1:4] = b[1:4] THEN 4 WHEN len(a) >= 3 AND a[1:3] = b[1:3] THEN 3 WHEN len(a) >= 2 AND a[1:2] = b[1:2] THEN 2 WHEN a[1:1] = b[1:1] THEN 1 ELSE 0 END) * 0.1::DOUBLE * (1 - j) AS jw FROM jaro)
, blend AS (SELECT *, greatest(jw, 0.3::DOUBLE * jw + 0.7::DOUBLE * len(list_filter(string_split(a, ' '), lambda t: list_contains(string_split(b, ' '), t))) / len(string_split(a, ' '))) AS score FROM winkler)"""
_JPAIR = _PAIR + ", jpair AS (SELECT x AS id, a, b FROM pair)" + _JARO


@query(_JPAIR + " SELECT id AS x, round(j, 6) AS jaro FROM jaro")
def fn_03_jaro(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", numbers.r6(jaro_udf("a", "b")).alias("jaro"))


@query(_JPAIR + " SELECT id AS x, round(jw, 6) AS winkler FROM winkler")
def fn_04_jaro_winkler(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", numbers.r6(jaro_winkler_column(F.col("a"), F.col("b"))).alias("winkler"))


@query(_JPAIR + " SELECT id AS x, round(score, 6) AS score FROM blend")
def fn_05_blended_score(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", numbers.r6(blended(jaro_winkler_column(F.col("a"), F.col("b")), token_containment(F.col("a"), F.col("b")))).alias("score"))


_SEARCH = """
, q AS (SELECT s_suppkey AS query_id, s_nationkey AS scope, 'customer 0000' || s_suppkey AS q FROM supplier), p AS (SELECT c_custkey AS person_id, c_nationkey AS scope, lower(replace(c_name, '#', '')) AS p FROM customer)
, jpair AS (SELECT struct_pack(query_id := query_id, person_id := person_id) AS id, q AS a, p AS b FROM q JOIN p USING (scope))""" + _JARO + """
, sc AS (SELECT id.query_id, id.person_id, score FROM blend)"""


@query(_SEARCH + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, person_id) AS place FROM sc WHERE score >= 0.5) SELECT query_id, person_id, place, round(score, 6) AS score FROM k WHERE place <= 10")
def sort_06_similarity_topk(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_nationkey").alias("scope"), F.concat(F.lit("Customer 0000"), F.col("s_suppkey").cast("string")).alias("query"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("scope"), F.col("c_name").alias("name"))
    return resolve.search(q, p).select("query_id", "person_id", "place", numbers.r6(F.col("score")).alias("score"))


@query("""
, nm AS (SELECT DISTINCT p_name AS name FROM part), idx AS (SELECT p_partkey AS person_id, p_partkey AS ordinal, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' junior' ELSE ' senior' END AS i FROM part)
SELECT name, min(person_id) AS person_id FROM nm JOIN idx ON contains(i, name) OR contains(name, i) OR len(list_filter(string_split(name, ' '), lambda t: NOT list_contains(string_split(i, ' '), t))) = 0 GROUP BY name""")
def join_19_fuzzy_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, " junior").otherwise(" senior")
    index = p.select(F.col("p_partkey").alias("person_id"), F.col("p_partkey").alias("ordinal"), F.concat("p_name", tail).alias("display_name"))
    return resolve.match_names(p.select(F.col("p_name").alias("name")), index)


# -- functions over urls and text ------------------------------------------------


@query(" SELECT page_id, regexp_replace(regexp_replace(url || '). ', '[.,)\\]\\s]+$', ''), '/+$', '') || '/' AS url FROM pages")
def fn_14_normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.concat("url", F.lit("). "))).alias("url"))


@query(" SELECT job_id, regexp_matches(url, '\\.example\\.org/[\\w-]+/privateurls/\\w+$') AND job_id % 2 = 0 AS ok FROM job")
def fn_14_private_url(spark, sf_dir):
    url = F.when(F.col("job_id") % 2 == 0, F.col("url")).otherwise(F.replace("url", F.lit("example.org"), F.lit("example.org.evil.net")))
    return facts.job(spark, sf_dir).select("job_id", urls.private_url(url, [".example.org"]).alias("ok"))


@query(" SELECT user_id, count(DISTINCT url) AS urls FROM job GROUP BY user_id")
def fn_15_extract_urls(spark, sf_dir):
    j = facts.job(spark, sf_dir).groupBy("user_id").agg(F.concat_ws(" ), see: ", F.collect_list("url")).alias("text"))
    return j.select("user_id", F.size(urls.extract_urls(F.replace("text", F.lit("privateurls"), F.lit("private=\nurls")), [".example.org"])).cast("bigint").alias("urls"))


@query(" SELECT page_id, length(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<')) AS n FROM pages WHERE NOT contains(html, '&nbsp') AND NOT contains(html, '&gt') AND NOT contains(html, '&quot') AND NOT contains(html, '&#39') AND NOT contains(html, '&amp;amp')")
def fn_16_strip_html(spark, sf_dir):
    plain = "instr(html, '&nbsp') = 0 and instr(html, '&gt') = 0 and instr(html, '&quot') = 0 and instr(html, '&#39') = 0 and instr(html, '&amp;amp') = 0"
    return table(spark, sf_dir, "pages").filter(plain).select("page_id", F.length(urls.strip_html(F.col("html"))).cast("bigint").alias("n"))


@query(" SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def fn_17_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


_PRINT = "substr(sha256(lower(split_part(split_part(url, '//', 2), '/', 1)) || '|' || coalesce(lower(split_part(url, '/', 4)), '') || '|' || lower(trim(regexp_replace('Open  ' || job_id % 9, '\\s+', ' ', 'g'))) || '|' || coalesce((1990 + job_id % 7)::VARCHAR, '')), 1, 32)"


@query(f" SELECT job_id, {_PRINT} AS print, ('0x' || substr({_PRINT}, 1, 15))::BIGINT AS lock FROM job")
def fn_18_fingerprint(spark, sf_dir):
    j = facts.job(spark, sf_dir)
    p = urls.fingerprint(urls.host(F.col("url")), urls.path_part(F.col("url"), 1), F.concat(F.lit("Open  "), (F.col("job_id") % 9).cast("string")), (1990 + F.col("job_id") % 7))
    return j.select("job_id", p.alias("print"), urls.lock_key(p).alias("lock"))


CATALOG.queries["fn_20_lock_key"], CATALOG.oracles["fn_20_lock_key"] = (lambda spark, sf_dir: fn_18_fingerprint(spark, sf_dir).select("job_id", "lock")), CATALOG.oracles["fn_18_fingerprint"].replace(f"{_PRINT} AS print, ", "")


@query(" SELECT tid, unnest(CASE WHEN tid % 2 = 0 THEN [year] WHEN year IS NULL THEN [NULL] ELSE [year, NULL, year - 1, year + 1] END)::INT AS candidate FROM tournament WHERE tid % 2 = 1 OR year IS NOT NULL")
def fn_19_candidates(spark, sf_dir):
    t = facts.tournament(spark, sf_dir).filter("tid % 2 = 1 or year is not null").withColumn("y", F.col("year").cast("int"))
    explicit = F.when(F.col("tid") % 2 == 0, F.col("y"))
    return t.select("tid", F.explode(urls.candidate_years(explicit, F.col("y"))).alias("candidate"))


@query("""
, s AS (SELECT p_partkey, lower(trim(CASE p_partkey % 6 WHEN 0 THEN 'ab' WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN replace(p_name, ' ', '--') WHEN 3 THEN 'Admin' WHEN 4 THEN repeat(replace(p_name, ' ', ''), 4) ELSE p_name END)) AS slug FROM part)
SELECT p_partkey, CASE WHEN length(slug) < 3 THEN 'too_short' WHEN length(slug) > 30 THEN 'too_long' WHEN NOT regexp_matches(slug, '^[a-z0-9]([a-z0-9-]{1,28}[a-z0-9])?$') OR contains(slug, '--') THEN 'invalid_chars' WHEN slug = 'admin' THEN 'reserved' END AS error FROM s""")
def fn_21_slug(spark, sf_dir):
    p, k, n = table(spark, sf_dir, "part"), F.col("p_partkey") % 6, F.col("p_name")
    slug = F.when(k == 0, "ab").when(k == 1, F.replace(n, F.lit(" "), F.lit("-"))).when(k == 2, F.replace(n, F.lit(" "), F.lit("--"))).when(k == 3, "Admin").when(k == 4, F.repeat(F.replace(n, F.lit(" "), F.lit("")), 4)).otherwise(n)
    return p.select("p_partkey", urls.slug_error(slug).alias("error"))


@query(" SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN 1000 + floor(value)::INT ELSE NULL END AS n FROM events")
def fn_22_parse_number(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(k == 1, F.lit("n/a")).when(k == 2, F.concat(F.lit("1,"), F.lpad(F.floor("value").cast("int").cast("string"), 3, "0"))).otherwise(F.lit("1e5"))
    return e.select("event_id", numbers.parse_number(text).alias("n"))


@query(" SELECT job_id, coalesce(CASE WHEN job_id % 3 = 0 THEN 1990 + job_id % 20 END, year(scheduled_at))::INT AS year FROM job")
def fn_18_year_of(spark, sf_dir):
    name = F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("Cup "), (1990 + F.col("job_id") % 20).cast("string"))).otherwise(F.lit("Novice Open"))
    return facts.job(spark, sf_dir).select("job_id", urls.year_of(name, F.col("scheduled_at")).alias("year"))


@query(" SELECT event_id, CASE event_type WHEN 'view' THEN 'OG' WHEN 'click' THEN 'CO' WHEN 'purchase' THEN 'Prop' WHEN 'signup' THEN 'Opp' ELSE 'Bench ' || (event_id % 4) END AS seat FROM events")
def fn_11_position(spark, sf_dir):
    t = F.col("event_type")
    label = F.when(t == "view", "Opening Government").when(t == "click", " closing   Opposition").when(t == "purchase", "Affirmative").when(t == "signup", "Neg").otherwise(F.concat(F.lit(" Bench "), (F.col("event_id") % 4).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", stages.canonical_position(label).alias("seat"))


@query(" SELECT tid, CASE format WHEN 'British Parliamentary' THEN 'BP' WHEN 'Asian Parliamentary' THEN 'AP' WHEN 'World Schools' THEN 'WSDC' END AS short FROM tournament")
def fn_12_format(spark, sf_dir):
    return facts.tournament(spark, sf_dir).select("tid", stages.format_abbreviation(F.col("format")).alias("short"))


@query(" SELECT a.x, a.team = b.team OR regexp_matches(a.team, '^' || b.team || '\\s+\\d+$') AS same FROM (SELECT p_partkey AS x, 'Team ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' 2' ELSE '' END AS team FROM part) a JOIN (SELECT p_partkey AS x, 'Team ' || p_brand AS team FROM part) b USING (x)")
def fn_26_team_cell(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("Team "), "p_brand")
    return p.select(F.col("p_partkey").alias("x"), team_matches(F.concat(name, F.when(F.col("p_partkey") % 3 == 0, " 2").otherwise("")), name).alias("same"))


@query(" SELECT event_id, CASE event_type WHEN 'view' THEN 'Wrong teammate; Other' WHEN 'click' THEN 'Someone claimed my identity' WHEN 'purchase' THEN 'new_code; Wrong outround' ELSE '' END AS labels FROM events")
def fn_27_report_labels(spark, sf_dir):
    t = F.col("event_type")
    codes = F.when(t == "view", F.array(F.lit("wrong_teammate"), F.lit("other"))).when(t == "click", F.array(F.lit("claimed_by_someone_else"))).when(t == "purchase", F.array(F.lit("new_code"), F.lit("wrong_outround"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", stages.report_labels(codes).alias("labels"))


# -- sorts, sets -----------------------------------------------------------------


@query(" SELECT tid, row_number() OVER (ORDER BY year DESC NULLS LAST, name) AS place FROM tournament")
def sort_01_year_name(spark, sf_dir):
    t = facts.tournament(spark, sf_dir)
    # a place is the place within its year, after all rows of later years: years are few, so their counts go to every task
    years = t.groupBy("year").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("year").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = years.select("year", before.alias("before")).alias("y")
    ranked = t.withColumn("i", F.row_number().over(Window.partitionBy("year").orderBy(F.collate("name", "UNICODE")))).alias("t")
    return ranked.join(F.broadcast(at), F.col("t.year").eqNullSafe(F.col("y.year"))).select("tid", (F.col("before") + F.col("i")).cast("bigint").alias("place"))


@query(" SELECT user_id, max(scheduled_at) AS latest FROM job GROUP BY user_id ORDER BY latest DESC, user_id LIMIT 5")
def sort_05_latest_five(spark, sf_dir):
    return facts.job(spark, sf_dir).groupBy("user_id").agg(F.max("scheduled_at").alias("latest")).orderBy(F.desc_nulls_first("latest"), "user_id").limit(5)


@query(" SELECT job_id FROM job ORDER BY scheduled_at DESC, job_id LIMIT 50")
def sort_07_newest(spark, sf_dir):
    return facts.job(spark, sf_dir).orderBy(F.desc("scheduled_at"), "job_id").limit(50).select("job_id")


@query(" SELECT tid, string_agg(motion_id::VARCHAR, ',' ORDER BY round, seq, motion_id) AS motions FROM motion GROUP BY tid")
def sort_08_motion_order(spark, sf_dir):
    g = facts.motion(spark, sf_dir).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("round", F.lit(0)).alias("r"), "seq", "motion_id"))).alias("list"))
    return g.select("tid", F.array_join(F.transform("list", lambda x: x["motion_id"].cast("string")), ",").alias("motions"))


@query(" SELECT motion_id, tid, row_number() OVER (PARTITION BY round ORDER BY year DESC NULLS LAST, name, seq, motion_id) AS place FROM motion JOIN tournament USING (tid)")
def sort_09_motion_entries(spark, sf_dir):
    j = facts.motion(spark, sf_dir).join(facts.tournament(spark, sf_dir), "tid")
    order = Window.partitionBy("round").orderBy(F.col("year").desc_nulls_last(), "name", "seq", "motion_id")
    return j.select("motion_id", "tid", F.row_number().over(order).cast("bigint").alias("place"))


@query(" SELECT motion_id, row_number() OVER (PARTITION BY tid ORDER BY round, seq, motion_id) - 1 AS seq FROM motion")
def win_08_sequence(spark, sf_dir):
    g = facts.motion(spark, sf_dir).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("round", "seq", "motion_id"))).alias("list"))
    return g.select(F.posexplode("list").alias("seq", "m")).select(F.col("m.motion_id").alias("motion_id"), F.col("seq").cast("bigint").alias("seq"))


@query(" SELECT user_id FROM (SELECT DISTINCT user_id FROM job) EXCEPT SELECT person_id FROM entry")
def set_03_difference(spark, sf_dir):
    return facts.job(spark, sf_dir).select("user_id").distinct().exceptAll(facts.entry(spark, sf_dir).select(F.col("person_id").alias("user_id")).distinct())


_SPOKEN = "CASE elimination WHEN 'Grand Final' THEN CASE WHEN champion THEN 'Final (W)' ELSE 'Final' END WHEN 'ESL Semifinals' THEN 'Semifinals' WHEN 'QF' THEN 'Quarterfinals' END"


@query(_JUDGE + """
, s AS (SELECT person_id, tid AS at, 'speaker' AS section, team, NULL AS inrounds_chaired, """ + _SPOKEN + """ AS last_outround_spoken, NULL AS last_outround_judged FROM entry), j AS (SELECT person_id, slot AS at, 'judge' AS section, NULL AS team, chaired::VARCHAR, NULL, panel_stage FROM rec)
SELECT * FROM s UNION ALL SELECT * FROM j""")
def set_04_section_union(spark, sf_dir):
    return _export(spark, sf_dir, ["inrounds_chaired", "last_outround_judged", "last_outround_spoken", "team"])


def _export(spark, d, wanted):
    s = facts.entry(spark, d).withColumn("at", F.col("tid"))
    j = ranks.judge_record(facts.judging(spark, d)).withColumn("at", F.col("slot")).withColumn("broke", F.col("chaired_stage").isNotNull() | F.col("panel_stage").isNotNull())
    s = s.withColumn("by_category", F.lit(None).cast("array<struct<category:string,stage:string>>"))
    return exports.export_rows(s, j, exports.fields(wanted), ["person_id", "at"])


@query(_JUDGE + """
, s AS (SELECT person_id, tid AS at, 'speaker,' || team || ',' || CASE WHEN broke THEN 'Yes' ELSE 'No' END || ',' || coalesce(""" + _SPOKEN + """, '') || ',' AS line FROM entry)
SELECT person_id, "at", line FROM s UNION ALL SELECT person_id, slot, 'judge,,' || CASE WHEN chaired_stage IS NOT NULL OR panel_stage IS NOT NULL THEN 'Yes' ELSE 'No' END || ',,' || chaired FROM rec""")
def snk_02_csv_export(spark, sf_dir):
    wanted = ["team", "broken", "last_outround_spoken", "inrounds_chaired"]
    rows = _export(spark, sf_dir, wanted)
    return rows.select("person_id", "at", exports.csv_line([F.col(c) for c in ("section", *wanted)]).alias("line"))


def _cv_frames(spark, d):
    """Speaker and judge rows of everybody with all that export fields need."""
    e, t, speech, team = facts.entry(spark, d), facts.tournament(spark, d), facts.speech(spark, d), facts.team_round(spark, d)
    person, x = F.col("c_custkey"), F.col("person_id") + F.col("tid")
    people = table(spark, d, "customer").select(person.alias("person_id"), F.when(person % 10 == 0, F.concat("c_name", F.lit(', "the third"'))).otherwise(F.col("c_name")).alias("name"))
    prelim = field.prelims(t, team, speech)
    cells = field.cells(e, speech, prelim)
    two = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("stage")) for c, s in (("Open", "Grand Final"), ("ESL", "SF"))])
    spoken = speech.groupBy("person_id", "tid").agg(F.count("score").alias("prelims_spoken"))
    debated = results.merged_rounds(speech, team)
    speakers = exports.speaker_frame(
        e.withColumn("by_category", F.when(x % 24 == 0, two)), t, people, field.averages(e, speech, prelim), spoken, field.summary(cells), field.context(cells), results.teammates(e), debated, facts.motion(spark, d), texts=True
    )
    j = facts.judging(spark, d)
    records = ranks.judge_record(j, "tid").join(ranks.inrounds_judged(j, "tid"), ["person_id", "tid"]).withColumn("tag", F.when(F.col("person_id") % 2 == 0, "core"))
    return speakers, exports.judge_frame(records, t, people)


@query(_FIELD + _MERGED + """
, k AS (SELECT *, regexp_matches(stage, '^R\\d+$') AS inround, CASE stage WHEN 'Grand Final' THEN 3 WHEN 'SF' THEN 2 ELSE 1 END AS rank FROM judging)
, rec AS (SELECT person_id, tid, count(*) FILTER (WHERE inround AND panel_role = 'chair') AS chaired, nullif(count(DISTINCT (stage, round)) FILTER (WHERE inround), 0) AS inrounds,
    arg_max(stage, rank) FILTER (WHERE NOT inround AND panel_role = 'chair') AS chaired_stage, arg_max(stage, rank) FILTER (WHERE NOT inround AND panel_role <> 'chair') AS panel_stage FROM k GROUP BY ALL)
, people AS (SELECT c_custkey AS person_id, c_name || CASE WHEN c_custkey % 10 = 0 THEN ', "the third"' ELSE '' END AS name FROM customer)
, mate AS (SELECT a.person_id, a.tid, string_agg(name, ' | ' ORDER BY name) AS teammates FROM entry a JOIN entry b ON a.tid = b.tid AND a.team = b.team AND a.person_id <> b.person_id JOIN people p ON p.person_id = b.person_id GROUP BY ALL)
, told AS (SELECT m.person_id, tid, 'Round ' || round || ': ' || text AS motion, type, topic, row_number() OVER (PARTITION BY m.person_id, tid ORDER BY round, seq, motion_id) AS i FROM merged m JOIN motion USING (tid, round))
, told1 AS (SELECT person_id, tid, string_agg(motion, ' | ' ORDER BY i) AS motions FROM told GROUP BY ALL)
, told2 AS (SELECT person_id, tid, string_agg(type, ' | ' ORDER BY i) AS types FROM (SELECT person_id, tid, type, min(i) AS i FROM told WHERE type <> '' GROUP BY ALL) GROUP BY ALL)
, told3 AS (SELECT person_id, tid, string_agg(topic, ' | ' ORDER BY i) AS topics FROM (SELECT person_id, tid, topic, min(i) AS i FROM told WHERE topic <> '' GROUP BY ALL) GROUP BY ALL)
, avgs AS (SELECT person_id, tid, spoken, """ + _FIX.format(x="x") + """ AS average FROM (SELECT person_id, tid, spoken, coalesce(CASE WHEN spoken > 0 THEN total / spoken END, cell_mean, CASE WHEN prelims > 0 THEN total / prelims END) AS x FROM p))
, summary AS (SELECT tid, count(x) AS n, avg(x) AS mean FROM cell GROUP BY tid)
, s AS (SELECT 'speaker' AS section, t.name, year, format, teams, p.name AS my_name, teammates, team, '#' || team_rank AS team_rank, points, average, nullif(spoken, 0) AS spoken,
    concat_ws(' | ', '#' || open_rank || ' Open', '#' || esl_rank || ' ESL', '#' || efl_rank || ' EFL') AS ranks, CASE WHEN broke THEN 'Yes' ELSE 'No' END AS broken,
    CASE WHEN (e.person_id + e.tid) % 24 = 0 THEN 'Open: Final · ESL: Semifinals' || CASE WHEN champion THEN ' (W)' ELSE '' END ELSE """ + _SPOKEN + """ END AS spoke,
    NULL AS tag, NULL AS inrounds, NULL AS chaired, NULL AS chaired_stage, NULL AS panel_stage, region, (better + 1) || '/' || ctx.n AS placement, """ + _FIX.format(x="f.mean") + """ AS field_mean,
    CASE WHEN average::DOUBLE >= f.mean THEN '+' ELSE '-' END || """ + _FIX.format(x="abs(average::DOUBLE - f.mean)") + """ AS delta, motions, types, topics
  FROM entry e LEFT JOIN tournament t USING (tid) LEFT JOIN summary f USING (tid) LEFT JOIN people p USING (person_id) LEFT JOIN mate USING (person_id, tid) LEFT JOIN told1 USING (person_id, tid) LEFT JOIN told2 USING (person_id, tid) LEFT JOIN told3 USING (person_id, tid)
  LEFT JOIN avgs USING (person_id, tid) LEFT JOIN ctx USING (person_id, tid))
, j AS (SELECT 'judge', t.name, year, format, teams, p.name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN chaired_stage IS NOT NULL OR panel_stage IS NOT NULL THEN 'Yes' ELSE 'No' END, NULL,
    CASE WHEN person_id % 2 = 0 THEN 'core' END, inrounds, chaired, chaired_stage, panel_stage, region, NULL, NULL, NULL, NULL, NULL, NULL FROM rec LEFT JOIN tournament t USING (tid) LEFT JOIN people p USING (person_id))
, cells AS (SELECT i, unnest(c) AS c, generate_subscripts(c, 1) AS k FROM (SELECT row_number() OVER () AS i, c FROM (SELECT list_value(*COLUMNS(*)) AS c FROM (SELECT COLUMNS(*)::VARCHAR FROM (SELECT * FROM s UNION ALL SELECT * FROM j)))))
SELECT string_agg(CASE WHEN regexp_matches(c, '[",\\r\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE coalesce(c, '') END, ',' ORDER BY k) AS line FROM cells GROUP BY i
UNION ALL SELECT 'section,tournament,year,format,teams,my_name,teammates,team,team_rank,team_points,speaker_average,prelims_spoken,speaker_rank,broken,last_outround_spoken,judge_type,inrounds_judged,inrounds_chaired,last_outround_chaired,last_outround_judged,region,field_placement,field_average,field_delta,motions,motion_types,motion_topics'
""")
def snk_02_all_fields(spark, sf_dir):
    """Everybody's rows with all fields, written in two phases and read back as lines of text, the header among them."""
    rows = exports.export_rows(*_cv_frames(spark, sf_dir), exports.fields(texts=True), ["person_id", "tid"]).drop("person_id", "tid")
    csv_sink.register(spark)
    path = shared_folder(spark) + "/export"
    rows.write.format(csv_sink.FORMAT).option("compression", "zstd").mode("append").save(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(""" SELECT event_id, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN '"' || replace(props, '"', '""') || '"' ELSE event_type END || ',' || CASE WHEN event_id % 2 = 0 THEN '"a, b"' ELSE 'ab' END AS line FROM events""")
def snk_01_csv_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", F.col("props")).otherwise(F.col("event_type"))
    b = F.when(F.col("event_id") % 2 == 0, "a, b").otherwise("ab")
    return e.select("event_id", exports.csv_line([a, b]).alias("line"))


@query(_JUDGE + " SELECT 'Speaking' AS sheet, 'Team|Broken' AS head, team || '|' || CASE WHEN broke THEN 'Yes' ELSE 'No' END AS row FROM entry UNION ALL SELECT 'Judging', 'Broken|Inrounds chaired|Last outround judged', CASE WHEN chaired_stage IS NOT NULL OR panel_stage IS NOT NULL THEN 'Yes' ELSE 'No' END || '|' || chaired || '|' || coalesce(panel_stage, '') FROM rec")
def snk_03_sheets(spark, sf_dir):
    j = ranks.judge_record(facts.judging(spark, sf_dir)).withColumn("broke", F.col("chaired_stage").isNotNull() | F.col("panel_stage").isNotNull())
    made = exports.sheets(facts.entry(spark, sf_dir), j, exports.fields(["team", "broken", "inrounds_chaired", "last_outround_judged"]))
    parts = [df.select(F.lit(name).alias("sheet"), F.lit("|".join(df.columns)).alias("head"), F.concat_ws("|", *[F.coalesce(df[c], F.lit("")) for c in df.columns]).alias("row")) for name, df in made.items()]
    return parts[0].unionByName(parts[1])


@query(" SELECT person_id, 1 AS version, tid, team, s.round, s.score FROM entry e LEFT JOIN speech s USING (person_id, tid)")
def snk_04_json_export(spark, sf_dir):
    e = facts.entry(spark, sf_dir)
    doc = exports.nested_json(e.select("person_id").distinct(), e, facts.speech(spark, sf_dir))
    back = F.from_json("json", "struct<schemaVersion:int,person_id:bigint,participations:array<struct<tid:bigint,team:string,scores:array<struct<round:bigint,score:double>>>>>")
    entry = doc.select(back.alias("d")).select("d.person_id", F.col("d.schemaVersion").alias("version"), F.explode("d.participations").alias("p"))
    return entry.select("person_id", "version", "p.tid", "p.team", F.explode_outer("p.scores").alias("s")).select("person_id", "version", "tid", "team", "s.round", "s.score")


@query(" SELECT job_id, coalesce(c_name, '?') || ': ' || url || ' — ' || last_error AS line FROM job LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 7 <> 0 WHERE last_error IS NOT NULL")
def snk_05_error_dump(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    j = facts.job(spark, sf_dir).filter("last_error is not null").join(c, "user_id", "left")
    return j.select("job_id", F.concat(F.coalesce("name", F.lit("?")), F.lit(": "), "url", F.lit(" — "), "last_error").alias("line"))


@query(" , t AS (SELECT c_custkey AS key, 'speaker' AS role, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS inst FROM customer), p AS (SELECT c_custkey * 2 AS key, CASE WHEN c_custkey % 5 = 0 THEN 'adjudicator' ELSE 'speaker' END AS role, c_mktsegment AS inst FROM customer) SELECT coalesce(t.key, p.key) AS key, CASE WHEN t.role = 'adjudicator' OR p.role = 'adjudicator' THEN 'adjudicator' ELSE coalesce(p.role, t.role) END AS role, coalesce(t.inst, p.inst) AS institution FROM t FULL JOIN p USING (key)")
def set_05_participant_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = c.select(F.col("c_custkey").alias("key"), F.lit("speaker").alias("role"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("institution"))
    p = c.select((F.col("c_custkey") * 2).alias("key"), F.when(F.col("c_custkey") % 5 == 0, "adjudicator").otherwise("speaker").alias("role"), F.col("c_mktsegment").alias("institution"))
    return merging.merge_participants(t, p)


# -- last aggregations -------------------------------------------------------------


@query(" SELECT slot, coalesce(nullif(count(*) FILTER (WHERE regexp_matches(stage, '^R\\d')), 0), 9) AS prelims FROM (SELECT DISTINCT slot, stage FROM judging) GROUP BY slot")
def agg_39_prelims_at_ingest(spark, sf_dir):
    s = facts.judging(spark, sf_dir).select("slot", "stage").distinct()
    n = F.nullif(F.count_if(stages.round_class(F.col("stage")) == "inround"), F.lit(0))
    return s.groupBy("slot").agg(F.coalesce(n, F.lit(9)).alias("prelims"))


_REMARKS = _ROWS + _FIELD + """
, prof AS (SELECT person_id, count(score) AS n, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM speech GROUP BY person_id)
, ordered AS (SELECT *, row_number() OVER (PARTITION BY person_id, tid ORDER BY round, event_id) AS i, count(*) OVER (PARTITION BY person_id, tid) AS n FROM speech WHERE score IS NOT NULL)
, mom AS (SELECT person_id, count(DISTINCT tid) AS samples, avg(score) FILTER (WHERE n - i < 3) - avg(score) FILTER (WHERE i <= 3) AS momentum FROM ordered WHERE n >= 6 GROUP BY person_id)
, faced AS (SELECT person_id, count(*) AS placements, avg((1 - better / n) * 100) FILTER (WHERE NOT coalesce(own_rounds < prelims, false)) AS percentile FROM ctx GROUP BY person_id)
, turn AS (SELECT m.*, row_number() OVER (PARTITION BY person_id ORDER BY year ASC NULLS LAST, name, round) - row_number() OVER (PARTITION BY person_id, won ORDER BY year ASC NULLS LAST, name, round) AS g FROM merged m JOIN tournament USING (tid) WHERE won IS NOT NULL)
, streak AS (SELECT person_id, max(n) AS streak FROM (SELECT person_id, won, g, count(*) AS n FROM turn GROUP BY ALL) WHERE won GROUP BY person_id)
, br AS (SELECT person_id, count(*) AS t, count(*) FILTER (WHERE broke) / count(*) AS rate FROM entry GROUP BY person_id)
, tally AS (SELECT person_id, dim, key, count(*) AS rounds, count(DISTINCT tid) AS events, count_if(won) / nullif(count(won), 0) AS rate, avg(score) - any_value(base_score) AS score_delta,
    (count_if(won) / nullif(count(won), 0) - any_value(base_rate)) * 100 AS rate_delta,
    CASE key WHEN 'Under 24 teams' THEN 1 WHEN '24–47 teams' THEN 2 WHEN '48–99 teams' THEN 3 ELSE 4 END AS place
  FROM split LEFT JOIN base USING (person_id) WHERE key <> '' GROUP BY ALL)
, sig AS (SELECT person_id, max(rate) FILTER (WHERE dim = 'position' AND rounds >= 6) - min(rate) FILTER (WHERE dim = 'position' AND rounds >= 6) AS seat,
    max(rate_delta) FILTER (WHERE dim = 'motion_type' AND rounds >= 6) AS gain,
    CASE WHEN count(score_delta) FILTER (WHERE dim = 'topic' AND rounds >= 6) >= 2 THEN min(score_delta) FILTER (WHERE dim = 'topic' AND rounds >= 6) END AS loss,
    CASE WHEN count(*) FILTER (WHERE dim = 'field_size' AND events >= 2) >= 2 THEN (arg_min(struct_pack(r := rate), place) FILTER (WHERE dim = 'field_size' AND events >= 2)).r - (arg_max(struct_pack(r := rate), place) FILTER (WHERE dim = 'field_size' AND events >= 2)).r END * 100 AS gap
  FROM tally GROUP BY person_id)
SELECT person_id, concat_ws(',', CASE WHEN abs(momentum) >= 0.3 AND samples >= 3 THEN 'momentum:' || CASE WHEN momentum > 0 THEN 'pos' ELSE 'neg' END || ':' || """ + _FIX.format(x="round(abs(momentum), 9)") + """ END,
  CASE WHEN prof.n >= 15 AND iqr IS NOT NULL THEN 'consistency:neutral:' || """ + _FIX.format(x="round(iqr, 9)") + """ END,
  CASE WHEN placements >= 3 AND percentile IS NOT NULL THEN 'field-percentile:' || CASE WHEN round(percentile, 9) >= 50 THEN 'pos:' ELSE 'neutral:' END || floor(100 - round(percentile, 9) + 0.5)::BIGINT END,
  CASE WHEN seat >= 0.12 THEN 'seat-spread:neutral:' || floor(seat * 100 + 0.5)::BIGINT END, CASE WHEN gain >= 10 THEN 'motion-type:pos:' || floor(gain + 0.5)::BIGINT END,
  CASE WHEN loss <= -0.5 THEN 'topic-weakness:neg:' || """ + _FIX.format(x="round(abs(loss), 9)") + """ END, CASE WHEN abs(gap) >= 12 THEN 'field-size:' || CASE WHEN gap > 0 THEN 'neg:' ELSE 'pos:' END || floor(abs(gap) + 0.5)::BIGINT END,
  CASE WHEN streak >= 5 THEN 'streak:pos:' || streak END, CASE WHEN t >= 4 THEN 'break-rate:' || CASE WHEN rate >= 0.5 THEN 'pos:' ELSE 'neutral:' END || floor(rate * 100 + 0.5)::BIGINT END) AS remarks
FROM prof JOIN br USING (person_id) LEFT JOIN mom USING (person_id) LEFT JOIN faced USING (person_id) LEFT JOIN streak USING (person_id) LEFT JOIN (SELECT person_id, round(seat, 9) AS seat, round(gain, 9) AS gain, round(loss, 9) AS loss, round(gap, 9) AS gap FROM sig) USING (person_id)"""


@query(_REMARKS)
def agg_40_remarks(spark, sf_dir):
    speech, e, t = facts.speech(spark, sf_dir), facts.entry(spark, sf_dir), facts.tournament(spark, sf_dir)
    team_round = facts.team_round(spark, sf_dir)
    rounds = results.merged_rounds(speech, team_round)
    made = results.splits(results.split_credits(rounds, t, facts.motion(spark, sf_dir)), results.baseline(speech, rounds))
    against = field.career(field.context(field.cells(e, speech, field.prelims(t, team_round, speech))))
    base = scores.score_profile(speech).select("person_id", "n", "iqr").join(results.rates(e), "person_id")
    for more in (
        scores.momentum(speech).select("person_id", "momentum", "samples"), against.select("person_id", "placements", "mean_percentile"),
        results.streaks(rounds, t).select("person_id", "win_streak"), readmodel.split_signals(made),
    ):
        base = base.join(more, "person_id", "left")
    base = base.withColumns({c: F.round(c, 9) for c in ("momentum", "iqr", "mean_percentile", "seat_spread", "type_gain", "topic_loss", "size_gap")})  # sums differ in their last bits
    shown = F.transform(readmodel.remarks(), lambda x: F.concat_ws(":", x["id"], x["tone"], x["value"]))
    return base.select("person_id", F.array_join(shown, ",").alias("remarks"))


@query(_MERGED + """
, w AS (SELECT person_id, position AS key, count(*) FILTER (WHERE won) / nullif(count(won), 0) AS rate FROM merged WHERE position <> '' GROUP BY ALL HAVING count(*) >= 6 AND count(won) > 0)
SELECT person_id, round(max(rate) - min(rate), 6) AS spread FROM w GROUP BY person_id HAVING max(rate) - min(rate) >= 0.12""")
def agg_40_seat_remark(spark, sf_dir):
    rounds = results.merged_rounds(facts.speech(spark, sf_dir), facts.team_round(spark, sf_dir))
    rows = results.split_credits(rounds, facts.tournament(spark, sf_dir), facts.motion(spark, sf_dir), ["position"])
    made = results.splits(rows, results.baseline(facts.speech(spark, sf_dir), rounds))
    return readmodel.seat_remark(made).select("person_id", numbers.r6(F.col("spread")).alias("spread"))


@query(" SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_41_ordered_string_agg(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct().groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_type")), ",").alias("types"))


@query(" SELECT 'orders' AS table_name, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns UNION ALL SELECT 'region', 'r_regionkey,r_name'")
def src_20_catalog(spark, sf_dir):
    return column_lists(spark, {t: table(spark, sf_dir, t) for t in ("orders", "region")})
