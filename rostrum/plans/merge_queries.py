"""Queries over merges, queues and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions.names import mask_name
from rostrum.functions.numbers import r6
from rostrum.functions.urls import host
from rostrum.operators import jobs, merging, ranks
from rostrum.operators.table_store import TableStore
from rostrum.plans import facts
from rostrum.plans.facts import Catalog, table
from rostrum.sources.store import shared_folder
from rostrum.streaming import windows

CATALOG = Catalog()
query = CATALOG.query

_PERSON = """
, old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS claimed, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal END AS suppressed FROM customer)
, new AS (SELECT c_custkey * 2 AS id, upper(c_name) AS name, c_nationkey + 100 AS claimed, NULL::DOUBLE AS suppressed FROM customer)"""


def _people(spark, d):
    """All customers as stored people, and all again as new ones under twice their key: half of either side meets the other."""
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("claimed"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal")).alias("suppressed"))
    new = c.select((F.col("c_custkey") * 2).alias("id"), F.upper("c_name").alias("name"), (F.col("c_nationkey") + 100).alias("claimed"), F.lit(None).cast("double").alias("suppressed"))
    return old, new


@query(_PERSON + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.name WHEN n.id IS NULL OR o.suppressed IS NOT NULL THEN o.name ELSE n.name END AS name, CASE WHEN o.id IS NULL THEN n.claimed WHEN n.id IS NULL OR o.suppressed IS NOT NULL THEN o.claimed ELSE n.claimed END AS claimed, o.suppressed FROM old o FULL JOIN new n ON o.id = n.id")
def mut_01_person_upsert(spark, sf_dir):
    return merging.upsert_unless(*_people(spark, sf_dir), ["id"], "suppressed")


@query(_PERSON + " SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(o.claimed, n.claimed) AS claimed, CASE WHEN n.id IS NULL OR o.id IS NOT NULL THEN o.suppressed END AS suppressed FROM old o FULL JOIN new n ON o.id = n.id")
def mut_02_claim_upsert(spark, sf_dir):
    return merging.upsert(*_people(spark, sf_dir), ["id"], {"claimed": "fill", "suppressed": "keep"})


@query(_PERSON + " SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.claimed ELSE n.claimed END AS claimed, CASE WHEN n.id IS NULL THEN o.suppressed END AS suppressed FROM old o FULL JOIN new n ON o.id = n.id")
def snk_06_upsert_on_key(spark, sf_dir):
    return merging.upsert(*_people(spark, sf_dir), ["id"])


@query(_PERSON + " SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def mut_05_insert_absent(spark, sf_dir):
    return merging.insert_absent(*_people(spark, sf_dir), ["id"])


@query(_PERSON + " SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(o.claimed, n.claimed) AS claimed, coalesce(o.suppressed, n.suppressed) AS suppressed FROM old o FULL JOIN new n ON o.id = n.id")
def mut_06_fill_nulls(spark, sf_dir):
    return merging.upsert(*_people(spark, sf_dir), ["id"], {"name": "fill", "claimed": "fill", "suppressed": "fill"})


@query(_PERSON + " SELECT * FROM old WHERE id % 40 NOT IN (SELECT id % 40 FROM new WHERE id % 3 = 0) UNION ALL SELECT * FROM new WHERE id % 3 = 0")
def snk_07_bulk_replace(spark, sf_dir):
    old, new = (x.withColumn("parent", F.col("id") % 40) for x in _people(spark, sf_dir))
    return merging.replace_children(old, new.filter("id % 3 = 0"), ["parent"], ["id"]).drop("parent")


@query("""
, tids AS (SELECT n_nationkey AS tid FROM nation WHERE n_regionkey = 1)
, participant AS (SELECT c_custkey AS participant_id, c_nationkey AS tid, c_custkey % 400 AS person_id, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS claimed FROM customer)
, panel AS (SELECT o_orderkey AS id, o_custkey % 25 AS tid, o_custkey % 400 AS person_id, CASE WHEN o_orderkey % 2 = 0 THEN 'landing' ELSE 'round_results' END AS source FROM orders)
SELECT 'elimination' AS name, p_partkey AS id FROM part WHERE p_partkey % 25 NOT IN (SELECT tid FROM tids)
UNION ALL SELECT 'team_result', event_id FROM events WHERE user_id % 25 NOT IN (SELECT tid FROM tids)
UNION ALL SELECT 'judge_assignment', id FROM panel WHERE NOT (source = 'round_results' AND tid IN (SELECT tid FROM tids))
UNION ALL SELECT 'speaker_score', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT participant_id FROM participant WHERE tid IN (SELECT tid FROM tids))
UNION ALL SELECT 'role', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT participant_id FROM participant WHERE tid IN (SELECT tid FROM tids))
UNION ALL SELECT 'participant', participant_id FROM participant WHERE NOT (tid IN (SELECT tid FROM tids) AND claimed IS NULL AND (tid, person_id) NOT IN (SELECT (tid, person_id) FROM panel))""")
def mut_03_refresh(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    o, key = t("orders"), F.col("o_orderkey").alias("id")
    tables = {
        "elimination": t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("tid")),
        "team_result": t("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("tid")),
        "judge_assignment": o.select(key, (F.col("o_custkey") % 25).alias("tid"), (F.col("o_custkey") % 400).alias("person_id"), F.when(F.col("o_orderkey") % 2 == 0, "landing").otherwise("round_results").alias("source")),
        "speaker_score": o.select(key, F.col("o_custkey").alias("participant_id")),
        "role": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("participant_id")),
        "participant": t("customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_nationkey").alias("tid"), (F.col("c_custkey") % 400).alias("person_id"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("claimed")),
    }
    left = merging.refreshed(tables, t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("tid")))
    parts = [df.select(F.lit(name).alias("name"), F.col("participant_id" if name == "participant" else "id").cast("bigint").alias("id")) for name, df in left.items()]
    return reduce(DataFrame.unionByName, parts)


@query(_PERSON + " SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.claimed ELSE n.claimed END AS claimed, CASE WHEN n.id IS NULL THEN o.suppressed END AS suppressed FROM old o FULL JOIN new n ON o.id = n.id")
def snk_06_stored_upsert(spark, sf_dir):
    """The upsert as a merge into a stored table: buckets without a new row are taken over as they are."""
    old, new = _people(spark, sf_dir)
    store = TableStore(spark, shared_folder(spark)).create(old, ["id"])
    store.merge(new, lambda a, b: merging.upsert(a, b, ["id"]))
    return store.read()


@query(_PERSON + " SELECT * FROM old WHERE id % 40 NOT IN (SELECT id % 40 FROM new WHERE id % 3 = 0) UNION ALL SELECT * FROM new WHERE id % 3 = 0")
def snk_07_stored_replace(spark, sf_dir):
    """The replacement of children as a merge into a table that is stored by parent."""
    old, new = (x.withColumn("parent", F.col("id") % 40) for x in _people(spark, sf_dir))
    store = TableStore(spark, shared_folder(spark)).create(old, ["parent"])
    store.merge(new.filter("id % 3 = 0"), lambda a, b: merging.replace_children(a, b, ["parent"], ["id"]))
    return store.read().drop("parent")


@query(_PERSON + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.name WHEN n.id IS NULL OR o.suppressed IS NOT NULL THEN o.name ELSE n.name END AS name, CASE WHEN o.id IS NULL THEN n.claimed WHEN n.id IS NULL OR o.suppressed IS NOT NULL THEN o.claimed ELSE n.claimed END AS claimed, o.suppressed FROM old o FULL JOIN new n ON o.id = n.id")
def mut_01_stored_persons(spark, sf_dir):
    """The upsert of persons in two merges, the second of which repeats the first: suppressed ones stay, and nothing changes twice."""
    old, new = _people(spark, sf_dir)
    store = TableStore(spark, shared_folder(spark)).create(old, ["id"])
    for _ in range(2):
        store.merge(new, lambda a, b: merging.upsert_unless(a, b, ["id"], "suppressed"))
    return store.read()


_MOTIONS = """
, om AS (SELECT p_partkey % 50 AS tid, p_partkey AS seq, p_name AS text, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS tag FROM part)
, nm AS (SELECT p_partkey * 2 % 50 AS tid, p_partkey * 2 AS seq, upper(p_name) AS text, p_brand AS tag FROM part)"""


@query(_MOTIONS + " SELECT * FROM om WHERE tid NOT IN (SELECT tid FROM nm) UNION ALL SELECT nm.tid, nm.seq, nm.text, coalesce(om.tag, nm.tag) AS tag FROM nm LEFT JOIN om ON om.tid = nm.tid AND om.seq = nm.seq")
def mut_04_motion_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    at = lambda seq: ((seq % 50).alias("tid"), seq.alias("seq"))  # noqa: E731  (odd tournaments get no new rows)
    old = p.select(*at(F.col("p_partkey")), F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).alias("tag"))
    new = p.select(*at(F.col("p_partkey") * 2), F.upper("p_name").alias("text"), F.col("p_brand").alias("tag"))
    return merging.merge_and_prune(old, new, ["tid"], ["tid", "seq"], ["tag"])


@query("""
, g AS (SELECT o_custkey AS tid, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS b, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS c, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS d,
    nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS e, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0) AS f FROM orders GROUP BY o_custkey)
SELECT tid, tid % 11 <> 0 AND tid % 13 <> 0 AND ((a > 5 AND b < a * 0.5) OR (c > 5 AND d < c * 0.5) OR (coalesce(e, 0) > 5 AND f < e * 0.5)) AS blocked FROM g""")
def mut_07_regression_guard(spark, sf_dir):
    """Teams, participants and ranked speakers before and after, for every customer as a tournament; some are new, and some are forced."""
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tid")).agg(
        F.count_if(k % 2 == 0).alias("a"), F.count_if(k % 5 == 0).alias("b"), F.count_if(k % 3 == 0).alias("c"), F.count_if(k % 7 != 0).alias("d"), F.nullif(F.count_if(done), F.lit(0)).alias("e"), F.count_if(done & (k % 4 == 0)).alias("f")
    )
    counts = [(F.col(x), F.col(y)) for x, y in ("ab", "cd", "ef")]
    return g.select("tid", merging.overwrite_blocked(counts, F.col("tid") % 11 != 0, F.col("tid") % 13 == 0).alias("blocked"))


@query(" SELECT o_orderkey AS id, o_orderkey % 17 <> 0 AND o_orderdate > TIMESTAMP '2000-01-01' - INTERVAL 30 DAY AND o_orderkey % 3 = 0 AND (o_custkey % 9 = 0 OR o_custkey % 9 <= o_orderkey % 8) AS fresh FROM orders")
def mut_08_cache_freshness(spark, sf_dir):
    k = F.col("o_orderkey")
    fresh = merging.cache_fresh(F.col("o_orderdate").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"), k % 3 == 0, F.col("o_custkey") % 9, k % 8, k % 17 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), fresh.alias("fresh"))


@query(" SELECT user_id, count(*) FILTER (WHERE last_error LIKE 'fetch%') > 0 AS aborted, count(*) AS parts FROM job GROUP BY user_id")
def mut_09_partial_abort(spark, sf_dir):
    return facts.job(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.bool_or(F.col("last_error").startswith("fetch")), F.lit(False)).alias("aborted"), F.count("*").alias("parts"))


_PROPOSAL = """
, proposal AS (SELECT o_orderkey AS id, o_custkey % 60 AS motion, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS value, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status FROM orders)"""


def _proposals(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("motion"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("value"), s.alias("status"))


@query(_PROPOSAL + """
, chosen AS (SELECT motion, value FROM proposal WHERE status = 'approved' QUALIFY row_number() OVER (PARTITION BY motion ORDER BY id) = 1)
SELECT p.id, p.motion, p.value, CASE WHEN p.status = 'pending' AND c.motion IS NOT NULL THEN 'approved' ELSE p.status END AS status FROM proposal p LEFT JOIN chosen c ON p.motion = c.motion AND p.value IS NOT DISTINCT FROM c.value""")
def mut_10_tag_approval(spark, sf_dir):
    p = _proposals(spark, sf_dir)
    chosen = ranks.first_by(p.filter("status = 'approved'"), ["motion"], F.asc("id")).select("motion", "value")
    j = p.alias("p").join(chosen.alias("c"), merging.null_safe("p", "c", ["motion", "value"]), "left")
    return j.select("p.id", "p.motion", "p.value", F.when((F.col("p.status") == "pending") & F.col("c.motion").isNotNull(), "approved").otherwise(F.col("p.status")).alias("status"))


@query("""
, req AS (SELECT o_orderkey AS proposal_id, o_custkey % 50 AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'motion_type' ELSE 'motion_topic' END AS kind, o_custkey % 25 AS tid,
    CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 7 = 0 THEN o_orderkey % 200 END AS motion_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE 'kind ' || (o_orderkey % 8) END AS value, o_orderkey % 5 = 0 AS stored, o_orderstatus, o_orderdate FROM orders)
, motions AS (SELECT DISTINCT p_partkey % 25 AS tid, p_partkey % 200 AS motion_id FROM part)
, ok AS (SELECT * FROM req WHERE NOT stored AND CASE kind WHEN 'region' THEN value IN ('1-URGENT', '2-HIGH') AND motion_id IS NULL ELSE value IN ('kind 1', 'kind 2', 'kind 5') AND (tid, motion_id) IN (SELECT (tid, motion_id) FROM motions) END
    AND (user_id, tid) IN (SELECT (c_custkey % 50, c_nationkey) FROM customer WHERE c_custkey % 2 = 0) QUALIFY row_number() OVER (PARTITION BY user_id, kind, tid, motion_id ORDER BY proposal_id DESC) = 1)
, old AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, row_number() OVER (PARTITION BY user_id, kind, tid, motion_id ORDER BY proposal_id) = 1 AS first FROM req WHERE stored)
SELECT o.proposal_id, o.user_id, o.kind, o.tid, o.motion_id, coalesce(n.value, o.value) AS value, CASE WHEN n.value IS NULL THEN o.status ELSE 'pending' END AS status, CASE WHEN n.value IS NULL THEN 'seen' END AS note, CASE WHEN n.value IS NULL THEN o.o_orderdate END AS reviewed_at
FROM old o LEFT JOIN ok n ON o.first AND n.user_id = o.user_id AND n.kind = o.kind AND n.tid = o.tid AND n.motion_id IS NOT DISTINCT FROM o.motion_id
UNION ALL SELECT n.proposal_id, n.user_id, n.kind, n.tid, n.motion_id, n.value, 'pending', NULL, NULL FROM ok n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.user_id = o.user_id AND n.kind = o.kind AND n.tid = o.tid AND n.motion_id IS NOT DISTINCT FROM o.motion_id)""")
def mut_11_tag_upsert(spark, sf_dir):
    """Every fifth order is a stored proposal, all others ask for one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    region = k % 3 == 0
    req = table(spark, sf_dir, "orders").select(
        k.alias("proposal_id"), (c % 50).alias("user_id"), F.when(region, "region").when(k % 3 == 1, "motion_type").otherwise("motion_topic").alias("kind"), (c % 25).alias("tid"),
        F.when(~region | (k % 7 == 0), k % 200).alias("motion_id"), F.when(region, F.col("o_orderpriority")).otherwise(F.concat(F.lit("kind "), (k % 8).cast("string"))).alias("value"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"), F.lit("seen").alias("note"), F.col("o_orderdate").alias("reviewed_at"), (k % 5 == 0).alias("stored"),
    )
    words = [("region", "1-URGENT"), ("region", "2-HIGH"), *((kind, f"kind {i}") for kind in ("motion_type", "motion_topic") for i in (1, 2, 5))]
    owned = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").alias("tid"))
    motions = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("tid"), (F.col("p_partkey") % 200).alias("motion_id"))
    asked = req.filter("not stored").withColumn("seq", F.col("proposal_id"))
    accepted = merging.accepted_proposals(asked, spark.createDataFrame(words, "kind string, value string"), owned, motions)
    return merging.propose_tags(req.filter("stored").drop("stored"), accepted)


@query(_PERSON + " SELECT id, CASE WHEN suppressed IS NOT NULL THEN '[name withdrawn]' ELSE name END AS name, CASE WHEN suppressed IS NULL THEN claimed END AS claimed FROM old")
def mut_12_suppress(spark, sf_dir):
    old, _ = _people(spark, sf_dir)
    return old.select("id", mask_name(F.col("name"), F.col("suppressed")).alias("name"), F.when(F.col("suppressed").isNull(), F.col("claimed")).alias("claimed"))


@query(" SELECT job_id, CASE WHEN status = 'failed' AND NOT coalesce(regexp_matches(last_error, 'HTTP 404'), false) THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND NOT coalesce(regexp_matches(last_error, 'HTTP 404'), false) THEN 0 ELSE attempts END AS attempts FROM job")
def mut_13_retry_failed(spark, sf_dir):
    j = facts.job(spark, sf_dir)
    again = (F.col("status") == "failed") & ~F.coalesce(jobs.is_permanent(F.col("last_error")), F.lit(False))
    return j.select("job_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, F.lit(0).cast("bigint")).otherwise(F.col("attempts")).alias("attempts"))


_RUN = "job_id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT again THEN last_error END AS last_error, CASE WHEN NOT again THEN finished_at END AS finished_at"


@query(" SELECT " + _RUN + " FROM (SELECT *, (user_id, url) IN (SELECT (user_id, url) FROM job WHERE attempts = 4) AS again FROM job)")
def mut_13_clear(spark, sf_dir):
    j = facts.job(spark, sf_dir)
    return jobs.cleared(j, j.filter("attempts = 4")).select("job_id", "status", "attempts", "last_error", "finished_at")


@query(" SELECT " + _RUN + " FROM (SELECT *, user_id % 5 <> 0 AND (user_id, url) NOT IN (SELECT (user_id, url) FROM job WHERE regexp_matches(last_error, 'HTTP 404')) AS again FROM job)")
def mut_13_reingest(spark, sf_dir):
    j = facts.job(spark, sf_dir)
    found = j.select("user_id", "url", (F.col("user_id") % 5 == 0).alias("locked")).distinct()
    return jobs.reingested(j, found).select("job_id", "status", "attempts", "last_error", "finished_at")


@query(" SELECT job_id, url, status FROM job WHERE NOT (status = 'pending' AND user_id % 5 = 0)")
def mut_13_lock(spark, sf_dir):
    j = facts.job(spark, sf_dir)
    return jobs.without_locked(j, j.filter("user_id % 5 = 0")).select("job_id", "url", "status")


@query("""
, seen AS (SELECT url, job_id, CASE WHEN job_id % 7 <> 0 THEN strftime(scheduled_at, '%a, %d %b %Y') END AS date FROM job)
, f AS (SELECT url, job_id, date FROM seen QUALIFY row_number() OVER (PARTITION BY url ORDER BY job_id) = 1)
SELECT s.url, s.job_id, s.date FROM seen s JOIN f USING (url) WHERE CASE WHEN f.date IS NULL THEN s.job_id = f.job_id ELSE s.date IS NOT NULL END
QUALIFY row_number() OVER (PARTITION BY s.url ORDER BY s.date, s.job_id) = 1""")
def mut_14_url_keep_earliest(spark, sf_dir):
    """Every job as a message with a link; dates are text as mail headers spell them, and compare as text."""
    date = F.when(F.col("job_id") % 7 != 0, F.date_format("scheduled_at", "EEE, dd MMM yyyy"))
    return jobs.earliest_urls(facts.job(spark, sf_dir).select("url", "job_id", date.alias("date")), "url", "job_id", "date")


_DOCS = ", doc AS (SELECT doc_id, source AS url, sha256(text) AS hash, TIMESTAMP '2024-01-01' + to_hours(doc_id % 5000) AS fetched_at FROM documents)"


def _archive(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("url"), F.sha2("text", 256).alias("hash"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id") % 5000)).alias("fetched_at"))


@query(_DOCS + " SELECT doc_id, url FROM doc QUALIFY fetched_at = max(fetched_at) OVER (PARTITION BY url) OR fetched_at >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY")
def mut_15_retention(spark, sf_dir):
    return jobs.newest_documents(_archive(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"), 10).select("doc_id", "url")


@query(_DOCS + " SELECT doc_id, url FROM doc QUALIFY fetched_at = max(fetched_at) OVER (PARTITION BY url)")
def win_05_newest_per_url(spark, sf_dir):
    return merging.keep_newest(_archive(spark, sf_dir), ["url"], "fetched_at").select("doc_id", "url")


@query(_DOCS + " SELECT url, hash, max(fetched_at) AS fetched_at, count(*) AS times FROM doc GROUP BY ALL")
def src_18_content_hash(spark, sf_dir):
    return _archive(spark, sf_dir).groupBy("url", "hash").agg(F.max("fetched_at").alias("fetched_at"), F.count("*").alias("times"))


_RUNS = ", run AS (SELECT event_id AS run_id, user_id AS document_id, event_type <> 'error' AS success, event_type AS parser, ts AS created_at FROM events)"


def _runs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("document_id"), (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("parser"), F.col("ts").alias("created_at"))


@query(_RUNS + " SELECT document_id, run_id FROM run WHERE success QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) = 1")
def win_04_latest_success(spark, sf_dir):
    return jobs.latest_success(_runs(spark, sf_dir)).select("document_id", "run_id")


@query(_RUNS + " SELECT document_id, parser, run_id FROM run QUALIFY row_number() OVER (PARTITION BY document_id, parser ORDER BY created_at DESC, run_id) = 1")
def win_09_latest_per_parser(spark, sf_dir):
    return ranks.first_by(_runs(spark, sf_dir), ["document_id", "parser"], F.desc("created_at"), F.asc("run_id")).select("document_id", "parser", "run_id")


@query(_RUNS + ", keep AS (SELECT run_id FROM run WHERE success QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) = 1) SELECT run_id, document_id FROM run WHERE run_id NOT IN (SELECT run_id FROM keep)")
def join_15_not_in(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return r.join(jobs.latest_success(r).select("run_id"), "run_id", "left_anti").select("run_id", "document_id")


@query(_RUNS + " SELECT r.run_id FROM run r WHERE EXISTS (SELECT 1 FROM run n WHERE n.document_id = r.document_id AND n.parser = r.parser AND n.created_at > r.created_at)")
def join_13_exists(spark, sf_dir):
    r = _runs(spark, sf_dir)
    top = r.groupBy("document_id", "parser").agg(F.max("created_at").alias("top"))
    return r.join(top, ["document_id", "parser"]).filter("created_at < top").select("run_id")


@query(" SELECT job_id, 'judge' AS role FROM job WHERE status = 'running' UNION ALL SELECT job_id, 'speaker' FROM job j WHERE NOT EXISTS (SELECT 1 FROM job r WHERE r.status = 'running' AND r.job_id = j.job_id)")
def join_14_not_exists(spark, sf_dir):
    j = facts.job(spark, sf_dir).select("job_id", "status")
    have = j.filter("status = 'running'").select("job_id", F.lit("judge").alias("role"))
    return merging.insert_absent(have, j.select("job_id", F.lit("speaker").alias("role")), ["job_id"])


@query(" SELECT min(assignment_id) AS assignment_id FROM judging GROUP BY person_id, slot, stage, round, panel_role")
def join_17_null_safe_dedupe(spark, sf_dir):
    return merging.keep_lowest(facts.judging(spark, sf_dir), ["person_id", "slot", "stage", "round", "panel_role"], "assignment_id").select("assignment_id")


@query(" SELECT job_id, user_id FROM job QUALIFY rank() OVER (PARTITION BY user_id ORDER BY scheduled_at DESC) = 1")
def join_18_keep_newest(spark, sf_dir):
    return merging.keep_newest(facts.job(spark, sf_dir), ["user_id"], "scheduled_at").select("job_id", "user_id")


@query(" SELECT job_id, CASE WHEN regexp_matches(last_error, 'HTTP 404') THEN 'abandoned' ELSE status END AS status FROM job")
def mut_16_backfill(spark, sf_dir):
    return facts.job(spark, sf_dir).select("job_id", F.when(F.col("last_error").like("%HTTP 404%"), "abandoned").otherwise(F.col("status")).alias("status"))


_ACCOUNTS = """
, usr AS (SELECT c_custkey AS user_id, c_name AS email, CASE WHEN c_nationkey = 3 THEN ' ' || upper(c_name) WHEN c_nationkey = 4 THEN 'x' END AS confirm FROM customer)
, gone AS (SELECT user_id FROM usr WHERE lower(trim(confirm)) = lower(email))
, person AS (SELECT p_partkey AS person_id, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 1500 END AS claimed_by, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS claimed_at FROM part)"""


def _accounts(spark, d):
    c, p, o = (table(spark, d, t) for t in ("customer", "part", "orders"))
    confirm = F.when(F.col("c_nationkey") == 3, F.concat(F.lit(" "), F.upper("c_name"))).when(F.col("c_nationkey") == 4, "x")
    users = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    claimed = F.col("p_partkey") % 3 != 0
    tables = {
        "user": users, "url": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")), "report": o.select((F.col("o_orderkey") * 10).alias("id"), F.col("o_orderkey").alias("url_id")),
        "person": p.select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), F.when(claimed, F.col("p_partkey") % 1500).alias("claimed_by"), F.when(claimed, F.col("p_size")).alias("claimed_at")),
    }
    return tables, c.select(F.col("c_custkey").alias("user_id"), confirm.alias("confirm"))


@query(_ACCOUNTS + """
SELECT 'user' AS name, user_id AS id, NULL AS ref FROM usr WHERE user_id NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'url', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'report', o_orderkey * 10, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'person', person_id, CASE WHEN claimed_by NOT IN (SELECT user_id FROM gone) THEN claimed_by END FROM person""")
def mut_17_delete_cascade(spark, sf_dir):
    """Accounts that are deleted under the right address, with what hangs on them: urls, their reports; people only lose the claim."""
    tables, requests = _accounts(spark, sf_dir)
    links = [merging.Link("url", "user_id", "user", "user_id"), merging.Link("report", "url_id", "url", "id"), merging.Link("person", "claimed_by", "user", "user_id", ("claimed_by", "claimed_at"))]
    left = merging.cascade(tables, links, "user", "user_id", merging.confirmed(requests, tables["user"]))
    shown = {"user": ("user_id", F.lit(None)), "url": ("id", F.col("user_id")), "report": ("id", F.col("url_id")), "person": ("person_id", F.col("claimed_by"))}
    parts = [left[name].select(F.lit(name).alias("name"), F.col(key).cast("bigint").alias("id"), ref.cast("bigint").alias("ref")) for name, (key, ref) in shown.items()]
    return reduce(DataFrame.unionByName, parts)


@query(_ACCOUNTS + """
SELECT person_id, CASE WHEN person_id % 4 <> 0 THEN claimed_by END AS claimed_by, CASE WHEN person_id % 4 <> 0 THEN claimed_at END AS claimed_at, CASE WHEN person_id % 4 = 0 AND claimed_by IS NOT NULL THEN claimed_by || ': "' || name || '" was removed from your record' END AS told FROM person""")
def mut_17_claim_release(spark, sf_dir):
    """Every fourth identity is released, and its holder is told."""
    persons = _accounts(spark, sf_dir)[0]["person"]
    after, told = merging.released_claims(persons, persons.filter("person_id % 4 = 0"))
    line = told.select("title", F.concat(F.col("user_id").cast("string"), F.lit(": "), "title").alias("told")).distinct()
    held = persons.filter("person_id % 4 = 0 and claimed_by is not null").select("person_id", F.concat(F.col("claimed_by").cast("string"), F.lit(': "'), "name", F.lit('" was removed from your record')).alias("told"))
    return after.join(held.join(line, "told", "left_semi"), "person_id", "left").select("person_id", "claimed_by", "claimed_at", "told")


_HOST = "split_part(split_part(url, '//', 2), '/', 1)"


@query(f" , p AS (SELECT job_id, {_HOST} AS host, attempts + 1 AS attempts, scheduled_at FROM job WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY scheduled_at, job_id) = 1) SELECT job_id, host, attempts FROM p ORDER BY scheduled_at, job_id LIMIT 3")
def str_01_queue_claim(spark, sf_dir):
    return jobs.claimable(facts.job(spark, sf_dir), 3)


@query(f" SELECT job_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY scheduled_at, job_id) AS wave FROM job WHERE status = 'pending'")
def str_02_drain_waves(spark, sf_dir):
    return jobs.waves(facts.job(spark, sf_dir))


@query(" SELECT job_id, CASE WHEN attempts > 3 THEN 'failed' WHEN last_error IS NULL THEN 'done' WHEN last_error LIKE '%deadlock%' THEN 'pending' WHEN last_error LIKE '%HTTP 404%' THEN 'abandoned' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS next FROM job")
def str_03_retry_machine(spark, sf_dir):
    return facts.job(spark, sf_dir).select("job_id", jobs.next_status(F.col("last_error"), F.col("attempts")).alias("next"))


@query(" SELECT job_id, CASE WHEN status = 'running' AND (started_at IS NULL OR started_at < TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE) THEN 'pending' ELSE status END AS status FROM job")
def str_04_stuck_recovery(spark, sf_dir):
    return jobs.recover_stuck(facts.job(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).select("job_id", "status")


_ANCHORED = """
, ev AS (SELECT user_id, {kind} ts, row_number() OVER (PARTITION BY user_id {part} ORDER BY ts, event_id) AS i FROM events)
, w AS (SELECT user_id, {kind} i, ts, ts AS window_start, 1::BIGINT AS n FROM ev WHERE i = 1
  UNION ALL SELECT e.user_id, {ekind} e.i, e.ts, CASE WHEN w.window_start < e.ts - INTERVAL {span} THEN e.ts ELSE w.window_start END, CASE WHEN w.window_start < e.ts - INTERVAL {span} THEN 1 ELSE w.n + 1 END
  FROM w JOIN ev e ON e.user_id = w.user_id {on} AND e.i = w.i + 1)"""


@query(_ANCHORED.format(kind="", part="", ekind="", on="", span="1 DAY") + " SELECT user_id, ts, window_start, n, n <= 3 AS ok FROM w")
def str_05_rate_limit(spark, sf_dir):
    return jobs.rate_limit(table(spark, sf_dir, "events"), ["user_id"], "ts", 86_400, 3)


def _as_they_arrive(spark, d, make, lots=5):
    """What a stream puts out over all events that are filed in ``lots`` lots, out of order by up to two days, and one much later that ends
    them. It runs once after each lot."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    seconds = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(172_800))
    ends = e.agg(F.min(F.unix_seconds("ts")).alias("low"), (F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts")) + 172_801).alias("span"))
    placed = e.join(F.broadcast(ends)).withColumn("lot", F.floor((seconds - F.col("low")) * lots / F.col("span"))).drop("low", "span")
    last = e.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), "ts", F.lit(lots).cast("bigint").alias("lot"))
    path = shared_folder(spark)
    for k in range(lots + 1):
        (placed if k < lots else last).filter(F.col("lot") == k).drop("lot").write.mode("append").parquet(f"{path}/in")
        stream = make(spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").parquet(f"{path}/in"))
        out = windows.collected(stream, f"{path}/out", f"{path}/state")
    return out.filter("user_id >= 0")


@query(_ANCHORED.format(kind="", part="", ekind="", on="", span="1 DAY") + " SELECT user_id, ts, window_start, n, n <= 3 AS ok FROM w")
def str_05_limits_of_a_stream(spark, sf_dir):
    """The limits of all events as they arrive late and out of order: the same as those of the batch plan."""
    return _as_they_arrive(spark, sf_dir, lambda events: windows.rate_limits(events, "user_id", "ts", 86_400, 3, "2 days"))


@query(_ANCHORED.format(kind="", part="", ekind="", on="", span="5 MINUTE") + " SELECT user_id, ts FROM w WHERE n = 1")
def str_07_cooldown_of_a_stream(spark, sf_dir):
    """The scans that may run, of all events as they arrive late and out of order."""
    return _as_they_arrive(spark, sf_dir, lambda events: windows.first_of_window(events, "user_id", "ts", 300, "2 days"))


@query(_ANCHORED.format(kind="event_type,", part=", event_type", ekind="e.event_type,", on="AND e.event_type = w.event_type", span="2 DAY") + " SELECT user_id, event_type, ts FROM w WHERE n = 1")
def str_06_notification_dedupe(spark, sf_dir):
    return jobs.deduped(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 2 * 86_400)


@query(_ANCHORED.format(kind="", part="", ekind="", on="", span="5 MINUTE") + " SELECT user_id, ts FROM w WHERE n = 1")
def str_07_scan_cooldown(spark, sf_dir):
    return jobs.cooled_down(table(spark, sf_dir, "events"), ["user_id"], "ts", 300)


@query(" SELECT user_id, max(ts) - INTERVAL 1 DAY AS after FROM events GROUP BY user_id")
def str_08_incremental_bound(spark, sf_dir):
    return jobs.incremental_bound(table(spark, sf_dir, "events"), ["user_id"], "ts")


@query(" , b AS (SELECT user_id, max(ts) - INTERVAL 1 DAY AS after FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id) SELECT event_id FROM events JOIN b USING (user_id) WHERE ts > after")
def src_17_incremental_list(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bound = jobs.incremental_bound(e.filter("ts < timestamp'2024-01-20'"), ["user_id"], "ts")
    return e.join(bound, "user_id").filter("ts > after").select("event_id")


@query(" SELECT user_id, count(*) AS refusals, least(3.0, 1.5 * 2.0 ** count(*))::DOUBLE AS seconds FROM job WHERE last_error IS NOT NULL GROUP BY user_id")
def str_09_backoff(spark, sf_dir):
    g = facts.job(spark, sf_dir).filter("last_error is not null").groupBy("user_id").agg(F.count("*").alias("refusals"))
    return g.withColumn("seconds", jobs.backoff(F.col("refusals")))


@query("""
, c AS (SELECT user_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done' AND finished_at >= TIMESTAMP '2000-01-01' - INTERVAL 60 MINUTE) AS done, count(*) FILTER (WHERE status IN ('failed', 'abandoned') AND finished_at >= TIMESTAMP '2000-01-01' - INTERVAL 60 MINUTE) AS failed FROM job GROUP BY user_id)
, cur AS (SELECT user_id, job_id AS current_job, started_at FROM job WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at NULLS LAST, job_id) = 1)
, l AS (SELECT user_id, epoch(finished_at) - epoch(started_at) AS took FROM job WHERE status = 'done' AND started_at IS NOT NULL AND finished_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY finished_at DESC, job_id) <= 20)
, m AS (SELECT user_id, avg(took) AS mean FROM l WHERE took >= 0 AND took < 600 GROUP BY user_id)
SELECT user_id, pending, running, done, failed, done + failed + running + pending AS total, current_job, floor(mean * 10 + 0.5) / 10 AS mean_seconds,
  CASE WHEN pending + running > 0 THEN greatest(floor(pending * coalesce(mean, 40) + 0.5) + CASE WHEN running > 0 THEN floor(greatest(coalesce(mean, 40) - coalesce(epoch(TIMESTAMP '2000-01-01') - epoch(started_at), 0), 5) * running + 0.5) ELSE 0 END, 5)::BIGINT END AS eta
FROM c LEFT JOIN m USING (user_id) LEFT JOIN cur USING (user_id)""")
def agg_34_queue_progress(spark, sf_dir):
    return jobs.progress(facts.job(spark, sf_dir), F.lit("2000-01-01").cast("timestamp"))


@query(" SELECT status, count(*) AS n, count(*) FILTER (WHERE attempts >= 3) AS tired FROM job GROUP BY status")
def agg_01_filtered_count(spark, sf_dir):
    return facts.job(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("attempts") >= 3).alias("tired"))


@query(f" SELECT {_HOST} AS host, count(DISTINCT url) AS urls FROM job GROUP BY 1")
def agg_35_host_counts(spark, sf_dir):
    return facts.job(spark, sf_dir).select(host(F.col("url")).alias("host"), "url").groupBy("host").agg(F.count_distinct("url").alias("urls"))


@query(" SELECT tid, max(round) AS last_round, round(avg(points), 6) AS points FROM team_round WHERE round > 0 GROUP BY tid")
def agg_02_group_max(spark, sf_dir):
    return facts.team_round(spark, sf_dir).filter("round > 0").groupBy("tid").agg(F.max("round").alias("last_round"), r6(F.avg("points")).alias("points"))
