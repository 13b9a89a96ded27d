"""Merges of a new parse and of proposals, by cases worked out by hand."""

from pyspark.sql import functions as F

from rostrum.operators import merging


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_parse_that_loses_half_of_anything_is_blocked(spark):
    cases = [((10, 4), (10, 9), (0, 0), True, False, True), ((10, 5), (10, 9), (0, 0), True, False, False), ((5, 0), (5, 0), (5, 0), True, False, False), ((9, 9), (6, 2), (0, 0), True, False, True),
             ((9, 9), (9, 9), (20, None), True, False, True), ((10, 0), (10, 0), (9, 0), True, True, False), ((10, 0), (10, 0), (9, 0), False, False, False), ((None, 0), (None, 0), (None, 0), True, False, False)]
    df = spark.createDataFrame([(i, *a, *b, *c, known, force, want) for i, (a, b, c, known, force, want) in enumerate(cases)], "i int, a int, b int, c int, d int, e int, f int, known boolean, force boolean, want boolean")
    got = df.withColumn("got", merging.overwrite_blocked([(F.col(x), F.col(y)) for x, y in ("ab", "cd", "ef")], F.col("known"), F.col("force")))
    assert got.filter("got <> want").collect() == []


def test_a_cache_is_fresh(spark):
    df = spark.createDataFrame([(1, 29, True, 5, 5, False), (2, 30, True, 5, 5, False), (3, 1, False, 5, 5, False), (4, 1, True, 6, 5, False), (5, 1, True, 0, 9, False), (6, 1, True, 5, 5, True)], "i int, age int, current boolean, nav int, stored int, force boolean")
    now = F.lit("2024-06-01").cast("timestamp")
    fresh = merging.cache_fresh(now - F.make_dt_interval(days=F.col("age")), now, F.col("current"), F.col("nav"), F.col("stored"), F.col("force"))
    assert {r.i for r in df.filter(fresh).collect()} == {1, 5}


def test_a_refresh_keeps_private_history_and_claimed_people(spark):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    tables = {
        "elimination": make([(1, 7), (2, 8)], "id long, tid long"), "team_result": make([(1, 7), (2, 8)], "id long, tid long"),
        "judge_assignment": make([(1, 7, 101, "landing"), (2, 7, 102, "round_results"), (3, 8, 103, "round_results")], "id long, tid long, person_id long, source string"),
        "speaker_score": make([(1, 11), (2, 21)], "id long, participant_id long"), "role": make([(1, 12), (2, 21)], "id long, participant_id long"),
        "participant": make([(11, 7, 101, None), (12, 7, 104, None), (13, 7, 105, 9), (14, 7, 102, None), (15, 7, None, None), (21, 8, 104, None)], "participant_id long, tid long, person_id long, claimed long"),
    }
    left = merging.refreshed(tables, make([(7,), (7,)], "tid long"))
    assert {name: sorted(r[0] if name == "participant" else r["id"] for r in df.select("participant_id" if name == "participant" else "id").collect()) for name, df in left.items()} == {
        "elimination": [2], "team_result": [2], "judge_assignment": [1, 3], "speaker_score": [2], "role": [2], "participant": [11, 13, 14, 21],
    }


def test_proposals_go_back_to_pending_and_do_not_stack(spark):
    request = "seq long, proposal_id long, user_id long, kind string, tid long, motion_id long, value string"
    asked = [
        (1, 91, 1, "region", 7, None, "Asia"), (2, 92, 1, "region", 7, None, "Europe"),  # the last counts
        (3, 93, 1, "region", 7, 5, "Asia"), (4, 94, 1, "region", 8, None, "Asia"), (5, 95, 1, "region", 7, None, "Mars"),  # with a motion, not owned, no such value
        (6, 96, 1, "motion_type", 7, None, "THW"), (7, 97, 1, "motion_type", 7, 6, "THW"), (8, 98, 1, "motion_type", 7, 5, "THW"), (9, 99, 2, "motion_type", 7, 5, "THW"),  # without, another's motion, new, new
    ]
    vocabulary = spark.createDataFrame([("region", "Asia"), ("region", "Europe"), ("motion_type", "THW")], "kind string, value string")
    owned = spark.createDataFrame([(1, 7), (1, 7), (2, 7)], "user_id long, tid long")
    motion = spark.createDataFrame([(7, 5), (8, 6)], "tid long, motion_id long")
    accepted = merging.accepted_proposals(spark.createDataFrame(asked, request), vocabulary, owned, motion)
    assert rows(accepted.select("proposal_id", "value")) == [(92, "Europe"), (98, "THW"), (99, "THW")]
    kinds = "proposal_id long, user_id long, kind string, tid long, motion_id long, value string, status string, note string, reviewed_at string"
    stored = spark.createDataFrame([(10, 1, "region", 7, None, "Asia", "rejected", "no", "then"), (11, 1, "region", 7, None, "Asia", "approved", "ok", "then"), (12, 2, "region", 7, None, "Asia", "approved", "ok", "then"), (13, 2, "motion_type", 7, 5, "THB", "pending", None, None)], kinds)
    out = merging.propose_tags(stored, accepted)
    assert {r.proposal_id: (r.value, r.status, r.note, r.reviewed_at) for r in out.collect()} == {
        10: ("Europe", "pending", None, None), 11: ("Asia", "approved", "ok", "then"), 12: ("Asia", "approved", "ok", "then"), 13: ("THW", "pending", None, None), 98: ("THW", "pending", None, None),
    }
    assert rows(merging.propose_tags(out, accepted)) == rows(out)


def test_deleting_an_account_takes_what_hangs_on_it(spark):
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    users = make([(1, "A@x.org"), (2, "b@x.org"), (3, None)], "user_id long, email string")
    asked = merging.confirmed(make([(1, " a@X.ORG "), (2, "a@x.org"), (3, ""), (9, "q")], "user_id long, confirm string"), users)
    assert sorted(r.user_id for r in asked.collect()) == [1, 3]
    tables = {"user": users, "url": make([(10, 1), (11, 2), (12, None)], "id long, user_id long"), "run": make([(100, 10), (101, 11)], "id long, url_id long"), "person": make([(5, 1, "t"), (6, 2, "t"), (7, None, None)], "person_id long, claimed_by long, claimed_at string")}
    links = [merging.Link("url", "user_id", "user", "user_id"), merging.Link("run", "url_id", "url", "id"), merging.Link("person", "claimed_by", "user", "user_id", ("claimed_by", "claimed_at"))]
    left = merging.cascade(tables, links, "user", "user_id", make([(1,), (1,)], "user_id long"))
    assert {k: rows(v) for k, v in left.items()} == {"user": [(2, "b@x.org"), (3, None)], "url": [(11, 2), (12, None)], "run": [(101, 11)], "person": [(5, None, None), (6, 2, "t"), (7, None, None)]}
    assert {k: v.columns for k, v in left.items()} == {k: v.columns for k, v in tables.items()}


def test_released_claims_are_told_to_their_holders(spark):
    persons = spark.createDataFrame([(1, "Ann", 7, "t"), (2, "Bob", None, None), (3, "Cy", 8, "t")], "person_id long, name string, claimed_by long, claimed_at string")
    after, told = merging.released_claims(persons, spark.createDataFrame([(1,), (2,), (1,)], "person_id long"))
    assert rows(after) == [(1, "Ann", None, None), (2, "Bob", None, None), (3, "Cy", 8, "t")]
    assert rows(told) == [(7, "identity_released", '"Ann" was removed from your record')]
    again, silent = merging.released_claims(after, spark.createDataFrame([(1,)], "person_id long"))
    assert rows(again) == rows(after) and silent.count() == 0
