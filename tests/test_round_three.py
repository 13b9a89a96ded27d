"""Queries on small tables of their own: what the reviewer of round 3 found."""

import datetime as dt

import duckdb
import pytest

from rostrum.plans import catalog

MONDAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with events: (user_id, hours since a Monday, value, k), in order."""

    def write(events, **others):
        rows = [(i, MONDAY + dt.timedelta(hours=h), u, ["view", "click", "purchase", "signup"][i % 4], float(v), f'{{"k": {k}}}') for i, (u, h, v, k) in enumerate(events)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
        for name, df in others.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def oracle(folder, name, tables=("events",)):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(c.execute(catalog.ORACLES[name]).fetchall(), key=str)


def test_entries_without_results_have_a_dash(spark, tables):
    # k % 17 = 0: the round has no result
    folder = tables([(1, 1, 70, 34), (2, 1, 71, 1), (2, 2, 72, 9)])
    got = sorted((tuple(r) for r in catalog.QUERIES["join_06_round_lists"](spark, folder).collect()), key=str)
    assert got == [(1, 2817, "-"), (2, 2817, "1,-")] == oracle(folder, "join_06_round_lists")


ROUNDS, MOTIONS = "person_id long, tid long, round long, score double, won boolean, points long, position string", "motion_id long, tid long, round long, type string, topic string"


def many(spark):
    rounds = spark.createDataFrame([(p, 5, r, 70.0 + p + r if p % 3 else None, p % 2 == 0 if r < 3 else None, p % 4, "OG") for p in range(9) for r in (1, 2, 3)], ROUNDS)
    motion = spark.createDataFrame([(i, 5, 1 + i % 2, "THW" if i % 3 else None, f"T{i % 2}") for i in range(40)], MOTIONS)
    return rounds, motion


def test_motions_are_counted_before_rounds_meet_them(spark):
    """A round has one row for each type or topic, however many motions it has, and what is not asked for is not read."""
    from pyspark.sql import functions as F

    from rostrum.operators import ranks, results

    rounds, motion = many(spark)
    t = spark.createDataFrame([(5, 2025, None, "Europe", 60)], "tid long, year int, format string, region string, teams long")
    credits = results.split_credits(rounds, t, motion)
    got = {tuple(r) for r in credits.groupBy("person_id", "dim", "key").agg(F.sum("credits")).collect()}
    assert got == {tuple(r) for r in results.split_rows(rounds, t, motion).groupBy("person_id", "dim", "key").count().collect()}
    assert credits.filter("dim = 'topic'").count() == 18  # nine persons, two rounds with a topic each, of twenty motions
    assert results.split_credits(rounds, t, None, results.PLAIN).filter("dim = 'position'").count() == 27
    made = {(r.person_id, r.dim, r.key): r for r in results.splits(credits, results.baseline(rounds, rounds)).collect()}
    assert (made[1, "topic", "T0"].rounds, made[1, "topic", "T0"].avg_score, made[1, "topic", "T0"].tournaments) == (20, 72.0, 1)
    assert made[0, "topic", "T0"].avg_score is None and made[0, "motion_type", "THW"].wins == made[0, "motion_type", "THW"].decided > 20
    r = {x.person_id: x for x in ranks.motion_totals(rounds, motion).collect()}[1]
    assert (r.debated, r.tagged, r.avg_score, r.decided, r.wins, r.tournaments, r.win_rate) == (40, 40, 72.5, 40, 0, 1, 0.0)


def test_crowded_rounds_are_dealt_over_tasks(spark, monkeypatch):
    from rostrum.operators import results, spread

    rounds, motion = many(spark)
    plain = sorted(map(tuple, rounds.join(motion, ["tid", "round"], "left").select("person_id", "round", "motion_id").collect()), key=str)
    monkeypatch.setattr(spread, "CROWD", 2)
    assert sorted(map(tuple, results.with_motions(rounds, motion).select("person_id", "round", "motion_id").collect()), key=str) == plain


def test_motions_of_a_tournament_are_dealt_over_tasks(spark, monkeypatch):
    from rostrum.operators import readmodel, spread

    _, motion = many(spark)
    there = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "person_id long, tid long")
    monkeypatch.setattr(spread, "CROWD", 3)
    made = readmodel.motion_entries(motion, there, there.limit(0))
    assert "__deal" in made._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in made.collect()]
    assert sorted(got) == [(p, i, 19, True, False) for p in (1, 2) for i in range(40)]


def test_exports_look_motions_up_by_round(spark):
    """Motions are put in order once for each round, not for each person who debated them."""
    from rostrum.operators import exports

    _, motion = many(spark)
    none = lambda kinds: spark.createDataFrame([], kinds)
    debated = spark.createDataFrame([(p, 5, r) for p in (1, 2) for r in (2, 1, 3)], "person_id long, tid long, round long")
    out = exports.speaker_frame(
        spark.createDataFrame([(1, 5), (2, 5), (3, 5), (1, 6)], "person_id long, tid long"), none("tid long, name string, year int, format string, region string, teams int"), none("person_id long, name string"),
        none("person_id long, tid long, average string"), none("person_id long, tid long, prelims_spoken long"), none("tid long, n long, mean double"), none("person_id long, tid long, placement long"),
        none("person_id long, tid long, mate long"), debated, motion.selectExpr("*", "motion_id % 7 as seq", "'m' as text"),
    )
    assert "__told" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.person_id, r.tid): [(m.round, m.seq, m.motion_id) for m in r.motions] for r in out.collect()}
    want = sorted((1 + i % 2, i % 7, i) for i in range(40))
    assert got == {(1, 5): want, (2, 5): want, (3, 5): [], (1, 6): []}


def test_means_are_summed_in_the_order_of_rounds(spark):
    from rostrum.operators import field

    scores = {1: 0.1, 2: 0.2, 3: 0.3}
    for order in ([1, 2, 3], [3, 2, 1], [2, 3, 1]):
        speech = spark.createDataFrame([(1, 5, r, scores[r]) for r in order], "person_id long, tid long, round long, score double").coalesce(1)
        assert field._own(speech).first().cell_mean == (0.1 + 0.2 + 0.3) / 3


def test_rounds_of_the_same_scores_tie(spark):
    from rostrum.operators import scores

    rows = [(1, t, 1, x) for t, x in ((1, 0.1), (2, 0.2), (3, 0.3))] + [(1, t, 2, x) for t, x in ((3, 0.3), (2, 0.2), (1, 0.1))]
    speech = spark.createDataFrame(rows, "person_id long, tid long, round long, score double").coalesce(1)
    got = sorted((r["round"], r.n, r.is_best, r.is_worst) for r in scores.round_profile(speech).collect())
    assert got == [(1, 3, True, True), (2, 3, False, False)]
