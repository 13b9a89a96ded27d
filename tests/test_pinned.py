"""Pinned input and output pairs of the domain operators."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rostrum.functions import names, numbers, similarity, stages, urls
from rostrum.operators import exports, field, jobs, merging, ranks, readmodel, resolve, results, scores
from rostrum.sources import html_tables, js_literal, navigation
from rostrum.streaming.limits import drain, rate_limited

HOSTS = [".tabs.example.org"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def speech(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, person_id long, tid long, round long, position string, score double")


def test_score_profile(spark):
    s = speech(spark, *[(1, 1, i + 1, "OG", x) for i, x in enumerate([70.0, 74.0, 76.0, 78.0, 82.0, None])], (2, 1, 1, "OG", None))
    one_, none = {r.person_id: r for r in scores.score_profile(s).collect()}[1], {r.person_id: r for r in scores.score_profile(s).collect()}[2]
    assert (one_.n, one_.mean, one_.median, one_.q1, one_.q3, one_.iqr, round(one_.stdev, 9)) == (5, 76, 76, 74, 78, 4, 4.0)
    assert (round(one_.p10, 6), round(one_.p90, 6)) == (71.6, 80.4)
    assert none.n == 0 and none.mean is None and none.stdev is None
    best = scores.extremes(s, ["tid", "round"]).first()
    assert (best.best_round, best.best_score, best.worst_round) == (5, 82, 1)


def test_first_of_equal_scores_wins(spark):
    s = speech(spark, (1, 1, 1, "OG", 80.0), (1, 1, 2, "OG", 80.0), (1, 1, 3, "OG", 80.0))
    r = scores.extremes(s, ["tid", "round"]).first()
    assert (r.best_round, r.worst_round) == (1, 1)


def test_histogram(spark):
    s = speech(spark, *[(1, 1, i, "OG", float(x)) for i, x in enumerate((70, 71, 71, 72))], *[(2, 1, i, "OG", float(x)) for i, x in enumerate((10, 40, 70, 99))])
    rows = scores.histogram(s).orderBy("person_id", "bin").collect()
    assert [(r["from"], r.to, r.n) for r in rows if r.person_id == 1] == [(70, 71, 1), (71, 72, 2), (72, 73, 1)]
    two = [r for r in rows if r.person_id == 2]
    assert len(two) <= 21 and sum(r.n for r in two) == 4


def test_momentum_and_slope(spark):
    s = speech(spark, *[(1, 1, i + 1, "OG", float(x)) for i, x in enumerate((70, 71, 72, 76, 77, 78))], *[(2, 1, i + 1, "OG", 70.0 + i) for i in range(3)])
    m = {r.person_id: r for r in scores.momentum(s).collect()}
    assert (m[1].opening, m[1].closing, m[1].momentum, m[1].samples) == (71, 77, 6, 1) and 2 not in m
    t = {r.person_id: r for r in scores.trends(s).collect()}
    assert t[1].slope > 0 and abs(t[2].slope - 1) < 1e-9


@pytest.mark.parametrize("x,text", [(76.25, "76.3"), (78.35, "78.3"), (80.0, "80.0"), (-0.05, "-0.1"), (1234.5, "1234.5"), (0.25, "0.3")])
def test_fixed1(spark, x, text):
    assert one(spark, numbers.fixed1(F.lit(x))) == text


def test_signed(spark):
    assert [one(spark, numbers.signed1(F.lit(x))) for x in (0.04, -0.04, 1.26, -1.26)] == ["0.0", "0.0", "+1.3", "-1.3"]


def test_speaker_average(spark):
    def pick(cells, total, prelims):
        n = sum(c is not None for c in cells)
        mean = sum(c for c in cells if c is not None) / n if n else None
        lit = lambda v: F.lit(v).cast("double")
        return one(spark, scores.speaker_average(lit(None), lit(total), lit(n), lit(mean), lit(prelims)))

    assert pick([78, 80, 82, 80], 320, 4) == "80.0"
    assert pick([75, 76, 77], None, 5) == "76.0"
    assert pick([], 379, 5) == "75.8"
    assert pick([], 379, 0) is None


def test_field_context(spark):
    rows = [(i, 1, float(x), 9, 9) for i, x in enumerate([78.0, 80.0, 74.0, 74.0])] + [(9, 1, None, 9, 9)]
    cell = spark.createDataFrame(rows, "person_id long, tid long, x double, own_rounds long, prelims long")
    got = {r.person_id: r for r in field.context(cell).collect()}
    assert got[0].placement == 2 and got[0].field == 4 and got[0].percentile == 75 and not got[0].incomplete and 9 not in got
    same = spark.createDataFrame([(1, 1, 70.0, 8, 9), (2, 1, 70.0, 9, None)], "person_id long, tid long, x double, own_rounds long, prelims long")
    got = {r.person_id: r for r in field.context(same).collect()}
    assert got[1].z is None and got[1].incomplete and not got[2].incomplete
    assert field.career(field.context(same)).filter("person_id = 1").first().mean_percentile is None


def test_streaks_and_points(spark):
    won = [(1, 1, 1, True, 3), (1, 1, 2, True, 3), (1, 1, 3, False, 0), (1, 2, 1, False, 1), (1, 2, 2, False, 0), (1, 2, 3, True, 2)]
    rounds = spark.createDataFrame([(p, t, r, None, w, x) for p, t, r, w, x in won], "person_id long, tid long, round long, score double, won boolean, points long")
    t = spark.createDataFrame([(1, "Cup", 2023), (2, "Cup", 2024)], "tid long, name string, year int")
    s = results.streaks(rounds, t).first()
    assert (s.win_streak, s.loss_streak) == (2, 3)
    assert {r.points: r.rounds for r in results.points_distribution(rounds).collect()} == {3: 2, 2: 1, 1: 1, 0: 2}
    r = results.record(rounds).first()
    assert (r.decided, r.wins, r.avg_points) == (6, 3, 1.5)


def test_undated_tournaments_come_last_in_streaks(spark):
    rounds = spark.createDataFrame([(1, 1, 1, True), (1, 2, 1, False), (1, 3, 1, True)], "person_id long, tid long, round long, won boolean")
    t = spark.createDataFrame([(1, "A", 2020), (2, "B", None), (3, "C", 2021)], "tid long, name string, year int")
    assert results.streaks(rounds, t).first().win_streak == 2


def test_motion_fan_out_credits_all(spark):
    rounds = spark.createDataFrame([(1, 5, 1, 70.0, True, 1, "OG"), (1, 5, 2, 72.0, False, 0, "OO")], "person_id long, tid long, round long, score double, won boolean, points long, position string")
    motion = spark.createDataFrame([(1, 5, 1, "THW", "Politics"), (2, 5, 1, "THW", None), (3, 5, 2, "THW", None), (4, 5, 7, "THBT", "Law"), (5, 10, 1, "THBT", "Law")], "motion_id long, tid long, round long, type string, topic string")
    t = spark.createDataFrame([(5, 2025, None, "Europe", 60)], "tid long, year int, format string, region string, teams long")
    rows = {(r.dim, r.key): r.n for r in results.split_rows(rounds, t, motion).groupBy("dim", "key").agg(F.count("*").alias("n")).collect()}
    assert rows["motion_type", "THW"] == 3 and rows["topic", "Politics"] == 1 and ("motion_type", "THBT") not in rows
    assert rows["field_size", "48–99 teams"] == 2 and rows["format", "Unknown"] == 2 and rows["region", "Europe"] == 2


def test_competition_ranks(spark):
    df = spark.createDataFrame([(1, "Second", 4, 1300, None), (1, "First", 5, 1200, None), (1, "Third", 4, 1200, None), (2, "Only", 3, 1, None), (3, "A", 4, 9, None), (3, "B", 4, 9, 7), (3, "C", 4, 9, None), (3, "D", None, None, None)], "tid long, team string, wins long, points long, rank long")
    got = {(r.tid, r.team): r.place for r in ranks.competition_ranks(df).collect()}
    assert (got[1, "First"], got[1, "Second"], got[1, "Third"]) == (1, 2, 3) and got[2, "Only"] is None
    assert (got[3, "A"], got[3, "B"], got[3, "C"], got[3, "D"]) == (1, 7, 1, None)


@pytest.mark.parametrize("label,rank", [("Grand Final", 100), ("Final", 95), ("ESL Semifinals", 90), ("Quarters", 80), ("Round of 16", 70), ("Double Octofinals", 60), ("Triple Octofinals", 50), ("Novice Final", 95), ("Round 4", None), ("Partial Octofinals", 60)])
def test_stage_rank(spark, label, rank):
    assert one(spark, stages.stage_rank(F.lit(label))) == rank
    assert one(spark, stages.stage_rank(F.lit(label), strict=False)) == (rank or 0)


@pytest.mark.parametrize("label,kind", [("R3", "inround"), ("12", "inround"), ("Round of 16", "outround"), ("GF", "outround"), ("Semi-finals", "outround"), ("", "unknown"), (None, "unknown"), ("Lunch", "unknown")])
def test_round_class(spark, label, kind):
    assert one(spark, stages.round_class(F.lit(label).cast("string"))) == kind


@pytest.mark.parametrize("label,seat", [("Opening Government", "OG"), ("Closing  Opposition", "CO"), ("Affirmative", "Prop"), ("Neg", "Opp"), ("Bench 3", "Bench 3")])
def test_position(spark, label, seat):
    assert one(spark, stages.canonical_position(F.lit(label))) == seat


@pytest.mark.parametrize("text,kind", [("THW ban private schools", "THW"), ("This House, as the EU, would federalize", "Other"), ("Round 1 motion TBA", None), ("this house believes that", "THBT")])
def test_motion_type(spark, text, kind):
    assert one(spark, stages.motion_type(F.lit(text))) == kind


def test_round_labels_one_by_one(spark):
    said = {
        "inround": ["1", "12", "Round 5", "round  12", "R1", "r12", " 3 "],
        "outround": ["GF", "f", "SF", "QF", "OF", "dof", "TOF", "Grand Final", "grandfinals", "Final", "Finals", "Semifinals", "semi-final", "Quarter Finals", "Octofinals", "octo-final", "Double Octofinals", "doubleocto finals",
                     "Triple Octofinals", "Partial Double Octofinals", "partialdouble-octofinal", "Partial Triple Octofinals", "Round of 16", "octos", "octo", "doubles", "Triple", "quarters", "semi"],
        "unknown": ["", "ESL Final", "Final 2", "Round", "Round of", "R", "1a", "Partial Octofinals", "Grand", "Octofinals!"],
    }
    df = spark.createDataFrame([(k, x) for k, labels in said.items() for x in labels] + [("unknown", None)], "kind string, label string")
    assert df.filter(stages.round_class(F.col("label")) != F.col("kind")).collect() == []


def test_fuzzy_names(spark):
    index = spark.createDataFrame([(1, 1, "Abhishek Lalatendu Acharya"), (2, 2, "Grace Hopper"), (3, 3, "Ann Lee"), (4, 4, "Plato")], "person_id long, ordinal long, display_name string")
    asked = ["Acharya, Abhishek", "Abhishek K Acharya Lalatendu", "Abhishek", "Shaurya Acharya", "plato", "Plato Smith", "Joann Lee"]
    got = {r.name: r.person_id for r in resolve.match_names(spark.createDataFrame([(x,) for x in asked], "name string"), index).collect()}
    assert got == {"Acharya, Abhishek": 1, "Abhishek K Acharya Lalatendu": 1, "plato": 4, "Joann Lee": 3}


def test_name_matching_agrees_with_its_blocking(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 3)))
    pool = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(60)})
    index = spark.createDataFrame([(i, i, n) for i, n in enumerate(pool[::2])], "person_id long, ordinal long, display_name string")
    asked = spark.createDataFrame([(n,) for n in pool[1::2]], "name string")
    got = {x.name: x.person_id for x in resolve.match_names(asked, index).collect()}

    def slow(a):
        entries = list(enumerate(pool[::2]))
        if hit := [i for i, b in entries if a == b]:
            return hit[0]
        ok = [(i, b) for i, b in entries if len(a.split()) >= 2 and len(b.split()) >= 2]
        if hit := [i for i, b in ok if a in b or b in a]:
            return hit[0]
        hit = [i for i, b in ok if set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split())]
        return hit[0] if hit else None

    assert got == {n: k for n in pool[1::2] if (k := slow(n)) is not None}


def test_similarity_measures():
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert similarity.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert similarity.jaro("a", "b") == 0 and similarity.jaro("", "x") == 0 and similarity.jaro("x", "x") == 1
    assert similarity.jaro("abcd", "badc") == pytest.approx((1 + 1 + 0.5) / 3)


def test_normalize_name(spark):
    assert one(spark, names.normalize_name(F.lit("José-Mara O'Neil_iit/b"))) == "jos mara oneil iit b"


def test_urls(spark):
    assert one(spark, urls.normalize_url(F.lit("https://a.tabs.example.org/x/privateurls/abc).,"))) == "https://a.tabs.example.org/x/privateurls/abc/"
    ok = {"https://a.tabs.example.org/x/privateurls/abc/": True, "https://a.tabs.example.org.evil.net/x/privateurls/abc/": False, "https://u@a.tabs.example.org/x/privateurls/abc": False, "https://a.tabs.example.org:8/x/privateurls/abc": False, "ftp://a.tabs.example.org/x/privateurls/abc": False, "https://a.tabs.example.org/x/abc": False}
    assert {u: one(spark, urls.private_url(F.lit(u), HOSTS)) for u in ok} == ok
    text = "see https://a.tabs.example.org/x/privateurls/ab=\nc/ and https://a.tabs.example.org/x/privateurls/zz."
    assert one(spark, urls.extract_urls(F.lit(text), HOSTS)) == ["https://a.tabs.example.org/x/privateurls/ab/", "https://a.tabs.example.org/x/privateurls/zz/", "https://a.tabs.example.org/x/privateurls/abc/"]
    assert one(spark, urls.candidate_years(F.lit(None).cast("int"), F.lit(2024))) == [2024, None, 2023, 2025]
    assert [one(spark, urls.slug_error(F.lit(s))) for s in ("ab", "a" * 31, "a--b", "Admin", "fine-1")] == ["too_short", "too_long", "invalid_chars", "reserved", None]


def test_breaks_are_independent_of_order(spark):
    rows = [(1, "T", "ESL", 1, 1), (1, "T", "Open", 9, 2), (1, "T", "Open", 3, 3)]
    for order in (rows, rows[::-1]):
        r = ranks.team_breaks(spark.createDataFrame(order, "tid long, team string, category string, rank long, seq long")).first()
        assert (r.category, r.rank, r.categories) == ("Open", 9, "ESL,Open")


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "n", None)], "id long, name string, claim string")
    new = spark.createDataFrame([(1, "A", "c"), (3, "C", None), (None, "N", "d")], "id long, name string, claim string")
    once = merging.upsert(old, new, ["id"], {"claim": "fill"})
    twice = merging.upsert(once, new, ["id"], {"claim": "fill"})
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == rows(twice) == sorted([(1, "A", "c"), (2, "b", "x"), (3, "C", None), (None, "N", "d")], key=str)
    assert rows(merging.insert_absent(old, new, ["id"])) == sorted([(1, "a", None), (2, "b", "x"), (None, "n", None), (3, "C", None)], key=str)


def test_anchored_windows(spark):
    base = 1_700_000_000
    rows = [("u", base + s) for s in (0, 50, 60, 61, 125, 400)] + [("v", base)]
    df = spark.createDataFrame([(k, t) for k, t in rows], "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    got = [(r.u, r.n, r.ok) for r in jobs.rate_limit(df, ["u"], "ts", 60, 2).orderBy("u", "ts").collect()]
    assert got == [("u", 1, True), ("u", 2, True), ("u", 3, False), ("u", 1, True), ("u", 1, True), ("u", 1, True), ("v", 1, True)]


def test_retry_machine(spark):
    cases = [(None, 3, "done"), (None, 4, "failed"), ("deadlock detected", 3, "pending"), ("deadlock detected", 4, "failed"), ("fetch landing failed: HTTP 404 x", 0, "abandoned"), ("other", 3, "failed"), ("other", 2, "pending")]
    for error, attempts, status in cases:
        assert one(spark, jobs.next_status(F.lit(error).cast("string"), F.lit(attempts))) == status


def test_eta_defaults_to_forty_seconds(spark):
    df = spark.createDataFrame([(1, "pending", None, None), (1, "pending", None, None), (2, "done", None, None)], "user_id long, status string, started_at timestamp, finished_at timestamp").withColumn("job_id", F.lit(1))
    got = {r.user_id: r.eta for r in jobs.progress(df, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: 80, 2: None}


def test_csv_cells(spark):
    assert one(spark, exports.csv_line([F.lit("a"), F.lit(None), F.lit('q"x'), F.lit("1,2"), F.lit("l\nm"), F.lit("")])) == 'a,,"q""x","1,2","l\nm",'
    assert [f.id for f in exports.fields(["team", "year"])] == ["year", "team"]
    with pytest.raises(ValueError):
        exports.fields(["nope"])


def test_remarks(spark):
    known = dict(person_id=1, momentum=7.04, samples=3, n=15, iqr=1.25, placements=3, mean_percentile=60.4, win_streak=5, tournaments=4, break_rate=0.5, seat_spread=0.12, type_gain=10.0, topic_loss=-0.5, size_gap=-12.0)
    kinds = "person_id long, momentum double, samples long, n long, iqr double, placements long, mean_percentile double, win_streak long, tournaments long, break_rate double, seat_spread double, type_gain double, topic_loss double, size_gap double"
    made = lambda **k: [(x.id, x.tone, x.value) for x in spark.createDataFrame([Row(**{**known, **k})], kinds).select(readmodel.remarks().alias("r")).first().r]
    assert [x[0] for x in made()] == ["momentum", "consistency", "field-percentile", "seat-spread", "motion-type", "topic-weakness", "field-size", "streak", "break-rate"]
    few = made(n=3, placements=0, mean_percentile=None, tournaments=1, seat_spread=0.1, type_gain=None, topic_loss=-0.4, size_gap=11.9)
    assert few == [("momentum", "pos", "7.0"), ("streak", "pos", "5")]


def test_tones_and_values_of_remarks(spark):
    kinds = "momentum double, samples long, n long, iqr double, placements long, mean_percentile double, win_streak long, tournaments long, break_rate double, seat_spread double, type_gain double, topic_loss double, size_gap double"
    names = [k.split()[0] for k in kinds.split(", ")]
    made = lambda **k: {x.id: (x.tone, x.value) for x in spark.createDataFrame([tuple(k.get(n) for n in names)], kinds).select(readmodel.remarks().alias("r")).first().r}
    assert made(momentum=-0.42, samples=3) == {"momentum": ("neg", "0.4")}
    assert made(placements=3, mean_percentile=72.4) == {"field-percentile": ("pos", "28")}
    assert made(placements=3, mean_percentile=49.9) == {"field-percentile": ("neutral", "50")}
    assert made(tournaments=4, break_rate=0.5) == {"break-rate": ("pos", "50")} and made(tournaments=4, break_rate=0.25) == {"break-rate": ("neutral", "25")}
    assert made(tournaments=4) == {} and made(size_gap=14.2) == {"field-size": ("neg", "14")} and made(size_gap=-14.2) == {"field-size": ("pos", "14")}


def test_rounds_without_a_published_score_or_result_do_not_count(spark):
    speech = spark.createDataFrame([(1, 7, 1, 10, "OG", 75.0), (1, 7, 2, 11, "OG", None), (1, 7, 3, 12, "CO", 70.0), (1, 7, 3, 13, "CO", 72.0), (1, 7, 4, 14, "CO", 71.0), (1, 7, 4, 15, "CO", None)], "person_id long, tid long, round long, event_id long, position string, score double")
    team = spark.createDataFrame([(1, 7, 1, 10, "OO", True, 3), (1, 7, 5, 16, "CG", False, 0), (1, 7, 5, 17, "CG", None, None)], "person_id long, tid long, round long, event_id long, position string, won boolean, points long")
    rounds = results.merged_rounds(speech, team)
    assert sorted(tuple(r) for r in rounds.collect()) == [(1, 7, 1, 75.0, True, 3, "OO"), (1, 7, 3, 72.0, None, None, None), (1, 7, 4, 71.0, None, None, None), (1, 7, 5, None, None, None, "CG")]
    t = spark.createDataFrame([(7, 2024, "BP"), (8, 2021, None)], "tid long, year long, format string")
    entry = spark.createDataFrame([(1, 7, "QF")], "person_id long, tid long, elimination string")
    mates = spark.createDataFrame([(1, 7, 2)], "person_id long, tid long, mate long")
    records = spark.createDataFrame([(1, 8, 4), (3, 8, None)], "person_id long, tid long, chaired long")
    found = {r.person_id: r.asDict() for r in results.volume(rounds, entry, t, mates, records).collect()}
    assert found[1] == dict(person_id=1, tournaments=1, judged=1, outrounds=1, rounds_chaired=4, years=4, first_year=2021, last_year=2024, formats=1, rounds=4, speeches=3, partners=1)
    assert found[3] == dict(person_id=3, tournaments=0, judged=1, outrounds=0, rounds_chaired=0, years=1, first_year=2021, last_year=2021, formats=0, rounds=0, speeches=0, partners=0)


def test_highlights_list_titles_bests_and_judging(spark):
    t = spark.createDataFrame([(1, "WUDC", 2020, 100), (2, "Cup", 2022, 20), (3, "Open", None, None)], "tid long, name string, year long, teams long")
    entry = spark.createDataFrame([(9, 1, True, True, 10), (9, 2, True, False, 3), (9, 3, False, False, 10)], "person_id long, tid long, broke boolean, champion boolean, open_rank long")
    averages = spark.createDataFrame([(9, 1, "76.0"), (9, 2, "76.0"), (9, 3, "n/a")], "person_id long, tid long, average string")
    records = spark.createDataFrame([(9, 1, "SF", "core"), (8, 1, None, "core")], "person_id long, tid long, chaired_stage string, tag string")
    got = {r.person_id: r.asDict() for r in ranks.highlights(entry, averages, records, t).collect()}
    assert got[9] == dict(person_id=9, titles="WUDC 2020", top_breaks=1, best_rank=3, best_rank_at="Cup", best_average=76.0, best_average_at="Cup", outrounds_chaired=1, core=1, majors=1, first_year=2020, last_year=2022)
    assert got[8]["core"] == 1 and got[8]["majors"] == 1 and got[8]["titles"] == "" and got[8]["best_rank"] is None


def test_progress_counts_and_what_is_left(spark):
    now = 1_700_000_000
    row = lambda i, status, start, end: (1, i, status, start and now - start, end and now - end)
    rows = [row(1, "done", 100, 60), row(2, "done", 200, 150), row(3, "done", 9000, 8999), row(4, "failed", 10, 5), row(5, "abandoned", 10, 5), row(6, "failed", 9000, 8000), row(7, "running", 20, None), row(8, "running", None, None)]
    rows += [row(9, "pending", None, None)] * 3 + [row(10, "done", 5000, 4000)]
    df = spark.createDataFrame(rows, "user_id long, job_id long, status string, s long, e long").select("user_id", "job_id", "status", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("finished_at"))
    r = jobs.progress(df, F.timestamp_seconds(F.lit(now))).first()
    mean = (40 + 50 + 1) / 3
    assert (r.pending, r.running, r.done, r.failed, r.total, r.current_job, r.mean_seconds) == (3, 2, 2, 2, 9, 7, 30.3)
    assert r.eta == int(3 * mean + 0.5) + int(max(mean - 20, 5) * 2 + 0.5)


def test_urls_keep_the_earliest_date_as_text(spark):
    rows = [("a", 1, None), ("a", 2, "2020"), ("b", 1, "Tue"), ("b", 2, "Mon"), ("b", 3, None), ("c", 1, "x"), ("c", 2, "x"), ("d", 1, ""), ("d", 2, "1")]
    df = spark.createDataFrame(rows, "url string, seq long, date string")
    assert sorted((r.url, r.seq) for r in jobs.earliest_urls(df, "url", "seq", "date").collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]


def test_split_signals(spark):
    row = lambda dim, key, rounds, events, win=None, gain=None, loss=None: (1, dim, key, rounds, events, win, gain, loss)
    rows = [row("position", "OG", 6, 1, 0.9), row("position", "CO", 6, 1, 0.5), row("position", "OO", 5, 1, 0.0), row("motion_type", "policy", 6, 1, 0.5, 11.0), row("motion_type", "value", 5, 1, 0.5, 40.0)]
    rows += [row("topic", "a", 6, 1, None, None, -0.7), row("topic", "b", 6, 1, None, None, 0.2), row("field_size", "100+ teams", 3, 2, 0.25), row("field_size", "Under 24 teams", 3, 2, 0.75), row("field_size", "24–47 teams", 3, 1, 0.0)]
    df = spark.createDataFrame(rows, "person_id long, dim string, key string, rounds long, tournaments long, win_rate double, win_rate_delta double, score_delta double")
    r = readmodel.split_signals(df).first()
    assert (round(r.seat_spread, 6), r.type_gain, r.topic_loss, r.size_gap) == (0.4, 11.0, -0.7, 50.0)


def test_js_literals():
    assert js_literal.parse("{a: 1, 'b': [\"x\\u0041\", -.5, 0x1F, undefined, true,],}") == {"a": 1, "b": ["xA", -0.5, 31, None, True]}
    for bad in ("f()", "{[k]: 1}", "{__proto__: 1}", "/x/", "1n", "1 2", "`t`", "a.b", ""):
        with pytest.raises(js_literal.LiteralError):
            js_literal.parse(bad)
    assert js_literal.parse_at("x = [1, {}]; more()", 4) == [1, {}]


def page(spark, html, url="https://a.example.org/t/results/round/2/"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_round_results_of_two_rows_and_marked_chairs(spark):
    html = 'x <script>window.vueData = [{head: [{key: "team"}, {key: "adjudicators", title: "Adjudicators"}], data: [[{text: "A"}, {text: "Jane Doe (chair), John Roe"}], [{text: "B"}, {text: "Jane Doe (chair), John Roe"}]]}]</script>'
    assert [r.team for r in html_tables.round_results(page(spark, html)).orderBy("row_no").collect()] == ["A", "B"]
    assert sorted((r.person, r.panel_role or "") for r in html_tables.judge_panels(page(spark, html)).collect()) == [("Jane Doe", "chair"), ("John Roe", "")]
    html = html.replace("Jane Doe (chair), John Roe", "Alice (c), Bob (chair), Carol (chief), Dave")
    assert sorted((r.person, r.panel_role or "") for r in html_tables.judge_panels(page(spark, html)).collect()) == [("Alice", "chair"), ("Bob", "chair"), ("Carol", "chair"), ("Dave", "")]


def test_rendered_tables_and_pages_without(spark):
    html = '<h4 class="card-title">Speakers</h4><table><thead><tr><th data-original-title="Speaker name">N</th><th>R1</th></tr></thead><tr><td><span hidden>Ann</span><b>A.</b></td><td>75</td></tr><tr><td></td><td>1</td></tr></table>'
    t = html_tables.page_tables(html)
    assert t[0]["title"] == "Speakers" and t[0]["head"][0]["title"] == "Speaker name" and t[0]["rows"][0][0]["text"] == "Ann"
    rows = html_tables.speaker_tab(page(spark, html)).collect()
    assert [(r.speaker, r.rank, r.scores[0].score) for r in rows] == [("Ann", 1, 75.0)]
    for empty in (None, "", "<p>no table</p>", "<script>window.vueData = [f()]</script>"):
        assert html_tables.page_tables(empty) == []
    assert html_tables.team_tab(page(spark, None)).count() == 0


def test_registration(spark):
    got = navigation.registration(page(spark, "<h3>Private URL for <b>Ann Lee</b> (Team X).</h3>")).first()
    assert (got.person, got.team) == ("Ann Lee", "Team X")


def test_limits_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = sorted((r.randrange(4), 1_700_000_000 + r.randrange(4000)) for _ in range(120))
    df = spark.createDataFrame(sorted(rows, key=lambda x: x[1]), "u long, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rate_limited(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "u", "ts", 300, 5)
    q = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((x.u, x.ts, x.n, x.ok) for x in spark.table("limits").collect())
    assert got == sorted((x.u, x.ts, x.n, x.ok) for x in jobs.rate_limit(df, ["u"], "ts", 300, 5).collect())


def test_drain_runs_one_job_per_host_in_a_wave(spark, tmp_path):
    rows = [(i, f"https://h{i % 3}.example.org/t/privateurls/x", "pending" if i < 8 else "done", 1_700_000_000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "job_id long, url string, status string, s long").select("job_id", "url", "status", F.timestamp_seconds("s").alias("scheduled_at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/jobs")
    seen = []
    q = drain(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/jobs"), f"{tmp_path}/state", lambda wave, n: seen.append([(r.job_id, r.host) for r in wave.collect()]), most=2)
    q.awaitTermination(120)
    assert sorted(j for wave in seen for j, _ in wave) == list(range(8))
    assert all(len(wave) <= 2 and len({h for _, h in wave}) == len(wave) for wave in seen)
