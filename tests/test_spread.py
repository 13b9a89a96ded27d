"""Groups that are spread over many tasks give what a window or an aggregate gives; one group has 90 % of the rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rostrum.operators import field, ranks, results, scores, spread

ROWS = 3000


def rows_of(r, values):
    """One group with 90 % of the rows, a null group and some small ones."""
    return [(7 if r.random() < 0.9 else r.choice([None, 1, 2, 3]), i, r.choice(values)) for i in range(ROWS)]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(spread, "GROUP_ROWS", 200)
    monkeypatch.setattr(spread, "TASK_ROWS", 150)
    monkeypatch.setattr(spread, "STRETCH", 64)


@pytest.mark.parametrize("values", [[None, 1.5, 2.5, 3.0], [float(x) for x in range(2000)], [4.0]])
def test_places_of_a_large_group(spark, small_tasks, values):
    df = spark.createDataFrame(rows_of(random.Random(1), values), "g long, id long, x double").repartition(6)
    large = spread.large_groups(df, ["g"])
    assert {r.g for r in large.collect()} >= {7}
    got = spread.places(df, ["g"], {"x": "desc_nulls_last"}, {"id": "asc"}, large)
    w = Window.partitionBy("g")
    want = df.withColumn("index", F.row_number().over(w.orderBy(F.col("x").desc_nulls_last(), "id")).cast("long")).withColumn("rank", F.rank().over(w.orderBy(F.col("x").desc_nulls_last())).cast("long"))
    key = lambda x: x.id
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_a_large_group_is_numbered_in_many_tasks(spark, small_tasks, monkeypatch):
    df = spark.createDataFrame(rows_of(random.Random(2), [float(x) for x in range(50)]), "g long, id long, x double")
    kept = []
    monkeypatch.setattr(spread, "stored", lambda df, of=spread.stored: kept.append(of(df)) or kept[-1])
    spread.places(df, ["g"], {"x": "desc"}, {"id": "asc"}, spread.large_groups(df, ["g"])).count()
    sizes = [r["count"] for r in kept[0].groupBy("__part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 3 * ROWS / len(sizes)


@pytest.mark.parametrize("values", [[None, 1.0, 2.0, 2.0, 5.5], [x / 7 for x in range(-1000, 1000)], [3.25], [1e300, -1e300, 0.1, 0.2, 1e-300], [None]])
def test_quantiles_of_a_large_group_to_the_bit(spark, small_tasks, values):
    df = spark.createDataFrame(rows_of(random.Random(3), values), "g long, id long, x double")
    at = [0.1, 0.25, 0.5, 0.75, 0.9, 0.0, 1.0]
    got = spread.quantiles(df, ["g"], "x", at, spread.large_groups(df, ["g"])).collect()
    want = df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q")).collect()
    told = lambda rows: {r.g: r.q for r in rows if r.q is not None}
    assert told(got) == told(want) and (values == [None] or len(told(got)) == 5)


@pytest.mark.parametrize("chance", [0.5, 0.97, 1.0])
def test_streaks_of_a_large_group(spark, small_tasks, chance):
    r = random.Random(4)
    rows = [(g, i, r.random() < chance) for g, i, _ in rows_of(r, [0])]
    df = spark.createDataFrame(rows, "g long, id long, won boolean").repartition(5)
    got = {x.g: (x.won, x.lost) for x in spread.longest_streaks(df, ["g"], {"id": "asc"}, "won", spread.large_groups(df, ["g"])).collect()}

    def slow(g):
        best, run, last = {True: 0, False: 0}, 0, None
        for won in [w for k, _, w in rows if k == g]:
            run = run + 1 if won == last else 1
            last = won
            best[won] = max(best[won], run)
        return best[True], best[False]

    assert got == {g: slow(g) for g in (None, 1, 2, 3, 7)}


def test_operators_give_the_same_with_a_large_tournament(spark, monkeypatch):
    r = random.Random(5)
    x = [(7 if i % 10 else i % 40, i, r.choice([None, *range(60, 80)])) for i in range(800)]
    cells = spark.createDataFrame([(t, p, v and float(v), 3, 5) for t, p, v in x], "tid long, person_id long, x double, own_rounds int, prelims int")
    standings = spark.createDataFrame([(t, f"t{p}", r.choice([None, 1, 2, 3]), r.choice([None, 5, 6]), r.choice([None, None, 4])) for t, p, _ in x], "tid long, team string, wins long, points long, rank long")
    speech = cells.selectExpr("tid as person_id", "x as score")
    entry = cells.selectExpr("tid", "person_id", "x as total").filter("total is not null")
    rounds = spark.createDataFrame([(t, 1 + p % 3, p, r.random() < 0.7) for t, p, _ in x], "person_id long, tid long, round long, won boolean")
    cups = spark.createDataFrame([(1, "B", 2020), (2, "a", 2020), (3, "C", None)], "tid long, name string, year long")
    made = lambda: [sorted(map(str, df.collect())) for df in (field.context(cells), field.summary(cells), ranks.competition_ranks(standings), scores.score_profile(speech), field.derived_ranks(entry, "total", "person_id"), results.streaks(rounds, cups))]
    before = made()
    monkeypatch.setattr(spread, "GROUP_ROWS", 100)
    monkeypatch.setattr(spread, "TASK_ROWS", 60)
    assert made() == before
