"""Results that are pairs, laid out without a task that holds all of a key, and exports of text that repeats itself."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostrum.operators import exports, readmodel, results, spread
from rostrum.sources import csv_sink


def _largest_share(df):
    """The largest partition's share of all rows."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts), sum(counts)


def test_motions_of_one_tournament_meet_its_persons_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spread, "TILE", 100, raising=False)
    motion = spark.range(1000).selectExpr("id as motion_id", "id div 10000 as tid", "id % 7 as round")
    entry = spark.range(900).selectExpr("id as person_id", "id div 10000 as tid")
    judged = spark.range(800, 1000).selectExpr("id as person_id", "id div 10000 as tid")
    out = readmodel.motion_entries(motion, entry, judged)
    share, rows = _largest_share(out)
    assert rows == 1_000_000 and share < 0.5
    assert out.distinct().count() == 1_000_000 and out.filter("judged_only").count() == 100_000


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_pairs_are_those_of_a_join(spark, monkeypatch, how, tile):
    monkeypatch.setattr(spread, "TILE", tile)
    # keys of one side only, a key with many rows, equal rows on both sides
    left = spark.createDataFrame([(k, i % 5) for k, n in ((1, 9), (2, 1), (3, 4), (9, 2)) for i in range(n)], "k long, a long")
    right = spark.createDataFrame([(k, i // 2, f"t{i}" if i % 3 else None) for k, n in ((1, 11), (2, 2), (3, 1), (8, 5)) for i in range(n)] + [(9, 0, "x"), (9, 0, "x")], "k long, b long, t string")
    rows = lambda df: Counter(map(tuple, df.select("k", "a", "b", "t").collect()))
    assert rows(spread.pairs(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))


def test_motions_of_one_round_meet_its_persons_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spread, "TILE", 100, raising=False)
    rounds = spark.range(900).selectExpr("id as person_id", "id div 890 as tid", "1 + id div 10000 as round")
    motion = spark.range(1000).selectExpr("id as motion_id", "id div 10000 as tid", "1 + id div 10000 as round", "'a' as type", "'b' as topic")
    # motions are too many to be sent to every task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        share, rows = _largest_share(results.with_motions(rounds, motion))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # ten persons are at a tournament without motions, and keep a row each
    assert rows == 890_010 and share < 0.5


@pytest.mark.parametrize("kind", ["zstd", "gzip"])
def test_a_compressed_export_is_the_same_file_in_less_room(spark, tmp_path, kind):
    csv_sink.register(spark)
    told = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("Round "), F.hash(i).cast("string"))), " | ")
    df = spark.range(400, numPartitions=2).select(F.col("id").cast("string"), told.alias("told"), F.lit('a "b", c').alias("q"))
    df.write.format("csv_export").mode("append").save(f"{tmp_path}/plain")
    df.write.format("csv_export").option("compression", kind).mode("append").save(f"{tmp_path}/small")
    assert csv_sink.content(f"{tmp_path}/small") == csv_sink.content(f"{tmp_path}/plain")
    assert spark.read.text(f"{tmp_path}/small").exceptAll(spark.read.text(f"{tmp_path}/plain")).count() == 0 and spark.read.text(f"{tmp_path}/small").count() == 401
    size = lambda name: sum(f.stat().st_size for f in os.scandir(f"{tmp_path}/{name}") if ".csv" in f.name)
    assert size("small") < size("plain") / (100 if kind == "zstd" else 2)
    with pytest.raises(Exception, match="not by lzma"):
        df.write.format("csv_export").option("compression", "lzma").mode("append").save(f"{tmp_path}/other")


@pytest.mark.parametrize("sent", [64_000_000, 0])
def test_texts_of_motions_are_those_of_their_lists(spark, monkeypatch, sent):
    monkeypatch.setattr(exports, "SENT_TEXT", sent)
    monkeypatch.setattr(spread, "CROWD", 2)
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    motion = [(i, 7 + i % 2, 1 + i % 3, i % 5, None if i % 3 == 2 or i % 7 == 0 else f"text {i}", [None, "", "p", "q"][i % 4], ["t", "u", None][i % 3]) for i in range(40)]
    frame = lambda **how: exports.speaker_frame(
        make([(p, t, "A", None, True, 1.0, 1, None, None, None, True, None) for p in range(6) for t in (7, 8, 9)], "person_id long, tid long, team string, elimination string, champion boolean, points double, wins int, open_rank int, esl_rank int, efl_rank int, broke boolean, team_rank int"),
        make([], "tid long, name string, year int, format string, region string, teams int"), make([], "person_id long, name string"), make([], "person_id long, tid long, average string"), make([], "person_id long, tid long, prelims_spoken long"),
        make([], "tid long, n long, mean double"), make([], "person_id long, tid long, placement long"), make([], "person_id long, tid long, mate long"),
        make([(p, t, r) for p in range(5) for t in (7, 8, 9) for r in range(p, 5)], "person_id long, tid long, round long"), make(motion, "motion_id long, tid long, round long, seq long, text string, type string, topic string"), **how,
    )
    chosen = ["motions", "motion_types", "motion_topics"]
    shown = lambda df, texts: {(r.person_id, r.tid): tuple(r[c] or "" for c in chosen) for r in df.select("person_id", "tid", *[f.speaker.alias(f.id) for f in exports.fields(chosen, texts)]).collect()}
    got, want = shown(frame(texts=True), True), shown(frame(), False)
    assert got == want and len(got) == 18 and want[(0, 7)][0].count(" | ") > 3 and want[(5, 7)] == ("", "", "")
