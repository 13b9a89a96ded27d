"""The pipeline on a small corpus with known junk, copies and benchmark passages, stage by stage against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
from rostrum.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    item = say(30)
    docs = [(i, say(r.randint(60, 120)), "en", f"s{i % 4}") for i in range(160)]
    docs += [(500 + i, " ".join(w + "###" for w in docs[i][1].split()), "en", "s1") for i in range(8)]
    docs += [(600 + i, docs[i][1], "en", "s2") for i in range(12)] + [(700 + i, docs[i][1] + " more", "en", "s3") for i in range(12)]
    docs += [(800 + i, say(60) + " " + item, "en", "s0") for i in range(6)] + [(900, "short", "en", "s0"), (901, None, None, None)]
    return [(a, b, c, d, len(b or "")) for a, b, c, d in docs], item


def test_stages(spark, tmp_path):
    docs, item = corpus()
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    at, seen = f"{tmp_path}/documents.parquet", {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(at), str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = f"{tmp_path}/{k}"
        seen[name] = spark.read.parquet(at)
    for name in list(seen)[:-1]:
        assert seen[name].columns == COLUMNS
    ids = {n: Counter(r.doc_id for r in df.select("doc_id").collect()) for n, df in seen.items()}
    assert set(ids["quality_rules"]) == {d[0] for d in docs} - set(range(500, 508)) - {900, 901}
    assert set(ids["near_dedup"]) == set(range(160)) | set(range(800, 806))
    assert set(ids["decontamination"]) == set(range(160))
    words = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    size = Counter()
    for d in docs[:160]:
        size[d[3]] += words[d[0]]
    aim = mixing.targets(dict(size))
    took = Counter()
    for i, n in ids["mixing"].items():
        assert n <= 2
        took[docs[i][3]] += n * words[i]
    assert all(abs(took[s] - aim[s]) <= 1 for s in aim)
    last = seen["sharding"].collect()
    assert Counter(r.doc_id for r in last) == ids["mixing"] and seen["sharding"].columns == [*COLUMNS, "shard", "slot"]
    bytes_ = Counter()
    for r in last:
        bytes_[r.shard] += len(r.text.encode()) + 1
    assert set(bytes_) == set(range(16)) and max(bytes_.values()) - min(bytes_.values()) <= 8 * max(len(d[1] or "") for d in docs)
    for k in bytes_:
        assert sorted(r.slot for r in last if r.shard == k) == list(range(sum(r.shard == k for r in last)))


def test_stages_take_empty_tables(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], kinds), str(tmp_path)).count() == 0
