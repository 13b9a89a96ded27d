"""Pages of many rows are read in blocks: rows and their numbers stay whole, and little memory is taken beside the text."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.sources import html_tables, tab_function

N = 20_000


def embedded(n):
    rows = ",\n".join(f'[{{text: "Name {i}"}}, {{text: "{"Debater" if i % 2 else "Invited Judge"}"}}, {{text: "—"}}]' for i in range(n))
    return f"<script>window.vueData = [{{head: [{{key: 'name', title: 'Name'}}, {{key: 'role', title: 'Role'}}, {{key: 'inst', title: 'Institution'}}], data: [{rows}], x: undefined}}];</script>"


def rendered(n):
    return "<table><tr><th>Name<th>Role<th>Institution" + "".join(f"<tr><td>Name {i}<td>{'Debater' if i % 2 else 'Invited Judge'}<td>—" for i in range(n)) + "</table>"


@pytest.mark.parametrize("spell", [embedded, rendered])
def test_rows_of_a_large_page_take_little_memory(spell):
    page = spell(N)
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    (table,) = html_tables.read_tables(page)
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
    tracemalloc.stop()
    assert sum(map(len, table.blocks)) == N and len(table.blocks) > 3
    # as Python objects all at once they take some twenty times the page
    assert peak < 6 * len(page), peak / len(page)


def test_rows_keep_their_numbers_across_blocks(spark):
    pages = spark.createDataFrame([(1, "u", embedded(N)), (2, "v", rendered(N)), (3, "w", embedded(2)), (4, "x", None), (5, "y", "<p>none</p>")], "page_id long, url string, html string")
    blocks = html_tables.with_tables(pages).select("page_id", "url", "table_no", "start", F.size("rows").alias("n")).orderBy("page_id", "start").collect()
    assert len(blocks) > 8 and {(b.page_id, b.url, b.table_no) for b in blocks} == {(1, "u", 0), (2, "v", 0), (3, "w", 0)}
    for p, n in ((1, N), (2, N), (3, 2)):
        own = [b for b in blocks if b.page_id == p]
        assert [b.start for b in own] == [sum(x.n for x in own[:i]) for i in range(len(own))] and sum(b.n for b in own) == n
    got = html_tables.participants(pages).filter(F.col("name") == F.concat(F.lit("Name "), F.col("row_no").cast("string"))).filter((F.col("role") == "speaker") == (F.col("row_no") % 2 == 1))
    assert {(r.page_id, r.n, r.d) for r in got.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("row_no").alias("d")).collect()} == {(1, N, N), (2, N, N), (3, 2, 2)}
    ranks = html_tables.speaker_tab(pages).filter(F.col("rank") == F.col("row_no") + 1)
    assert ranks.count() == 2 * N + 2
    tab_function.register(spark)
    pages.createOrReplaceTempView("large")
    assert spark.sql("SELECT page_id FROM large, LATERAL tab_rows(html, 'n! = name') t WHERE n = 'Name ' || row_no").count() == 2 * N + 2


def test_own_debates_of_a_large_page_are_whole(spark):
    rows = ", ".join(f"[{{text: 'R{i}'}}, {{text: 'A', html: '<strong>A</strong>'}}]" for i in range(1, N + 1))
    html = f"<script>window.vueData = [{{title: 'Other', head: ['Judge'], data: [['x']]}}, {{title: 'My rounds', head: ['Round', 'Judge'], data: [{rows}]}}];</script>"
    assert html_tables.judge_rounds(spark.createDataFrame([(1, html)], "page_id long, html string")).agg(F.countDistinct("sequence")).first()[0] == N


def test_what_is_put_away_counts_only_for_a_whole_literal(monkeypatch, spark):
    monkeypatch.setattr(html_tables, "BLOCK_CHARS", 1)
    table = "<table><tr><td>a</td></tr><tr><td>b</td></tr><thead><tr><th>H</th></tr></thead></table>"
    cut = "<script>window.vueData = [{head: ['n'], data: [['x'], ['y']], z: f()}];</script>"
    as_rows = [[{"text": "a", "mark": ""}], [{"text": "b", "mark": ""}]]
    assert html_tables.page_tables(cut + table) == [{"title": "", "head": [{"key": "", "title": "H"}], "rows": as_rows}]
    twice = "<script>window.vueData = {tablesData: [{data: [['x']]}], tablesData: [{data: [['y'], 5, []], head: ['n'], data: [['z'], 5, []]}]};</script>"
    assert html_tables.page_tables(twice) == [{"title": "", "head": [{"key": "", "title": "n"}], "rows": [[{"text": "z", "mark": " "}], [], []]}]
    pair = "<script>window.vueData = [{data: [['\\ud83d\\ude00 \\ud83d']]}];</script>"
    assert html_tables.page_tables(pair)[0]["rows"][0][0]["text"] == "\U0001f600 \ufffd"
    empty = spark.createDataFrame([(1, "<script>window.vueData = [{head: ['n']}, {data: []}];</script>")], "page_id long, html string")
    assert [(r.table_no, r.start, r.rows) for r in html_tables.with_tables(empty).orderBy("table_no").collect()] == [(0, 0, []), (1, 0, [])]


def test_a_speaker_tab_of_a_large_page(spark):
    heads = ", ".join(f"{{key: '{k}', title: '{t}'}}" for k, t in [("rank", "Rk"), ("esl", "ESL Rank"), ("name", "Name"), ("team", "Team"), ("r1", "R1"), ("r2", "2"), ("avg", "Avg"), ("total", "Total")])
    cells = lambda i: [i % 90 + 1, i % 9 + 1 if i % 2 else "", f"Name {i}", "Blue", i % 30 + 60, "—" if i % 5 == 0 else i % 25 + 60, 75.5, i]
    rows = ",\n".join("[" + ", ".join(f'{{text: "{c}"}}' for c in cells(i)) + "]" for i in range(N))
    page = f"<script>window.vueData = [{{head: [{heads}], data: [{rows}]}}];</script>"
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    (table,) = html_tables.read_tables(page)
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
    tracemalloc.stop()
    assert sum(map(len, table.blocks)) == N and peak < 6 * len(page), peak / len(page)
    got = html_tables.speaker_tab(spark.createDataFrame([(1, page)], "page_id long, html string"))
    want = lambda i: (i, i % 90 + 1, i % 9 + 1 if i % 2 else None, f"Name {i}", float(i), [("R1", i % 30 + 60.0), ("2", None if i % 5 == 0 else i % 25 + 60.0)])
    assert [(r.row_no, r["rank"], r.rank_esl, r.speaker, r.total, [tuple(x) for x in r.scores]) for r in got.orderBy("row_no").collect()] == [want(i) for i in range(N)]


def test_the_table_function_reads_a_large_page_in_blocks():
    page = embedded(N)
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    arrow = n = 0
    for r in tab_function.TabRows().eval(page, "speaker_tab"):
        assert r == (0, n, f"Name {n}", None, "—", None, None, None)
        n, arrow = n + 1, max(arrow, pa.total_allocated_bytes() - held)
    peak = tracemalloc.get_traced_memory()[1] + arrow
    tracemalloc.stop()
    assert n == N and peak < 8 * len(page), peak / len(page)
