"""The table function: its columns follow what is asked for, and its rows are those of the readers."""

import pytest

from rostrum.sources import html_tables, tab_function
from rostrum.sources.tab_function import columns_of, value_of

PAGE = """<h4 class="card-title">Standings</h4><table><thead><tr><th>Rk</th><th>Team name</th><th>School</th><th>Wins</th><th>Spk</th></tr></thead>
<tr><td>1</td><td>A, "B"</td><td>Uni</td><td>4</td><td>1,234.5</td></tr><tr><td>x</td><td></td><td>none</td><td>1</td><td>3</td></tr><tr><td>2</td><td>C</td><td></td><td>n/a</td><td>7</td></tr></table>
<table><thead><tr><th>Team</th><th>Points</th></tr></thead><tr><td>D</td><td>9</td></tr></table>"""


@pytest.fixture
def pages(spark):
    tab_function.register(spark)
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "<p>nothing</p>"), (4, "u", "<table><tr><th>Name</th></tr><tr><td>x</td></tr></table>")], "page_id long, url string, html string")
    df.createOrReplaceTempView("p")
    return df


def test_a_kind_gives_the_rows_of_its_reader(spark, pages):
    got = spark.sql("SELECT page_id, row_no, rank, team, institution, wins, points FROM p, LATERAL tab_rows(html, 'team_tab')")
    want = html_tables.team_tab(pages)
    assert got.schema.simpleString() == want.select(got.columns).schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    assert [tuple(r)[1:] for r in got.orderBy("row_no").collect()] == [(0, 1, 'A, "B"', "Uni", 4, 1234.5), (2, 2, "C", None, None, 7.0)]


def test_columns_of_ones_own(spark, pages):
    got = spark.sql("SELECT page_id, t.* FROM p, LATERAL tab_rows(html, 'who! = team; points double = points / spk; seen int = nothing') t ORDER BY page_id, table_no, row_no")
    assert got.columns == ["page_id", "table_no", "row_no", "who", "points", "seen"]
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0, 'A, "B"', 1234.5, None), (1, 0, 2, "C", 7.0, None), (1, 1, 0, "D", 9.0, None)]
    assert spark.sql("SELECT page_id, t.n FROM p, LATERAL tab_rows(html, 'n! = name; m = title') t WHERE page_id > 1").collect() == [(4, "x")]


def test_what_is_refused(spark, pages):
    for bad in ("standings", "a b c = x", "n money = x", "first", ""):
        with pytest.raises(Exception, match="neither a kind|no columns|must be a constant"):
            spark.sql(f"SELECT * FROM p, LATERAL tab_rows(html, '{bad}')").collect()
    with pytest.raises(Exception, match="must be a constant"):
        spark.sql("SELECT * FROM p, LATERAL tab_rows(html, url)").collect()


def test_columns_and_values():
    first, columns = columns_of("first; a! = x, Y / z; b int = q")
    assert first and [(c.name, c.type, c.must, c.words) for c in columns] == [("a", "string", True, [["x", "y"], ["z"]]), ("b", "int", False, [["q"]])]
    assert [value_of(x, "double") for x in ("1,234.50", "-2", "1e3", "", None, "٣")] == [1234.5, -2.0, None, None, None, None]
    assert value_of("7.9", "int") == 7 and value_of("", "string") is None
