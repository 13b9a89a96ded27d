"""Queries of the page sources: pages are spelled from the tables, parsed back, and compared with what was spelled."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import functions as F

from rostrum.plans.facts import Catalog, table
from rostrum.sources import archive, html_tables, js_literal, navigation, tab_function
from rostrum.sources.store import shared_folder

CATALOG = Catalog()
query = CATALOG.query


def _page(df, by, heads, cells, order, script=True):
    """A page per group: an embedded table literal, or a rendered table."""
    if script:
        head = "[" + ", ".join(f"{{key: '{k}', title: \"{t}\"}}" for k, t in heads) + "]"
        row = F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit("{text: "), F.to_json(F.array(c.cast("string"))).substr(2, 10000).alias("x"), F.lit("}")) for c in cells]), F.lit("]"))
        row = F.regexp_replace(row, r"\]\}", "}")
        start, end = f"<html><script>window.vueData = [{{head: {head}, data: [", "], undefinedThing: undefined}];</script></html>"
        sep = ",\n"
    else:
        row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells], F.lit("</tr>"))
        start, end, sep = "<html><table><thead><tr>" + "".join(f"<th>{t}</th>" for _, t in heads) + "</tr></thead><tbody>", "</tbody></table></html>", "\n"
    g = df.groupBy(F.col(by).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), sep)
    return g.select("page_id", F.lit("https://a.example.org/t/results/round/3/").alias("url"), F.concat(F.lit(start), body, F.lit(end)).alias("html"))


def _teams(spark, d, script=True):
    s = table(spark, d, "supplier")
    return _page(s, "s_nationkey", [("rk", "Rank"), ("team", "Team"), ("inst", "Institution"), ("wins", "Wins"), ("pts", "Points")], [F.col("s_suppkey") % 20 + 1, F.col("s_name"), F.concat(F.lit('Uni "'), F.col("s_nationkey"), F.lit('"')) if script else F.concat(F.lit("Uni "), F.col("s_nationkey")), F.col("s_suppkey") % 7, F.col("s_acctbal")], "s_suppkey", script)


@query(" SELECT s_nationkey::BIGINT AS page_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS row_no, (s_suppkey % 20 + 1)::INT AS rank, s_name AS team, 'Uni \"' || s_nationkey || '\"' AS institution, (s_suppkey % 7)::INT AS wins, s_acctbal AS points FROM supplier")
def src_06_team_tab(spark, sf_dir):
    return html_tables.team_tab(_teams(spark, sf_dir)).withColumn("page_id", F.col("page_id").cast("bigint"))


@query(" SELECT s_nationkey::BIGINT AS page_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS row_no, (s_suppkey % 20 + 1)::INT AS rank, s_name AS team, 'Uni \"' || s_nationkey || '\"' AS institution, (s_suppkey % 7)::INT AS wins, s_acctbal AS points FROM supplier")
def src_06_tab_function(spark, sf_dir):
    """The team tabs in SQL, through the table function."""
    tab_function.register(spark)
    _teams(spark, sf_dir).createOrReplaceTempView("tab_pages")
    return spark.sql("SELECT CAST(page_id AS BIGINT) AS page_id, row_no, rank, team, institution, wins, points FROM tab_pages, LATERAL tab_rows(html, 'team_tab')")


@query(" SELECT c_nationkey::BIGINT AS page_id, c_name AS speaker, c_mktsegment AS team, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 + 1 END::INT AS rank_esl, c_acctbal AS total, (c_custkey % 30 + 60)::DOUBLE AS first FROM customer")
def src_07_tab_function(spark, sf_dir):
    """The speaker tabs in SQL, with a column of one's own."""
    tab_function.register(spark)
    _speakers(spark, sf_dir).createOrReplaceTempView("tab_pages")
    wanted = "first; speaker! = name; team = team; rank_esl int = esl; total double = total; first double = r1"
    return spark.sql(f"SELECT CAST(page_id AS BIGINT) AS page_id, t.speaker, t.team, t.rank_esl, t.total, t.first FROM tab_pages, LATERAL tab_rows(html, '{wanted}') t")


@query(" SELECT s_nationkey::BIGINT AS page_id, s_name AS team, 'Uni ' || s_nationkey AS institution, s_acctbal AS points FROM supplier")
def src_05_rendered_tables(spark, sf_dir):
    return html_tables.team_tab(_teams(spark, sf_dir, script=False)).select(F.col("page_id").cast("bigint").alias("page_id"), "team", "institution", "points")


@query("""
, r AS (SELECT s_nationkey::BIGINT AS page_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS row_no, [(s_suppkey % 20 + 1)::VARCHAR, s_name, 'Uni "' || s_nationkey || '"', (s_suppkey % 7)::VARCHAR] AS c FROM supplier)
SELECT page_id, row_no, (generate_subscripts(c, 1) - 1)::INT AS col_no, unnest(['rk', 'team', 'inst', 'wins']) AS key, unnest(['Rank', 'Team', 'Institution', 'Wins']) AS title, unnest(c) AS text FROM r""")
def src_03_embedded_tables(spark, sf_dir):
    """Every cell of the embedded tables but for the decimals, with what its column is called."""
    t = html_tables.with_tables(_teams(spark, sf_dir))
    row = t.select(F.col("page_id").cast("bigint").alias("page_id"), "head", "start", F.posexplode("rows").alias("pos", "row"))
    cell = row.select("page_id", (F.col("start") + F.col("pos")).alias("row_no"), "head", F.posexplode("row").alias("col_no", "cell")).filter("col_no < 4")
    head = F.get("head", F.col("col_no"))
    return cell.select("page_id", "row_no", "col_no", head["key"].alias("key"), head["title"].alias("title"), "cell.text")


@query("""
SELECT p_partkey, p_partkey % 8 < 4 AS ok, CASE WHEN p_partkey % 8 < 4 THEN p_name END AS name, CASE WHEN p_partkey % 8 < 4 THEN (p_size + 16)::DOUBLE END AS size, CASE WHEN p_partkey % 8 < 4 THEN (-p_size - 0.5)::DOUBLE END AS low FROM part""")
def src_04_js_literal(spark, sf_dir):
    """Literals of every part: half of them well-formed, in several spellings, and half of a kind that must be refused."""
    p = table(spark, sf_dir, "part")
    quoted = F.concat(F.lit("'"), F.replace("p_name", F.lit("'"), F.lit("\\'")), F.lit("'"))
    good = F.concat(F.lit("{name: "), quoted, F.lit(", 'size': 0x"), F.lower(F.hex(F.col("p_size") + 16)), F.lit(", low: ["), (-F.col("p_size") - 0.5).cast("string"), F.lit(", [], null,], gone: undefined}"))
    bad = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("f("), good, F.lit(")"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("{[x]: "), good, F.lit("}"))).when(F.col("p_partkey") % 4 == 2, F.lit("{__proto__: {name: 'x'}}")).otherwise(F.concat(good, F.lit("; more")))
    text = F.when(F.col("p_partkey") % 8 < 4, good).otherwise(bad)
    read = F.from_json(js_literal.as_json(text), "struct<name:string,size:double,low:array<string>>")
    return p.select("p_partkey", read.alias("r")).select("p_partkey", F.col("r").isNotNull().alias("ok"), "r.name", "r.size", F.get("r.low", F.lit(0)).cast("double").alias("low"))


def _speakers(spark, d):
    c = table(spark, d, "customer")
    return _page(c, "c_nationkey", [("rank", "Rk"), ("esl", "ESL Rank"), ("name", "Name"), ("team", "Team"), ("r1", "R1"), ("r2", "2"), ("avg", "Avg"), ("total", "Total")], [F.col("c_custkey") % 90 + 1, F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 9 + 1).cast("string")).otherwise(F.lit("")), F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 30 + 60, F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 25 + 60).cast("string")).otherwise(F.lit("—")), F.lit("75.5"), F.col("c_acctbal")], "c_custkey")


@query(" SELECT c_nationkey::BIGINT AS page_id, c_name AS speaker, c_mktsegment AS team, (c_custkey % 90 + 1)::INT AS rank, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 + 1 END::INT AS rank_esl, c_acctbal AS total, (c_custkey % 30 + 60)::DOUBLE AS first, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 25 + 60 END::DOUBLE AS second, 2::INT AS scores FROM customer")
def src_07_speaker_tab(spark, sf_dir):
    t = html_tables.speaker_tab(_speakers(spark, sf_dir))
    return t.select(F.col("page_id").cast("bigint").alias("page_id"), "speaker", "team", "rank", "rank_esl", "total", F.get("scores", F.lit(0))["score"].alias("first"), F.get("scores", F.lit(1))["score"].alias("second"), F.size("scores").alias("scores"))


def _debates(spark, d):
    s = table(spark, d, "supplier")
    return _page(s, "s_nationkey", [("team", "Team"), ("side", "Side"), ("result", "Result"), ("points", "Points"), ("adj", "Adjudicators")], [F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "OG").otherwise("OO"), F.when(F.col("s_suppkey") % 3 == 0, "Won").otherwise("lost"), F.col("s_suppkey") % 4, F.concat(F.lit("Ann "), F.col("s_suppkey") % 5, F.lit(" (c), Bob "), F.col("s_suppkey") % 3)], "s_suppkey")


@query(" SELECT s_nationkey::BIGINT AS page_id, s_name AS team, CASE WHEN s_suppkey % 2 = 0 THEN 'OG' ELSE 'OO' END AS position, (s_suppkey % 4)::DOUBLE AS points, s_suppkey % 3 = 0 AS won FROM supplier")
def src_08_round_results(spark, sf_dir):
    return html_tables.round_results(_debates(spark, sf_dir)).select(F.col("page_id").cast("bigint").alias("page_id"), "team", "position", "points", "won")


@query(" SELECT DISTINCT s_nationkey::BIGINT AS page_id, 'Ann ' || (s_suppkey % 5) AS person, 'chair' AS panel_role FROM supplier UNION SELECT s_nationkey::BIGINT, 'Bob ' || (s_suppkey % 3), NULL FROM supplier")
def src_08_judge_panels(spark, sf_dir):
    return html_tables.judge_panels(_debates(spark, sf_dir)).select(F.col("page_id").cast("bigint").alias("page_id"), "person", "panel_role")


@query(" SELECT s_nationkey::BIGINT AS page_id, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_suppkey % 20 + 1 END::INT AS rank, s_name AS entity, CASE s_nationkey % 4 WHEN 0 THEN 'Adjudicators' WHEN 1 THEN 'ESL' WHEN 2 THEN 'Pro-Am' ELSE 'Open' END AS stage FROM supplier")
def src_09_break_page(spark, sf_dir):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, "adjudicators").when(k == 1, "teams/esl").when(k == 2, "teams/pro-am").otherwise("teams/open")
    pages = _teams(spark, sf_dir).withColumn("url", F.concat(F.lit("https://a.example.org/t/break/"), tail, F.lit("/")))
    return html_tables.break_rows(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "rank", "entity", "stage")


@query(" SELECT c_nationkey::BIGINT AS page_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'speaker' ELSE 'adjudicator' END AS role, CASE c_custkey % 3 WHEN 1 THEN 'core' WHEN 2 THEN 'invited' END AS judge_tag, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS institution FROM customer")
def src_10_participants(spark, sf_dir):
    role = F.when(F.col("c_custkey") % 3 == 0, "Debater").when(F.col("c_custkey") % 3 == 1, "Deputy Chief Adjudicator").otherwise("Invited Judge")
    pages = _page(table(spark, sf_dir, "customer"), "c_nationkey", [("name", "Name"), ("role", "Role"), ("inst", "Institution")], [F.col("c_name"), role, F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("—"))], "c_custkey")
    return html_tables.participants(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "name", "role", "judge_tag", "institution")


_ROLE_TEXTS = ["Tab Director", "Deputy Chief Adjudicator", "Subsidised judge", "Independent adjudicator", "Adjudicator", "Debater", "Guest", "DCA", "Cameron"]


@query("""
SELECT p_partkey, CASE p_partkey % 9 WHEN 5 THEN 'speaker' WHEN 6 THEN 'other' WHEN 8 THEN 'other' ELSE 'adjudicator' END AS role,
  CASE p_partkey % 9 WHEN 0 THEN 'core' WHEN 1 THEN 'core' WHEN 2 THEN 'subsidized' WHEN 3 THEN 'invited' WHEN 4 THEN 'normal' WHEN 7 THEN 'core' END AS judge_tag FROM part""")
def fn_24_all_roles(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, _ROLE_TEXTS)), (F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", html_tables.participant_role(text).alias("r")).select("p_partkey", "r.role", "r.judge_tag")


@query("""
SELECT (c_custkey // 25)::BIGINT AS page_id, (row_number() OVER (PARTITION BY c_custkey // 25 ORDER BY c_custkey) - 1)::INT AS row_no, c_name AS name,
  CASE c_custkey % 4 WHEN 1 THEN 'speaker' WHEN 2 THEN 'other' ELSE 'adjudicator' END AS role, CASE c_custkey % 4 WHEN 0 THEN 'invited' WHEN 3 THEN 'normal' END AS judge_tag,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS institution FROM customer""")
def src_10_registration_cards(spark, sf_dir):
    """Every customer as a registration card, some 25 to a page."""
    k = F.col("c_custkey")
    bullets = F.when(k % 4 == 0, "<li>Independent adjudicator</li><li>hello</li>").when(k % 4 == 1, "<li>Debater</li><li>hello</li>").when(k % 4 == 2, "<li>guest</li><li>hello</li>").otherwise("<li>hello &amp; welcome</li>")
    at = F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, "—").otherwise(F.lit(None))
    item = F.coalesce(F.concat(F.lit('<span class="list-group-item small">Institution: <b>'), at, F.lit("</b></span>")), F.lit(""))
    card = F.concat(F.lit('<div class="list-group mt-3"><h4 class="card-title">Registration ('), "c_name", F.lit(")</h4><ul>"), bullets, F.lit("</ul>"), item, F.lit("</div>"))
    g = table(spark, sf_dir, "customer").groupBy(F.floor(k / 25).cast("bigint").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), card.alias("card")))).alias("cards"))
    pages = g.select("page_id", F.concat(F.lit("<html><body><div class=card>Participants</div>"), F.array_join(F.transform("cards", lambda c: c["card"]), "\n"), F.lit("</body></html>")).alias("html"))
    return html_tables.registration_cards(pages)


@query("""
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY p_partkey, k) - 1)::INT AS seq, label AS round_label, n AS round_number, text, info AS info_slide FROM (
  SELECT (p_partkey // 20)::BIGINT AS page_id, p_partkey, unnest([1, 2]) AS k, CASE WHEN p_partkey % 3 = 2 THEN 'Grand Final' ELSE 'Round ' || (p_partkey % 20 + 1) END AS label, CASE WHEN p_partkey % 3 <> 2 THEN p_partkey % 20 + 1 END::INT AS n,
    unnest([p_name, p_type]) AS text, unnest([CASE WHEN p_partkey % 2 = 0 THEN p_brand END, NULL]) AS info FROM part)""")
def src_11_motion_sections(spark, sf_dir):
    """Every part as a round of two motions under a heading: a list, or paragraphs with an info slide; some twenty to a page."""
    k = F.col("p_partkey")
    label = F.when(k % 3 == 2, F.lit("<h3>Grand Final</h3>")).otherwise(F.concat(F.lit("<h3 class=r>Round "), (k % 20 + 1).cast("string"), F.lit("</h3>")))
    as_list = F.concat(F.lit("<ul><li>"), "p_name", F.lit("</li><li> "), "p_type", F.lit("</li></ul><p>Good luck</p>"))
    as_text = F.concat(F.lit("<p>"), "p_name", F.lit("</p><p></p><p>"), "p_type", F.lit("</p><p>Info slide: "), "p_brand", F.lit("</p>"))
    part = F.concat(label, F.when(k % 2 == 0, as_text).otherwise(as_list), F.lit("<h2>Venue</h2><p>Hall</p>"))
    g = table(spark, sf_dir, "part").groupBy(F.floor(k / 20).cast("bigint").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), part.alias("part")))).alias("parts"))
    pages = g.select("page_id", F.concat(F.lit("<html><body><h1>Motions</h1>"), F.array_join(F.transform("parts", lambda c: c["part"]), "\n"), F.lit("</body></html>")).alias("html"))
    return html_tables.motion_sections(pages)


@query(" SELECT 'Professional ' || p_brand AS n, count(*) AS total FROM part GROUP BY p_brand")
def fn_24_role_classes(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("r", html_tables.participant_role(F.concat(F.lit("Independent adjudicator "), "p_brand")))
    return p.filter("r.role = 'adjudicator' and r.judge_tag = 'invited'").groupBy(F.concat(F.lit("Professional "), "p_brand").alias("n")).agg(F.count("*").alias("total"))


@query(" SELECT s_nationkey::BIGINT AS page_id, 1::INT AS team, 4::INT AS points FROM supplier GROUP BY 1")
def fn_23_needles(spark, sf_dir):
    t = html_tables.with_tables(_teams(spark, sf_dir)).filter("start = 0")
    return t.select(F.col("page_id").cast("bigint").alias("page_id"), html_tables.find_column(F.col("head"), "team").alias("team"), html_tables.find_column(F.col("head"), "pts", "point").alias("points"))


@query(" SELECT (p_partkey % 40)::BIGINT AS page_id, (row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) - 1)::INT AS seq, 'R' || (p_partkey % 6) AS round_label, (p_partkey % 6)::INT AS round_number, p_name AS text FROM part")
def src_11_motions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("page", F.col("p_partkey") % 40)
    pages = _page(p, "page", [("round", "Round"), ("motion", "Motion"), ("info", "Info slide")], [F.concat(F.lit("R"), F.col("p_partkey") % 6), F.col("p_name"), F.lit("")], "p_partkey")
    return html_tables.motions(pages).select("page_id", "seq", "round_label", "round_number", "text")


_NAV = """<nav><a href="/t1/tab/team/">Teams</a><a href='/t1/results/round/2/'>Round 2</a><a href="/t1/results/round/10/">Grand Final</a><a href="https://other.example.net/t1/tab/speaker/">no</a><a class=x href="/t1/x/">Participants</a></nav>"""


def _nav_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.lit("/t1/privateurls/abc/")).alias("url"), F.concat(F.lit(_NAV), "html").alias("html"))


_NAV_SQL = """
, b AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root FROM pages)
SELECT page_id, unnest(['team_tab', 'round', 'round', 'participants', 'speaker_tab']) AS kind, unnest([root || '/t1/tab/team/', root || '/t1/results/round/2/', root || '/t1/results/round/10/', root || '/t1/x/', root || '/t1/tab/speaker/']) AS url, unnest([false, false, false, false, true]) AS constructed FROM b"""


@query(_NAV_SQL)
def src_12_navigation(spark, sf_dir):
    return navigation.navigation(_nav_pages(spark, sf_dir)).select("page_id", "kind", "url", "constructed")


# links on which path and label disagree
_ODD_NAV = """<nav><a href="/t1/results/round/2/">Speaker Tab</a><a href="/t1/tab/team/">Round 3</a><a href="/t1/x/">Team Tab</a><a href="/t1/y/">Semifinals</a></nav>"""
_ODD_SQL = """
, b AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root FROM pages)
SELECT page_id, unnest({kinds}) AS kind, root || '/t1/' || unnest({paths}) AS url, unnest({made}) AS constructed FROM b"""


def _odd_nav_pages(spark, d):
    return _nav_pages(spark, d).withColumn("html", F.replace("html", F.lit(_NAV), F.lit(_ODD_NAV)))


@query(_ODD_SQL.format(kinds=["round", "team_tab", "speaker_tab", "participants"], paths=["results/round/2/", "tab/team/", "tab/speaker/", "participants/list/"], made="[false, false, true, true]"))
def src_12_paths_before_labels(spark, sf_dir):
    return navigation.navigation(_odd_nav_pages(spark, sf_dir)).select("page_id", "kind", "url", "constructed")


@query(_ODD_SQL.format(kinds=["speaker_tab", "round", "team_tab", "round", "participants"], paths=["results/round/2/", "tab/team/", "x/", "y/", "participants/list/"], made="[false, false, false, false, true]"))
def src_15_navigation_by_label(spark, sf_dir):
    return navigation.navigation(_odd_nav_pages(spark, sf_dir), by_label=True).select("page_id", "kind", "url", "constructed")


@query(" SELECT c_custkey AS page_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS person, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN c_mktsegment || ' A' END AS team FROM customer")
def src_12_registration(spark, sf_dir):
    team = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" ("), "c_mktsegment", F.lit(" A)"))).otherwise(F.lit("."))
    line = F.when(F.col("c_custkey") % 5 == 0, "<h1>Nobody's page</h1>").otherwise(F.concat(F.lit("<p>hello</p><h4 class=x>Private URL\n for <strong>"), "c_name", F.lit("</strong>"), team, F.lit("</h4>")))
    return navigation.registration(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("<html><body>"), line, F.lit("</body></html>")).alias("html")))


def _cards(spark, d):
    s = table(spark, d, "supplier")
    mark = F.concat(F.lit("<span>Bob</span> <strong>Ann "), F.when(F.col("s_suppkey") % 3 == 0, "Ⓒ").when(F.col("s_suppkey") % 3 == 1, "Ⓣ").otherwise(""), F.lit("</strong>"))
    row = F.concat(F.lit('[{text: "R'), F.col("s_suppkey") % 9, F.lit('"}, {text: "'), "s_name", F.lit('", class: "team-name", html: "'), F.when(F.col("s_suppkey") % 2 == 0, "<i class=chevron-up></i>").otherwise("<i class=chevron-down></i>"), F.lit('"}, {text: "Bob, Ann", html: "'), mark, F.lit('"}]'))
    g = s.groupBy(F.col("s_nationkey").cast("bigint").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda r: r["row"]), ", ").alias("rows"), F.min("s_name").alias("team"))
    head = '[{key: "round", title: "Round"}, {key: "team"}, {key: "adjudicators", title: "Adjudicators"}]'
    return g.select("page_id", "team", F.concat(F.lit(f'<script>vueData = {{tablesData: [{{title: "My Debates", head: {head}, data: ['), "rows", F.lit("]}]}</script>")).alias("html"))


@query(" SELECT s_nationkey::BIGINT AS page_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS sequence, 'Round ' || (s_suppkey % 9) AS stage, (s_suppkey % 9)::INT AS round_number, CASE s_suppkey % 3 WHEN 0 THEN 'chair' WHEN 1 THEN 'trainee' ELSE 'panellist' END AS role FROM supplier")
def src_13_judge_rounds(spark, sf_dir):
    return html_tables.judge_rounds(_cards(spark, sf_dir).drop("team"))


def src_13_owner_by_name(spark, sf_dir):
    """The same rounds where nothing is in bold, and the owner is known by name."""
    pages = _cards(spark, sf_dir).drop("team").withColumn("html", F.replace("html", F.lit("strong"), F.lit("em"))).withColumn("owner", F.lit("Ann"))
    return html_tables.judge_rounds(pages, owner="owner")


CATALOG.queries["src_13_owner_by_name"], CATALOG.oracles["src_13_owner_by_name"] = src_13_owner_by_name, CATALOG.oracles["src_13_judge_rounds"]


@query(" SELECT s_nationkey::BIGINT AS page_id, s_suppkey % 2 = 0 AS won, 'Round ' || (s_suppkey % 9) AS stage FROM supplier QUALIFY s_name = min(s_name) OVER (PARTITION BY s_nationkey)")
def src_14_speaker_rounds(spark, sf_dir):
    pages = _cards(spark, sf_dir).withColumn("html", F.replace("html", F.lit("strong"), F.lit("em")))
    return html_tables.speaker_rounds(pages, "team").select("page_id", "won", "stage")


@query(" SELECT conv_id, turn, role || chr(10) || text AS text FROM conversations WHERE text IS NOT NULL")
def src_16_mail_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    body = F.replace(F.replace(F.rtrim(F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("=")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    part = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(body.alias("data")).alias("body"))
    payload = F.struct(F.array(F.struct(F.lit("Subject").alias("name"), F.col("role").alias("value"))).alias("headers"), F.array(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part).alias("parts"))).alias("parts"))
    return navigation.mail_texts(c.select("conv_id", "turn", F.to_json(F.struct(payload.alias("payload"))).alias("raw"))).select("conv_id", "turn", "text")


def _archived(spark, records):
    archive.register(spark)
    path = shared_folder(spark) + "/archive"
    records.sortWithinPartitions("at").write.format(archive.FORMAT).mode("append").save(path)
    return path


@query(" SELECT page_id::VARCHAR AS id, TIMESTAMP '2024-01-01' + to_hours(page_id * 37 % 900) AS at, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS owner, sha256(html) AS hash FROM pages WHERE page_id * 37 % 900 BETWEEN 100 AND 700")
def src_18_page_archive(spark, sf_dir):
    """All pages are archived by the hour of their fetch; a span of time is read back, from the files of its days only."""
    p = table(spark, sf_dir, "pages")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("page_id") * 37 % 900)
    path = _archived(spark, p.select(F.col("page_id").cast("string").alias("id"), at.alias("at"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("owner"), F.col("html").alias("body")))
    found = spark.read.format(archive.FORMAT).load(path).filter("at >= timestamp'2024-01-05 04:00:00' and at <= timestamp'2024-01-30 04:00:00'")
    return found.select("id", "at", "owner", F.sha2("body", 256).alias("hash"))


@query("""
, mail AS (SELECT conv_id || '/' || turn AS id, TIMESTAMP '2024-02-01' + to_minutes(conv_id * 40 + turn) AS at, role AS owner, text FROM conversations)
SELECT id, "at", owner, chr(10) || coalesce(text, '') AS text FROM mail WHERE owner = 'user'""")
def src_16_mail_archive(spark, sf_dir):
    """All messages are archived; those of one owner are read back, and their texts are taken from the parts of the message."""
    c = table(spark, sf_dir, "conversations")
    body = F.translate(F.replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\r\n"), F.lit("")), "+/=", "-_")
    raw = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text/plain").alias("mimeType"), F.struct(body.alias("data")).alias("body"))).alias("parts")).alias("payload")))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-02-01").cast("timestamp")) + (F.col("conv_id") * 40 + F.col("turn")).cast("bigint") * 60_000_000)
    path = _archived(spark, c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), at.alias("at"), F.col("role").alias("owner"), raw.alias("body")))
    found = spark.read.format(archive.FORMAT).load(path).filter("owner = 'user'")
    return navigation.mail_texts(found, "body").select("id", "at", "owner", "text")


@query("""
, first AS (SELECT event_id, user_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 10 <> 0), bound AS (SELECT max(ts) AS last FROM first)
SELECT 1 AS run, event_id::VARCHAR AS id, ts AS at, user_id::VARCHAR AS owner FROM first
UNION ALL SELECT 2, event_id::VARCHAR, ts, user_id::VARCHAR FROM events, bound WHERE (ts >= TIMESTAMP '2024-01-20' OR event_id % 10 = 0) AND ts > last - INTERVAL 1 DAY""")
def str_08_mail_stream(spark, sf_dir):
    """All events as messages, filed in two lots: the second has all later ones, and a tenth of the earlier ones, late. A stream runs
    after each lot; its second run gives what is new since the last message less a day."""
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("owner"), F.col("props").alias("body"))
    early = (F.col("at") < F.lit("2024-01-20").cast("timestamp")) & (F.col("id").cast("bigint") % 10 != 0)
    path, out = _archived(spark, records.filter(early)), shared_folder(spark)
    one = archive.drained(spark, path, f"{out}/one", f"{out}/seen").withColumn("run", F.lit(1))
    records.filter(~early).sortWithinPartitions("at").write.format(archive.FORMAT).mode("append").save(path)
    two = archive.drained(spark, path, f"{out}/two", f"{out}/seen").withColumn("run", F.lit(2))
    return one.unionByName(two).select("run", "id", "at", "owner")


def src_19_seeded_numbers(spark, sf_dir):
    return spark.createDataFrame([(i, x) for i, x in enumerate(islice(navigation.seeded(42), 1000))], "i bigint, x double")


CATALOG.query(" , s AS (SELECT 0::BIGINT AS i, (42::BIGINT * 1664525 + 1013904223) % 4294967296 AS x UNION ALL SELECT i + 1, (x * 1664525 + 1013904223) % 4294967296 FROM s WHERE i < 999) SELECT i, x / 4294967296 AS x FROM s")(src_19_seeded_numbers)
