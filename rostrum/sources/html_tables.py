"""Result pages as tables of cells, and the rows that tab pages hold.

Only the step from a page to ragged cells is Python (one small function per
page, in Arrow batches). Finding columns by what their headers say, and turning
cells into typed rows, are DataFrame expressions over those cells.

A page is read once, row by row. Its rows are put away in Arrow blocks as they
come, so that of a large page a task holds the text and the cells as Arrow data,
and Python objects of one block only; blocks go to Spark as rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from rostrum.functions.numbers import parse_number
from rostrum.functions.stages import normalize_stage
from rostrum.sources.js_literal import LiteralError, Reader
from rostrum.sources.navigation import text_of

# How pages name their embedded tables, in order of preference.
MARKERS = [r"window\.vueData\s*=\s*", r"\bvueData\s*[=:]\s*", r"""["']?tablesData["']?\s*[=:]\s*"""]

_CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("mark", T.StringType())])
_HEAD = T.StructType([T.StructField("key", T.StringType()), T.StructField("title", T.StringType())])
_BLOCK = T.StructType([
    T.StructField("table_no", T.IntegerType(), False), T.StructField("title", T.StringType()), T.StructField("head", T.ArrayType(_HEAD)),
    T.StructField("start", T.IntegerType(), False), T.StructField("rows", T.ArrayType(T.ArrayType(_CELL))),
])
_ROW_ARROW = pa.list_(pa.struct([("text", pa.string()), ("mark", pa.string())]))
_HEAD_ARROW = pa.list_(pa.struct([("key", pa.string()), ("title", pa.string())]))

#: A block of rows is full at so many characters, where a row and a cell count as 64 more each.
BLOCK_CHARS = 1 << 20


class Rows:
    """Rows of a table as they come, put away in blocks; a row is a list of (text, mark)."""

    def __init__(self) -> None:
        self.blocks: list[pa.Array] = []
        self.open: list[list[tuple[str, str]]] = []
        self.size = 0

    def add(self, row: list[tuple[str, str]]) -> None:
        self.open.append(row)
        self.size += 64 + sum(64 + len(text) + len(mark) for text, mark in row)
        if self.size >= BLOCK_CHARS:
            self.close()

    def close(self) -> list[pa.Array]:
        if self.open:
            self.blocks.append(pa.array(self.open, _ROW_ARROW))
            self.open, self.size = [], 0
        return self.blocks


class Table(NamedTuple):
    title: str
    head: list[dict]
    blocks: list[pa.Array]


def _plain(value) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", "" if value is None else str(value))).strip()


def _embedded(page: str) -> list[Table] | None:
    for marker in MARKERS:
        for m in re.finditer(marker, page):
            try:
                found = _literal_tables(Reader(page, m.end()))
            except LiteralError:
                continue
            if found is not None:
                return found
    return None


def _literal_tables(r: Reader) -> list[Table] | None:
    """Tables of a literal that is an array of them, or an object that names one; null for any other. What is not a literal to its
    end has none, so nothing is given out before."""
    if r.opens("["):
        return _table_array(r, 0)
    if not r.opens("{"):
        r.read()
        return None
    found = None
    for key in r.entries():
        if key == "tablesData" and r.opens("["):
            found = _table_array(r, 1)
        else:
            r.read(1)
            found = None if key == "tablesData" else found
    return found


def _table_array(r: Reader, depth: int) -> list[Table] | None:
    found, fit = [], True
    for _ in r.elements():
        if r.opens("{"):
            found.append(_embedded_table(r, depth + 1))
        else:
            r.read(depth + 1)
            fit = False
    return found if fit else None


def _embedded_table(r: Reader, depth: int) -> Table:
    told: dict = {}
    rows = Rows()
    for key in r.entries():
        if key == "data" and r.opens("["):
            rows = Rows()
            for _ in r.elements():
                rows.add(_cells(r.read(depth + 2)))
        elif key == "data":
            rows = Rows()
            for row in _items(r.read(depth + 1)):
                rows.add(_cells(row))
        else:
            value = r.read(depth + 1)
            if key in ("title", "head"):
                told[key] = value
    heads = [h if isinstance(h, dict) else {"title": h} for h in _items(told.get("head"))]
    head = [{"key": _plain(h.get("key")), "title": _plain(h.get("title")) or _plain(h.get("tooltip"))} for h in heads]
    return Table(_plain(told.get("title")), head, rows.close())


def _items(value) -> Iterable:
    """What a value lists; nothing for a number or a truth value."""
    return value if isinstance(value, list | dict | str) else []


def _cells(row) -> list[tuple[str, str]]:
    cells = [c if isinstance(c, dict) else {"text": c} for c in _items(row)]
    return [(_plain(c.get("text")), f"{c.get('class') or ''} {c.get('html') or ''}") for c in cells]


class _Tables(HTMLParser):
    """Rendered tables: the first head row, else the first row, names the columns."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.title: list[str] | None = None
        self.last_title = ""
        self.table: dict | None = None
        self.cell: dict | None = None
        self.hidden: list[str] = []
        self.special: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if "card-title" in classes:
            self.title = []
        if tag == "table":
            self.table = {"title": self.last_title, "open": [], "first": None, "head": None, "rows": Rows()}
        if self.table is None:
            return
        if tag == "tr":
            if self.table["open"] and not self.table["open"][-1]["cells"]:
                self.table["open"].pop()
            self.table["open"].append({"cells": [], "th": False, "thead": self.table.get("in_head", False)})
        elif tag == "thead":
            self.table["in_head"] = True
        elif tag in ("td", "th") and self.table["open"]:
            self.settle(self.table["open"][:-1])
            row = self.table["open"][-1]
            self.table["open"] = [row]
            row["th"] |= tag == "th"
            self.cell = {"text": [], "hidden": [], "trigger": [], "mark": a.get("class") or "", "tip": a.get("data-original-title") or ""}
            row["cells"].append(self.cell)
        elif self.cell is not None:
            self.cell["mark"] += " " + (a.get("class") or "")
            self.cell["tip"] = self.cell["tip"] or a.get("data-original-title") or ""
            if tag == "span" and "hidden" in a:
                self.special.append((tag, "hidden"))
            elif "tooltip-trigger" in classes:
                self.special.append((tag, "trigger"))

    def handle_endtag(self, tag):
        if self.special and self.special[-1][0] == tag:
            self.special.pop()
        if tag in ("td", "th"):
            self.cell, self.special = None, []
        elif tag == "thead" and self.table is not None:
            self.table["in_head"] = False
        elif tag == "table" and self.table is not None:
            self.end_table()
        if self.title is not None and tag in ("h1", "h2", "h3", "h4", "h5", "div", "span"):
            self.last_title, self.title = _plain(" ".join(self.title)), None

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if self.cell is not None:
            self.cell[self.special[-1][1] if self.special else "text"].append(data)

    def settle(self, rows: list[dict]) -> None:
        """Puts rows away that take no more text. The first one waits, as a later row may be the head."""
        t = self.table
        for r in rows:
            if not r["cells"]:
                continue
            if t["head"] is None and r["thead"]:
                t["head"] = r
            if t["first"] is None:
                t["first"] = r
            elif not r["thead"]:
                t["rows"].add(_rendered_cells(r))

    def end_table(self) -> None:
        self.settle(self.table["open"])
        title, first, rows = self.table["title"], self.table["first"], self.table["rows"]
        if first is not None:
            head = self.table["head"] or first
            leading = Rows()
            if not first["thead"] and not (first is head and first["th"]):
                leading.add(_rendered_cells(first))
            self.tables.append(Table(title, [{"key": "", "title": c["tip"] or _cell_text(c)} for c in head["cells"]], leading.close() + rows.close()))
        self.table, self.cell = None, None


def _cell_text(c: dict) -> str:
    return _plain(" ".join(c["hidden"])) or _plain(" ".join(c["trigger"])) or _plain(" ".join(c["text"]))


def _rendered_cells(row: dict) -> list[tuple[str, str]]:
    return [(_cell_text(c), c["mark"]) for c in row["cells"]]


def _rendered(page: str) -> list[Table]:
    p = _Tables()
    p.feed(page)
    p.close()
    if p.table is not None:
        p.end_table()
    return p.tables


def read_tables(page: str | None) -> list[Table]:
    """All tables of a page: embedded ones if it has any, else rendered ones; none for a page without."""
    if not page:
        return []
    return _embedded(page) or _rendered(page)


def page_tables(page: str | None) -> list[dict]:
    """The tables of a page as plain values."""
    return [{"title": t.title, "head": t.head, "rows": [row for b in t.blocks for row in b.to_pylist()]} for t in read_tables(page)]


def _read_pages(batches: Iterator[pa.RecordBatch], html: str, first: bool) -> Iterator[pa.RecordBatch]:
    none = pa.array([], _ROW_ARROW)
    for batch in batches:
        texts, others = batch.column(html), batch.drop_columns([html])
        made: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            for n, t in enumerate(read_tables(texts[i].as_py())[: 1 if first else None]):
                start = 0
                for block in t.blocks or [none]:
                    made.append((i, n, t.title, t.head, start, block))
                    start, size = start + len(block), size + block.nbytes
                    if size >= BLOCK_CHARS:
                        yield _as_batch(others, made)
                        made, size = [], 0
        if made:
            yield _as_batch(others, made)


def _as_batch(others: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    page, number, title, head, start, blocks = zip(*made, strict=True)
    ends = [0]
    for b in blocks:
        ends.append(ends[-1] + len(b))
    rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(blocks))
    values = [pa.array(number, pa.int32()), pa.array(title, pa.string()), pa.array(head, _HEAD_ARROW), pa.array(start, pa.int32()), rows]
    return pa.RecordBatch.from_arrays([*others.take(pa.array(page, pa.int64())).columns, *values], [*others.schema.names, *_BLOCK.names])


def with_tables(pages: DataFrame, html: str = "html", first: bool = False) -> DataFrame:
    """Tables of pages, or the first of each, in blocks of rows: the page's other columns, table number, title, head, number of the
    block's first row (``start``), rows. Every table has one block that starts at 0, which is empty if the table is."""
    others = [f for f in pages.schema if f.name != html]
    return pages.mapInArrow(partial(_read_pages, html=html, first=first), T.StructType([*others, *_BLOCK]))


# -- columns by what their header says ---------------------------------------


def find_column(head: Column, *needles: str, exclude: tuple[Column, ...] = ()) -> Column:
    """Number (from 0) of the first column whose key or title holds a needle; null if none does."""
    says = lambda h: F.lower(F.concat_ws("\x00", h["key"], h["title"]))

    def hit(h, i):
        ok = F.lit(False)
        for n in needles:
            ok = ok | F.contains(says(h), F.lit(n))
        for x in exclude:
            ok = ok & ~i.eqNullSafe(x)
        return F.struct(ok.alias("ok"), i.alias("i"))

    hits = F.filter(F.transform(head, hit), lambda x: x["ok"])
    return F.get(hits, F.lit(0))["i"]


def cell(row: str, column: Column) -> Column:
    """Text of a cell; null where the column is missing or the cell is empty."""
    return F.nullif(F.get(F.col(row), column)["text"], F.lit(""))


def _first_tables(pages: DataFrame) -> DataFrame:
    return with_tables(pages, first=True)


def _rows(tables: DataFrame, columns: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per table row, with its number, cells (``row``) and the numbers of the found columns."""
    found = tables.select(*keys, "title", "head", "start", "rows", *[c.alias(name) for name, c in columns.items()])
    each = found.select(*keys, "title", "head", "start", *columns, F.posexplode("rows").alias("pos", "row"))
    return each.select(*keys, "title", "head", *columns, (F.col("start") + F.col("pos")).alias("row_no"), "row")


def team_tab(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row_no, rank, team, institution, wins, points): standings of teams."""
    h = F.col("head")
    points = F.coalesce(find_column(h, "pts", "point", "total"), find_column(h, "spk", "speak", "score"))
    r = _rows(_first_tables(pages), {"c_team": find_column(h, "team"), "c_rank": find_column(h, "rk", "rank", "#"), "c_inst": find_column(h, "inst", "school", "uni"), "c_wins": find_column(h, "win"), "c_points": points}, [key])
    at = lambda c: cell("row", F.col(c))
    return r.filter(at("c_team").isNotNull()).select(key, "row_no", parse_number(at("c_rank")).cast("int").alias("rank"), at("c_team").alias("team"), at("c_inst").alias("institution"), parse_number(at("c_wins")).cast("int").alias("wins"), parse_number(at("c_points")).alias("points"))


# Headers of columns that hold one round.
ROUND_HEADER = r"(?i)\b(r(ound)?\s*\d+|final|semi|quarter|octo|grand)\b|^\s*\d+\s*$|\b(speech|debate|match)\s*\d+"


def speaker_tab(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row_no, rank, rank_esl, rank_efl, speaker, team, institution, total, scores): standings of speakers. Without any rank
    column, the place among named rows is the rank; without round columns, the average is the one score."""
    h = F.col("head")
    esl, efl = find_column(h, "esl"), find_column(h, "efl")
    average = F.get(F.filter(F.transform(h, lambda x, i: F.struct(F.concat_ws(" ", x["key"], x["title"]).rlike(r"(?i)\b(avg|average|mean)\b").alias("ok"), i.alias("i"))), lambda x: x["ok"]), F.lit(0))["i"]
    columns = {
        "c_name": find_column(h, "name", "speaker"), "c_esl": esl, "c_efl": efl, "c_rank": find_column(h, "rk", "rank", "#", exclude=(esl, efl)), "c_avg": average, "c_team": find_column(h, "team"),
        "c_inst": find_column(h, "inst", "school"), "c_total": find_column(h, "total", "spk", "score", "pts", "point", "sum", "speaks", exclude=(average,)),
    }
    r = _rows(_first_tables(pages), columns, [key])
    at = lambda c: cell("row", F.col(c))
    taken = F.array(*[F.col(c) for c in columns])
    label = lambda x: F.when(x["title"] != "", x["title"]).otherwise(x["key"])
    heads = F.filter(F.transform("head", lambda x, i: F.struct(label(x).alias("label"), i.alias("i"), (label(x).rlike(ROUND_HEADER) | x["key"].rlike(r"(?i)^r\d+$")).alias("ok"))), lambda x: x["ok"] & ~F.coalesce(F.exists(taken, lambda t: t == x["i"]), F.lit(False)))
    scores = F.transform(heads, lambda x: F.struct(x["label"].alias("label"), parse_number(F.get(F.col("row"), x["i"])["text"]).alias("score")))
    mean = parse_number(at("c_avg"))
    only = F.array(F.struct(F.lit("Average").alias("label"), mean.alias("score")))
    named = r.filter(at("c_name").isNotNull())
    place = F.row_number().over(_by(key))
    rank = F.when(F.col("c_rank").isNotNull(), parse_number(at("c_rank")).cast("int")).when(F.col("c_esl").isNull() & F.col("c_efl").isNull(), place)
    return named.select(
        key, "row_no", rank.alias("rank"), parse_number(at("c_esl")).cast("int").alias("rank_esl"), parse_number(at("c_efl")).cast("int").alias("rank_efl"), at("c_name").alias("speaker"), at("c_team").alias("team"),
        at("c_inst").alias("institution"), parse_number(at("c_total")).alias("total"), F.when((F.size(heads) == 0) & mean.isNotNull(), only).otherwise(scores).alias("scores"),
    )


def _by(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("row_no")


def _round_rows(pages: DataFrame, key: str) -> DataFrame:
    h = F.col("head")
    team = find_column(h, "team")
    seats = {f"c_{s}": find_column(h, s) for s in ("og", "oo", "cg", "co")}
    columns = {"c_team": team, **seats, "c_win": find_column(h, "win", "result"), "c_side": find_column(h, "position", "side", "pos"), "c_points": find_column(h, "point", "score", "pts"), "c_adj": find_column(h, "adjud", "judge"), "c_role": find_column(h, "chair", "panel", "role", exclude=(team,))}
    return _rows(_first_tables(pages), columns, [key])


def round_results(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row_no, team, position, points, won): teams of one column, or of four seat columns (then without points and result).
    With a result column, what it does not call won is lost."""
    at = lambda c: cell("row", F.col(c))
    r = _round_rows(pages, key)
    won = F.when(F.col("c_win").isNotNull(), F.coalesce(F.lower(at("c_win")).rlike("won|win|✓|✔"), F.lit(False)))
    one = r.filter(at("c_team").isNotNull()).select(key, "row_no", at("c_team").alias("team"), at("c_side").alias("position"), parse_number(at("c_points")).alias("points"), won.alias("won"))
    seats = F.array(*[F.struct(F.lit(s).alias("position"), at(f"c_{s.lower()}").alias("team")) for s in ("OG", "OO", "CG", "CO")])
    four = r.filter("c_team is null").select(key, "row_no", F.explode(seats).alias("s")).filter("s.team is not null")
    return one.unionByName(four.select(key, "row_no", "s.team", "s.position", F.lit(None).cast("double").alias("points"), F.lit(None).cast("boolean").alias("won")))


def judge_panels(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, person, panel_role): adjudicators of a round, each once per role; a chair is marked as such or by the row's role."""
    at = lambda c: cell("row", F.col(c))
    r = _round_rows(pages, key).withColumn("role_text", F.lower(F.coalesce(at("c_role"), F.lit(""))))
    tokens = r.select(key, "role_text", F.explode(F.split(at("c_adj"), r"[,;\n]|\s+/\s+")).alias("token")).withColumn("token", F.trim(F.regexp_replace("token", r"\s+", " ")))
    chair = F.lower("token").rlike(r"\bchair\b|\bchief\b|\(c\)") | F.col("role_text").rlike("chair|chief")
    name = F.trim(F.regexp_replace("token", r"(?i)\s*\(\s*c\s*\)$|\s+\((chair|chief)\)$", ""))
    return tokens.select(key, name.alias("person"), F.when(chair, "chair").when(F.col("role_text") != "", "panel").alias("panel_role")).filter(F.length("person") >= 2).distinct()


def break_stage(url: Column) -> Column:
    """The stage that a break page's address names, in words."""
    part = F.regexp_extract(url, r"/break/(teams/[^/]+|adjudicators)", 1)
    slug = F.lower(F.regexp_extract(part, "^teams/(.+)$", 1))
    words = F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "-")
    return F.when(part == "adjudicators", "Adjudicators").when(slug.isin("esl", "efl"), F.upper(slug)).when(slug != "", words)


def break_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row_no, rank, entity_type, entity, institution, score, stage): who broke; adjudicators have no rank."""
    h = F.col("head")
    r = _rows(_first_tables(pages), {"c_rank": find_column(h, "rk", "rank", "#"), "c_name": F.coalesce(find_column(h, "team", "adjudicator", "name"), F.lit(0)), "c_inst": find_column(h, "inst", "school"), "c_score": find_column(h, "score", "pts", "point", "total")}, [key, "url"])
    at = lambda c: cell("row", F.col(c))
    adj = F.contains("url", F.lit("/break/adjudicators/"))
    return r.filter(at("c_name").isNotNull()).select(
        key, "row_no", F.when(~adj, parse_number(at("c_rank")).cast("int")).alias("rank"), F.when(adj, "adjudicator").otherwise("team").alias("entity_type"), at("c_name").alias("entity"),
        at("c_inst").alias("institution"), parse_number(at("c_score")).alias("score"), break_stage(F.col("url")).alias("stage"),
    )


# Roles of those who run an event.
CORE_ROLES = [r"\b(?:chief|deputy)\s+(?:chief\s+)?adjudicator\b", r"\b(?:adj[\s-]?core|core\s+adjudicator|tab[\s-]?director)\b", r"\bd?ca\b"]


def participant_role(text: Column) -> Column:
    """(role, judge_tag) of a role text: core before other adjudicators, those before speakers."""
    low = F.lower(text)
    core = low.rlike(CORE_ROLES[0]) | low.rlike(CORE_ROLES[1]) | low.rlike(CORE_ROLES[2])
    judge = low.rlike("adjud|judge")
    tag = F.when(low.rlike("subsid"), "subsidized").when(low.rlike("invited|independent"), "invited").otherwise("normal")
    role = F.when(core | judge, "adjudicator").when(low.rlike("speak|debat"), "speaker").otherwise("other")
    return F.struct(role.alias("role"), F.when(core, "core").when(judge, tag).alias("judge_tag"))


def participants(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_no, row_no, name, role, judge_tag, team, institution): a role column decides, else the table's title or shape."""
    h = F.col("head")
    tables = with_tables(pages)
    columns = {"c_name": find_column(h, "name"), "c_team": find_column(h, "team"), "c_inst": find_column(h, "inst", "school"), "c_role": find_column(h, "role"), "c_rating": find_column(h, "rating"), "c_ind": find_column(h, "independent")}
    r = _rows(tables, columns, [key, "table_no"])
    at = lambda c: cell("row", F.col(c))
    title = F.lower(F.coalesce("title", F.lit("")))
    adj_title, speaker_title = title.rlike("^adjudicators?$"), title.rlike("^speakers?$")
    speakers = speaker_title | (F.col("c_team").isNotNull() & ~adj_title)
    judges = adj_title | (~speakers & F.col("c_rating").isNotNull())
    invited = F.coalesce(F.get(F.col("row"), F.col("c_ind"))["mark"].rlike(r"(?i)\bfeather-check\b"), F.lit(False))
    shape = F.struct(F.when(speakers, "speaker").when(judges, "adjudicator").otherwise("other").alias("role"), F.when(~speakers & judges, F.when(invited, "invited").otherwise("normal")).alias("judge_tag"))
    kind = F.when(F.col("c_role").isNotNull(), participant_role(F.coalesce(at("c_role"), F.lit("")))).otherwise(shape)
    inst = at("c_inst")
    named = r.filter(at("c_name").isNotNull()).withColumn("k", kind)
    return named.select(key, "table_no", "row_no", at("c_name").alias("name"), "k.role", "k.judge_tag", at("c_team").alias("team"), F.when(~inst.isin("—", "-"), inst).alias("institution"))


# A registration card is a list group; its items tell the role and the institution.
_GROUP = r"""(?is)<div\b[^>]*class=["'][^"']*\blist-group(?![\w-])[^>]*>.*?(?=<div\b[^>]*class=["'][^"']*\blist-group(?![\w-])|\z)"""
_ITEM = r"""(?is)<(\w+)\b[^>]*class=["'][^"']*\blist-group-item(?![\w-])[^>]*>.*?</\1>"""
_TITLE = r"""(?is)class=["'][^"']*\bcard-title(?![\w-])[^>]*>(.*?)</"""


def registration_cards(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row_no, name, role, judge_tag, institution): participants of pages that show a card per registration. A card that names no
    role and has a single bullet is an adjudicator's."""
    cards = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(_GROUP), 0)).alias("card_no", "card"))
    name = F.trim(F.regexp_extract(text_of(F.regexp_extract("card", _TITLE, 1)), r"(?i)^Registration\s*\((.+)\)$", 1))
    bullets = F.filter(F.transform(F.regexp_extract_all("card", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1), text_of), lambda b: b != "")
    items = F.transform(F.regexp_extract_all("card", F.lit(_ITEM), 0), lambda i: F.trim(F.regexp_extract(text_of(i), r"(?i)^Institution:\s*(.+)$", 1)))
    made = cards.withColumn("name", name).filter("name <> ''").withColumn("bullets", bullets).withColumn("at", F.try_element_at(F.filter(items, lambda i: i != ""), F.lit(-1)))
    told = participant_role(F.array_join("bullets", " "))
    lone = (told["role"] == "other") & (F.size("bullets") == 1)
    row = F.row_number().over(Window.partitionBy(key).orderBy("card_no")) - 1
    return made.select(
        key, row.alias("row_no"), "name", F.when(lone, "adjudicator").otherwise(told["role"]).alias("role"), F.when(lone, "normal").otherwise(told["judge_tag"]).alias("judge_tag"),
        F.when(~F.col("at").isin("—", "-"), F.col("at")).alias("institution"),
    )


# What makes a heading a round's.
ROUND_HEADING = r"(?i)\bround\s*\d+\b|\br\d+\b|\b(final|semi|quarter|octo|grand)\b"
_PIECE = r"(?is)<h[1-4]\b[^>]*>.*?</h[1-4]>|<li\b[^>]*>.*?</li>|<p\b[^>]*>.*?</p>"


def motion_sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, round_label, round_number, text, info_slide): motions of pages that are laid out as headings with lists or paragraphs.
    A list right after a round's heading holds its motions; else all that follows up to the next heading does. An info slide goes with the round's first motion."""
    piece = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(_PIECE), 0)).alias("pos", "raw")).withColumn("text", text_of(F.col("raw"))).filter("text <> ''")
    order = Window.partitionBy(key).orderBy("pos")
    heading, listed = F.col("raw").rlike("(?i)^<h[1-4]"), F.col("raw").rlike("(?i)^<li")
    in_section = Window.partitionBy(key, "section").orderBy("pos")
    s = piece.withColumn("label", F.when(heading, F.col("text"))).withColumn("section", F.count("label").over(order)).filter("section > 0")
    s = s.withColumn("label", F.first("label").over(in_section)).withColumn("i", F.row_number().over(in_section)).withColumn("listed", listed)
    body = s.filter((F.col("i") > 1) & F.col("label").rlike(ROUND_HEADING)).withColumn("list_first", F.first("listed").over(in_section)).withColumn("broken", F.max(~F.col("listed")).over(in_section))
    body = body.filter(~(F.col("list_first") & F.col("broken")))
    slide = ~F.col("list_first") & F.col("text").rlike(r"(?i)^info[-\s]?slide[:\s]")
    whole = in_section.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = F.nullif(F.trim(F.regexp_replace("text", r"(?i)^info[-\s]?slide[:\s]*", "")), F.lit(""))
    body = body.withColumn("slide", slide).withColumn("info", F.last(F.when(F.col("slide"), said), ignorenulls=True).over(whole)).filter(~F.col("slide"))
    first = F.row_number().over(in_section) == 1
    number = F.regexp_extract(normalize_stage(F.col("label")), r"(?i)^Round\s+(\d+)$", 1).try_cast("int")
    return body.select(key, (F.row_number().over(order) - 1).alias("seq"), F.col("label").alias("round_label"), number.alias("round_number"), "text", F.when(first, F.col("info")).alias("info_slide"))


def team_matches(a: Column, b: Column) -> Column:
    """Whether two cells mean one team: equal, or the longer is the shorter and a number."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    numbered = F.startswith(longer, shorter) & F.substr(longer, F.length(shorter) + 1).rlike(r"^\s+\d+\s*$")
    return (shorter != "") & ((a == b) | numbered)


def motions(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, round_label, round_number, text, info_slide): motions in document order."""
    h = F.col("head")
    columns = {"c_text": find_column(h, "motion", "text", "topic"), "c_round": find_column(h, "round", "stage", "label"), "c_info": find_column(h, "info", "slide")}
    r = _rows(with_tables(pages), columns, [key, "table_no"])
    at = lambda c: cell("row", F.col(c))
    label = F.when(F.col("c_round").isNotNull(), F.coalesce(at("c_round"), F.lit(""))).otherwise(F.coalesce("title", F.lit("")))
    number = F.regexp_extract(normalize_stage(label), r"(?i)^Round\s+(\d+)$", 1).try_cast("int")
    seq = F.row_number().over(Window.partitionBy(key).orderBy("table_no", "row_no")) - 1
    return r.filter(at("c_text").isNotNull()).select(key, seq.alias("seq"), label.alias("round_label"), number.alias("round_number"), at("c_text").alias("text"), at("c_info").alias("info_slide"))


def _debates(pages: DataFrame, key: str) -> DataFrame:
    """Rows of a person's own debates: the table that is titled so, else the first that names adjudicators."""
    t = with_tables(pages)
    titled = F.coalesce(F.col("title").rlike(r"(?i)^((my|your)\s+)?(debates?|rounds?)$|^schedule$|^panel(s|\s+history)?$|round\s+assignments?"), F.lit(False))
    adj = find_column(F.col("head"), "adjudicator", "judge")
    t = t.withColumn("fit", F.when(titled, 2).when(adj.isNotNull(), 1).otherwise(0)).filter("fit > 0")
    own = t.withColumn("i", F.rank().over(Window.partitionBy(key).orderBy(F.desc("fit"), "table_no"))).filter("i = 1")
    h = F.col("head")
    return _rows(own, {"c_round": F.coalesce(find_column(h, "round"), F.lit(0)), "c_adj": find_column(h, "adjudicator", "judge", "adj"), "c_result": find_column(h, "result")}, [key])


def judge_rounds(pages: DataFrame, key: str = "page_id", owner: str | None = None) -> DataFrame:
    """(key, sequence, stage, round_number, role): rounds that the page's owner judged, and how. The owner is who is set in bold; where
    nothing is, and ``owner`` names a column of the pages, who has that name."""
    r = _debates(pages, key)
    mark = F.coalesce(F.get("row", F.col("c_adj"))["mark"], F.lit(""))
    bold = F.regexp_extract(mark, r"(?is)<strong\b.*?</strong>", 0)
    said = bold
    if owner is not None:
        r = r.join(pages.select(key, F.lower(F.trim(owner)).alias("known")).filter("known <> ''"), key, "left")
        plain = text_of(mark)
        at = F.instr(F.lower(plain), F.col("known"))
        # the name and what stands right behind it, up to the next name
        said = F.when(bold != "", bold).when(at > 0, F.concat(F.lit("="), F.substring(plain, at + F.length("known"), F.lit(3)))).otherwise("")
    stage = normalize_stage(cell("row", F.col("c_round")))
    role = F.when(said.rlike("Ⓒ|(?i)chair"), "chair").when(said.rlike("Ⓣ|(?i)trainee"), "trainee").otherwise("panellist")
    return r.filter((said != "") & stage.isNotNull()).select(key, (F.col("row_no") + 1).alias("sequence"), stage.alias("stage"), F.regexp_extract(stage, r"^Round (\d+)$", 1).try_cast("int").alias("round_number"), role.alias("role"))


def speaker_rounds(pages: DataFrame, team: str, key: str = "page_id") -> DataFrame:
    """(key, sequence, stage, won): rounds of the page's owner as a speaker: the row whose team cell is in bold or names the known team."""
    r = _debates(pages.drop(team), key).join(pages.select(key, F.lower(F.trim(team)).alias("__team")), key)
    own = F.filter("row", lambda c: F.coalesce(c["mark"].rlike(r"(?i)<strong\b") | team_matches(F.lower(c["text"]), F.col("__team")), F.lit(False)))
    mark = F.get(own, F.lit(0))["mark"]
    won = F.when(mark.rlike(r"(?i)chevron-up|\bwon\b|text-success|\bwin\b"), True).when(mark.rlike(r"(?i)chevron-down|\blost\b|text-danger|\bloss\b"), False)
    stage = normalize_stage(cell("row", F.col("c_round")))
    return r.filter((F.size(own) > 0) & stage.isNotNull()).select(key, (F.col("row_no") + 1).alias("sequence"), stage.alias("stage"), won.alias("won"))
