"""Tables of pages in SQL: a table function whose columns follow the kind of tab that is asked for.

    register(spark)
    SELECT page_id, t.* FROM pages, LATERAL tab_rows(html, 'team_tab') t
    SELECT page_id, t.* FROM pages, LATERAL tab_rows(html, 'name! = name, speaker; total double = total / pts, point') t

The second argument is a constant: one of :data:`KINDS`, or columns of one's own. A column has a name, a type (text if none), and the
words by one of which its header is known; words after a slash count only where none before it is met. Rows where a column with
``!`` is empty are left out; where its header is missing, a table gives none. Every row comes with the numbers of its table and row,
from 0; kinds of a standing read a page's first table only, as :mod:`rostrum.sources.html_tables` does.

Defined: a null page, or one without tables, gives no rows; numbers that are none are null; of two headers the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rostrum.sources.html_tables import read_tables

# Words of the headers of published tabs.
KINDS = {
    "team_tab": "first; rank int = rk, rank, #; team! = team; institution = inst, school, uni; wins int = win; points double = pts, point, total / spk, speak, score",
    "speaker_tab": "first; speaker! = name, speaker; team = team; institution = inst, school; rank_esl int = esl; rank_efl int = efl; total double = total, spk, score, pts, point, sum, speaks",
    "participants": "name! = name; role = role; team = team; institution = inst, school",
    "motions": "text! = motion, text, topic; round = round, stage, label; info_slide = info, slide",
    "round_results": "first; team! = team; side = side, position; result = result, win; points double = points, pts, score; adjudicators = adj, judge, panel",
}
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
_COLUMN = re.compile(r"^(?P<name>\w+)(?P<must>!?)(\s+(?P<type>\w+))?\s*=\s*(?P<words>.+)$")


@dataclass
class Column:
    name: str
    type: str
    must: bool
    words: list[list[str]]


def columns_of(wanted: str) -> tuple[bool, list[Column]]:
    """(whether only the first table counts, the columns) of a kind or of columns that are spelled out."""
    parts = [p.strip() for p in KINDS.get(wanted, wanted).split(";") if p.strip()]
    first, out = "first" in parts, []
    for p in parts:
        if p == "first":
            continue
        m = _COLUMN.match(p)
        if not m or (m["type"] or "string") not in _TYPES:
            raise ValueError(f"neither a kind of tab ({', '.join(KINDS)}) nor a column: {p!r}")
        out.append(Column(m["name"], m["type"] or "string", bool(m["must"]), [[w.strip().lower() for w in group.split(",")] for group in m["words"].split("/")]))
    if not out:
        raise ValueError("no columns are asked for")
    return first, out


def place_of(head: list[dict], column: Column) -> int | None:
    """The first header that says one of the column's words."""
    said = ["\x00".join([h.get("key") or "", h.get("title") or ""]).lower() for h in head]
    return next((i for words in column.words for i, s in enumerate(said) if any(w in s for w in words)), None)


def value_of(text: str | None, kind: str):
    if not text or kind == "string":
        return text or None
    bare = re.sub(r"[,\s]", "", text)
    number = float(bare) if re.fullmatch(r"-?\d+(\.\d+)?", bare, re.ASCII) else None
    return number if kind == "double" or number is None else int(number)


def texts_of(block: pa.ListArray) -> Iterator[list[str]]:
    """The texts of each row of a block."""
    texts = block.values.field("text").to_pylist()
    for start, end in pairwise(block.offsets.to_pylist()):
        yield texts[start:end]


class TabRows:
    @staticmethod
    def analyze(html: AnalyzeArgument, wanted: AnalyzeArgument) -> AnalyzeResult:
        if not wanted.isConstantExpression or not wanted.value:
            raise ValueError("the kind of tab must be a constant")
        fields = [T.StructField(c.name, _TYPES[c.type]) for c in columns_of(wanted.value)[1]]
        return AnalyzeResult(T.StructType([T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()), *fields]))

    def __init__(self) -> None:
        self.known: dict[str, tuple[bool, list[Column]]] = {}

    def eval(self, html: str | None, wanted: str) -> Iterator[tuple]:
        if wanted not in self.known:
            self.known[wanted] = columns_of(wanted)
        first, columns = self.known[wanted]
        for t, table in enumerate(read_tables(html)[: 1 if first else None]):
            places = [place_of(table.head, c) for c in columns]
            if any(c.must and p is None for c, p in zip(columns, places, strict=True)):
                continue
            for r, row in enumerate(row for block in table.blocks for row in texts_of(block)):
                texts = [row[p] if p is not None and p < len(row) else None for p in places]
                if not any(c.must and not x for c, x in zip(columns, texts, strict=True)):
                    yield t, r, *(value_of(x, c.type) for c, x in zip(columns, texts, strict=True))


tab_rows = F.udtf(TabRows)


def register(spark: SparkSession) -> None:
    spark.udtf.register("tab_rows", tab_rows)
