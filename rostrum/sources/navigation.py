"""Links of a tournament's pages, who a page is registered for, and mail messages."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.functions.urls import host, strip_html

# Paths and labels of a tournament's pages.
PATHS = {
    "team_tab": r"/tab/team(-standings)?/?$|/tab/overall/?$",
    "speaker_tab": r"/tab/speaker(-standings)?/?$",
    "motions_tab": r"/tab/motions/?$",
    "round": r"/results/round/\d+/?(by-team/|by-debate/)?$",
    "break": r"/break/[^/]+/?",
    "participants": r"/participants/list/?$",
    "institutions": r"/participants/institutions/?$",
}
LABELS = {"site home": "home", "team tab": "team_tab", "speaker tab": "speaker_tab", "motions tab": "motions_tab", "participants": "participants", "institutions": "institutions"}
CONSTRUCTED = {"team_tab": "tab/team/", "speaker_tab": "tab/speaker/", "participants": "participants/list/"}
LINK = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def text_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(strip_html(html), r"\s+", " "))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, base, seq, url, label): the links of a page to its own host, absolute, in order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    root = F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1))
    base = F.concat(root, F.lit("/"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/+([^/?#]+)", 1), F.lit("/"))
    each = pages.select(key, "url", root.alias("root"), base.alias("base"), F.posexplode(found).alias("seq", "a"))
    href = F.col("a.href")
    absolute = F.when(href.rlike("^[A-Za-z]+://"), href).when(F.startswith(href, F.lit("/")), F.concat("root", href)).otherwise(F.concat("base", href))
    out = each.select(key, "url", "base", "seq", absolute.alias("link"), text_of(F.col("a.label")).alias("label"))
    return out.filter(host(F.col("link")) == host(F.col("url"))).select(key, "base", "seq", F.col("link").alias("url"), "label")


def link_kind(url: Column, label: Column, by_label: bool = False) -> Column:
    """What a link leads to: by path first, then by label. by_label: labels first, and any that speaks of a final is a round."""
    path, low = F.regexp_replace(url, r"[?#].*$", ""), F.lower(label)
    by_path = F.lit(None).cast("string")
    for kind, pattern in reversed(PATHS.items()):
        by_path = F.when(path.rlike(pattern), F.lit(kind)).otherwise(by_path)
    named = F.lit(None).cast("string")
    for text, kind in LABELS.items():
        named = F.when(low == text, F.lit(kind)).otherwise(named)
    if by_label:
        return F.coalesce(named, F.when(low.rlike(r"final|^round \d+$"), "round"), by_path)
    return F.coalesce(by_path, named)


def navigation(pages: DataFrame, key: str = "page_id", by_label: bool = False) -> DataFrame:
    """(key, kind, url, label, constructed): the first link of each single page, all rounds and breaks; team tab, speaker tab and
    participants are constructed where no link leads there."""
    l = links(pages, key).withColumn("kind", link_kind(F.col("url"), F.col("label"), by_label)).filter("kind is not null")
    many = l.filter("kind in ('round', 'break')").groupBy(key, "kind", "url").agg(F.min_by("label", "seq").alias("label"))
    one = l.filter("kind not in ('round', 'break')").groupBy(key, "kind").agg(F.min_by(F.struct("url", "label"), "seq").alias("x")).select(key, "kind", "x.url", "x.label")
    found = many.unionByName(one).withColumn("constructed", F.lit(False))
    base = F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+/+[^/?#]+)", 1), F.lit("/"))
    wanted = pages.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(base, F.lit(p)).alias("url")) for k, p in CONSTRUCTED.items()])).alias("c")).select(key, "c.kind", "c.url")
    made = wanted.join(found.select(key, "kind"), [key, "kind"], "left_anti").select(key, "kind", "url", F.lit(None).cast("string").alias("label"), F.lit(True).alias("constructed"))
    return found.unionByName(made)


def registration(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, person, team): for whom a private page is."""
    text = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-5]|p)\b[^>]*>(.*?)</(?:h[1-5]|p)>"), F.lit(1)), text_of)
    line = F.get(F.filter(text, lambda t: t.rlike(r"(?i)^Private URL\s+for\b")), F.lit(0))
    name = F.regexp_extract(line, r"(?i)^Private URL\s+for\s+(.+?)\s*(?:\(([^)]+)\))?\s*\.?\s*$", 1)
    team = F.regexp_extract(line, r"(?i)^Private URL\s+for\s+(.+?)\s*\(([^)]+)\)\s*\.?\s*$", 2)
    return pages.select(key, F.nullif(name, F.lit("")).alias("person"), F.nullif(team, F.lit("")).alias("team"))


def _bodies(part: dict, kind: str) -> list[str]:
    out = []
    if part.get("mimeType") == kind and (data := (part.get("body") or {}).get("data")):
        out.append(base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace"))
    for child in part.get("parts") or []:
        out += _bodies(child, kind)
    return out


def message_text(raw: str | None) -> tuple[str, str] | None:
    """Subject with snippet and body of a message in JSON: plain parts before HTML ones."""
    if not raw:
        return None
    m = json.loads(raw)
    payload = m.get("payload") or {}
    subject = next((h.get("value") or "" for h in payload.get("headers") or [] if (h.get("name") or "").lower() == "subject"), "")
    plain = _bodies(payload, "text/plain")
    return "\n".join(x for x in (m.get("snippet") or "", subject) if x), "\n".join(plain) if plain else "<!>" + "\n".join(_bodies(payload, "text/html"))


@F.pandas_udf(T.StructType([T.StructField("head", T.StringType()), T.StructField("body", T.StringType())]))
def _message_udf(raw: pd.Series) -> pd.DataFrame:
    rows = [message_text(x) or (None, None) for x in raw]
    return pd.DataFrame(rows, columns=["head", "body"])


def mail_texts(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """messages with ``text``: snippet, subject and body, HTML bodies as plain text."""
    m = messages.withColumn("__m", _message_udf(raw))
    body = F.when(F.startswith("__m.body", F.lit("<!>")), strip_html(F.substr("__m.body", F.lit(4)))).otherwise(F.col("__m.body"))
    return m.withColumn("text", F.concat_ws("\n", "__m.head", body)).drop("__m")


def seeded(seed: int):
    """Numbers in [0, 1) of a fixed linear congruential sequence."""
    x = seed & 0xFFFFFFFF
    while True:
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        yield x / 2**32


