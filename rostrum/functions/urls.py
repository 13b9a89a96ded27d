"""URLs and text that holds them: normal form, checks, hosts, fingerprints, HTML to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slugs that collide with routes, and references that are decoded, in order.
RESERVED_SLUGS = ["admin", "api", "app", "cv", "dashboard", "login", "logout", "onboarding", "privacy", "public", "settings", "signup", "support", "terms", "u"]
REFERENCES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def normalize_url(url: Column) -> Column:
    """Without punctuation and slashes at its end, then one slash."""
    return F.concat(F.regexp_replace(F.regexp_replace(url, r"[.,)\]\s]+$", ""), "/+$", ""), F.lit("/"))


def url_variants(url: Column) -> Column:
    return F.array_distinct(F.array(url, normalize_url(url)))


def host(url: Column) -> Column:
    return F.split_part(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))


def path_part(url: Column, k: int) -> Column:
    """The k-th part of the path, from 1."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+" + r"/+[^/?#]+" * (k - 1) + r"/+([^/?#]+)", 1), F.lit(""))


def _suffixes(hosts: Sequence[str]) -> str:
    return "(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + ")"


def private_url(url: Column, hosts: Sequence[str]) -> Column:
    """http(s) under one of the host suffixes, without user, port or odd parts, and with a path of slug, privateurls, token."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#@:\s]*" + _suffixes(hosts) + r"/+[\w-]+/+privateurls/+\w+(/[^?#]*)?([?#].*)?$"), F.lit(False))


def extract_urls(text: Column, hosts: Sequence[str]) -> Column:
    """Distinct normalised private URLs of a text as it is, and with quoted-printable line breaks and ``=3D`` undone."""
    undone = F.regexp_replace(F.regexp_replace(text, r"=\r?\n", ""), "=3[dD]", "=")
    both = F.when(undone == text, text).otherwise(F.concat(text, F.lit("\n---\n"), undone))
    found = F.regexp_extract_all(both, F.lit(r"(?i)https?://[\w-]+" + _suffixes(hosts) + r"/[\w-]+/privateurls/\w+/?"), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(found, normalize_url)), F.array().cast("array<string>"))


def strip_html(html: Column) -> Column:
    """Tags, styles and scripts become spaces; the common references are decoded, in order."""
    out = F.regexp_replace(html, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for code, char in REFERENCES:
        out = F.regexp_replace(out, "(?i)" + code, char)
    return out


def fingerprint(host_: Column, slug: Column, name: Column, year: Column) -> Column:
    """32 hex digits of host, slug, name (single spaces) and year in lower case; nulls count as empty."""
    text = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    spaced = F.trim(F.regexp_replace(text(name), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws("|", text(host_), text(slug), spaced, text(year)), 256), 1, 32)


def candidate_years(explicit: Column, inferred: Column) -> Column:
    """Years under which a record may be stored, most likely first: the one stated; else the one inferred, none, and its neighbours."""
    none = F.lit(None).cast("int")
    return F.when(explicit.isNotNull(), F.array(explicit)).when(inferred.isNull(), F.array(none)).otherwise(F.array(inferred, none, inferred - 1, inferred + 1))


def lock_key(print_: Column) -> Column:
    return F.conv(F.substring(print_, 1, 15), 16, 10).cast("bigint")


def slug_error(raw: Column) -> Column:
    """Why a slug is refused: too_short, too_long, invalid_chars or reserved; null if it is not."""
    slug = F.lower(F.trim(raw))
    fits = slug.rlike(r"^[a-z0-9](?:[a-z0-9-]{1,28}[a-z0-9])?$") & ~F.contains(slug, F.lit("--"))
    return F.when(F.length(slug) < 3, "too_short").when(F.length(slug) > 30, "too_long").when(~fits, "invalid_chars").when(slug.isin(RESERVED_SLUGS), "reserved")


def year_in(name: Column) -> Column:
    return F.regexp_extract(name, r"(?:19|20)\d{2}", 0).try_cast("int")


def year_of(name: Column, sent: Column) -> Column:
    """A year in the name, else the year of the message."""
    return F.coalesce(year_in(name), F.year(sent))
