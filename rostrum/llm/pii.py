"""Personal data: fixed patterns, and spans that a character BiLSTM-CRF adds.

The patterns find emails, IP addresses, card numbers and phone numbers as
written by the book. The tagger is trained on windows of generated text with
labelled spans of those kinds in more spellings than the patterns know: spaced
or bracketed at signs and dots, spelled-out ones, numbers without a plus or in
words, in four languages. Overlapping windows lie over the whole of every text,
and every character is tagged: a place takes its tag from the window in which it
is farthest from an edge, and spans are read off the reconciled tags. What
overlaps a pattern's span is left to the pattern.

A tagged span is widened to whole words and kept if it is possible for its kind:
a local part, an at, and a dotted host; four numbers up to 255; 13 to 19 digits
passing Luhn; 9 to 15 digits, or 7 to 15 digit words.

Defined results: a null or empty text has no spans; repeated rows get equal
results; very long texts are read whole, in time that grows with their length,
:data:`BATCH` windows at once; an empty table gives an empty result; other
columns are left alone, but for one named ``__p``, which the result replaces.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.pii_model import BEYOND, KINDS, Tagger, classes, encode

#: Characters of a window, and by how many the next one starts later.
WINDOW, STRIDE = 512, 480
BATCH = 512
#: Generated windows to fit on, and their characters.
TRAIN_WINDOWS, TRAIN_WIDTH, EPOCHS = 6000, 72, 9

Span = tuple[int, int, str]

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
#: A number's first digit is where a match starts, and no part of a match is given back: the leftmost matches, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
_IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at signs, so that long runs cost no more than their length."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _IN_LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end(), "email"
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed in KINDS, then start."""
    out = list(_emails(text))
    if DIGITS.search(text):
        ones = lambda s: "".join(DIGITS.findall(s))
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [(*m.span(), "card") for m in CARD.finditer(text) if 13 <= len(d := ones(m[0])) <= 19 and luhn(d)]
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(ones(m[0])) <= 15]
    return out


# -- training --------------------------------------------------------------

# Digits in words, by language.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DOT_WORDS = ("dot", "punkt", "point", "punto")
AT_WORDS = ("at", "arroba", "arobase")
#: Frequent words and pieces of words of four languages, of which running text is made.
_SMALL = """the of and a to in is that it he was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do
der die und das in zu den mit von ist des sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um noch wie über
le la les de des et en un une du que qui dans est pour par sur au aux plus pas ce il se ne son avec elle nous vous
el los las y que una por con para su al lo como más pero sus le ya o este sí porque dot point punkt punto uno dos tres two three six drei deux""".split()
_PIECES = """th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur tion ing ation wh ly sh ble
ung keit heit ver sch ein ge au ü ö ä ß pf tz lich eit aus qu eau aux ment é è ê ç ois eur pa vi leu que ción mente ado ar os ó í ñ rr ja bo ga ez ue ci""".split()


def _word(r: random.Random) -> str:
    w = r.choice(_SMALL) if r.random() < 0.45 else "".join(r.choice(_PIECES) for _ in range(r.randint(1, 5)))
    return w.upper() if (x := r.random()) < 0.04 else w.capitalize() if x < 0.18 else w


def _name(r: random.Random) -> str:
    if r.random() < 0.5:
        return "".join(r.choice("aeioustrnlmdchbfgkpvw") for _ in range(r.randint(3, 9)))
    return "".join(x for _ in range(r.randint(1, 4)) if (x := r.choice(_PIECES)).isascii()) or "ann"


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn_digits(r: random.Random, n: int) -> str:
    head = _digits(r, n - 1)
    return next(head + c for c in "0123456789" if luhn(head + c))


def personal(r: random.Random, kind: str) -> str:
    """One piece of personal data in one of many spellings."""
    if kind == "email":
        local = r.choice([[_name(r)], [_name(r), _name(r)], [_name(r), str(r.randint(1, 99))], [f"{_name(r)}_{_name(r)}"], [f"{_name(r)}-{_name(r)}"]])
        host = [_name(r) + r.choice(["", "", r.choice("0123456789")]), *([r.choice(["example", "mail", _name(r)])] if r.random() < 0.5 else []), r.choice(["com", "org", "net", "de", "fr", "es", "io"])]
        at, dot = r.choice([("@", "."), ("@", "."), (" @ ", "."), ("[@]", "."), ("(@)", "."), (" [at] ", "."), ("(at)", "."), (" (at) ", "."), (f" {r.choice(AT_WORDS)} ", f" {r.choice(DOT_WORDS)} "), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", " . "), (" at ", " dot "), (f" {r.choice(AT_WORDS)} ", f" {r.choice(DOT_WORDS)} ")])
        return dot.join(local) + at + dot.join(host)
    if kind == "ip":
        return r.choice([".", ".", " . ", "[.]", "(.)", " dot ", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _luhn_digits(r, 16)
        return r.choice(["", " ", "-", ".", "/", "_", "  ", " - "]).join(d[i : i + 4] for i in range(0, 16, 4))
    if r.random() < 0.35:
        words = r.choice(DIGIT_WORDS).split()
        return r.choice([" ", " ", "-", ", "]).join(r.choice(words) for _ in range(r.randint(7, 11)))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(30, 99)} {a} {b} {c}", f"00{r.randint(30, 99)} {a} {b}{c}", f"({a}) {b} {c}", f"{a}/{b}{c}", f"+1/{a}/{b}/{c}"])


def harmless(r: random.Random) -> str:
    """Text that looks a little like personal data."""
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 24, 32, 40])))
    few = " ".join(r.choice(r.choice(DIGIT_WORDS).split()) for _ in range(r.randint(1, 4)))
    return r.choice(
        [f'token = "{hexa}"', hexa, str(r.randint(1, 3000)), f"{r.randint(0, 999)}.{r.randint(0, 99)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 99)}"]
        + [f"@{_name(r)}", f"{r.randint(1, 9)} @ {r.randint(1, 99)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 9)},{_digits(r, 3)},{_digits(r, 3)}", few, f"at {_name(r)}", f"{_name(r)} at the {_name(r)}", f"dot {_name(r)}", f"({_name(r)})"]
        + [_digits(r, r.choice([5, 6, 8, 12, 20])) if r.random() < 0.6 else f"{_digits(r, 2)}:{_digits(r, 2)}"]
    )


def labelled_text(r: random.Random, length: int, share: float = 0.16) -> tuple[str, list[int], list[Span]]:
    """Generated text of at least that length, the tag of every character, and the spans."""
    text, tag, spans = "", [], []
    odd = r.choice([0.0, 0.03, 0.14])  # pieces that look a little like personal data
    gaps = r.choice([[" ", " ", " ", " ", " ", " ", ", ", ". ", ".\n"], [" ", ", ", ". ", "\n", "### ", "!! ", "&&& ", "*** ", "; ", "%%% ", "$$$ "]])
    while len(text) < length:
        x = r.random()
        kind = r.choice(KINDS) if x < share else None
        piece = personal(r, kind) if kind else harmless(r) if x < share + odd else _word(r)
        k = 1 + 2 * KINDS.index(kind) if kind else 0
        if kind:
            spans.append((len(text), len(text) + len(piece), kind))
        tag += [k] + [k + 1] * (len(piece) - 1) if k else [0] * len(piece)
        gap = r.choice(gaps)
        text += piece + gap
        tag += [0] * len(gap)
    return text, tag, spans


def labelled_windows(n: int, seed: int = 11, width: int = TRAIN_WIDTH) -> tuple[list[str], np.ndarray]:
    """Windows of generated text, and the tag of every character."""
    r = random.Random(seed)
    windows, tags = [], np.zeros((n, width), np.int64)
    for row in tags:
        offset = r.randint(0, width)
        text, tag, _ = labelled_text(r, offset + width, r.choice([0.0, 0.05, 0.2, 0.3]))
        windows.append(text[offset : offset + width])
        row[:] = tag[offset : offset + width]
    return windows, tags


@lru_cache(maxsize=2)
def trained(windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = 11) -> Tagger:
    """Fit once in a session; the weights go to the tasks by broadcast."""
    text, tags = labelled_windows(windows, seed)
    tagger = Tagger()
    tagger.fit(encode(text), tags, epochs, batch=100, rate=0.02)
    return tagger


# -- decoding --------------------------------------------------------------


def tags_of(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """The reconciled tag of every character of each text."""
    margin = (WINDOW - STRIDE) // 2
    inputs = [classes(t) for t in texts]
    tags = [np.zeros(len(x), np.int8) for x in inputs]
    jobs = [(i, s) for i, x in enumerate(inputs) for s in range(0, max(1, len(x) - (WINDOW - STRIDE)), STRIDE) if len(x)]
    # windows of one length are decoded together: short texts do not pay for a whole window
    jobs.sort(key=lambda j: min(WINDOW, len(inputs[j[0]]) - j[1]))
    for k in range(0, len(jobs), BATCH):
        part = jobs[k : k + BATCH]
        width = min(WINDOW, len(inputs[part[-1][0]]) - part[-1][1])
        x = np.full((len(part), width), BEYOND, np.int16)
        for row, (i, s) in zip(x, part, strict=True):
            piece = inputs[i][s : s + WINDOW]
            row[: len(piece)] = piece
        for row, (i, s) in zip(tagger.decode(x), part, strict=True):
            n = min(WINDOW, len(inputs[i]) - s)
            a, b = margin if s else 0, n if s + n == len(inputs[i]) else WINDOW - margin
            tags[i][s + a : s + b] = row[a:b]
    return tags


_AT = r"\s?(?:@|\[@\]|\(@\)|\[at\]|\(at\)|\b(?:" + "|".join(AT_WORDS) + r")\b)\s?"
_DOT = r"\s?(?:\.|\[\.\]|\[dot\]|\(dot\)|\b(?:" + "|".join(DOT_WORDS) + r")\b)\s?"
LIKE_EMAIL = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
WORD_OF_DIGIT = {w for words in DIGIT_WORDS for w in words.split()}


def possible(piece: str, kind: str) -> bool:
    """Whether a tagged piece can be what it is called."""
    digits = "".join(DIGITS.findall(piece))
    if kind == "email":
        return LIKE_EMAIL.fullmatch(piece) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in piece)
    numbers = re.findall(r"[0-9]+", piece)
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and not set(re.findall(r"[^\W\d_]+", piece.lower())) - set(DOT_WORDS)
    words = re.findall(r"[^\W\d_]+", piece.lower())
    if words:
        return 7 <= len(words) + len(digits) <= 15 and all(w in WORD_OF_DIGIT for w in words)
    return 9 <= len(digits) <= 15


def read_spans(text: str, tags: np.ndarray) -> list[Span]:
    """Spans of the reconciled tags, from word to word, that can be what they are called."""
    out, end = [], 0
    begins = tags % 2 == 1
    inside = tags > 0
    for a in np.flatnonzero(begins | (inside & np.concatenate([[True], ~inside[:-1]]))).tolist():
        kind = (int(tags[a]) - 1) // 2
        b = a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind:
            b += 1
        while a > end and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a >= end and b > a and possible(text[a:b], KINDS[kind]):
            out.append((a, b, KINDS[kind]))
            end = b
    return out


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the tagger finds and no pattern touches."""
    out = []
    for text, tags, known in zip(texts, tags_of(tagger, texts), base, strict=True):
        if not tags.any():
            out.append([])
            continue
        covered = np.zeros(len(text), bool)
        for a, b, _ in known:
            covered[a:b] = True
        out.append([s for s in read_spans(text, tags) if not covered[s[0] : s[1]].any()])
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


_SPANS = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with a column ``__p``: base spans by kind (counts), base spans and all spans as ``kind:start:end`` lists."""
    docs = docs.drop("__p")
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    @F.arrow_udf(_SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        values = [t.as_py() or "" for t in texts]
        base = [base_spans(t) for t in values]
        more = added_spans(shared.value, values, base)
        columns = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        columns += [pa.array([joined(b) for b in base], pa.string()), pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string())]
        return pa.StructArray.from_arrays(columns, [*[f"n_{k}" for k in KINDS], "base", "spans"])

    return docs.withColumn("__p", scan("text"))


def masked(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    found = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, end = [], 0
    for a, b, k in found:
        if a >= end:
            out += [text[end:a], f"[{k}]"]
            end = b
    return "".join(out) + text[end:]


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).select("doc_id", *[f"__p.n_{k}" for k in KINDS], F.sha2("__p.base", 256).alias("base_sha256"), "__p.spans")
