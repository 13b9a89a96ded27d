"""JavaScript literals as Python values, without evaluating anything."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<punct>[\[\]{},:])|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity)(?![\w$]))|(?P<word>[A-Za-z_$][\w$]*))""", re.S)
_REST = re.compile(r"\s*\Z")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
_WORDS = {"true": True, "false": False, "null": None, "undefined": None, "NaN": float("nan"), "Infinity": float("inf")}
DEEPEST = 200


class LiteralError(ValueError):
    """What is there is not a literal of values, arrays and objects."""


def _text(token: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "ux" and len(e) > 1:
            return chr(int(e[1:].strip("{}"), 16))
        return _PLAIN.get(e, e)

    text = _ESCAPE.sub(one, token[1:-1])
    # halves of a pair become one character, as in a browser; a half alone is no character
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in token else text


def _number(token: str) -> float | int:
    sign, bare = (-1 if token[0] == "-" else 1), token.lstrip("+-")
    if bare == "Infinity":
        return sign * float("inf")
    if bare[:2] in ("0x", "0X"):
        return sign * int(bare, 16)
    return sign * (int(bare) if bare.isdigit() else float(bare))


class Reader:
    """A literal read from its place in a text: as a whole, or piece by piece."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.kind, self.value = text, at, "", ""
        self.next()

    def next(self) -> None:
        m = _TOKEN.match(self.text, self.at)
        if m is None:
            self.kind, self.value = "end" if _REST.match(self.text, self.at) else "other", ""
            return
        self.at, self.kind, self.value = m.end(), m.lastgroup or "", m[m.lastgroup or 0]

    def take(self, punct: str) -> bool:
        if self.kind == "punct" and self.value == punct:
            self.next()
            return True
        return False

    def opens(self, punct: str) -> bool:
        return self.kind == "punct" and self.value == punct

    def elements(self) -> Iterator[None]:
        """Stops at every element of an array; whoever takes it reads it before going on."""
        self.next()
        while not self.take("]"):
            yield
            if not self.take(",") and not self.opens("]"):
                raise LiteralError("array")

    def entries(self) -> Iterator[str]:
        """The keys of an object; whoever takes one reads its value before going on."""
        self.next()
        while not self.take("}"):
            if self.kind not in ("string", "word", "number"):
                raise LiteralError("key")
            key = _text(self.value) if self.kind == "string" else self.value
            if key == "__proto__":
                raise LiteralError("key")
            self.next()
            if not self.take(":"):
                raise LiteralError("computed key or call")
            yield key
            if not self.take(",") and not self.opens("}"):
                raise LiteralError("object")

    def read(self, depth: int = 0):
        if depth > DEEPEST:
            raise LiteralError("nested too deeply")
        kind, value = self.kind, self.value
        if kind == "string":
            self.next()
            return _text(value)
        if kind == "number":
            self.next()
            return _number(value)
        if kind == "word" and value in _WORDS:
            self.next()
            return _WORDS[value]
        if self.opens("["):
            return [self.read(depth + 1) for _ in self.elements()]
        if self.opens("{"):
            return {key: self.read(depth + 1) for key in self.entries()}
        raise LiteralError("not a literal")


def parse(text: str):
    """The value of a text that is one literal; anything else is a :class:`LiteralError`."""
    r = Reader(text, 0)
    value = r.read()
    if r.kind != "end":
        raise LiteralError("something follows")
    return value


def parse_at(text: str, at: int):
    """The value of the literal that starts at a place of a text; what follows it does not matter."""
    return Reader(text, at).read()


@F.pandas_udf(T.StringType())
def as_json(text: pd.Series) -> pd.Series:
    """Literals as JSON texts; null for what is not one literal and nothing else."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(parse(t))
        except LiteralError:
            return None

    return text.map(one)
