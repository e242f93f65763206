"""Reading and printing EDN: the text form of queries, patterns, transactions and database values.

Vectors are Python lists, lists are ``Seq``, sets are frozensets, maps are dicts; keywords and symbols are their own types.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import uuid
from collections.abc import Callable
from typing import Any


class Keyword(str):
    """``:ns/name``; the string has the colon."""

    __slots__ = ()

    def __new__(cls, name: str) -> Keyword:
        return super().__new__(cls, name if name.startswith(":") else f":{name}")

    def __repr__(self) -> str:
        return str(self)

    def __hash__(self) -> int:
        return hash((":kw", str(self)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Keyword) and str.__eq__(self, other)

    def __ne__(self, other: object) -> bool:
        return not self == other

    def __reduce__(self) -> tuple:
        return Keyword, (str(self),)

    @property
    def namespace(self) -> str | None:
        return self[1:].rpartition("/")[0] or None

    @property
    def name(self) -> str:
        return self[1:].rpartition("/")[2]


class Symbol(str):
    __slots__ = ()

    def __repr__(self) -> str:
        return str(self)

    def __hash__(self) -> int:
        return hash((":sym", str(self)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Symbol) and str.__eq__(self, other)

    def __ne__(self, other: object) -> bool:
        return not self == other

    def __reduce__(self) -> tuple:
        return Symbol, (str(self),)


class Seq(tuple):
    """A list in parentheses."""

    __slots__ = ()


class Regex(str):
    __slots__ = ()


class EdnError(ValueError):
    pass


SPACE = " \t\r\n,"
STOP = SPACE + "()[]{}\";"
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", '"': '"'}
CHARACTERS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r", "backspace": "\b", "formfeed": "\f"}
INTEGER, FLOAT, RATIO = re.compile(r"[+-]?\d+N?"), re.compile(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?"), re.compile(r"([+-]?\d+)/(\d+)")


class Reader:
    def __init__(self, text: str, tags: dict[str, Callable[[Any], Any]] | None = None) -> None:
        self.text, self.at = text, 0
        self.tags = {"inst": lambda s: dt.datetime.fromisoformat(s.replace("Z", "+00:00")), "uuid": uuid.UUID} | (tags or {})

    def blank(self) -> None:
        text, n = self.text, len(self.text)
        while self.at < n:
            if text[self.at] in SPACE:
                self.at += 1
            elif text[self.at] == ";":
                self.at = n if (end := text.find("\n", self.at)) < 0 else end
            elif text.startswith("#_", self.at):
                self.at += 2
                self.read()
            else:
                return

    def until(self, close: str) -> list:
        out = []
        while True:
            self.blank()
            if self.at >= len(self.text):
                raise EdnError(f"EOF while reading, expected {close}")
            if self.text[self.at] == close:
                self.at += 1
                return out
            out.append(self.read())

    def read(self) -> Any:
        self.blank()
        if self.at >= len(self.text):
            raise EdnError("EOF while reading")
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            return Seq(self.until(")"))
        if c == "[":
            return self.until("]")
        if c == "{":
            own = self.until("}")
            if len(own) % 2:
                raise EdnError("Map literal must contain an even number of forms")
            return {frozen(k): v for k, v in zip(own[::2], own[1::2], strict=True)}
        if c == '"':
            return self.string()
        if c in ")]}":
            raise EdnError(f"Unmatched delimiter: {c}")
        if c == "\\":
            word = self.word() or self.text[self.at - 1]
            return CHARACTERS.get(word, word)
        if c == "'":
            return self.read()
        if c == "#":
            return self.dispatch()
        self.at -= 1
        return atom(self.word())

    def dispatch(self) -> Any:
        c = self.text[self.at]
        if c == "{":
            self.at += 1
            return frozenset(map(frozen, self.until("}")))
        if c == '"':
            self.at += 1
            end = self.at
            while self.text[end] != '"' or self.text[end - 1] == "\\":
                end += 1
            found, self.at = self.text[self.at : end], end + 1
            return Regex(found)
        if c == "#":
            self.at += 1
            return {"Inf": math.inf, "-Inf": -math.inf, "NaN": math.nan}[self.word()]
        tag = self.word()
        value = self.read()
        if tag not in self.tags:
            raise EdnError(f"No reader function for tag {tag}")
        return self.tags[tag](value)

    def string(self) -> str:
        out = []
        while True:
            if self.at >= len(self.text):
                raise EdnError("EOF while reading string")
            c = self.text[self.at]
            self.at += 1
            if c == '"':
                return "".join(out)
            if c == "\\":
                c = self.text[self.at]
                self.at += 1
                if c == "u":
                    out.append(chr(int(self.text[self.at : self.at + 4], 16)))
                    self.at += 4
                else:
                    out.append(ESCAPES[c])
            else:
                out.append(c)

    def word(self) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in STOP:
            self.at += 1
        return self.text[start : self.at]


def atom(word: str) -> Any:
    if word in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[word]
    if word[0] == ":":
        return Keyword(word)
    if INTEGER.fullmatch(word):
        return int(word.rstrip("N"))
    if m := RATIO.fullmatch(word):
        return int(m[1]) / int(m[2])
    if FLOAT.fullmatch(word):
        return float(word.rstrip("M"))
    return Symbol(word)


def frozen(value: Any) -> Any:
    """A hashable form."""
    if isinstance(value, list):
        return tuple(map(frozen, value))
    if isinstance(value, dict):
        return frozenset((k, frozen(v)) for k, v in value.items())
    return value


def read_string(text: str, tags: dict[str, Callable[[Any], Any]] | None = None) -> Any:
    return Reader(text, tags).read()


def pr_str(value: Any) -> str:
    """The text that reads back as the value."""
    if value is None:
        return "nil"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Keyword | Symbol):
        return str(value)
    if isinstance(value, Regex):
        return f'#"{value}"'
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(value, float):
        if math.isnan(value):
            return "##NaN"
        return repr(value) if math.isfinite(value) else "##Inf" if value > 0 else "##-Inf"
    if isinstance(value, Seq):
        return "(" + " ".join(map(pr_str, value)) + ")"
    if isinstance(value, list | tuple):
        return "[" + " ".join(map(pr_str, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{pr_str(k)} {pr_str(v)}" for k, v in value.items()) + "}"
    if isinstance(value, set | frozenset):
        return "#{" + " ".join(sorted(map(pr_str, value))) + "}"
    if isinstance(value, uuid.UUID):
        return f'#uuid "{value}"'
    if isinstance(value, dt.datetime):
        return f'#inst "{value.isoformat()}"'
    return str(value)
