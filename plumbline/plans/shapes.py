"""Queries that differ in their literals alone have one tree: it is made once, and the literals are put into what was read off it.

A shape is a query's text with its numbers and strings left out, and which of them are equal. Its tree is made with marks in their
place. Texts that are no plain case (comments, quoted names, other than ASCII, literals that are no values, such as quoted
aliases, and texts that can't be parsed) have no shape and are read one by one."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Sequence
from typing import Any

from .sqltree import Node, Parser, SqlError, tokens

#: What lies before a literal, and the literal, cut as the parser's tokens are.
_PART = re.compile(r"((?:[^\W\d]\w*+|[^'\d.\w]++|\.(?!\d))*+)('(?:[^']|'')*'|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)")
_OTHER = re.compile(r"[\"`\[\x01]|--|/\*")
_END = " ''"
_MARK = re.compile("\x01(\\d+)\x01")
#: Shapes and single texts that are kept by a worker at most.
MOST = 20_000

Shape = tuple[tuple[str, ...], tuple[int, ...], tuple[bool, ...]]


def shape(*texts: str | None) -> tuple[list[tuple[str, ...]], tuple[int, ...], list[str]] | None:
    """What lies between the literals of each text, the number of each literal's first equal one, and the distinct literals; None for no plain case."""
    between, at, order = [], [], {}
    for text in texts:
        if not text or not text.isascii() or _OTHER.search(text):
            return None
        whole = text + _END
        found = _PART.findall(whole)
        if sum(len(p) + len(x) for p, x in found) != len(whole) or found[-1][1] != "''":
            return None
        between.append(tuple(p for p, _ in found))
        at += [order.setdefault(x, len(order)) for _, x in found[:-1]]
    return between, tuple(at), list(order)


def marked(between: Sequence[str], at: Sequence[int], literals: Sequence[str]) -> Node | None:
    """The tree of a shape, with marks for literals; None if it can't be parsed or a literal is not a value of its own."""
    try:
        row = []
        for i, piece in enumerate(between):
            row += tokens(piece)
            if i < len(at):
                text = literals[at[i]]
                row.append(("str", f"'\x01{at[i]}\x01'") if text[0] == "'" else ("num", f"\x01{at[i]}\x01"))
        parser = Parser(row)
        tree = parser.statement()
        return tree if parser.values == len(at) else None
    except (SqlError, RecursionError):
        return None


class Filled:
    """A text with marks, cut at them."""

    def __init__(self, text: str) -> None:
        self.parts = _MARK.split(text)
        self.at = [int(x) for x in self.parts[1::2]]

    def __call__(self, literals: Sequence[str]) -> str:
        if not self.at:
            return self.parts[0]
        out = self.parts.copy()
        out[1::2] = [literals[i] for i in self.at]
        return "".join(out)


def bare(literals: Sequence[str]) -> list[str]:
    """Literals as they stand for marks: strings without their outer quotes, which the marks keep."""
    return [x[1:-1] if x[0] == "'" else x for x in literals]


class Memo:
    """Values by key, of which a worker keeps MOST at most."""

    def __init__(self) -> None:
        self.known: dict[Hashable, Any] = {}

    def __call__(self, key: Hashable, make: Callable[[], Any]) -> Any:
        if key in self.known:
            return self.known[key]
        if len(self.known) >= MOST:
            self.known.clear()
        value = self.known[key] = make()
        return value
