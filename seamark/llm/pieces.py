"""Texts cut where no tokenizer of the known kinds looks across, and what workers remember of the pieces."""

from __future__ import annotations

import re
from collections.abc import Callable

#: The longest piece that is remembered.
MEMO_LENGTH = 40

#: A blank between characters that are no white space on its right and no blank on its left.
CUT = re.compile(r"(?<! ) (?=\S)")
#: A blank beside more white space: such texts need the pattern above.
WIDE = re.compile(r" \s")


def cut(text: str) -> list[str]:
    """Pieces of a text that begins with a blank: each begins with one, which is left out.

    A byte-level tokenizer's pattern takes a single blank into the word after
    it, and merges of a piece vocabulary never end in a blank after a letter, so
    that ids of a text are those of its pieces, each after a blank, in a row.
    """
    if not (text[1:2].isspace() or text[-1:] == " " or WIDE.search(text)):
        return text[1:].split(" ")
    first, *rest = CUT.split(text)
    return [first[1:], *rest] if first else rest


class Memo(dict):
    """What was made of pieces: the last ``size`` ones, and as many old ones that come back when they are asked for."""

    def __init__(self, make: Callable[[str], object], size: int):
        self.old: dict[str, object] = {}
        self.make, self.size = make, size

    def __missing__(self, piece: str):
        if (out := self.old.get(piece)) is None:
            out = self.make(piece)
        if len(piece) <= MEMO_LENGTH:
            self[piece] = out
            if len(self) >= self.size:
                self.aged()
        return out

    def aged(self) -> None:
        self.old = dict(self)
        self.clear()
