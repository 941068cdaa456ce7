"""Cutting texts where no pre-token of the byte-level BPE pattern can cross.

The pattern lets a pre-token start with one space and otherwise keeps white
space apart, so a cut in front of a space or line break is safe unless that
character has white space on both sides (or ends the text after white space).
"""

from __future__ import annotations

import re

FIRST, BREAK = "\x01", "\x00"  # marks of the first piece and of a piece that starts with a line break
_UNSAFE = re.compile(r"[\x00\x01]|\s[ \n](?:\s|\Z)")


def pieces(text: str) -> list[str] | None:
    """Marked pieces of a non-empty text, or None if a cut could be wrong.

    A piece without a mark stands for itself with one space in front.
    """
    flat = text.replace("\n", " ")
    if (not flat.isprintable() or "  " in flat) and _UNSAFE.search(text):
        return None
    return (FIRST + text).replace("\n", " " + BREAK).split(" ")


def unmarked(piece: str) -> str:
    """The text that a marked piece stands for."""
    if piece[:1] == FIRST:
        return piece[1:]
    if piece[:1] == BREAK:
        return "\n" + piece[1:]
    return " " + piece
