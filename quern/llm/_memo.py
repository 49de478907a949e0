"""Bounded memories of what a tokenizer makes of a piece of text."""

from __future__ import annotations

import re
import weakref

_SPACE = re.compile(r"[^\S \n]").search


_every: weakref.WeakSet = weakref.WeakSet()


def forget() -> None:
    """Empties the memories of this worker, which Spark may give to another operator's tasks after a tokenizer's."""
    for memo in list(_every):
        memo.clear()
        memo.old = {}


class Memo(dict):
    """Key -> make(key), in two generations of at most limit entries.

    When the young one is full it becomes the old one; what is asked for again
    moves back. Frequent keys so stay, at a cost of two dict operations a
    generation, and memory is bounded whatever the corpus.
    """

    __hash__ = object.__hash__

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}
        _every.add(self)

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def chunks(text: str) -> list[str] | None:
    """The text cut before each single space and newline, or None where white space is not as simple as that.

    The first chunk is marked by a carriage return; later ones begin with a
    newline or stand for the chunk after a space. The simple case has no other
    white space, no two such characters in a row and none at the end.
    """
    if any(c in text for c in "\t\r\x0b\x0c") if text.isascii() else _SPACE(text):
        return None
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = "\r" + parts[0]
    return None if "" in parts or "\n" in parts else parts


def chunk_text(chunk: str) -> str:
    return chunk[1:] if chunk[0] == "\r" else chunk if chunk[0] == "\n" else " " + chunk
