"""The split of texts before byte-level merges."""

from __future__ import annotations

import re

import regex

#: The public split. A fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"  # of the first 256 characters
LATIN = re.compile(f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+").findall


class Splitter:
    """Pieces of a text by a pattern; texts of the first 256 characters take a faster equal of the public one."""

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern).findall
        self.quick = pattern == BYTE_LEVEL

    def __call__(self, text: str) -> list[str]:
        if self.quick:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any(text)
            return LATIN(text)
        return self.any(text)


class Remembered(dict):
    """Ids of pieces, in two generations of at most ``most`` pieces: a full one becomes the old one, and what is met again is taken over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, pieces: set[str]) -> list[str]:
        """Of the pieces those that neither generation has; the others are in the young one afterwards."""
        new = pieces.difference(self)
        if len(self) + len(new) > self.most:
            self.old = dict(self)
            self.clear()
            new = pieces
        again = [p for p in new if p in self.old]
        self.update((p, self.old[p]) for p in again)
        return list(new.difference(again))
