"""Fragments of texts that are looked at once each and remembered.

A tokenizer's work on a corpus is mostly the same words over and over.  Where a text can be cut for certain, its pieces
are looked up in a dictionary that makes what is missing, and all the rest is numpy over the pieces' codes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Fragments, and values made of them, that a worker remembers before it starts anew; only speed depends on them.
REMEMBERED, REMEMBERED_VALUES = 600_000, 16_000_000


class Flat:
    """Numbers one after the other that grow at their end."""

    def __init__(self, kind: type = np.int64, *first: int) -> None:
        self.held, self.n = np.zeros(1024, dtype=kind), 0
        self.extend(np.array(first, dtype=kind))

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            grown = np.zeros(max(2 * len(self.held), self.n + len(values)), dtype=self.held.dtype)
            grown[: self.n] = self.held[: self.n]
            self.held = grown
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Fragments(dict):
    """Codes of fragments; ``make`` gives the values of new ones, all in one, and how many each has."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = REMEMBERED) -> None:
        self.make, self.most = make, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.values_of_all, self.ends = Flat(), Flat(np.int64, 0)

    def full(self) -> bool:
        return len(self) > self.most or self.values_of_all.n > REMEMBERED_VALUES

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.new.append(piece)
        return code

    def codes(self, pieces: list[list[str]]) -> np.ndarray:
        """The codes of all pieces of all lists, in order."""
        self.new: list[str] = []
        n = sum(map(len, pieces))
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=n)
        if self.new:
            values, sizes = self.make(self.new)
            self.ends.extend(self.values_of_all.n + np.cumsum(sizes, dtype=np.int64))
            self.values_of_all.extend(values)
        return found

    def gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of these fragments in order, and how many each has."""
        return spread(self.values_of_all.all, self.ends.all, codes)


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists one after the other, and how many each has."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


def spread(values: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[ends[c]:ends[c + 1]]`` of all codes one after the other, and their sizes."""
    sizes = ends[codes + 1] - ends[codes]
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(ends[codes] - upto + sizes, sizes) + np.arange(total)], sizes


class BlankCuts:
    """Cuts texts before blanks where that is allowed after the character in front of them."""

    def __init__(self, allowed_after: Callable[[str], bool]) -> None:
        self.allowed_after = allowed_after
        self.known: dict[str, bool] = {}

    def _allowed(self, piece: str) -> bool:
        last = piece[-1:]
        if last not in self.known:
            self.known[last] = bool(last) and self.allowed_after(last)
        return self.known[last]

    def pieces(self, text: str) -> list[str]:
        """What lies between the cuts, each piece but the first without the blank that it starts with."""
        found = text.split(" ")
        allowed = self._allowed
        cuts = [allowed(p) for p in found]
        cuts[-1] = True
        if all(cuts):
            return found
        out, start = [], 0
        for k, cut in enumerate(cuts):
            if cut:
                out.append(" ".join(found[start : k + 1]))
                start = k + 1
        return out
