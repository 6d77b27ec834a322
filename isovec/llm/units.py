"""A memo of what a tokenizer makes of short units of text.

Natural text repeats its words, so that a unit is encoded once a worker and then
looked up. Which cuts into units are exact depends on the tokenizer and is
stated, with the reason, where a text is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
from tokenizers import Tokenizer

#: Units held by a worker; a full memo is emptied, which costs time and changes no result.
LIMIT = 1_000_000
#: Longer units are encoded afresh, so that a memo's memory is bounded.
LONGEST = 64
#: Units that are encoded in one call; a call costs as much as many units.
TOGETHER = 512


def encode_units(tokenizer: Tokenizer, units: list[str], mark: str) -> Iterator[bytes]:
    """The ids, as little-endian 32-bit integers, of each unit with ``mark`` before it.

    The units stand in one string, and its tokens are told apart by where they
    start. The caller answers for it that no token spans a ``mark`` with units on
    both sides.
    """
    for at in range(0, len(units), TOGETHER):
        own = units[at:at + TOGETHER]
        made = tokenizer.encode("".join([mark + u for u in own]), add_special_tokens=False)
        starts = np.array([a for a, _ in made.offsets], np.int64)
        ids = np.array(made.ids, "<u4")
        ends = np.searchsorted(starts, np.cumsum([len(mark) + len(u) for u in own]))
        begin = 0
        for end in ends.tolist():
            yield ids[begin:end].tobytes()
            begin = end


class Memo(dict):
    def __init__(self, encode: Callable[[list[str]], Iterable[Any]], limit: int = LIMIT):
        self.encode = encode
        self.limit = limit

    def of(self, parts: list[str]) -> list[Any]:
        """What the units become, in order."""
        try:
            return list(map(self.__getitem__, parts))
        except KeyError:
            pass
        missing = [p for p in set(parts) if p not in self]
        made = dict(zip(missing, self.encode(missing), strict=True))
        out = [made[p] if p in made else self[p] for p in parts]
        if len(self) + len(made) > self.limit:
            self.clear()
        self.update((p, v) for p, v in made.items() if len(p) <= LONGEST)
        return out
