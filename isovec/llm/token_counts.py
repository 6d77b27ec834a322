"""Token counts (operator 3) with overlap resynchronisation.

The tokenizer is byte-level BPE whose pre-tokens never hold white space after
another character. A place with a single space between two characters that are
no white space is therefore a **stable boundary**: a pre-token ends before the
space, whatever stands further left, and what follows depends only on the text
from the space on; look-ahead past white space stays within its own side. So is
the place between a line feed and a letter or digit, to which only a space could
be joined, and that between a letter or digit and a symbol, since runs of either
hold nothing else (an apostrophe before letters begins a pre-token of its own).
No added token spans such a place: those that hold a space or a line feed are
refused, and a symbol that an added token holds makes no boundary.

* A text of up to ``HUGE`` characters is cut at its single spaces; the units
  are encoded by the tokenizers library and remembered (``units.Memo``). Chunks
  and splices are for huge documents, where they bound memory.
* A longer text is encoded in chunks of ``CHUNK`` characters that overlap by
  ``OVERLAP``, with offsets. In each overlap a stable boundary at which both
  encodings have a token boundary is sought; tokens before it are taken from the
  left chunk, those from it on from the right one. Where there is none, the
  overlap doubles, in the end to one chunk that holds both; a chunk without any such
  place grows fourfold at a time, so that a text without any boundary costs a few times its encoding as a whole.

Memory is bounded by a chunk's encoding, unless a text offers no stable boundary.

Edge cases: a null text counts as empty, with 0 bytes and 0 tokens; repeated
rows get equal counts; an empty table gives an empty result; further columns of
the input, also of clashing names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Isolated
from .units import Memo, encode_units

HUGE = 32_768
CHUNK = 8_192
OVERLAP = 256
LIMIT_TOKENS = 512

_DOUBLE = re.compile(r"\s\s")
_STABLE = re.compile(r"(?<=\S) (?=\S)")
_PLACES = re.compile(r"(?<=\S)(?= \S)|(?<=\n)(?=[^\W_])|(?<=[^\W_])(?=[^\w\s])")


class Counter:
    def __init__(self, tokenizer: Tokenizer, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = tokenizer
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.first = Memo(lambda parts: map(len, tokenizer.encode_batch(parts, add_special_tokens=False)))
        self.after_space = Memo(self.counted)
        self.widened = 0
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in added for c in t):
            raise ValueError("an added token holds white space")
        self.within = {c for t in added for c in t}

    def counted(self, parts: list[str]) -> list[int]:
        """Tokens of each part after a space. Parts without outer white space have stable boundaries between them."""
        inner = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        found = {p: len(ids) // 4 for p, ids in zip(inner, encode_units(self.tokenizer, inner, " "), strict=True)}
        rest = [p for p in parts if p not in found]
        found |= zip(rest, map(len, self.tokenizer.encode_batch([" " + p for p in rest], add_special_tokens=False)), strict=True)
        return [found[p] for p in parts]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.huge:
            return self.spliced(text)
        # Without two white-space characters in a row, every inner space is a stable boundary.
        parts = text.split(" ") if _DOUBLE.search(text) is None else _STABLE.split(text)
        return (self.first.of(parts[:1])[0] if parts[0] else 0) + sum(self.after_space.of(parts[1:]))

    def starts(self, text: str, at: int, end: int) -> list[int]:
        """Where the tokens of ``text[at:end]`` start, in characters of ``text``."""
        return [at + a for a, _ in self.tokenizer.encode(text[at:end], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        total, begun, at, end = 0, 0, 0, min(len(text), self.chunk)
        left = self.starts(text, at, end)  # of the chunk from ``at``; tokens before ``begun`` are counted
        while end < len(text):
            places = self.places(text, max(at, begun), end)
            overlap = self.overlap
            while True:
                right_at = max(at, end - overlap)
                if right_at == at and not places:  # no overlap can serve: the chunk grows
                    self.widened += 1
                    end = min(len(text), end + max(self.chunk, 3 * (end - at)))
                    left = self.starts(text, at, end)
                    break
                if places and places[-1] > right_at:
                    right_end = min(len(text), end + max(self.chunk, end - at))
                    right = self.starts(text, right_at, right_end)
                    cut = self.common(places, left, right, max(right_at, begun))
                    if cut is not None:
                        total += sum(begun <= x < cut for x in left)
                        begun, left, at, end = cut, right, right_at, right_end
                        break
                    self.widened += 1
                    if right_at == at:  # the overlap reaches back to the chunk's start: it becomes one larger chunk
                        left, end = right, right_end
                        break
                elif right_at == at:
                    places = []
                    continue
                overlap *= 2
        return total + sum(x >= begun for x in left)

    def places(self, text: str, low: int, high: int) -> list[int]:
        """The stable boundaries of which the characters on both sides lie between ``low`` and ``high``."""
        return [p for m in _PLACES.finditer(text, low + 1, high - 1) if text[p := m.start()] not in self.within]

    def common(self, places: list[int], left: list[int], right: list[int], low: int) -> int | None:
        """A place beyond ``low`` where tokens start in both encodings; of several, the middle one."""
        both = set(left).intersection(right)
        found = [p for p in places if p > low and p in both]
        return found[len(found) // 2] if found else None


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(Tokenizer.from_file(path))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    box = Isolated(docs)
    inner = box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()),
                 pa.array([c.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    found = inner.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
