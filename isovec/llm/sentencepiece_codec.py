"""SentencePiece encoding and decoding (operator 1) on the tokenizers library.

The model's protobuf is parsed here, without generated classes. From it are
rebuilt: the normaliser (compiled character map, removal of extra white space),
the metaspace marker and its prefix, the vocabulary with its scores (unigram
models) or the merges that the scores imply (BPE models), and byte fallback.

If no piece of the vocabulary has the marker after another character, no token can
span such a place, whatever the order of merges or the best path: a text is then cut
before each marker that follows another character. The units that a worker does not
remember are put together, up to ``TOGETHER`` a string, and encoded by one
multithreaded call a batch. The first token of a unit is the only one that begins
with the marker, which tells the units' tokens apart; a string in which the two
numbers differ is encoded unit by unit. Texts of other models are encoded whole.

``round_trip`` compares the text that all its ids decode to, ``parity`` the ids with
those of the sentencepiece library, both for every whole text. Pieces that text
cannot give (control, unknown, unused) stand in a unigram vocabulary with a space
before them, which no normalised text holds. Of several best unigram paths of exactly
equal score the two libraries may take different ones; ``parity`` tells.

Edge cases: a null text counts as empty and has no ids; null ids decode to null; a
text of any length is encoded whole, in units; repeated rows get equal results; an
empty table gives an empty result; further columns of the input, also of clashing
names, are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import Isolated
from .units import LIMIT, LONGEST

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Units in a string, and characters of the texts that are encoded together.
TOGETHER = 512
BATCH_CHARS = 2_000_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The protobuf wire format: field numbers with integers or raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + n]
            at += n


class Spec(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    strip_extra: bool

    @property
    def plain(self) -> bool:
        return not self.charsmap and not self.strip_extra


def parse(data: bytes) -> Spec:
    pieces: list[tuple[str, float, int]] = []
    trainer: dict[int, int | bytes] = {}
    norm: dict[int, int | bytes] = {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            norm = dict(fields(value))
    return Spec(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), norm.get(2, b""),
                bool(norm.get(3, 1)), bool(norm.get(4, 1)))


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Each way to join two pieces to a third, best third first, as the scores order them."""
    usable = {p: i for i, (p, _, t) in enumerate(spec.pieces) if t in (NORMAL, USER_DEFINED)}
    ranked = sorted(((-spec.pieces[i][1], i, p) for p, i in usable.items() if len(p) > 1))
    return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]


def build(spec: Spec) -> Tokenizer:
    """The tokenizer with its normaliser and decoder."""
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p if t in (NORMAL, USER_DEFINED, BYTE) else f" {p}", s) for p, s, t in spec.pieces], unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=spec.pieces[spec.unk_id][0],
                           fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"a model of kind {spec.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.strip_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    steps += [normalizers.Prepend(MARKER)] * spec.dummy_prefix + [normalizers.Replace(" ", MARKER)]
    tokenizer = Tokenizer(model)
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(),
                                           *[decoders.Strip(" ", 1, 0)] * spec.dummy_prefix])
    return tokenizer


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.spec = parse(f.read())
        self.tokenizer = build(self.spec)
        self.bare = Tokenizer(self.tokenizer.model)  # for what is normalised already
        self.cuttable = not any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, _ in self.spec.pieces)
        self.begins = np.array([p.startswith(MARKER) for p, _, _ in self.spec.pieces])
        self.surface = [surface(p, t) for p, _, t in self.spec.pieces]
        self.memo: dict[str, bytes] = {}  # by what follows a unit's first marker

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.bare.encode_batch(texts, add_special_tokens=False)]

    def cut(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first marker, and what follows the marker of each unit."""
        if self.spec.plain and self.spec.dummy_prefix and text[0] != " " and text[-1] != " " and "  " not in text and MARKER not in text:
            return "", text.split(" ")
        first, *rest = re.split(f"(?<=[^{MARKER}])(?={MARKER})", self.tokenizer.normalizer.normalize_str(text))
        units = [u[1:] for u in rest]
        return ("", [first[1:], *units]) if first.startswith(MARKER) else (first, units)

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units, each without its first marker. An empty unit, or one of further markers, is no cut and stands alone."""
        joined = [u for u in units if u and u[0] != MARKER]
        groups = [joined[k:k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
        lone = [u for u in units if not u or u[0] == MARKER]
        made = self.ids([*(MARKER + MARKER.join(g) for g in groups), *(MARKER + u for u in lone)])
        found = dict(zip(lone, made[len(groups):], strict=True))
        for group, data in zip(groups, made, strict=False):
            starts = np.flatnonzero(self.begins[np.frombuffer(data, "<u4")])
            if len(starts) == len(group) and starts[0] == 0:
                at = [*(4 * starts).tolist(), len(data)]
                found |= {u: data[x:y] for u, x, y in zip(group, at, at[1:], strict=False)}
            else:
                found |= zip(group, self.ids([MARKER + u for u in group]), strict=True)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            size, end = 0, k
            while end < len(texts) and size < BATCH_CHARS:
                size += len(texts[end] or "")
                end += 1
            out += self._encode(texts[k:end])
            k = end
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuttable:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        units: list[str] = []
        heads: list[str] = []
        ends = []
        for t in texts:
            head, own = self.cut(t) if t else ("", [])
            heads.append(head)
            units += own
            ends.append(len(units))
        found = list(map(self.memo.get, units))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            made = self.learn(list(dict.fromkeys(units[i] for i in missing)))
            for i in missing:
                found[i] = made[units[i]]
            if len(self.memo) + len(made) > LIMIT:
                self.memo.clear()
            self.memo |= {u: x for u, x in made.items() if len(u) <= LONGEST}
        lead = dict(zip(known, self.ids(known), strict=True)) if (known := [h for h in dict.fromkeys(heads) if h]) else {}
        return [lead.get(h, b"") + b"".join(found[x:y]) for h, x, y in zip(heads, [0, *ends], ends, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """The text of all ids, in UTF-8."""
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data[1:] if self.spec.dummy_prefix and data[:1] == b" " else data


def surface(piece: str, kind: int) -> bytes:
    """What a piece adds to a decoded text."""
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    if kind == UNKNOWN:
        return " \u2047 ".encode()
    return b"" if kind == CONTROL else piece.replace(MARKER, " ").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (array of int)."""
    box = Isolated(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            own = c.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in own)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["text"].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """From ``doc_id``, ``ids`` to ``doc_id``, ``text``; null ids give null."""
    box = Isolated(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = iter(c.tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(texts) for x in ids], pa.string())],
                                             names=["doc_id", "text"])

    return box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["ids"].alias("ids")).mapInArrow(run, "doc_id long, text string")


def verify(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids_crc32``, ``round_trip``, ``parity``."""
    box = Isolated(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, lib = codec(path), library(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own = c.encode(texts)
            theirs = chain.from_iterable(lib.encode(texts[k:k + 256], num_threads=1) for k in range(0, len(texts), 256))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(x) // 4 for x in own], pa.int64()),
                pa.array([zlib.crc32(x) for x in own], pa.int64()),
                pa.array([t.encode() == c.decode(x) for t, x in zip(texts, own, strict=True)], pa.bool_()),
                pa.array([np.array(x, "<u4").tobytes() == y for x, y in zip(theirs, own, strict=True)], pa.bool_()),
            ], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"])

    return box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["text"].alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
