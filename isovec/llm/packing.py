"""Best-fit packing (operator 8) by a grouping genetic algorithm.

A document is its ids and one end id; longer ones are cut into pieces of
``CAPACITY``. Pieces go into sequences of at most that length, as few as can be.

The pieces are dealt into shards of about ``SHARD`` by hash. Every shard is
evolved by ``ISLANDS`` islands, each a task of its own with its own population.
Crossover injects whole well-filled bins of one parent into the other, removes
the other's bins that hold the same pieces and its emptiest ones. A bin then gives
up to two pieces for displaced ones that fill it better, and what is still
displaced is best-fitted, longest first. Children are born until none has gained
for ``STALLED`` generations, or none could: bins that best fit fills to ``FULL``
stay, and where it needs no more bins for the other pieces than the sum of their
lengths must have, it is the answer itself. After each epoch the islands' elites migrate around the ring of
their shard. Bins filled to ``FULL`` are final; the pieces of the others are
dealt and evolved anew with those of all shards, until one shard holds them or
most of them stay.

A piece's place needs its length alone, so no text or id list moves: an island
holds ``SHARD`` pairs of numbers, whatever the input.

Edge cases: a null or empty text is a document of the end id alone; very long
texts give many pieces, of which all but the last are full; of packings of equal
fitness the first found stays, of bins of equal room any; every row is a document,
also of a null or repeated id; an empty table gives an empty result;
further columns of the input, also of clashing names, are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import Isolated, keep, materialise
from .units import Memo, encode_units

CAPACITY = 4096
END = 1
SHARD = 20_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 12
#: Generations without a gain after which an island rests, and what counts as one in the mean square of the fill.
STALLED = 40
GAIN = 1e-4
#: Bins injected, and bins emptied, of those of a parent.
INJECTED = (0.04, 0.2)
EMPTIED = 0.04
#: Pieces of a bin that may be given for displaced ones at a time.
TRIED = 8
FULL = 0.999


#: Units, and words, that a worker remembers.
REMEMBERED = 250_000
#: Letters that lower-case to one letter each and that NFC leaves alone, before and after.
LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c not in "\xaa\xb5\xba\u0130")
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
PLAIN = re.compile(f"([{LETTERS}]+)([{re.escape(PUNCTUATION)}]*)")
#: What a tokenizer does to a text before its model sees a word, for which ``PLAIN`` units are cut right.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class Encoder:
    """Ids as bytes. No token spans white space, and a space or line feed ends
    every match of the pre-tokenizer, so texts are cut there.

    A ``PLAIN`` unit, letters and then punctuation, is two matches, whatever their
    case: the library's model gets the lower-case letters as they are, without the
    normalizer and the pre-tokenizer, which take most of the time. What else a unit
    holds, and every unit where those are not ``KNOWN_STEPS``, is left to the library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        inside = re.compile(f"[{re.escape(PUNCTUATION)}][{LETTERS}]|[^{LETTERS}{re.escape(PUNCTUATION)}]")
        self.cuts = (all(spec[k] == v for k, v in KNOWN_STEPS.items()) and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
                     and all(inside.search(t["content"]) for t in spec["added_tokens"]))  # none can stand in a plain unit
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {ord(c): level.pre_tokenize_str(c.lower())[0][0] for c in LETTERS}
        self.memo = Memo(self._encoded, REMEMBERED)
        self.words = Memo(self._modelled, REMEMBERED)
        self.others = Memo(lambda units: encode_units(self.tokenizer, units, " "), REMEMBERED)

    def _modelled(self, words: list[str]) -> Iterator[bytes]:
        model = self.tokenizer.model
        for word in words:
            ids = [t.id for t in model.tokenize(word)]
            yield struct.pack(f"<{len(ids)}I", *ids)

    def _encoded(self, units: list[str]) -> list[bytes]:
        if not self.cuts:
            return list(encode_units(self.tokenizer, units, " "))
        cut = [m.groups() if (m := PLAIN.fullmatch(u)) else ("", u) for u in units]
        begin = self.words.of([a.translate(self.bytes_of) for a, _ in cut])
        return [a + b for a, b in zip(begin, self.others.of([b for _, b in cut]), strict=True)]

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.memo.of((text or "").replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    return keep(("packing", path), lambda: Encoder(path))


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece."""
    box = Isolated(docs)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids, number, length, crc = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = e.encode(text) + end
                for k in range(0, len(own), 4 * CAPACITY):
                    part = own[k:k + 4 * CAPACITY]
                    ids.append(i)
                    number.append(k // (4 * CAPACITY))
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array([CAPACITY * k for k in number], pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["text"].alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Open:
    """Open bins by room left; the tightest that fits is found by a bit scan."""

    def __init__(self, room: np.ndarray):
        self.by_room: dict[int, list[int]] = {}
        self.bits = 0
        for b, r in enumerate(room.tolist()):
            self.put(b, r)
        self.count = len(room)

    def put(self, b: int, room: int) -> None:
        if room > 0:
            self.by_room.setdefault(room, []).append(b)
            self.bits |= 1 << room

    def best_fit(self, size: int) -> int:
        above = self.bits >> size
        if above:
            room = (above & -above).bit_length() - 1 + size
            held = self.by_room[room]
            b = held.pop()
            if not held:
                self.bits &= ~(1 << room)
        else:
            b, room = self.count, CAPACITY
            self.count += 1
        self.put(b, room - size)
        return b


def fill(sizes: np.ndarray, bins: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Best-fits the pieces of ``order`` (bin -1) beside those that have a bin from 0 on, gapless."""
    placed = bins >= 0
    used = np.bincount(bins[placed], sizes[placed], int(bins.max(initial=-1)) + 1).astype(np.int64)
    held, out = Open(CAPACITY - used), bins.copy()
    out[order] = [held.best_fit(s) for s in sizes[order].tolist()]
    return out


class Displaced:
    """Pieces without a bin, by length. The lengths that one of them has, and those that two
    have together, are the set bits of two numbers, so that the best fit is found by a bit scan."""

    def __init__(self, sizes: list[int], pieces: list[int]):
        self.sizes = sizes
        self.by_length: dict[int, list[int]] = {}
        self.add(pieces)

    def add(self, pieces: tuple | list) -> None:
        for p in pieces:
            self.by_length.setdefault(self.sizes[p], []).append(p)
        self.one, self.two = sum(1 << s for s in self.by_length), 0
        for s, held in self.by_length.items():
            self.two |= (self.one if len(held) > 1 else self.one & ~(1 << s)) << s

    def longest(self, above: int, most: int) -> tuple[int, ...] | None:
        """The lengths of one or two pieces that together are longest, if over ``above``, and at most ``most``."""
        mask = (1 << most + 1) - 1
        one, two = (self.one & mask).bit_length() - 1, (self.two & mask).bit_length() - 1
        if max(one, two) <= above:
            return None
        if one >= two:
            return (one,)
        return next((s, two - s) for s, held in self.by_length.items() if two - s in self.by_length and (two != 2 * s or len(held) > 1))

    def take(self, lengths: tuple[int, ...]) -> list[int]:
        out = []
        for s in lengths:
            out.append(self.by_length[s].pop())
            if not self.by_length[s]:
                del self.by_length[s]
        return out


def insert(sizes: list[int], bins: list[list[int]], pieces: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Puts displaced pieces into bins. First each bin in turn gives up to two of its pieces for one
    or two displaced ones that fill it better; what is left is best-fitted, longest first."""
    held = Displaced(sizes, pieces)
    used = [sum(sizes[p] for p in b) for b in bins]
    for k in rng.permutation(len(bins)).tolist():
        room, own = CAPACITY - used[k], bins[k]
        if not room or not held.by_length:
            continue
        some = own if len(own) <= TRIED else [own[i] for i in rng.choice(len(own), TRIED, replace=False)]
        gain, swap = 0, None
        for out in [(), *((p,) for p in some), *((p, q) for i, p in enumerate(some) for q in some[:i])]:
            size = sum(sizes[p] for p in out)
            if gain == room:
                break
            got = held.longest(size + gain, size + room)
            if got:
                gain, swap = sum(got) - size, (out, got)
        if swap:
            bins[k] = [p for p in own if p not in swap[0]] + held.take(swap[1])
            held.add(swap[0])
            used[k] += gain
    held_open = Open(CAPACITY - np.array(used, np.int64))
    for p in sorted((p for some in held.by_length.values() for p in some), key=lambda p: -sizes[p]):
        b = held_open.best_fit(sizes[p])
        if b == len(bins):
            bins.append([])
        bins[b].append(p)
    return bins


def fitness(sizes: list[int], bins: list[list[int]]) -> tuple[int, float]:
    """Fewer bins first, then uneven ones: the mean square of their fill."""
    used = [sum(sizes[p] for p in b) / CAPACITY for b in bins]
    return -len(bins), sum(x * x for x in used) / max(1, len(used))


def cross(sizes: list[int], into: list[list[int]], of: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of one parent are injected whole; the other's bins that share a piece with them go, and so do its emptiest."""
    used = np.array([sum(sizes[p] for p in b) for b in of])
    good = np.flatnonzero(used >= np.median(used))
    count = max(1, int(len(of) * rng.uniform(*INJECTED)))
    chosen = rng.choice(good, min(count, len(good)), replace=False).tolist()
    injected = {p for k in chosen for p in of[k]}
    fills = np.array([sum(sizes[p] for p in b) for b in into]) * rng.uniform(0.9, 1, len(into))
    emptied = set(np.argsort(fills, kind="stable")[:max(2, int(len(into) * EMPTIED))].tolist())
    bins, displaced = [list(of[k]) for k in chosen], []
    for k, b in enumerate(into):
        if k in emptied or not injected.isdisjoint(b):
            displaced += [p for p in b if p not in injected]
        else:
            bins.append(list(b))
    return insert(sizes, bins, displaced, rng)


def least_bins(lengths: np.ndarray) -> int:
    """No packing has fewer: by the sum of lengths, and by pieces of which no two share a bin."""
    return max(-(-int(lengths.sum()) // CAPACITY), int(np.count_nonzero(2 * lengths > CAPACITY)))


def _listed(bins: np.ndarray) -> list[list[int]]:
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)] if len(bins) else []


def evolve(lengths: np.ndarray, known: list[np.ndarray], seed: int) -> np.ndarray:
    """A bin from 0 on for every piece. The bins that best fit fills to ``FULL`` stay, the same on every
    island; the pieces of the others are searched unless they are in as few bins as must be."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    first = fill(lengths, np.full(len(lengths), -1, np.int64), np.argsort(-lengths, kind="stable"))
    full = np.bincount(first, lengths) >= FULL * CAPACITY
    core = ~full[first]
    out = np.empty(len(lengths), np.int64)
    out[~core] = (np.cumsum(full) - 1)[first[~core]]
    if core.any():
        held = [np.unique(x[core], return_inverse=True)[1] for x in known or [first]]
        out[core] = int(full.sum()) + search(lengths[core], held, seed)
    return out


def search(lengths: np.ndarray, known: list[np.ndarray], seed: int) -> np.ndarray:
    """The fittest packing that an island finds from those that are known."""
    rng = np.random.default_rng(seed)
    least = least_bins(lengths)
    for x in known:
        if int(x.max()) + 1 <= least:
            return x
    none = np.full(len(lengths), -1, np.int64)
    sizes = lengths.tolist()
    living = [_listed(x) for x in known]
    while len(living) < POPULATION:
        order = np.argsort(-lengths * rng.uniform(0.8, 1, len(sizes)), kind="stable")
        living.append(_listed(fill(lengths, none, order)))
    ranked = sorted(((fitness(sizes, x), -k, x) for k, x in enumerate(living)), reverse=True)
    born = stalled = 0
    while stalled < STALLED and -ranked[0][0][0] > least:
        a, b = rng.choice(len(ranked), 2, replace=False).tolist()
        child = cross(sizes, ranked[a][2], ranked[b][2], rng)
        found, best = fitness(sizes, child), ranked[0][0]
        born += 1
        stalled = 0 if found[0] > best[0] or found[0] == best[0] and found[1] > best[1] + GAIN else stalled + 1
        if all(found != x[0] for x in ranked):  # of equal ones the first stays
            ranked = sorted([*ranked, (found, -POPULATION - born, child)], reverse=True)[:POPULATION]
    out = np.empty(len(sizes), np.int64)
    for k, b in enumerate(ranked[0][2]):
        out[b] = k
    return out


STATE = "shard long, island int, uid long, length long, bin long, n_bins long, fitness double"


def _epoch(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("uid", kind="stable")
    sizes = frame["length"].to_numpy(np.int64)
    known = [x for x in (frame["mine"].to_numpy(np.int64), frame["theirs"].to_numpy(np.int64)) if (x >= 0).all()]
    shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
    bins = evolve(sizes, known, shard * ISLANDS + island + 1)
    used = np.bincount(bins, sizes) / CAPACITY
    count, quality = -len(used), float(np.mean(used ** 2))
    return pd.DataFrame({"shard": frame["shard"], "island": frame["island"], "uid": frame["uid"], "length": sizes, "bin": bins,
                         "n_bins": -count, "fitness": quality})


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    """Each piece's offset in its bin, and how full the bin is."""
    frame = frame.sort_values(["bin", "uid"], kind="stable")
    ends = frame.groupby("bin")["length"].cumsum()
    return frame.assign(offset=ends - frame["length"], used=frame.groupby("bin")["length"].transform("sum"))[
        ["shard", "bin", "uid", "length", "offset", "used"]]


def _level(items: DataFrame, shards: int, level: int) -> DataFrame:
    """``shard``, ``bin``, ``uid``, ``length``, ``offset``, ``used`` of the best island of every shard."""
    dealt = items.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"), "uid", "length")
    state = dealt.select("shard", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), "uid", "length",
                         F.lit(-1).cast("long").alias("mine"), F.lit(-1).cast("long").alias("theirs"))
    for epoch in range(EPOCHS):
        ended = materialise(state.groupBy("shard", "island").applyInPandas(_epoch, STATE), "packing-islands")
        came = ended.select(F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "uid", F.col("bin").alias("theirs"))
        state = ended.withColumnRenamed("bin", "mine").join(came, ["island", "uid"]).select("shard", "island", "uid", "length", "mine", "theirs")
    best = (ended.groupBy("shard", "island").agg(F.first("n_bins").alias("n"), F.first("fitness").alias("f"))
            .groupBy("shard").agg(F.min(F.struct("n", -F.col("f"), "island")).alias("best")).select("shard", F.col("best.island").alias("island")))
    chosen = ended.join(best, ["shard", "island"]).select("shard", "bin", "uid", "length")
    return materialise(chosen.groupBy("shard").applyInPandas(_settled, "shard long, bin long, uid long, length long, offset long, used long"),
                       "packing-level")


def pack_pieces(items: DataFrame) -> DataFrame:
    """From ``uid`` (unique), ``length`` to ``uid``, ``sequence_id``, ``offset``."""
    placed, level = None, 0
    left, count = items.select("uid", "length"), items.count()
    while True:
        shards = max(1, -(-count // SHARD))
        done = _level(left, shards, level)
        loose = done.where(F.col("used") < FULL * CAPACITY)
        remain = loose.count() if shards > 1 else 0
        last = remain == 0 or remain > count // 2
        own = (done if last else done.where(F.col("used") >= FULL * CAPACITY)).select(
            "uid", (F.lit(level << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        placed = own if placed is None else placed.union(own)
        if last:
            return placed
        left, count, level = loose.select("uid", "length"), remain, level + 1


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    cut = materialise(pieces(docs, path).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    return cut.join(pack_pieces(cut), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
